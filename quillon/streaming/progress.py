"""Progress of sessions (W2, W3): repeats, discoveries and the reason to stop, as a stream with keyed state and as a batch.

``Tracker`` holds a session's state and takes one action at a time.  The stream keeps it between batches as JSON; the batch twin runs it over
a session's actions in order.  A session ends after some 35 actions, so its state is small."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions.text import QUERY_STOPS

# Limits of repeats, of actions without progress and of all actions; new products that make a result set count; and how much
# evidence of each kind is credited.
REPEATS, IDLE, STEPS, NEW_PRODUCTS = 2, 4, 35, 3
CREDITED = {"result_set": 3, "product": 5, "subpage": 6}
PAGES = ("next >", "< prev")
PRODUCT = re.compile(r"\d{8,12}")
OUTPUT = "session string, step int, repeats int, idle int, result_sets int, products int, subpages int, reason string"


def canonical_action(name: str, argument: str) -> str:
    """An action as JSON with sorted keys; a search by its normal query."""
    if name == "search":
        argument = unicodedata.normalize("NFKC", argument).casefold().replace("人民币", "元").replace("块钱", "元")
        argument = re.sub(r"(?<=\d)\s*(?:rmb|cny|yuan)\b", "元", argument)
        argument = " ".join(re.sub(QUERY_STOPS, " ", argument).split())
    return json.dumps({"action": name, "argument": argument}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@dataclass
class Tracker:
    steps: int = 0
    repeats: int = 0
    idle: int = 0
    last: str | None = None
    shown: list[str] = field(default_factory=list)
    found: dict[str, list[str]] = field(default_factory=dict)
    credited: dict[str, int] = field(default_factory=dict)

    def _discover(self, kind: str, mark: str, counts: bool = True) -> bool:
        """Whether the mark is new and counts as progress; new marks are kept even if they don't count."""
        seen = self.found.setdefault(kind, [])
        if mark in seen:
            return False
        seen.append(mark)
        if counts and self.credited.get(kind, 0) < CREDITED.get(kind, 1 << 30):
            self.credited[kind] = self.credited.get(kind, 0) + 1
        return counts

    def act(self, name: str, argument: str, visible: list[str], page: str, options: dict[str, str]) -> str | None:
        """Takes an action and what was seen after it; the reason to stop, or None.  options: canonical axes and option texts."""
        name, argument = (name or "").strip().casefold(), (argument or "").strip().casefold()
        self.steps += 1
        mark = canonical_action(name, argument)
        self.repeats = self.repeats + 1 if mark == self.last else 0
        self.last = mark
        fresh = [v for v in dict.fromkeys(visible) if v not in self.shown]
        self.shown += fresh
        progress = False
        click = name == "click"
        if visible and (name == "search" or (click and argument in PAGES)):
            progress |= self._discover("result_set", "|".join(visible), len(fresh) >= NEW_PRODUCTS)
        if click and PRODUCT.fullmatch(argument):
            progress |= self._discover("product", argument)
        if click and page == "information_subpage" and visible:
            progress |= self._discover("subpage", f"{visible[0]}:{argument}")
        for axis, value in sorted((options or {}).items()) if visible else ():
            progress |= self._discover("option", f"{visible[0]}:{axis}:{value}")
        self.idle = 0 if progress else self.idle + 1
        if self.repeats >= REPEATS or self.idle >= IDLE:
            return "repeat_loop"
        return "max_steps" if self.steps >= STEPS else None

    def row(self, session: str, reason: str | None) -> tuple:
        have = self.credited.get
        return (session, self.steps, self.repeats, self.idle, have("result_set", 0), have("product", 0), have("subpage", 0), reason)


_COLUMNS = ["session", "step", "repeats", "idle", "result_sets", "products", "subpages", "reason"]


def _run(tracker: Tracker, session: str, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for r in rows.sort_values("pos").itertuples(index=False):
        reason = tracker.act(r.name, r.argument, list(r.visible) if r.visible is not None else [], r.page, dict(r.options) if r.options is not None else {})
        out.append(tracker.row(session, reason))
    return out


def progress(actions: DataFrame) -> DataFrame:
    """W2 as a batch: a row an action.  actions: session, pos, name, argument, visible (array<string>), page, options (map<string,string>)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_run(Tracker(), key[0], rows), columns=_COLUMNS)

    return actions.groupBy("session").applyInPandas(run, OUTPUT)


def progress_stream(actions: DataFrame) -> DataFrame:
    """W2 as a stream: the same rows as batches of actions come in; write it in append mode.  Inside a batch a session's actions go in
    order of pos; over batches, in the order that they came."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        tracker = Tracker(**json.loads(state.get[0])) if state.exists else Tracker()
        out = _run(tracker, key[0], pd.concat(held)) if held else []
        state.update((json.dumps(asdict(tracker)),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return actions.groupBy("session").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)
