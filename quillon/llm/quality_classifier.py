"""Quality classifier by co-training on two views of a document.

The text view holds the hashed words of the whole text and its shape (shares of capitals, symbols, digits, distinct
words and the like); the metadata view holds source, language and size.  Each view has a logistic classifier of its own,
fitted to labelled documents.  In every round both score all unlabelled documents, and each classifier hands the other
the ``grow`` documents of either label that it is surest of, as pseudo-labels; both are fitted again on what they have.
A part of the labelled documents is put aside from the start: on it each view's scores are calibrated by a logistic
curve, and the score of a document joins the views' calibrated log-odds, less the prior's, which both hold.

The fit runs on the driver over a bounded sample: at most ``MOST_LABELLED`` labelled documents, those with the smallest
hashes of their ids, and ``2 * grow`` pseudo-labelled ones a view and round.  The search for these covers all unlabelled
documents: each gets its odds in both views, which are written without texts, and only the chosen ones' features travel.
Tasks get tables of weights of fixed size.  The final scores are one pass without a shuffle.

Where a quarter of the labelled rows has not both labels, all of them serve for the fit and for the calibration.

Defined results: a null text counts as empty and null metadata as a value of its own, and both are scored like any other; documents
labelled by null or anything but 0 and 1 are unlabelled; with no labelled rows, or one label only, every score is that
label's share (0.5 without any); repeated rows are scored each for itself and count once as pseudo-labels; ties among sure documents go to the smaller
hash of the row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import written
from quillon.llm.words import mix, text_buffers, words_by_text

MOST_LABELLED, GROW, ROUNDS = 8000, 100, 3
BUCKETS = 1 << 16
_SHAPE = 12
_METADATA = 1 << 12
_PIECE = 1 << 20

#: Features of a document in a view: places and values.
Sparse = tuple[np.ndarray, np.ndarray]


@dataclass
class View:
    """weights: by place, place 0 the bias; slope and shift: of the calibrated log-odds."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: Sparse) -> float:
        return float(self.weights[0] + self.weights[x[0]] @ x[1])

    def calibrated(self, x: Sparse) -> float:
        return self.slope * self.odds(x) + self.shift


@dataclass
class Model:
    text: View
    metadata: View
    prior: float
    constant: float | None = None

    def scores(self, text: Sparse, metadata: Sparse) -> tuple[float, float, float]:
        """Chance of label 1 by the text, by the metadata, and by both."""
        if self.constant is not None:
            return (self.constant,) * 3
        a, b = self.text.calibrated(text), self.metadata.calibrated(metadata)
        return _chance(a), _chance(b), _chance(a + b - self.prior)


def _chance(odds: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def _counts(data: np.ndarray) -> np.ndarray:
    """How often each byte occurs, piece by piece."""
    out = np.zeros(256, np.int64)
    for at in range(0, len(data), _PIECE):
        out += np.bincount(data[at : at + _PIECE], minlength=256)
    return out


_CAPITAL, _SMALL, _DIGIT, _WHITE, _LINE, _SYMBOL, _SHOUT, _POINT = (np.isin(np.arange(256), list(s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\f\r", b"\n", b"#*$%&|<>=_{}[]", b"!?", b".,;:"))


def text_features(texts: pa.Array) -> Iterator[Sparse]:
    """Shape at the places 1 to _SHAPE, then a place for each distinct word's hash; word values share unit length."""
    data, offsets, _ = text_buffers(texts)
    for row, words in words_by_text(texts, True):
        of = _counts(data[offsets[row] : offsets[row + 1]])
        n, size = max(len(words), 1), max(int(of.sum()), 1)
        seen, times = np.unique(words, return_counts=True)
        share = lambda kind: of[kind].sum() / size
        shape = [np.log1p(len(words)) / 5, len(seen) / n, (times.max() if len(times) else 0) / n, (size - of[_WHITE].sum()) / n / 10, 3 * share(_CAPITAL), share(_SMALL), 5 * share(_DIGIT),
                 5 * share(_SYMBOL), 5 * share(_SHOUT), 5 * share(_POINT), 20 * share(_LINE), float(len(words) < 50)]
        places = np.unique((seen >> np.uint64(20)) % np.uint64(BUCKETS - _SHAPE - 1)).astype(np.int32) + _SHAPE + 1
        values = np.full(len(places), 1 / np.sqrt(max(len(places), 1)))
        yield np.concatenate([np.arange(1, _SHAPE + 1, dtype=np.int32), places]), np.concatenate([shape, values]).astype(np.float32)


def metadata_features(columns: list[list]) -> Iterator[Sparse]:
    """A place for each column's value, by a digest of column and whole value; a number counts by the half power of two that it lies in."""
    for values in zip(*columns, strict=True):
        marks = [f"{k}={round(2 * np.log2(1 + abs(v))) if isinstance(v, (int, float)) and np.isfinite(v) else v}" for k, v in enumerate(values)]
        hashes = np.array([int.from_bytes(blake2b(m.encode(), digest_size=8).digest(), "little") for m in marks], np.uint64)
        places = np.unique(mix(hashes) % np.uint64(_METADATA - 1)).astype(np.int32) + 1
        yield places, np.ones(len(places), np.float32)


# --- fitting -----------------------------------------------------------------------------------------------------


def _fit(rows: list[Sparse], y: np.ndarray, size: int, ridge: float, steps: int = 150) -> View:
    """Logistic regression with an L2 penalty, by full-batch Adam; both labels weigh the same in all."""
    w = np.zeros(size)
    at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    places = np.concatenate([p for p, _ in rows])
    values = np.concatenate([v for _, v in rows]).astype(float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v = np.zeros(size), np.zeros(size)
    for r in range(1, steps + 1):
        odds = w[0] + np.bincount(at, w[places] * values, len(rows))
        miss = weight * (y - 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        g = np.bincount(places, miss[at] * values, size) - ridge * w
        g[0] = miss.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    return View(w.astype(np.float32))


def _calibrate(view: View, rows: list[Sparse], y: np.ndarray) -> None:
    """slope and shift by a logistic fit; a slope below 0 says that the view knows nothing, and counts as 0."""
    odds = np.array([view.odds(x) for x in rows])
    x = np.stack([np.ones(len(odds)), odds], 1)
    b = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    start = b.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-1]), x.T @ (y - p) - np.array([0, 1e-1]) * b)
        b += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    if b[1] < 0:
        b = start
    view.shift, view.slope = float(b[0]), float(b[1])


def _views(batch: pa.RecordBatch) -> Iterator[tuple[Sparse, Sparse]]:
    """Of the columns id, text and the metadata."""
    return zip(text_features(batch.column(1)), metadata_features([c.to_pylist() for c in batch.columns[2:]]), strict=True)


def _surest(docs: DataFrame, known: DataFrame, model: Model, grow: int) -> list[tuple[int, int, Sparse, Sparse]]:
    """view, label and both views' features of the grow surest documents of each view and label, among those whose id
    known doesn't have.  Every document's odds go to a table without its text; features are made again for the chosen rows alone."""
    if grow < 1:
        return []
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["id"].dataType.simpleString()
    columns = [c for c in docs.columns if c != "mark"]

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            own = np.array([(held.text.calibrated(t), held.metadata.calibrated(m)) for t, m in _views(batch.select(columns))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["id", "mark", "odds0", "odds1"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_views(batch.select(columns)))
            lists = lambda view, part, kind: pa.array([r[view][part] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("mark"), lists(0, 0, pa.int32()), lists(0, 1, pa.float32()), lists(1, 0, pa.int32()), lists(1, 1, pa.float32())], names=["mark", "tp", "tv", "mp", "mv"])

    every = docs.mapInArrow(odds, f"id {kind}, mark bigint, odds0 double, odds1 double").join(known.select("id"), "id", "left_anti")
    every = written(every.groupBy("mark").agg(F.first("odds0").alias("odds0"), F.first("odds1").alias("odds1")), "odds")
    sure: list[tuple[int, int, int]] = []
    for view in (0, 1):
        for label in (0, 1):
            cost = -F.col(f"odds{view}") if label else F.col(f"odds{view}")
            top = every.select("mark", cost.alias("cost")).orderBy("cost", "mark").limit(grow).collect()
            sure += [(view, label, r.mark) for r in top if r.cost < 0]
    if not sure:
        return []
    chosen = docs.sparkSession.createDataFrame([(m,) for m in {m for _, _, m in sure}], "mark bigint")  # 4 * grow rows at most
    made = docs.join(F.broadcast(chosen), "mark").select(*docs.columns).mapInArrow(features, "mark bigint, tp array<int>, tv array<float>, mp array<int>, mv array<float>")
    found = {r.mark: ((np.array(r.tp, np.int32), np.array(r.tv, np.float32)), (np.array(r.mp, np.int32), np.array(r.mv, np.float32))) for r in made.dropDuplicates(["mark"]).collect()}
    return [(view, label, *found[m]) for view, label, m in sure]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars"), label_column: str = "quality", most_labelled: int = MOST_LABELLED, grow: int = GROW, rounds: int = ROUNDS) -> Model:
    """Labels from labels; pseudo-labels from all documents that labels doesn't have."""
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *[F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(metadata)])
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    got = plain.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), "id").select("id", "text", *[f"m{k}" for k in range(len(metadata))], "y").toArrow()  # most_labelled rows
    y = got["y"].to_numpy().astype(float)
    flat = View(np.zeros(1, np.float32))
    if not len(y) or y.min() == y.max():
        return Model(flat, flat, 0.0, float(y.mean()) if len(y) else 0.5)
    rows = [x for batch in got.drop_columns(["y"]).to_batches() for x in _views(batch)]
    aside = np.arange(len(rows)) % 4 == 0
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside[:] = False
    held = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    pools = [([rows[k][view] for k in np.flatnonzero(~aside)], y[~aside].tolist()) for view in (0, 1)]

    def fitted() -> Model:
        text, meta = (_fit(pool, np.array(own), size, ridge) for (pool, own), size, ridge in zip(pools, (BUCKETS, _METADATA), (1e-4, 1e-3), strict=True))
        _calibrate(text, [rows[k][0] for k in held], y[held])
        _calibrate(meta, [rows[k][1] for k in held], y[held])
        return Model(text, meta, float(np.log(y[held].sum() / (len(held) - y[held].sum()))))

    model = fitted()
    marked = plain.withColumn("mark", F.xxhash64(*plain.columns))
    for _ in range(rounds):
        sure = [r for r in _surest(marked, known, model, grow) if (model.text, model.metadata)[r[0]].slope > 0]
        if not sure:
            break
        for view, label, *x in sure:  # what one view is sure of teaches the other
            pools[1 - view][0].append(x[1 - view])
            pools[1 - view][1].append(float(label))
        model = fitted()
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """The id column, text_score, metadata_score and score (0 to 1, higher: label 1 likelier)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([sent.value.scores(t, m) for t, m in _views(batch)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, k]) for k in range(3)]], names=[id_column, "text_score", "metadata_score", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column), F.col(text_column), *[F.col(f"`{c}`").alias(f"m{k}") for k, c in enumerate(metadata)])
    return plain.mapInArrow(run, f"`{id_column}` {kind}, text_score double, metadata_score double, score double")
