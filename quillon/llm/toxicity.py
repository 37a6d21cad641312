"""Toxic spans by a linear-chain conditional random field.

A token is a run of ASCII letters and non-ASCII bytes; ASCII capitals count as small letters.  Its features are
the whole token and its first 3 to 7 bytes, hashed into one table of weights.  Token labels come from document labels: a
feature is toxic if documents that hold it are toxic far more often than chance allows, and a token of a toxic document is
labelled if one of its features is.  The field is fitted to these labels on stretches of the training
documents, which hold every token with a telling feature, ``REACH`` tokens around, and ``CLEAN_STRETCHES`` places of documents without any, by
penalised maximum likelihood: the gradient is what was seen less what forward-backward expects, of tokens and of pairs.  The label before a
stretch's or a text's first token is clean, in the fit and in scoring alike.  Its forward-backward marginals give each token's chance to be in a toxic span, tokens above one half are the offending
offsets, and a logistic fit on other training documents turns sums and maxima of marginals into the document's score.

The fit runs on the driver over a bounded sample: at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents of at most
``MOST_CHARS`` characters, those with the smallest hashes of their ids.  What tasks get is the table of weights, of fixed size.
Scoring is one pass without a shuffle.  The chain is exact for texts of any length: blocks of ``BLOCK`` tokens are
multiplied out side by side, then joined in order.

Defined results: a null, empty or tokenless text has no spans and the score of no evidence; repeated rows are scored each for
itself; with no labelled rows, or labels of one kind only, every score is that label's share (0.5 without any); labelled rows that are null are passed over;
other columns of the tables, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import PIECE, _piece_words, mix, shingles, text_buffers

MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 3000, 6000, 200_000
BLOCK = 64
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
MEASURES = 4
REACH, CLEAN_STRETCHES = 16, 3

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


@dataclass
class Model:
    """weights: of the toxic against the clean label by bucket, bucket 0 the bias; chain: log weights of label pairs
    [before][after], 1 toxic; fit: intercept and weights of the document's measures; constant: a score for all, if there was nothing to fit."""

    weights: np.ndarray
    chain: np.ndarray
    fit: np.ndarray
    constant: float | None = None


def _tokens(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, start, end): the buckets of every token's features, 0 where there is none."""
    whole, start, end, *parts = _piece_words(data, cuts, True, _BETWEEN, PREFIXES)
    hashes = np.stack([whole, *parts], axis=1) if len(whole) else np.zeros((0, 1 + len(PREFIXES)), np.uint64)
    buckets = (hashes >> np.uint64(20)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return np.where(hashes == 0, np.uint64(0), buckets).astype(np.int32), start, end


def _long_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one long text, cut between tokens."""
    found, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data) and not _BETWEEN[data[stop]]:
            stop += 1
        f, s, e = _tokens(data[at:stop], np.zeros(0, np.int64))
        found.append((f, s + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, features, start, end, bounds): texts together as far as PIECE goes; tokens bounds[k] to bounds[k + 1]
    are those of row first + k."""
    data, offsets, _ = text_buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        if offsets[row + 1] - offsets[row] > PIECE:
            own = data[offsets[row] : offsets[row + 1]]
            features, start, end = _long_tokens(own)
            yield row, own, features, start, end, np.array([0, len(start)])
            row += 1
            continue
        stop = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1))
        at = offsets[row : stop + 1] - offsets[row]
        own = data[offsets[row] : offsets[stop]]
        features, start, end = _tokens(own, at[1:-1])
        yield row, own, features, start, end, np.searchsorted(start, at)
        row = stop


def _forward_backward(e: np.ndarray, keep: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 at every place of many short chains, and how often each pair of labels is expected in all of them, the clean label
    before the first place included.  e (chains, places): evidence for label 1; keep: False past a chain's end."""
    step = np.exp(chain)
    n, length = e.shape
    weight = np.exp(np.clip(e, -60, 60))
    ahead = np.empty((length, n, 2))
    first = np.tile([1.0, 0.0], (n, 1))
    a = first
    for t in range(length):
        b = np.stack([a[:, 0] * step[0, 0] + a[:, 1] * step[1, 0], (a[:, 0] * step[0, 1] + a[:, 1] * step[1, 1]) * weight[:, t]], 1)
        b /= b.sum(1, keepdims=True)
        a = np.where(keep[:, t, None], b, a)
        ahead[t] = a
    out, pairs = np.empty((n, length)), np.zeros((2, 2))
    back = np.ones((n, 2))
    for t in range(length - 1, -1, -1):
        p = ahead[t] * back
        out[:, t] = p[:, 1] / p.sum(1)
        w = weight[:, t]
        on = keep[:, t]
        joint = (ahead[t - 1] if t else first)[on, :, None] * step * (np.stack([np.ones(n), w], 1) * back)[on, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = np.stack([step[0, 0] * back[:, 0] + step[0, 1] * w * back[:, 1], step[1, 0] * back[:, 0] + step[1, 1] * w * back[:, 1]], 1)
        b /= b.sum(1, keepdims=True)
        back = np.where(keep[:, t, None], b, back)
    return out, pairs


def marginals(evidence: np.ndarray, bounds: np.ndarray, chain: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Chance of label 1 at every token of many chains; chain k has the tokens bounds[k] to bounds[k + 1]."""
    lengths = np.diff(bounds)
    blocks = -(-lengths // block)
    n = int(blocks.sum())
    if not n:
        return np.zeros(0)
    first = np.cumsum(blocks) - blocks  # each chain's first block
    chain_of = np.repeat(np.arange(len(lengths)), blocks)
    place = np.arange(n) - first[chain_of]
    at = bounds[chain_of] + place * block
    size = np.minimum(block, bounds[chain_of + 1] - at)
    where = at[:, None] + np.arange(block)
    keep = np.arange(block) < size[:, None]
    weight = np.where(keep, np.exp(np.clip(evidence[np.where(keep, where, 0)], -60, 60)), 1.0)
    step = np.exp(chain)
    # A block as a matrix from the label before it to the label at its end.
    m = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    for t in range(block):
        nxt = m @ step
        nxt[:, :, 1] *= weight[:, t, None]
        nxt /= nxt.sum((1, 2), keepdims=True)
        m = np.where(keep[:, t, None, None], nxt, m)
    # What reaches each block from the left, and from the right; chains side by side, block by block.
    left = np.empty((n, 2))
    right = np.empty((n, 2))
    live = np.flatnonzero(blocks > 0)
    a = np.zeros((len(lengths), 2))
    a[:, 0] = 1  # before the first token the label is 0
    b = np.ones((len(lengths), 2))
    for k in range(int(blocks.max())):
        on = live[blocks[live] > k]
        own = first[on] + k
        left[own] = a[on]
        nxt = np.einsum("ni,nij->nj", a[on], m[own])
        a[on] = nxt / nxt.sum(1, keepdims=True)
        own = first[on] + blocks[on] - 1 - k
        right[own] = b[on]
        nxt = np.einsum("nij,nj->ni", m[own], b[on])
        b[on] = nxt / nxt.sum(1, keepdims=True)
    ahead = np.empty((block, n, 2))
    a = left
    for t in range(block):
        nxt = a @ step
        nxt[:, 1] *= weight[:, t]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(keep[:, t, None], nxt, a)
        ahead[t] = a
    out = np.empty(len(evidence))
    b = right
    for t in range(block - 1, -1, -1):
        p = ahead[t] * b
        on = keep[:, t]
        out[where[on, t]] = p[on, 1] / p[on].sum(1)
        nxt = np.stack([b[:, 0], b[:, 1] * weight[:, t]], 1) @ step.T
        nxt /= nxt.sum(1, keepdims=True)
        b = np.where(on[:, None], nxt, b)
    return out


def _measures(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A document's measures: the largest marginal, log(1 + their sum), whether two tokens are more likely than not, and
    the log of the marginals' sum a thousand tokens."""
    n = len(bounds) - 1
    out = np.zeros((n, MEASURES))
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        sure = np.where(p > 0.1, p, 0.0)  # many small chances are no evidence
        out[some, 0] = np.maximum.reduceat(p, bounds[some])
        out[some, 1] = np.log1p(np.add.reduceat(sure, bounds[some]))
        out[some, 2] = np.add.reduceat((p > 0.5).astype(float), bounds[some]) >= 2
        out[some, 3] = np.log1p(1000 * np.add.reduceat(sure, bounds[some]) / np.diff(bounds)[some])
    return out


def _evidence(model: Model, features: np.ndarray) -> np.ndarray:
    return model.weights[0] + model.weights[features].sum(1) - model.weights[0] * (features == 0).sum(1) if len(features) else np.zeros(0)


# --- fitting -----------------------------------------------------------------------------------------------------


def _telling(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Whether a bucket tells a toxic document: its share of toxic documents is five times the overall odds, beyond chance (1e-7)."""
    with_it = np.zeros((2, BUCKETS))
    for f, y in zip(features, toxic, strict=True):
        own = np.unique(f)
        with_it[y, own[own > 0]] += 1
    n = with_it.sum(0)
    base = toxic.mean()
    share = np.divide(with_it[1], n, out=np.zeros(BUCKETS), where=n > 0)
    inner = np.clip(share, 1e-12, 1 - 1e-12)
    surprise = n * (inner * np.log(inner / base) + (1 - inner) * np.log((1 - inner) / (1 - base)))
    odds = (with_it[1] + 0.1) / toxic.sum() / ((with_it[0] + 0.1) / (1 - toxic).sum())
    return (share > base) & (surprise > 16) & (odds > 5)


def _stretches(found: np.ndarray, seed: int, reach: int = REACH, clean_stretches: int = CLEAN_STRETCHES) -> list[tuple[int, int]]:
    """Stretches of a document's tokens that don't overlap: around all with a telling feature, else at places spread by a hash."""
    n = len(found)
    places = np.flatnonzero(found)
    if not len(places):
        places = np.unique((mix(np.arange(1, 1 + clean_stretches, dtype=np.uint64) * np.uint64(seed + 1)) % np.uint64(max(n, 1))).astype(np.int64))
    out: list[tuple[int, int]] = []
    for p in places.tolist():
        last = out[-1][1] if out else 0
        if not out or p >= last:
            out.append((max(last, p - reach), min(n, p + reach + 1)))
    return [s for s in out if s[1] > s[0]]


def _fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 40, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """weights and chain by maximum likelihood with an L2 penalty; rows: (features, tags) of stretches."""
    length = 2 * reach + 1
    n = len(rows)
    features = np.zeros((n, length, 1 + len(PREFIXES)), np.int32)
    tags = np.zeros((n, length), np.int8)
    keep = np.zeros((n, length), bool)
    for k, (f, y) in enumerate(rows):
        features[k, : len(y)], tags[k, : len(y)], keep[k, : len(y)] = f, y, True
    used, features = np.unique(features, return_inverse=True)
    features = features.reshape(n, length, -1)
    if not len(used) or used[0] != 0:
        used, features = np.concatenate([[0], used]), features + 1
    w = np.zeros(len(used))
    w[0] = -4.0
    chain = np.array([[0.0, 0.0], [0.0, 0.0]])
    state = [np.zeros_like(x) for x in (w, w, chain, chain)]
    before = np.concatenate([np.zeros((n, 1), np.int8), tags[:, :-1]], 1)
    seen = np.array([[((before == i) & (tags == j) & keep).sum() for j in (0, 1)] for i in (0, 1)], float)
    for r in range(1, rounds + 1):
        own = np.where(features > 0, w[features], 0.0).sum(2) + w[0]
        p, expected = _forward_backward(own, keep, chain)
        miss = np.where(keep, tags - p, 0.0)
        gw = np.bincount(features.ravel(), np.repeat(miss.ravel(), features.shape[2]), len(w))
        gw[0] = miss.sum()
        gw -= 0.05 * w
        gc = seen - expected - 0.05 * chain
        for x, g, m, v in ((w, gw, state[0], state[1]), (chain, gc, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.3 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        chain -= chain.mean()
        np.clip(chain, -3, 3, out=chain)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return weights, chain


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * np.r_[0, b[1:]]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.diag(np.r_[1e-6, np.ones(len(b) - 1)])
        move = np.linalg.solve(h, g)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return b


def fit(texts: pa.Array, toxic: np.ndarray, shares: tuple[float, float] = (1.0, 1.0), reach: int = REACH, clean_stretches: int = CLEAN_STRETCHES) -> Model:
    """texts and their labels (0 or 1).  shares: which part of the clean and of the toxic labelled documents the sample has.
    Of copies, exact or near, one is used: those that share their smallest hash of five words."""
    empty = Model(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.zeros(1 + MEASURES), None)
    if not len(toxic) or toxic.min() == toxic.max():
        empty.constant = float(toxic.mean()) if len(toxic) else 0.5
        return empty
    features: list[np.ndarray] = []
    for _, _, f, _, _, bounds in _pieces(texts):
        features += [f[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)]
    seen, chosen = set(), []
    for k, f in enumerate(features):
        s = shingles(mix(f[:, 0].astype(np.uint64)), 5)
        mark = (int(s[0]), int(toxic[k])) if len(s) else None
        if mark and mark not in seen:
            seen.add(mark)
            chosen.append(k)
    training = [k for n, k in enumerate(chosen) if n % 4]
    checking = [k for n, k in enumerate(chosen) if n % 4 == 0]
    if len({int(toxic[k]) for k in training}) < 2:
        empty.constant = float(toxic.mean())
        return empty
    telling = _telling([features[k] for k in training], toxic[training])
    telling[0] = False
    rows = []
    for k in training:
        found = telling[features[k]].any(1)  # in clean documents the field learns which of them to pass over
        tags = found & bool(toxic[k])
        rows += [(features[k][a:b], tags[a:b]) for a, b in _stretches(found, k, reach, clean_stretches)]
    weights, chain = _fit_chain(rows, reach=reach)
    model = Model(weights, chain, np.zeros(1 + MEASURES))
    x = np.vstack([_measures(marginals(_evidence(model, features[k]), np.array([0, len(features[k])]), chain), np.array([0, len(features[k])])) for k in checking])
    y = toxic[checking]
    if len(set(y.tolist())) < 2:
        x = np.vstack([x, np.zeros((1, MEASURES)), np.ones((1, MEASURES))])
        y = np.concatenate([y, [0, 1]])
    weight = np.where(y == 1, 1 / max(shares[1], 1e-9), 1 / max(shares[0], 1e-9))
    model.fit = _logistic(x, y, weight * len(y) / weight.sum())
    return model


# --- on tables ---------------------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, reach: int = REACH, clean_stretches: int = CLEAN_STRETCHES) -> Model:
    """Fits on the labelled documents among docs.  The field sees every telling token with reach tokens on either side, and
    clean_stretches such places of a document that has none."""
    wanted = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    counts = {r.y: r.n for r in wanted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id", F.lit(1)), F.col("id")]
    sample = wanted.where("y = 1").orderBy(*order).limit(most_toxic).unionByName(wanted.where("y = 0").orderBy(*order).limit(most_clean))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS))
    rows = texts.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), "id", "text").select("text", "y").toArrow()  # the sample has most_toxic + most_clean rows at most
    text = rows["text"].combine_chunks()
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
    shares = tuple(min(1.0, most / max(counts.get(y, 0), 1)) for y, most in ((0, most_clean), (1, most_toxic)))
    return fit(text, rows["y"].to_numpy().astype(int), shares, reach, clean_stretches)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, score (0 to 1), spans: array<struct<start,end,chance>>, the offending tokens in characters of the text from 0, end excluded."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            counts = np.zeros(batch.num_rows, np.int64)
            starts, ends, chances = [], [], []
            for row, data, features, start, end, bounds in _pieces(batch.column(1)):
                n = len(bounds) - 1
                p = marginals(_evidence(held, features), bounds, held.chain) if held.constant is None else np.zeros(len(features))
                x = _measures(p, bounds)
                scores[row : row + n] = 1 / (1 + np.exp(-np.clip(held.fit[0] + x @ held.fit[1:], -40, 40))) if held.constant is None else held.constant
                hit = np.flatnonzero(p > 0.5)
                if len(hit):
                    char = np.cumsum((data & 0xC0) != 0x80)  # characters up to each byte
                    of = np.searchsorted(bounds, hit, "right") - 1
                    before = _chars_before(batch.column(1), row, n, data, char)
                    counts[row : row + n] = np.bincount(of, minlength=n)
                    starts.append(char[start[hit]] - 1 - before[of])
                    ends.append(char[end[hit] - 1] - before[of])
                    chances.append(p[hit])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            spans = pa.StructArray.from_arrays([flat(starts, pa.int32()), flat(ends, pa.int32()), flat(chances, pa.float64())], ["start", "end", "chance"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=[id_column, "score", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, score double, spans array<struct<start:int,end:int,chance:double>>")


def _chars_before(texts: pa.Array, row: int, n: int, data: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Characters of the piece before each of its rows."""
    _, offsets, _ = text_buffers(texts)
    at = offsets[row : row + n] - offsets[row]
    return np.where(at > 0, char[np.maximum(at, 1) - 1], 0)
