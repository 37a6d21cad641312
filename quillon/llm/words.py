"""Word and shingle hashing over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Texts are hashed straight from the Arrow
value buffer: a prefix sum of ``table[byte] * BASE**i`` (mod 2**64) gives the hash of any word as a difference,
so a batch of texts costs a handful of vector passes and no per-word Python.  Work goes in pieces of about
``PIECE`` bytes; a text longer than that is cut between words, so memory doesn't follow a text's length
except for eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse mod 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    order = np.arange(1, 257, dtype=np.uint64)
    if lower:
        order[65:91] = order[97:123]
    return mix(order * np.uint64(_BASE))


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, PIECE + 4096), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string array; nulls are empty texts with valid False."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    valid = np.asarray(texts.is_valid())
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(texts) and not valid.all():  # a null's slot may hold bytes
        out = pa.array([t if t is not None else "" for t in texts.to_pylist()], pa.large_string())
        return text_buffers(out)[0], text_buffers(out)[1], valid
    return data, offsets, valid


def _piece_words(data: np.ndarray, cuts: np.ndarray, lower: bool, between: np.ndarray = _IS_SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of every word of a piece, then for each of prefixes the hash of the word's first so many
    bytes, 0 for words that are no longer.  between: which bytes stand between words.  No word crosses a place in cuts."""
    if not len(data):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * len(prefixes)
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * up[: len(data)], out=total[1:])
    out = [mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end]
    for n in prefixes:
        at = np.minimum(start + n, len(data))
        out.append(np.where(end - start > n, mix((total[at] - total[start]) * down[start] + np.uint64(n << 32)), np.uint64(0)))
    return tuple(out)


def words_by_text(texts: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row of a string array; a null has no words."""
    data, offsets, _ = text_buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        if offsets[row + 1] - offsets[row] > PIECE:
            yield row, _long_text(data[offsets[row] : offsets[row + 1]], lower)
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        stop = min(stop, n)
        at = offsets[row : stop + 1] - offsets[row]
        hashes, start, _ = _piece_words(data[offsets[row] : offsets[stop]], at[1:-1], lower)
        bounds = np.searchsorted(start, at)
        for k in range(stop - row):
            yield row + k, hashes[bounds[k] : bounds[k + 1]]
        row = stop


def _long_text(data: np.ndarray, lower: bool) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data):  # to the next space, so that no word is cut
            spaces = np.flatnonzero(_IS_SPACE[data[stop : stop + PIECE]])
            if len(spaces):
                stop += int(spaces[0])
                break
            stop = min(stop + PIECE, len(data))
        out.append(_piece_words(data[at:stop], np.zeros(0, np.int64), lower)[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes, ascending, of all runs of ``size`` words; a shorter text's words make one shingle; no words, none."""
    if not len(words):
        return words
    if len(words) < size:
        out = np.uint64(len(words)) * np.ones(1, np.uint64)
        for w in words:
            out = mix(out * np.uint64(_BASE) + w)
        return out
    n = len(words) - size + 1
    out = words[:n]
    for k in range(1, size):
        out = mix(out * np.uint64(_BASE) + words[k : k + n])
    return np.unique(out)
