"""Harmonic packing of token ids into sequences.

Lengths are partitioned into classes by reciprocal capacity: class i holds lengths in (capacity / (i + 1),
capacity / i], and a bin of class i takes exactly i pieces.  Every task fills the bins of its own documents, with
nothing shared and nothing shuffled.  A document is cut so that its pieces sit at the top of their classes: as many
whole sequences as it fills, then powers of two down to ``least``, whose bins come out full, and one rest below
``least``, whose class is at least capacity / least and wastes 1 / (i + 1) of its bin at most.  What is left in
bins when a task ends is cut into powers of two and laid, largest first, into sequences whose lengths are powers of
two, which need no padding: a task pads nothing but the bins of rests.

A task holds at most one open bin a class: about capacity * ln(least) short pieces, whatever the input.

Defined results: a null or empty text has the end id only; rows with equal ids are packed one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import encoder

CAPACITY = 2048
LEAST = 64
_OUT_BYTES = 8 << 20

#: (row's id, start, ids, tokens of the document)
Piece = tuple[object, int, np.ndarray, int]


def cut(length: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    size = capacity // 2
    while size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def _powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """capacity must be a power of two.  add and close give finished sequences, each a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST):
        if capacity < 2 or capacity & (capacity - 1) or least < 1:
            raise ValueError("capacity must be a power of two and least at least 1")
        self.capacity, self.least = capacity, min(least, capacity)
        self.bins: dict[int, list[Piece]] = {}

    def add(self, key: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        at = 0
        for n in cut(len(ids), self.capacity, self.least):
            i = self.capacity // n
            held = self.bins.setdefault(i, [])
            held.append((key, at, ids[at : at + n].copy(), len(ids)))
            at += n
            if len(held) == i:
                yield self.bins.pop(i)

    def close(self) -> Iterator[list[Piece]]:
        rest: list[Piece] = []
        for key, start, ids, total in itertools.chain.from_iterable(self.bins.values()):
            at = 0
            for n in _powers(len(ids)):
                rest.append((key, start + at, ids[at : at + n], total))
                at += n
        self.bins = {}
        rest.sort(key=lambda p: -len(p[2]))
        left = sum(len(p[2]) for p in rest)
        at = 0
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                out.append(rest[at])
                room -= len(rest[at][2])
                at += 1
            yield out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: the id column, start (ids of the document before it), length, ids (little-endian unsigned
    32-bit integers), doc_tokens (with the end id), sequence_id (the task's number in the upper half), offset (place in the sequence),
    sequence_tokens (used) and padded (the sequence's length with padding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer).encode_all
        packer, numbers = Packer(capacity, least), itertools.count(TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        size = 0

        def put(sequence: list[Piece]) -> int:
            number, offset, used = next(numbers), 0, sum(len(p[2]) for p in sequence)
            padded = used if used & (used - 1) == 0 else capacity
            for key, start, ids, total in sequence:
                rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset, used, padded))
                offset += len(ids)
            return 4 * used + 100 * len(sequence)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, own in zip(batch.column(0).to_pylist(), encode_all(batch.column(1)), strict=True):
                for sequence in packer.add(key, np.append(own, own.dtype.type(end_id))):
                    size += put(sequence)
                if size >= _OUT_BYTES:
                    yield flush()
                    size = 0
        for sequence in packer.close():
            put(sequence)
        if rows:
            yield flush()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, padded bigint")
