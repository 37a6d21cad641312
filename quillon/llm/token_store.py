"""Token ids in files, each document compressed for itself with one shared zstandard dictionary.

``write_tokens`` trains the dictionary on the serialised ids of a bounded sample of documents, sorts documents into
shards by (id, hash of the text), and writes a file a shard: frames, then an index, then a footer.

    frame     zstandard, of the document's ids as little-endian integers of ``width`` bytes
    index     Arrow IPC stream: id, offset and size of the frame, tokens
    footer    length of the index (8 bytes), width (1), SHA-256 of the dictionary (32), magic (8)

So a short document is read with two ranged reads: footer and index once a file, then its frame.  The dictionary lies beside the
files under its hash.  A file's name is new for each attempt of a task and the manifest, which tasks return, names the one that
counts, so a lost executor leaves a file that nothing refers to.

The dictionary is trained on a sample of SAMPLE_DOCS documents of SAMPLE_CHARS characters at most, those with the smallest hashes
of their ids; every document is compressed with it.  Where the sample is too small for training (zstandard refuses some ten
documents), the sample's own ids, up to DICTIONARY_BYTES, are the dictionary as raw content; without any such document, or in an
empty table, the dictionary has no bytes and documents are compressed without one.

Defined results: a null or empty text has the end id only; rows with equal ids follow one another; a null id comes first; an empty
table gives an empty manifest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import new_path
from quillon.llm.tokens import encoder

MAGIC = b"QTOKENS1"
_FOOTER = "<QB32s8s"
#: The sample that the dictionary is trained on: so many documents, of so many characters at most; and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 50_000, 64 << 10
LEVEL = 3


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """file:/x, as Spark may say, is file:///x elsewhere."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def train_dictionary(docs: DataFrame, tokenizer: str, id_column: str, text_column: str) -> bytes:
    """Trained on ids of the sample.  Its rows are chosen by hashes alone; the texts follow for the chosen ones."""
    marked = docs.select(F.xxhash64(id_column).alias("a"), F.xxhash64(text_column).alias("b"), F.col(text_column).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    chosen = marked.select("a", "b").orderBy("a", "b").limit(SAMPLE_DOCS).distinct()
    sample = marked.join(F.broadcast(chosen), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])  # SAMPLE_DOCS pairs of longs
    encode = encoder(tokenizer).encode
    rows = [encode(r.text).tobytes() for r in sorted(sample.collect(), key=lambda r: (r.a, r.b))]
    if not rows:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(rows)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the files and the manifest, a table at folder/manifest: shard, path, docs, tokens, id_type.  Returns the manifest."""
    id_type = docs.schema[id_column].dataType.simpleString()
    folder = _uri(folder)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    spark = docs.sparkSession
    trained = train_dictionary(docs, tokenizer, "id", "text")
    digest = hashlib.sha256(trained).digest()
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{digest.hex()}.zdict") as out:
        out.write(trained)
    sent = spark.sparkContext.broadcast(trained)  # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(tokenizer)
        end = np.array([end_id], held.type).tobytes()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(sent.value)).compress
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tokens"
        store, base = _open(folder)
        ids, tokens, sizes, out, kind = [], [], [], None, pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            out = out or store.open_output_stream(f"{base}/{name}")
            ids += batch.column(0).to_pylist()
            for own in held.encode_all(batch.column(1)):
                frame = compress(own.tobytes() + end)
                out.write(frame)
                tokens.append(len(own) + 1)
                sizes.append(len(frame))
        if not ids:
            return
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        index = pa.table({"id": pa.array(ids, kind), "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int64()), "tokens": pa.array(tokens, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        body = sink.getvalue()
        out.write(body)
        out.write(struct.pack(_FOOTER, body.size, held.type.itemsize, digest, MAGIC))
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "docs": len(ids), "tokens": int(sum(tokens))}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    order = ["id", F.xxhash64("text")]
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "shard int, path string, docs bigint, tokens bigint").withColumn("id_type", F.lit(id_type)).write.parquet(f"{folder}/manifest")
    return spark.read.schema("shard int, path string, docs bigint, tokens bigint, id_type string").parquet(f"{folder}/manifest")


class TokenFile:
    """One file, read by ranges."""

    def __init__(self, path: str):
        store, base = _open(path)
        self.file = store.open_input_file(base)
        end = self.file.size() - struct.calcsize(_FOOTER)
        size, width, digest, magic = struct.unpack(_FOOTER, self.file.read_at(struct.calcsize(_FOOTER), end))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        self.type = np.dtype(f"<u{width}")
        self.index = pa.ipc.open_stream(self.file.read_at(size, end - size)).read_all()
        folder = base.rpartition("/")[0]
        with store.open_input_stream(f"{folder}/{digest.hex()}.zdict") as held:
            data = held.read()
        if hashlib.sha256(data).digest() != digest:
            raise ValueError(f"the dictionary of {path} isn't the one it was written with")
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in a row of the index."""
        offset, size = self.index["offset"][row].as_py(), self.index["size"][row].as_py()
        return np.frombuffer(self.decompress(self.file.read_at(size, offset)), self.type)

    def all_ids(self, most: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of every document in order, by reads of about ``most`` bytes."""
        offsets, sizes = self.index["offset"].to_numpy(), self.index["size"].to_numpy()
        row = 0
        while row < len(offsets):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most)))
            data = memoryview(self.file.read_at(int(offsets[stop - 1] + sizes[stop - 1] - offsets[row]), int(offsets[row])))
            for k in range(row, stop):
                at = int(offsets[k] - offsets[row])
                yield np.frombuffer(self.decompress(data[at : at + int(sizes[k])]), self.type)
            row = stop


def read_document(manifest: DataFrame, doc_id: object) -> list[np.ndarray]:
    """The ids of the documents with this id, by ranged reads of the files' indexes and of these documents' frames."""
    out = []
    for path in sorted(r.path for r in manifest.select("path").collect()):
        held = TokenFile(path)
        out += [held.ids(row) for row in np.flatnonzero(np.array([x == doc_id for x in held.index["id"].to_pylist()], bool))]
    return out


def read_tokens(manifest: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The id column, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers), one
    row a document, in the order of the shards.  Shards are few: the sums over them are taken in one task."""
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, manifest.count())
    first = manifest.select("id_type").first()
    id_type = first.id_type if first else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                held = TokenFile(path)
                counts = held.index["tokens"].to_numpy()
                starts = start + np.cumsum(counts) - counts
                ids = held.index["id"].combine_chunks()
                at, rows, size = 0, [], 0
                for own in held.all_ids():
                    rows.append(own.astype("<u4").tobytes())
                    size += len(rows[-1])
                    if size >= 8 << 20:
                        yield _batch(ids, starts, counts, rows, at, id_column)
                        at, rows, size = at + len(rows), [], 0
                if rows:
                    yield _batch(ids, starts, counts, rows, at, id_column)

    return placed.select("path", "start").repartition(n).mapInArrow(run, f"`{id_column}` {id_type}, start bigint, n_tokens bigint, ids binary")


def _batch(ids: pa.Array, starts: np.ndarray, counts: np.ndarray, rows: list[bytes], at: int, id_column: str) -> pa.RecordBatch:
    stop = at + len(rows)
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    return pa.RecordBatch.from_arrays([ids[at:stop], pa.array(starts[at:stop], pa.int64()), pa.array(counts[at:stop], pa.int64()), pa.array(rows, pa.binary())], names=[id_column, "start", "n_tokens", "ids"])


def folder_in(spark) -> str:
    return _uri(new_path(spark, "tokens"))
