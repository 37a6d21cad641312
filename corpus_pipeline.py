"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read again as the next one's docs.  All but the last return the columns of ``documents``; a stage that cuts
texts sets ``n_chars`` to the new length.  Null and empty texts go with the rules' first; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.llm import line_dedup, near_dedup, packing, quality_rules, unit_dedup
from quillon.llm.queries import table, tokenizer_path
from quillon.llm.shared import written


def _with_texts(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars as the cleaned texts have it."""
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go."""
    return quality_rules.filter_documents(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later places of every repeated line that holds a word go, and documents of which nothing else is left."""
    cleaned = line_dedup.dedup_lines(docs, window=1)
    emptied = (F.size(F.col(f"`{line_dedup.free_name(docs, 'line_dedup')}`.removed_lines")) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _with_texts(docs, cleaned.where(~F.coalesce(emptied, F.lit(False))))


def _keyed(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """docs with __key and __odd.  The key is the id, or a hash of the text, placed after all usual ids, where the id is null or
    another text of the same id has it; odd rows are those whose key other rows may share."""
    text = F.xxhash64("text")
    if isinstance(docs.schema["doc_id"].dataType, StringType):
        own = F.concat(F.lit("\U0010ffff"), F.lpad(F.hex(text), 16, "0"))
    else:
        own = text.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    nameless = docs.where("doc_id is null").select("*", own.alias("__key"), F.lit(True).alias("__odd"))
    named = docs.where("doc_id is not null").join(odd.where("doc_id is not null"), "doc_id", "left")
    named = named.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col("__text").isNull() | (text == F.col("__text")), F.col("doc_id")).otherwise(own).alias("__key"), F.col("__text").isNotNull().alias("__odd"))
    return written(named.unionByName(nameless), "keyed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the one with the smallest id, a null one last.
    Of repeated rows, and of rows without an id that have the same text, the one with the smallest hash of the row stays;
    rows with the same id and other texts count as documents of their own."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    odd = written(docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("__text"), F.count("*").alias("n")).where("n > 1 or doc_id is null").drop("n"), "odd")
    if odd.isEmpty():
        found = near_dedup.near_components(docs, size=5, percent=80)
        gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    keyed = _keyed(docs, odd)
    found = near_dedup.near_components(keyed, size=5, percent=80, id_column="__key")
    gone = found.where(~F.col("kept")).select(F.col("id").alias("__key"))
    left = keyed.join(gone, "__key", "left_anti")
    one = left.where("__odd").groupBy("__key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return left.where("not __odd").select(*columns).unionByName(one.select("row.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every later occurrence of a repeated sentence or run of sentences, lists of short items included, goes; only
    runs under five words together stay, which can be parts of numbers, addresses and abbreviations."""
    return _with_texts(docs, unit_dedup.dedup_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    out = packing.pack(docs, tokenizer_path(), end_id=1, capacity=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("substring_dedup", passages), ("packing", pack)]

#: SQL has no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
