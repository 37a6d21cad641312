"""Substring dedup by hashing of paragraphs' sentences.

A text is cut into units: a run of characters other than ``.``, ``!``, ``?`` and line ends, with the run of these
that follows.  A unit is normalised (lower case, all but letters and digits to single spaces) and counts if it then
has ``min_words`` words.  Digests of units are grouped over the whole corpus; the earliest occurrence by (id, place)
is the origin and every other one is a repeat.  Repeats that follow one another in a document, with no counted
unit between them, make a passage, which is cut out if its units have ``min_passage`` words together.  Under the defaults
every unit with a word counts, so lists of short items are found too, and every later occurrence goes but for repeats
of fewer than five words that stand alone, which can be parts of numbers, addresses and abbreviations.
A passage that was put into a paragraph is found as well as one on lines of its own.  Spans of what was removed keep their
offsets, in characters of the original text.

Digests found once in the corpus are put aside by a count, which is combined before the shuffle; of the others the origin is
a grouped minimum, and repeats find it by a join that can be split where a unit is common.

Defined results: a null text stays null, an empty one empty; a text without counted units is left as it is; repeated
rows (same id and text) are one document and keep alike; the same id with other texts is told apart; a null id comes before all
others; a passage may repeat within a document.  Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.line_dedup import free_name

MIN_WORDS = 1
MIN_PASSAGE = 5
UNIT = "[^.!?\\n]+[.!?\\n]*|[.!?\\n]+"


def _keys(id_column: str, text_column: str) -> list[Column]:
    return [F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("th")]


def _units(docs: DataFrame, min_words: int, id_column: str, text_column: str) -> DataFrame:
    """A row for each counted unit: id and th (the document), h (a digest), gi (another digest in the upper half, the unit's number
    among all units in the lower one), qw (its number among the counted ones in the upper half, its words in the lower one)."""
    out = docs.select(*_keys(id_column, text_column), F.regexp_extract_all(F.col(text_column), F.lit(UNIT), 0).alias("units"))
    out = out.select("id", "th", F.expr("transform(units, (u, i) -> struct(i as i, trim(regexp_replace(lower(u), '[^\\\\p{L}\\\\p{N}]+', ' ')) as s))").alias("units"))
    words = "if(u.s = '', 0, 1 + char_length(u.s) - char_length(translate(u.s, ' ', '')))"
    out = out.select("id", "th", F.expr(f"transform(units, u -> struct({words} as words, xxhash64(u.s) as h, shiftleft(cast(hash(u.s) as bigint), 32) | cast(u.i as bigint) as gi))").alias("units"))
    out = out.select("id", "th", F.posexplode(F.expr(f"filter(units, u -> u.words >= {max(1, int(min_words))})")).alias("q", "u"))
    return out.select("id", "th", "u.h", "u.gi", F.expr("shiftleft(cast(q as bigint), 32) | cast(u.words as bigint)").alias("qw"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, th (a hash of the text) and passages, array<struct<a,b>> in order: the first and last unit of each passage to remove, of documents that have one."""
    units = _units(docs, min_words, id_column, text_column)
    shared = units.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    near = units.join(shared, "h").select("id", "th", "h", F.expr("shiftright(gi, 32)").alias("g"), F.expr("cast(gi & 4294967295L as int)").alias("i"), F.expr("cast(shiftright(qw, 32) as int)").alias("q"), F.expr("qw & 4294967295L").alias("words"))
    place = F.struct("id", "th", "i")
    origin = near.groupBy("h", "g").agg(F.min(place).alias("origin"), F.max(place).alias("last")).where(~F.col("origin").eqNullSafe(F.col("last"))).drop("last")
    repeats = near.join(origin, ["h", "g"]).where(~place.eqNullSafe(F.col("origin"))).select("id", "th", "q", "i", "words")
    # Rows with the same id and text make one set, before the shuffle; what follows stays where it is.
    repeats = repeats.groupBy("id", "th").agg(F.collect_set(F.struct("q", "i", "words")).alias("r")).select("id", "th", F.explode("r").alias("r")).select("id", "th", "r.*")
    passages = repeats.withColumn("island", F.col("q") - F.row_number().over(Window.partitionBy("id", "th").orderBy("q")))
    passages = passages.groupBy("id", "th", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.sum("words").alias("words")).where(F.col("words") >= min_passage)
    return passages.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("passages"))


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, id_column: str = "doc_id", text_column: str = "text", added: str = "removed") -> DataFrame:
    """docs with the texts cleaned, and after its own columns one (called added, with underscores if they have that name):
    array<struct<start,end>>, what was cut out of the original text, in characters from 0, end excluded."""
    found = repeated_passages(docs, min_words, min_passage, id_column, text_column)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(id_column, text_column))
    out = whole.join(found.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "passages"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    text = F.col(f"row.`{text_column}`")
    out = out.select("row", "passages", F.when(F.col("passages").isNotNull(), F.regexp_extract_all(text, F.lit(UNIT), 0)).alias("units"))
    # Where every unit ends, in characters, so that no text is joined for its length.
    out = out.withColumn("lengths", F.expr("transform(units, u -> char_length(u))"))
    before = "aggregate(slice(lengths, 1, {}), 0, (n, x) -> n + x)"
    out = out.withColumn("spans", F.expr(f"coalesce(transform(passages, s -> struct({before.format('s.a')} as start, {before.format('s.b + 1')} as end)), cast(array() as array<struct<start:int,end:int>>))"))
    clean = F.expr(
        "array_join(transform(sequence(0, size(passages)), k -> array_join(slice(units, 1 + coalesce(get(passages, k - 1).b + 1, 0), "
        "coalesce(get(passages, k).a, size(units)) - coalesce(get(passages, k - 1).b + 1, 0)), '')), '')"
    )
    own = [F.when(F.col("passages").isNull(), text).otherwise(clean).alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, F.col("spans").alias(free_name(docs, added)))
