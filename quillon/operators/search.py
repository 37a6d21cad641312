"""Search over several fields by BM25."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import search_tokens

# Weights as they are configured, and as they take effect where a field's weight binds one place too far right.
DECLARED = {"title": 3.0, "brand": 2.0, "category": 2.0, "model": 2.5, "attributes": 1.5, "options": 1.2, "bullets": 0.8}
EFFECTIVE = {"title": 2.0, "brand": 2.0, "category": 2.5, "model": 1.5, "attributes": 1.2, "options": 0.8, "bullets": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def checked_weights(weights: dict[str, float], fields: list[str]) -> dict[str, float]:
    """Weights, if they are finite numbers above 0 for exactly these fields."""
    if set(weights) != set(fields):
        raise ValueError(f"weights are needed for {sorted(fields)}")
    for name, w in weights.items():
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w <= 0:
            raise ValueError(f"the weight of {name} must be finite and above 0")
    return {name: float(w) for name, w in weights.items()}


def postings(products: DataFrame, key: str, fields: dict[str, Column], *order: Column, tokens=search_tokens) -> DataFrame:
    """Id, field, term, tf and size (the tokens of all the document's fields), a row for each term of a field.  Of rows with
    one key the first by order counts; rows without a key are passed over."""
    own = products.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    once = own.groupBy(F.col(key).alias("id")).agg(F.min_by(row, F.struct(*order)).alias("r")) if order else own.select(F.col(key).alias("id"), row.alias("r"))
    made = once.select("id", *[tokens(F.col(f"r.{n}")).alias(n) for n in fields])
    made = made.withColumn("size", sum(F.size(n) for n in fields))
    each = made.select("id", "size", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("terms")) for n in fields])).alias("f"))
    each = each.select("id", "size", "f.field", F.explode("f.terms").alias("term"))
    return each.groupBy("id", "size", "field", "term").agg(F.count("*").alias("tf"))


def corpus_sizes(index: DataFrame) -> DataFrame:
    """One row: n documents that have a term, and their mean size."""
    return index.groupBy("id").agg(F.first("size").alias("size")).agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size"))


def bm25(index: DataFrame, queries: DataFrame, weights: dict[str, float], k: int, tokens=search_tokens) -> DataFrame:
    """query_id, rank (from 1), id and score of every query's k best documents, ties to the smaller id.  queries: query_id, query.

    A term's postings are weighted and summed by document before the logarithms.  The postings are filtered by the queries' terms first, and
    scores are summed by (query, document) with partial sums; a group limit keeps k rows a query and task."""
    from pyspark.sql import Window

    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("field"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = index.join(terms.select("term").distinct(), "term", "left_semi").where(weight.isNotNull())
    of_doc = wanted.groupBy("term", "id", "size").agg(F.sum(weight * F.col("tf")).alias("f"))
    holders = of_doc.groupBy("term").agg(F.count("*").alias("df"))
    corpus = corpus_sizes(index)  # one row
    rarity = holders.crossJoin(F.broadcast(corpus)).withColumn("idf", F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    scored = of_doc.join(rarity, "term").select("term", "id", part.alias("part")).join(terms, "term")
    total = scored.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return total.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
