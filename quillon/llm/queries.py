"""The registered queries of this package: opN_<name> over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_dedup, near_dedup, packing, piece_nbest, quality_classifier, quality_rules, token_store, topk_search, toxicity, unit_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed_mask").bitwiseAND(F.lit(quality_rules.policy_mask("base")).cast("bigint")) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_mask", "n_lines", "n_digits", "n_capitals", "n_shouts")


_OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)
),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dups FROM l GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(len(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines,
    len(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
    len(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    len(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_shouts
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
),
f AS (SELECT *, (
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_digits > 30 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_capitals > 60 * word_chars THEN 128 ELSE 0 END
    + CASE WHEN 2 * n_shouts > n_words THEN 256 ELSE 0 END)::BIGINT AS failed_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_mask & 3) <> 0 AS base_failed,
  (failed_mask & 51) = 0 AS kept, failed_mask, n_lines, n_digits, n_capitals, n_shouts
FROM f
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and with others, from the ledger's masks."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")


_ABLATIONS_SQL = f"""
WITH ledger AS ({_OP2_SQL.strip()}), m AS (SELECT failed_mask & 51 AS mask FROM ledger),
r AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines']) AS rule, unnest([1, 2, 16, 32]) AS bit)
SELECT rule, count(*) FILTER (WHERE mask & bit <> 0) AS rejected, count(*) FILTER (WHERE mask = bit) AS only_rule, count(*) FILTER (WHERE mask & (51 - bit) <> 0) AS without_rule FROM r, m GROUP BY rule
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = token_store.write_tokens(docs, token_store.folder_in(spark), tokenizer_path(), end_id=2, shards=shards)
    return token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, capacity=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.col("line_dedup.removed_lines")
    return out.select("doc_id", "text", "line_dedup.n_lines", F.size(gone).alias("n_removed"), F.concat_ws(",", gone).alias("removed_lines"))


_OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents
),
h AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
g AS (
  SELECT doc_id, p, i, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2,
    line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY p)
),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS occurrence FROM g WHERE run IS NOT NULL),
one AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS occurrence FROM h WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5),
gone AS (SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM r WHERE occurrence > 1 UNION SELECT doc_id, i FROM one WHERE occurrence > 1)
SELECT d.doc_id, k.text, coalesce(n.n, 0)::INTEGER AS n_lines, coalesce(x.n, 0)::INTEGER AS n_removed, coalesce(x.lines, '') AS removed_lines
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS lines FROM gone GROUP BY doc_id) x USING (doc_id)
LEFT JOIN (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '') AS text
  FROM (SELECT l.*, gone.i IS NOT NULL AS removed FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i) GROUP BY doc_id
) k USING (doc_id)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unit_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.expr("aggregate(removed, 0, (n, s) -> n + s.end - s.start)")
    return out.select("doc_id", "text", F.size("removed").alias("n_removed"), cut.alias("removed_chars"), F.expr("array_join(transform(removed, s -> concat(s.start, '-', s.end)), ',')").alias("removed"))


_OP10_SQL = r"""
WITH u AS (
  SELECT doc_id, generate_subscripts(us, 1) - 1 AS i, unnest(us) AS unit
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS us FROM documents)
),
o AS (SELECT doc_id, i, unit, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start,
  trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM u),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q, len(string_split(s, ' ')) AS words FROM o WHERE s <> ''),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, q) AS occurrence FROM c) WHERE occurrence > 1),
p AS (SELECT doc_id, min(i) AS a, max(i) AS b, min(start) AS start, max(start + length(unit)) AS stop
  FROM (SELECT *, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS island FROM r) GROUP BY doc_id, island HAVING sum(words) >= 5),
k AS (SELECT doc_id, string_agg(unit, '' ORDER BY i) AS text FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = o.doc_id AND o.i BETWEEN p.a AND p.b) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(x.n, 0)::INTEGER AS n_removed, coalesce(x.chars, 0)::INTEGER AS removed_chars, coalesce(x.spans, '') AS removed
FROM documents d LEFT JOIN k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, sum(stop - start) AS chars, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM p GROUP BY doc_id) x USING (doc_id)
"""

def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


_OP7_SQL = """
WITH e AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


_OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS sh
  FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- sets that share no shingle have no link; shingles found once join nothing
k AS (SELECT doc_id, sh FROM s WHERE sh IN (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM k a JOIN k b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.v),
c AS (SELECT v, min(m) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""


def _held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: whether a document's labels are kept from every fit."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def _learnable(labels: DataFrame) -> DataFrame:
    return _held_out(labels).where("not held_out").drop("held_out")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _learnable(table(spark, sf_dir, "labels")))
    scored = _held_out(quality_classifier.score(docs, model))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "metadata_score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _learnable(table(spark, sf_dir, "labels")))
    scored = _held_out(toxicity.score(docs, model))
    spans = F.expr("array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), spans.alias("spans"))


def op6_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = piece_nbest.encode_texts(table(spark, sf_dir, "documents"), model, n=4, decoded="text")
    listed = F.expr("trim(BOTH '[]' FROM to_json(ids))")  # as array_join gives them, which makes a string of every id first
    return encoded.select("doc_id", "rank", "score", F.size("ids").alias("n_pieces"), F.crc32(listed).alias("ids_crc32"), F.length("text").alias("n_chars"), F.crc32("text").alias("text_crc32"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op6_piece_nbest": op6_piece_nbest,
    "op2_quality_rules": op2_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op3_token_store": op3_token_store,
    "op9_packing": op9_packing,
    "op7_topk_search": op7_topk_search,
    "op8_near_dedup": op8_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "quality_ablations": quality_ablations,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": _OP2_SQL,
    "quality_ablations": _ABLATIONS_SQL,
    "op5_line_dedup": _OP5_SQL,
    "op7_topk_search": _OP7_SQL,
    "op8_near_dedup": _OP8_SQL,
    "op10_substring_dedup": _OP10_SQL,
}
