"""Queries of leakage, ranking, joins and sets (G, D, J, U), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.text import stable_hash
from quillon.operators import leakage, ranking, sets

_SPLITS = [("teacher", 40), ("train", 30), ("validation", 10)]


def _t(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _keys(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars")
    kinds = {"query": F.substring("text", 1, 40), "family": F.concat_ws("|", "source", "lang", "n_chars"), "tag": F.array(F.substring("text", 1, 60))}
    return leakage.leakage_keys(docs, "doc_id", kinds)


_KEYS_SQL = """keys AS (SELECT DISTINCT doc_id AS task, unnest([CASE WHEN substr(text, 1, 40) <> '' THEN 'query:' || substr(text, 1, 40) END, CASE WHEN concat_ws('|', source, lang, n_chars) <> '' THEN 'family:' || concat_ws('|', source, lang, n_chars) END,
  CASE WHEN substr(text, 1, 60) <> '' THEN 'tag:' || substr(text, 1, 60) END]) AS key FROM documents),
edges AS (SELECT DISTINCT a.task AS a, b.task AS b FROM (SELECT key, min(task) AS task FROM keys WHERE key IS NOT NULL GROUP BY 1) a JOIN keys b USING (key)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM reach r JOIN both_ways e ON e.a = r.v),
comp AS (SELECT v AS task, min(m) AS root FROM reach GROUP BY 1)"""


def g1_leakage_keys(spark, sf_dir):
    return _keys(spark, sf_dir)


def g2_leakage_components(spark, sf_dir):
    return leakage.leakage_components(_keys(spark, sf_dir))


def _owners(spark, sf_dir):
    split = _t(spark, sf_dir, "documents", F.col("doc_id").alias("task"), F.when(F.col("doc_id") % 5 == 0, "final").otherwise("train").alias("split"))
    return _keys(spark, sf_dir).join(split, "task")


def g3_audit(spark, sf_dir):
    return leakage.audit(_owners(spark, sf_dir)).select("kind", "evidence_sha256", F.array_join("splits", ",").alias("splits"))


def _pool(spark, sf_dir):
    tasks = _t(spark, sf_dir, "documents", F.col("doc_id").alias("task"), F.col("lang").alias("difficulty"))
    return leakage.leakage_components(_keys(spark, sf_dir)).join(tasks, "task"), tasks


def g4_allocate(spark, sf_dir):
    pool, _ = _pool(spark, sf_dir)
    return leakage.allocate(pool, _SPLITS, 7)


def g5_final_isolation(spark, sf_dir):
    components = leakage.leakage_components(_keys(spark, sf_dir))
    final = components.where("task % 10 = 3").select("task")
    left, lost = leakage.isolate(components, final)
    return left.withColumn("state", F.lit("free")).unionByName(lost.withColumn("state", F.lit("lost")))


def g6_distinct_content(spark, sf_dir):
    return leakage.distinct_content(_t(spark, sf_dir, "documents", "doc_id", "text"), F.coalesce("text", F.lit("")), F.col("doc_id")).select("content_sha256", "doc_id")


def a8_split_records(spark, sf_dir):
    tasks = _t(spark, sf_dir, "documents", F.col("doc_id").alias("task"), F.col("lang").alias("difficulty"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("split"))
    return leakage.split_records(tasks.select("split", "task"), tasks)


def f24_manifest_problems(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders", F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("task"))
    return leakage.manifest_problems(rows, {"F": 3, "O": 5})


def d2_completion(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "event_type", F.concat_ws(":", "user_id", F.col("event_id") % 40).alias("request"))
    return ranking.completion(e, "request", F.col("event_type") == "error", F.col("event_id"))


def d4_process_pick(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return ranking.first_by(li, ["l_orderkey"], F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")).select("l_orderkey", "l_partkey", "l_linenumber")


def d5_best_candidate(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    tie = stable_hash(F.lit(11), F.col("o_custkey"), F.col("o_orderkey"))
    return ranking.best_candidate(o, "o_custkey", F.col("o_orderstatus") != "O", F.col("o_orderpriority") == "1-URGENT", F.substring("o_orderpriority", 1, 1).cast("int"), tie).select("o_custkey", "o_orderkey")


def d6_first_accepted(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return ranking.first_accepted(o, "o_custkey", F.col("o_orderstatus") == "F", F.col("o_custkey") % 7 == 0, F.col("o_orderkey")).select("o_orderkey", "verdict")


def d8_quotas(spark, sf_dir):
    return ranking.quotas(_t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", 101)


def d10_subset(spark, sf_dir):
    return ranking.subset(_t(spark, sf_dir, "part", "p_partkey"), "p_partkey", 3, ratio=0.125)


def d11_refill(spark, sf_dir):
    c = _t(spark, sf_dir, "customer", F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"), (F.col("c_custkey") % 10).alias("k"))
    source = c.where("k < 6").select("id", "stratum", F.when(F.col("k") < 2, "dev").otherwise("train").alias("split"))
    return ranking.refill(source, c.where("k >= 6").select("id", "stratum"), c.where("id % 7 = 0").select("id"), "id", "stratum", "split", 5)


def d12_curriculum(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_size")
    level = F.when(F.col("p_size") < 15, "simple").when(F.col("p_size") < 35, "medium").otherwise("hard")
    out = ranking.curriculum(p, level, F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 4 == 0)
    flags = ranking.review_flags(level, F.col("p_partkey") % 4 == 0, F.col("p_size") % 3, F.col("p_partkey") % 2, F.col("p_size") % 8, F.col("p_size"))
    return out.select("p_partkey", "bucket", F.array_join("stages", ",").alias("stages"), F.array_join(flags, ",").alias("flags"))


def d19_event_interleave(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    steps = ranking.indexed(e.where("event_type <> 'error'"), "user_id", "index", F.col("event_id"))
    guards = ranking.indexed(e.where("event_type = 'error'"), "user_id", "index", F.col("event_id")).withColumn("before_step", F.when(F.col("value") < 100, F.col("value").cast("int") % 20))
    return ranking.interleaved_events(steps, guards, "user_id")


def d22_batches(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast("bigint").alias("size")))).alias("r"))
    made = rows.withColumn("b", ranking.batches(F.col("r.size"), 3, 400_000))
    return made.select(F.posexplode("r").alias("k", "x"), "b").select("x.o_orderkey", F.get("b", F.col("k")).alias("batch"))


def d23_round_robin(spark, sf_dir):
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return leakage.interleaved(c, "c_mktsegment", F.lit(7), F.col("c_mktsegment"), F.col("c_custkey")).select("c_custkey", "turn")


def d24_taskwise_split(spark, sf_dir):
    return ranking.taskwise_split(_t(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey", 0.1, 13)


def _steps(spark, sf_dir):
    e = _t(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "ts")
    return ranking.indexed(e, "user_id", "turn", F.col("ts"), F.col("event_id"))


def d14_divergence(spark, sf_dir):
    s = _steps(spark, sf_dir).select((F.col("user_id") % 20).alias("task"), F.col("user_id").alias("attempt"), "turn", "event_type")
    return ranking.divergence(s, "task", "attempt", "turn", "event_type")


def d15_decision_ready(spark, sf_dir):
    return ranking.decision_ready(_steps(spark, sf_dir), "user_id", "turn", F.col("value") > 50, "event_type", ["view", "click"], F.col("event_type") == "purchase")


def d16_step_repeats(spark, sf_dir):
    return ranking.step_repeats(_steps(spark, sf_dir).withColumn("seen", F.floor(F.col("value") / 100)), "user_id", ["turn"], "event_type", "seen")


def j1_facts(spark, sf_dir):
    return sets.join_all(_t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")), _t(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", "p_brand")


def j8_leaked(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    return sets.leaked(o.where("o_orderstatus = 'F'"), {"final": o.where("o_orderpriority = '1-URGENT'"), "validation": o.where("o_orderpriority = '5-LOW'")}, "o_custkey")


def j9_resume_anti_join(spark, sf_dir):
    done = _t(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice").where("o_orderstatus = 'F' and o_totalprice > 200000")
    return sets.remaining(_t(spark, sf_dir, "customer", "c_custkey"), done, ["c_custkey"])


def j10_known_content(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents", "doc_id", "text", "source")
    known = docs.where("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256")).distinct()
    return sets.without_known(docs, known, F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 0).select("doc_id", "content_sha256")


def j15_contained(spark, sf_dir):
    words = _t(spark, sf_dir, "benchmark", F.substring("text", 1, 30).alias("needle"))
    return sets.contained(_t(spark, sf_dir, "documents", "doc_id", "text"), "text", words, "needle").select("doc_id", "needle")


def u1_sets(spark, sf_dir):
    """U1 to U5, J11."""
    o = _t(spark, sf_dir, "orders", F.col("o_custkey").alias("k"), "o_orderstatus")
    a, b = o.where("o_orderstatus = 'F'").select("k"), o.where("o_orderstatus = 'P'").select("k")
    parts = {"common": sets.overlap(a, b, "k"), "any": sets.any_of(a, b)}
    sides = sets.missing_and_extra(a, b, "k")
    return sets.tagged_union({**parts, "missing": sides.where("side = 'missing'").select("k"), "extra": sides.where("side = 'extra'").select("k")})


def u6_array_sets(spark, sf_dir):
    p = _t(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    a, b = F.split("p_name", " "), F.array(F.lit("cold"), F.lit("widget"), F.lower("p_type"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("common"), F.array_join(F.array_sort(F.array_except(b, a)), ",").alias("missing"), F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("every"))


def _allocation_sql() -> str:
    steps, names = [], []
    for k, (split, quota) in enumerate(_SPLITS):
        steps.append(f"""turns{k} AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY sha256('7:{split}:' || difficulty || ':' || task)) AS turn FROM pool{k}),
seen{k} AS (SELECT root, row_number() OVER (ORDER BY turn, difficulty) AS spot FROM turns{k}),
claims{k} AS (SELECT root, min(spot) AS spot, count(*) AS size FROM seen{k} GROUP BY 1),
taken{k} AS (SELECT root, before FROM (SELECT root, sum(size) OVER (ORDER BY spot) - size AS before FROM claims{k}) WHERE before < {quota}),
chosen{k} AS (SELECT '{split}' AS split, task FROM (SELECT task, before + row_number() OVER (PARTITION BY root ORDER BY sha256('7:{split}:component:' || task)) AS place FROM pool{k} JOIN taken{k} USING (root)) WHERE place <= {quota}),
pool{k + 1} AS (SELECT * FROM pool{k} WHERE root NOT IN (SELECT root FROM taken{k}))""")
        names.append(f"SELECT * FROM chosen{k}")
    return f"WITH RECURSIVE {_KEYS_SQL}, pool0 AS (SELECT task, root, lang AS difficulty FROM comp JOIN documents ON doc_id = task),\n" + ",\n".join(steps) + "\n" + " UNION ALL ".join(names)


_STEPS = "steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn FROM events)"
_LEVEL = "CASE WHEN p_size < 15 THEN 'simple' WHEN p_size < 35 THEN 'medium' ELSE 'hard' END"

ORACLES = {
    "g1_leakage_keys": f"WITH RECURSIVE {_KEYS_SQL} SELECT task, key FROM keys WHERE key IS NOT NULL",
    "g2_leakage_components": f"WITH RECURSIVE {_KEYS_SQL} SELECT task, root FROM comp",
    "g3_audit": f"""WITH RECURSIVE {_KEYS_SQL}, o AS (SELECT task, key, CASE WHEN task % 5 = 0 THEN 'final' ELSE 'train' END AS split FROM keys WHERE key IS NOT NULL)
SELECT split_part(key, ':', 1) AS kind, sha256(key) AS evidence_sha256, 'final,train' AS splits FROM o GROUP BY key HAVING count(DISTINCT split) > 1""",
    "g4_allocate": _allocation_sql(),
    "g5_final_isolation": f"""WITH RECURSIVE {_KEYS_SQL}, held AS (SELECT DISTINCT root FROM comp WHERE task % 10 = 3)
SELECT task, root, CASE WHEN root IN (SELECT root FROM held) THEN 'lost' ELSE 'free' END AS state FROM comp WHERE root NOT IN (SELECT root FROM held) OR task % 10 <> 3""",
    "g6_distinct_content": "SELECT sha256(coalesce(text, '')) AS content_sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "a8_split_records": """WITH t AS (SELECT doc_id, lang, 's' || (doc_id % 3) AS split FROM documents),
h AS (SELECT split, sha256('[' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) || ']') AS ids_sha256 FROM t GROUP BY 1)
SELECT split, lang AS difficulty, count(*) AS n, any_value(ids_sha256) AS ids_sha256 FROM t JOIN h USING (split) GROUP BY 1, 2""",
    "f24_manifest_problems": """WITH c AS (SELECT o_orderstatus AS split, count(*) AS n, count(DISTINCT o_custkey) AS ids FROM orders GROUP BY 1)
SELECT split, 'count' AS problem FROM c WHERE n IS DISTINCT FROM CASE split WHEN 'F' THEN 3 WHEN 'O' THEN 5 END UNION ALL SELECT split, 'duplicate_id' FROM c WHERE ids <> n""",
    "d2_completion": """WITH r AS (SELECT event_id, event_type, user_id || ':' || (event_id % 40) AS request FROM events)
SELECT event_id, event_type, request, n_completed FROM (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY request) AS n_completed,
  row_number() OVER (PARTITION BY request ORDER BY event_type <> 'error' DESC, event_id DESC) AS k FROM r) WHERE k = 1""",
    "d4_process_pick": "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_tax, l_quantity, l_partkey, l_linenumber) = 1",
    "d5_best_candidate": """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'O' DESC, o_orderpriority = '1-URGENT' DESC,
  o_orderpriority[1]::INT, sha256('11:' || o_custkey || ':' || o_orderkey) DESC) = 1""",
    "d6_first_accepted": """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'held_out' WHEN o_orderstatus <> 'F' THEN 'rejected'
  WHEN o_orderkey = min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) THEN 'accepted' ELSE 'duplicate_task' END AS verdict FROM orders""",
    "d8_quotas": """WITH z AS (SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) AS of FROM orders GROUP BY 1)
SELECT o_orderpriority, (101 * n) // of + (row_number() OVER (ORDER BY (101 * n) % of DESC, o_orderpriority) <= 101 - sum((101 * n) // of) OVER ())::BIGINT AS quota FROM z""",
    "d10_subset": "SELECT p_partkey FROM part ORDER BY sha256('3:' || p_partkey), p_partkey LIMIT (SELECT greatest(1, round_even(count(*) * 0.125, 0))::BIGINT FROM part)",
    "d11_refill": """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS stratum, c_custkey % 10 AS k FROM customer),
s AS (SELECT id AS replaces, stratum, CASE WHEN k < 2 THEN 'dev' ELSE 'train' END AS split, row_number() OVER (PARTITION BY stratum ORDER BY k >= 2, id) AS n FROM c WHERE k < 6 AND id % 7 = 0),
r AS (SELECT id AS task, stratum, sha256('5:reserve:' || id) AS h, row_number() OVER (PARTITION BY stratum ORDER BY sha256('5:reserve:' || id)) AS n FROM c WHERE k >= 6),
m AS (SELECT split, task, replaces FROM s JOIN r USING (stratum, n)),
a AS (SELECT *, row_number() OVER (ORDER BY split <> 'dev', replaces) AS j FROM s WHERE replaces NOT IN (SELECT replaces FROM m)),
b AS (SELECT *, row_number() OVER (ORDER BY h) AS j FROM r WHERE task NOT IN (SELECT task FROM m))
SELECT split, task, replaces FROM m UNION ALL SELECT a.split, b.task, a.replaces FROM a JOIN b USING (j)""",
    "d12_curriculum": f"""WITH l AS (SELECT *, {_LEVEL} AS level, p_partkey % 3 = 0 AS rewrites, p_partkey % 4 = 0 AS compares FROM part),
b AS (SELECT *, CASE WHEN level = 'simple' THEN 'foundation' WHEN level = 'medium' AND NOT rewrites AND NOT compares THEN 'constraints' ELSE 'strategy' END AS bucket FROM l)
SELECT p_partkey, bucket, CASE bucket WHEN 'foundation' THEN 'a,b,c' WHEN 'constraints' THEN 'b,c' ELSE 'c' END AS stages,
  concat_ws(',', CASE WHEN compares AND p_size % 3 < 2 THEN 'candidate_comparison_under_evidenced' END, CASE WHEN p_partkey % 2 > 0 THEN 'consecutive_exact_action' END,
    CASE WHEN p_size % 8 > CASE level WHEN 'simple' THEN 2 WHEN 'medium' THEN 4 ELSE 6 END THEN 'search_heavy' END,
    CASE WHEN p_size > CASE level WHEN 'simple' THEN 10 WHEN 'medium' THEN 16 ELSE 25 END THEN 'trajectory_long' END) AS flags FROM b""",
    "d19_event_interleave": """WITH i AS (SELECT *, event_type = 'error' AS g, row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) - 1 AS idx FROM events),
p AS (SELECT *, CASE WHEN NOT g THEN idx WHEN value < 100 THEN trunc(value)::BIGINT % 20 ELSE 1073741824 END AS pos FROM i)
SELECT user_id, format('e{:04d}', row_number() OVER (PARTITION BY user_id ORDER BY pos, NOT g, idx) - 1) AS event_id, CASE WHEN g THEN 'guard' ELSE 'step' END AS kind, idx::INT AS "index" FROM p""",
    "d22_batches": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, trunc(o_totalprice)::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT o_custkey, o_orderkey, k, 0 AS batch, 1 AS held, size AS total FROM o WHERE k = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.k, f.batch + (f.held >= 3 OR f.total + o.size > 400000)::INT, CASE WHEN f.held >= 3 OR f.total + o.size > 400000 THEN 1 ELSE f.held + 1 END,
    CASE WHEN f.held >= 3 OR f.total + o.size > 400000 THEN o.size ELSE f.total + o.size END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1)
SELECT o_orderkey, batch FROM f""",
    "d23_round_robin": "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_mktsegment || ':' || c_custkey))::INT AS turn FROM customer",
    "d24_taskwise_split": """WITH t AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT least(greatest(1, round_even(count(*) * 0.1, 0)), count(*) - 1)::BIGINT AS n FROM t),
v AS (SELECT o_custkey FROM t ORDER BY sha256('13:' || o_custkey), o_custkey LIMIT (SELECT n FROM n))
SELECT o_orderkey, o_custkey, o_custkey IN (SELECT o_custkey FROM v) AS is_validation FROM orders""",
    "d14_divergence": f"""WITH {_STEPS}, s AS (SELECT user_id % 20 AS task, user_id AS attempt, turn, event_type FROM steps), a AS (SELECT task, count(DISTINCT attempt) AS n FROM s GROUP BY 1),
t AS (SELECT task, turn, count(DISTINCT event_type) AS kinds, count(DISTINCT attempt) AS present FROM s GROUP BY 1, 2)
SELECT task, min(turn) FILTER (WHERE kinds > 1 OR present < n)::INT AS first_divergence_turn FROM t JOIN a USING (task) GROUP BY 1""",
    "d15_decision_ready": f"""WITH {_STEPS}, r AS (SELECT user_id, turn, event_type, value > 50 AND bool_or(event_type = 'view') OVER w AND bool_or(event_type = 'click') OVER w AS ready FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY turn)),
f AS (SELECT user_id, min(turn) FILTER (WHERE ready) AS ready_step FROM r GROUP BY 1)
SELECT user_id, ready_step::INT AS ready_step, count(*) FILTER (WHERE turn > ready_step AND event_type <> 'purchase') AS steps_after FROM r JOIN f USING (user_id) GROUP BY 1, 2""",
    "d16_step_repeats": f"""WITH {_STEPS}, m AS (SELECT user_id, event_type, floor(value / 100) = lag(floor(value / 100)) OVER w AS same,
  event_type IN (lag(event_type, 1) OVER w) OR coalesce(event_type = lag(event_type, 2) OVER w, false) OR coalesce(event_type = lag(event_type, 3) OVER w, false) AS recent FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY turn))
SELECT user_id, count(*) FILTER (WHERE same) AS no_progress, count(*) - count(DISTINCT event_type) AS repeats, count(*) FILTER (WHERE recent) AS recent_repeats FROM m GROUP BY 1""",
    "j1_facts": "SELECT l_orderkey, l_linenumber, p_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey",
    "j8_leaked": """SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'final' ELSE 'validation' END AS split, o_custkey FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    "j9_resume_anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)",
    "j10_known_content": """SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256 FROM documents
WHERE doc_id % 2 <> 0 OR sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)""",
    "j15_contained": "SELECT doc_id, needle FROM documents JOIN (SELECT DISTINCT substr(text, 1, 30) AS needle FROM benchmark) ON contains(text, needle)",
    "u1_sets": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, 'common' AS source FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT k, 'missing' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
    "u6_array_sets": """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, ['cold', 'widget', lower(p_type)] AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct([x FOR x IN a IF list_contains(b, x)])), ',') AS common, array_to_string(list_sort(list_distinct([x FOR x IN b IF NOT list_contains(a, x)])), ',') AS missing,
  array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS "every" FROM p""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
