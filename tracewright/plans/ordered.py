"""Windows, recurrences, ranking and sampling (W, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import windows as W
from ..operators.aggregates import whiten
from .base import query, table, turn, turn_sql

R6 = lambda c: F.round(c, 6)


@query(
    """SELECT o_orderkey, o_custkey, round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_samp(o_totalprice) OVER w + 1e-6), 6) AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey) QUALIFY count(*) OVER w > 1""",
    name="group_norm_advantage",
)
def w01_group_norm_advantage(spark, d):
    out = W.group_advantage(table(spark, d, "orders"), "o_custkey", "o_totalprice", single="drop")
    return out.select("o_orderkey", "o_custkey", R6("advantage").alias("advantage"))


def _rollouts(spark, d):
    """Rollouts of tokens with step scores: one per event, eight tokens each."""
    return table(spark, d, "events").select(
        "event_id",
        (F.col("user_id") % 40).alias("uid"),
        F.expr("transform(sequence(0, 7), i -> CASE WHEN i = 2 + event_id % 2 THEN value WHEN i = 7 THEN value / 2 ELSE 0D END)").alias("scores"),
        F.expr("array(CAST(2 + event_id % 2 AS INT), 7)").alias("ends"),
        F.expr("array(CAST(event_id % 2 AS INT))").alias("delims"),
        F.expr("transform(sequence(0, 7), i -> IF(i < 4 + event_id % 5, 1, 0))").alias("mask"),
    )


@query(
    """WITH e AS (SELECT event_id, user_id % 40 AS uid, value, 2 + event_id % 2 AS p, 4 + event_id % 5 AS n, event_id % 2 AS dl FROM events),
 s AS (SELECT uid, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS k FROM (SELECT uid, value AS x FROM e UNION ALL SELECT uid, value / 2 FROM e) GROUP BY 1),
 t AS (SELECT e.*, (value - m) / (sd + 1e-6) * 1.78 / (sqrt(k - 1) + 1e-6) AS a, (value / 2 - m) / (sd + 1e-6) * 1.78 / (sqrt(k - 1) + 1e-6) AS b FROM e JOIN s USING (uid))
 SELECT event_id, i AS pos, round(CASE WHEN i >= n OR (i >= dl AND i < dl + 5) THEN 0 WHEN i <= p THEN a ELSE b END, 6)::DOUBLE AS advantage FROM t, range(0, 8) r(i)"""
)
def w02_step_advantage(spark, d):
    out = W.step_advantage(_rollouts(spark, d), "uid", "event_id", "scores", "ends", "delims", "mask")
    return out.select("event_id", F.posexplode("advantage").alias("pos", "advantage")).select("event_id", F.col("pos").cast("long").alias("pos"), (R6("advantage") + 0.0).alias("advantage"))


@query(
    """SELECT o_orderkey, round(o_totalprice - (sum(o_totalprice) OVER w - o_totalprice) / (count(*) OVER w - 1) + 1e-6, 4) AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey) QUALIFY count(*) OVER w > 1""",
    name="leave_one_out_advantage",
)
def w03_leave_one_out(spark, d):
    return W.leave_one_out(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", F.round(F.col("advantage") + 1e-6, 4).alias("advantage"))  # off the ties of cents


@query("SELECT event_id, i AS pos, CASE WHEN i < 1 + event_id % 4 THEN round(value * 2 - 10, 6) ELSE 0 END AS advantage FROM events, range(0, 4) r(i)")
def w04_baseline_advantage(spark, d):
    mask = F.expr("transform(sequence(0, 3), i -> IF(i < 1 + event_id % 4, 1, 0))")
    value = R6(F.col("value") * 2 - 10)
    rows = table(spark, d, "events").select("event_id", F.posexplode(W.broadcast_to_mask(value, mask)).alias("pos", "advantage"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), (F.col("advantage") + 0.0).alias("advantage"))


@query(
    """WITH g AS (SELECT event_id, event_id // 8 AS grp, value FROM events) SELECT event_id, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-4), 6) AS scaled, round(value - avg(value) OVER w, 6) AS centred FROM g WINDOW w AS (PARTITION BY grp) QUALIFY count(*) OVER w > 1"""
)
def w05_fixed_group_advantage(spark, d):
    rows = W.fixed_groups(table(spark, d, "events"), "event_id", 8)
    a = W.group_advantage(rows, "group", "value", "scaled", eps=1e-4, single="drop")
    b = W.group_advantage(a, "group", "value", "centred", single="drop", scale=False)
    return b.select("event_id", R6("scaled").alias("scaled"), R6("centred").alias("centred"))


@query(
    """WITH z AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS x FROM events)
 SELECT user_id, event_id, coalesce(first_value(nullif(x, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled FROM z""",
    name="zero_backfill",
)
def w06_zero_backfill(spark, d):
    rows = table(spark, d, "events").withColumn("x", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return W.backfill(rows, ["user_id"], "event_id", "x", "filled").select("user_id", "event_id", "filled")


# The recurrences in closed form: with i counted from the end, what follows a row weighs c^(distance).
_SEQ = """e AS (SELECT user_id, event_id, value AS r, (event_type <> 'error')::INT AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) / 10 AS nv FROM events),
 g AS (SELECT user_id, event_id, m, r / 10 AS v, sum((r - r / 10 + 0.9 * nv) * pow(0.72::DOUBLE, -i)) OVER (PARTITION BY user_id ORDER BY i) * pow(0.72::DOUBLE, i) AS a FROM e)"""


@query(f"WITH {_SEQ} SELECT user_id, event_id, round(a, 6) AS advantage, round(a + v, 6) AS ret FROM g", name="gae")
def w07_gae(spark, d):
    out = W.gae_rows(table(spark, d, "events"), ["user_id"], "event_id", F.col("value"), F.col("value") / 10, 0.9, 0.8)
    return out.select("user_id", "event_id", R6("advantage").alias("advantage"), R6("ret").alias("ret"))


@query(f"WITH {_SEQ}, w AS (SELECT avg(a) AS mean, var_samp(a) AS dev FROM g WHERE m = 1) SELECT user_id, event_id, round((a - mean) / sqrt(dev + 1e-8), 6) AS white FROM g, w")
def w07_gae_whitened(spark, d):
    out = W.gae_rows(table(spark, d, "events"), ["user_id"], "event_id", F.col("value"), F.col("value") / 10, 0.9, 0.8)
    rows = whiten(out.withColumn("m", F.col("event_type") != "error"), "advantage", "m")
    return rows.select("user_id", "event_id", R6("white").alias("white"))


@query(
    """WITH e AS (SELECT user_id, event_id, value AS r, row_number() OVER w AS i, coalesce(sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC)),
 g AS (SELECT user_id, event_id, sum(r * pow(0.95::DOUBLE, -i)) OVER (PARTITION BY user_id, cut ORDER BY i) * pow(0.95::DOUBLE, i) AS a FROM e) SELECT user_id, event_id, round(a + 1e-7, 4) AS ret FROM g""",
    name="discounted_return",
)
def w08_discounted_return(spark, d):
    out = W.discounted_rows(table(spark, d, "events"), ["user_id"], "event_id", F.col("value"), (F.col("event_type") != "error").cast("int"), 0.95)
    return out.select("user_id", "event_id", F.round(F.col("ret") + 1e-7, 4).alias("ret"))


@query(
    """WITH m AS (SELECT user_id, event_id, (coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS mask FROM events)
 SELECT user_id, event_id, mask, greatest(sum(mask) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 0)::BIGINT AS position FROM m""",
    name="mask_to_first_stop",
)
def w09_mask_to_first_stop(spark, d):
    rows = W.rows_to_stop(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error", "mask")
    return W.positions(rows, ["user_id"], "event_id", "mask", "position").select("user_id", "event_id", "mask", "position")


@query("SELECT row_id, ingested, CASE WHEN p = 0 THEN n ELSE least(p, n) END::BIGINT AS kept FROM (SELECT row_id, epoch_us(ingested_at) AS ingested, coalesce(list_position(input_ids, 103), 0) AS p, len(input_ids) AS n FROM packed_inputs)")
def w09_mask_array(spark, d):
    mask = W.mask_to_stop(F.col("input_ids"), 103)
    rows = table(spark, d, "packed_inputs").select("row_id", F.unix_micros("ingested_at").alias("ingested"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("kept"))
    return rows


@query(
    """WITH p AS (SELECT p_brand, p_partkey, p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand) AS p FROM part),
 c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY p_brand ORDER BY p DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT p_brand, p_partkey FROM c WHERE before <= 0.333"""
)
def w11_top_p(spark, d):
    from pyspark.sql import Window

    share = F.col("p_retailprice") / F.sum("p_retailprice").over(Window.partitionBy("p_brand"))
    return W.top_p(table(spark, d, "part").withColumn("p", share), ["p_brand"], "p", "p_partkey", 0.333).select("p_brand", "p_partkey")


@query(
    """SELECT split, attack_success, problem_id FROM (SELECT r.split, s.attack_success, s.problem_id, row_number() OVER (PARTITION BY r.split, s.attack_success ORDER BY s.problem_id) AS k FROM (SELECT DISTINCT problem_id, record_id, attack_success FROM search_results) s JOIN cot_records r USING (record_id)) WHERE k <= 5""",
    name="first_n_per_class",
)
def w12_first_n_per_class(spark, d):
    rows = table(spark, d, "search_results").select("problem_id", "record_id", "attack_success").distinct().join(table(spark, d, "cot_records").select("record_id", "split"), "record_id")
    return W.first_n(rows, ["split", "attack_success"], "problem_id", 5).select("split", "attack_success", "problem_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row_id FROM documents")
def w13_number_rows(spark, d):
    return W.number_rows(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], blocks=8).select("doc_id", "row_id")


@query("SELECT event_id, i AS pos, (CASE WHEN i = event_id % 6 THEN value ELSE 0 END)::DOUBLE AS last, (CASE WHEN i = 1 THEN 0.5 WHEN i = 3 THEN value ELSE 0 END)::DOUBLE AS placed FROM events, range(0, 6) r(i)")
def w14_place_scores(spark, d):
    last = W.place_scores(F.col("event_id") % 6 + 1, 6, F.col("value"))
    at = W.place_at(F.array(F.lit(1), F.lit(3)), F.array(F.lit(0.5), F.col("value")), 6)
    rows = table(spark, d, "events").select("event_id", F.posexplode(F.arrays_zip(last.alias("last"), at.alias("placed"))).alias("pos", "z"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), "z.last", "z.placed")


@query("SELECT record_id, i // 2 AS pair, string_agg(s, ' ' ORDER BY i) AS text FROM (SELECT record_id, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS i FROM cot_records WHERE steps IS NOT NULL) GROUP BY 1, 2")
def w15_joined_pairs(spark, d):
    rows = table(spark, d, "cot_records").where("steps is not null").select("record_id", F.posexplode(W.joined_pairs(F.col("steps"))).alias("pair", "text"))
    return rows.select("record_id", F.col("pair").cast("long").alias("pair"), "text")


# ------------------------------------------------------------------ ranking


@query(
    f"""SELECT p_partkey, g = 1 AS refilled FROM (SELECT p_partkey, 0 AS g, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size = 1
 UNION ALL SELECT p_partkey, 1, row_number() OVER (ORDER BY {turn_sql('p_partkey')}, p_partkey) FROM part WHERE p_size BETWEEN 2 AND 9) ORDER BY g, r LIMIT 1000"""
)
def t01_topk_with_refill(spark, d):
    """Few parts have the asked size, so that others fill up."""
    parts = table(spark, d, "part")
    return K.top_k_with_refill(parts, "p_retailprice", "p_partkey", F.col("p_size") == 1, 1000, parts.where("p_size between 2 and 9"), turn=turn("p_partkey"))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best, max(p_retailprice) AS most, arg_min(p_partkey, (p_retailprice, p_partkey)) AS worst FROM part GROUP BY 1", name="best_candidate")
def t02_best_candidate(spark, d):
    parts = table(spark, d, "part")
    best = K.best_row(parts, ["p_brand"], "p_retailprice", "p_partkey", "p_partkey").toDF("p_brand", "best", "most")
    worst = K.best_row(parts, ["p_brand"], "p_retailprice", "p_partkey", "p_partkey", largest=False).select("p_brand", F.col("p_partkey").alias("worst"))
    return best.join(worst, "p_brand")


@query("SELECT p_brand, p_type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type)::INT AS rank FROM part GROUP BY 1, 2) WHERE rank <= 5", name="histogram_topk")
def t03_histogram_topk(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return K.top_per_group(counts, ["p_brand"], "n", "p_type", 5)


@query(f"SELECT model_output FROM (SELECT DISTINCT model_output FROM sample_results WHERE model_output IS NOT NULL) ORDER BY {turn_sql('model_output')}, 1 LIMIT 20")
def t04_logging_sample(spark, d):
    rows = table(spark, d, "sample_results").where("model_output is not null").select("model_output").distinct()
    return K.hashed_sample(rows, "model_output", 20, turn=turn("model_output"))


@query("SELECT n_name, 24 - n_nationkey AS pos FROM nation")
def t05_reorder(spark, d):
    from ..operators.relational import reorder

    n = table(spark, d, "nation")
    return reorder(n, "n_nationkey", n.select((F.lit(24) - F.col("n_nationkey")).alias("pos"), "n_nationkey")).select("n_name", "pos")


@query("SELECT DISTINCT run_id, regexp_extract(run_id, '(\\d+)', 1)::BIGINT AS number FROM sample_results WHERE run_id LIKE 'run-%'")
def t06_number_in_name(spark, d):
    return K.by_number_in_name(table(spark, d, "sample_results").where("run_id like 'run-%'").select("run_id").distinct(), "run_id")


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k > 3")
def t07_beyond_newest(spark, d):
    return K.beyond_newest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", 3).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query(
    """WITH r AS (SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events) SELECT user_id, min(event_id) AS stopped_at, arg_min(best, event_id) AS best FROM r WHERE best > 80 GROUP BY 1""",
    name="running_best_stop",
)
def t08_running_best_stop(spark, d):
    return K.first_beyond(table(spark, d, "events"), ["user_id"], "event_id", "value", 80.0)


@query("SELECT count(*) AS n, count(DISTINCT pos) AS n_pos, 0::BIGINT AS first, max(pos) AS last, 24::BIGINT AS n_keys FROM (SELECT unnest(range(0, 24 * 2 * 3)) AS pos)")
def t09_repeat_sampler(spark, d):
    """25 rows in batches of 8: one row is dropped, the others come six times each."""
    out = K.repeat_sampler(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 25, 8, 2, 3)
    return out.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("n_pos"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("n_nationkey").alias("n_keys"))


@query(f"SELECT ds_name, count(*) AS n FROM packed_inputs WHERE {turn_sql('row_id')} < CASE ds_name WHEN 'chart_steps' THEN 1.0 WHEN 'visual_cot' THEN 0.5 WHEN 'region_crops' THEN 0.25 ELSE 0 END GROUP BY 1")
def t10_weighted_mix(spark, d):
    out = K.weighted_mix(table(spark, d, "packed_inputs"), "ds_name", {"chart_steps": 2.0, "visual_cot": 1.0, "region_crops": 0.5}, "row_id", turn=turn("row_id"))
    return out.groupBy("ds_name").agg(F.count("*").alias("n"))


@query("SELECT problem_id, run_name, pos, score FROM (SELECT DISTINCT problem_id, run_name, unnest(scores[1:50]) AS score, generate_subscripts(scores[1:50], 1) - 1 AS pos FROM search_results)")
def t11_first_scores(spark, d):
    rows = table(spark, d, "search_results").select("problem_id", "run_name", F.posexplode(K.first_items(F.col("scores"), 50)).alias("pos", "score"))
    return rows.withColumn("pos", F.col("pos").cast("long")).distinct()


@query("SELECT i % 25 AS n_nationkey, i AS pos FROM range(0, 60) r(i)")
def t12_scaled_epoch(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return K.scaled_epoch(rows, "n_nationkey", 25, 60)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 2")
def t13_keep_newest(spark, d):
    return K.newest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", 2).select("o_custkey", "o_orderkey")
