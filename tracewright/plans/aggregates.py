"""Aggregations (A1 to A34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as X
from ..functions.text import char_count, line_count, word_count
from ..operators import aggregates as A
from .answers import LAST_NUMBER
from .base import query, table

R6 = lambda c: F.round(c, 6)


@query("SELECT run_id, round(avg((prediction = ground_truth)::INT), 6) AS accuracy, round(avg(list_contains([prediction, 1.0], ground_truth)::INT), 6) AS membership FROM sample_results GROUP BY 1")
def a01_accuracy(spark, d):
    p, g = F.col("prediction"), F.col("ground_truth")
    return table(spark, d, "sample_results").groupBy("run_id").agg(
        R6(A.accuracy(p, g)).alias("accuracy"), R6(A.membership_accuracy(F.array(p, F.lit(1.0)), g)).alias("membership")
    )


@query(
    f"""WITH e AS (SELECT event_type, event_id, {LAST_NUMBER('props')} = user_id AS ok FROM events)
 SELECT event_type, round(avg(ok::INT), 9) AS accuracy, count(*) AS num_samples, count(*) FILTER (ok) AS num_correct FROM e GROUP BY 1""",
    name="accuracy_by_group",
)
def a02_accuracy_by_group(spark, d):
    rows = table(spark, d, "events").withColumn("ok", X.number("props") == F.col("user_id"))
    return A.summary(rows, ["event_type"], "ok").withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT DISTINCT dataset, run_id, record_id FROM sample_results WHERE correct")
def a02_correct_ids(spark, d):
    return A.correct_ids(table(spark, d, "sample_results"), ["dataset", "run_id"], "correct", "record_id")


@query(
    """SELECT dataset, round(avg(m), 6) AS macro, round(any_value(micro), 6) AS micro FROM (SELECT dataset, record_id, avg(correct::INT) AS m FROM sample_results WHERE correct IS NOT NULL GROUP BY 1, 2)
 JOIN (SELECT dataset, avg(correct::INT) AS micro FROM sample_results GROUP BY 1) USING (dataset) GROUP BY 1"""
)
def a03_macro_and_micro(spark, d):
    rows = table(spark, d, "sample_results").where("correct is not null").withColumn("x", F.col("correct").cast("int"))
    macro = A.macro_mean(rows, ["dataset"], ["record_id"], "x", "macro")
    micro = rows.groupBy("dataset").agg(F.avg("x").alias("micro"))
    return macro.join(micro, "dataset").select("dataset", R6("macro").alias("macro"), R6("micro").alias("micro"))


@query(
    """SELECT run_name, count(*) AS done, count(*) FILTER (attack_success) AS success, count(*) FILTER (NOT attack_success) AS failed, count(*) FILTER (NOT clean_correct) AS original_incorrect,
 round(100.0 * count(*) FILTER (attack_success) / count(*), 6) AS success_pct FROM search_results GROUP BY 1"""
)
def a04_success_counters(spark, d):
    ok = F.col("attack_success")
    out = A.counters(table(spark, d, "search_results"), ["run_name"], success=ok, failed=~ok, original_incorrect=~F.col("clean_correct"))
    return out.select("run_name", "done", "success", "failed", "original_incorrect", R6("success_pct").alias("success_pct"))


@query("SELECT run_name, round(avg(coalesce(baseline_logit_diff, best_logit_diff)), 6) AS mean_diff FROM search_results WHERE attack_success GROUP BY 1")
def a05_mean_with_fallback(spark, d):
    rows = table(spark, d, "search_results").where("attack_success")
    return rows.groupBy("run_name").agg(R6(F.avg(F.coalesce("baseline_logit_diff", "best_logit_diff"))).alias("mean_diff"))


@query("SELECT run_name, dataset, round(avg(len(scores)), 6) AS mean_steps FROM search_results GROUP BY 1, 2")
def a06_mean_array_length(spark, d):
    return table(spark, d, "search_results").groupBy("run_name", "dataset").agg(R6(F.avg(F.size("scores"))).alias("mean_steps"))


@query("SELECT p_type, count(*) AS n, count(*) - 1 AS parity FROM part GROUP BY 1")
def a07_histogram(spark, d):
    return A.histogram(table(spark, d, "part"), "p_type")


def _describe_sql(name: str, x: str) -> str:
    return f"""round(avg({x}), 6) AS {name}_mean, round(stddev_pop({x}), 6) AS {name}_std, min({x})::DOUBLE AS {name}_min, max({x})::DOUBLE AS {name}_max,
 round(quantile_cont({x}::DOUBLE, 0.5), 6) AS {name}_median, round(quantile_cont({x}::DOUBLE, 0.95), 6) AS {name}_p95"""


@query(
    rf"""WITH m AS (SELECT lang, length(text) AS c, length(text) - length(replace(text, chr(10), '')) + 1 AS l, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS w FROM documents)
 SELECT lang, {_describe_sql('chars', 'c')}, {_describe_sql('lines', 'l')}, {_describe_sql('words', 'w')} FROM m GROUP BY 1"""
)
def a08_describe_lengths(spark, d):
    out = A.describe(table(spark, d, "documents"), ["lang"], {"chars": char_count("text"), "lines": line_count("text"), "words": word_count("text")})
    return out.select("lang", *(R6(c).alias(c) for c in out.columns[1:]))


_MASKED = "packed_inputs p, (SELECT 1) WHERE labels IS NOT NULL"


@query(
    """SELECT ds_name, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, round(var_samp(x), 4) AS var FROM (SELECT ds_name, unnest(input_ids) AS x, unnest(labels) AS y FROM packed_inputs) WHERE y <> -100 GROUP BY 1"""
)
def a09_masked_metrics(spark, d):
    rows = table(spark, d, "packed_inputs").withColumn("m", F.transform("labels", lambda y: (y != -100).cast("int")))
    out = A.masked_stats(rows, "input_ids", "m", ["ds_name"])
    return out.select("ds_name", R6("mean").alias("mean"), "min", "max", F.round("var", 4).alias("var"))


@query(
    """SELECT run_id, round(avg((len = 30)::INT), 6) AS clipped, round(1 - var_samp(t - v) / (var_samp(t) + 1e-5), 5) AS explained FROM
 (SELECT run_id, length(model_output) AS len, ground_truth AS t, prediction AS v FROM sample_results WHERE ground_truth < 'inf'::DOUBLE AND prediction < 'inf'::DOUBLE) GROUP BY 1"""
)
def a09_clip_and_explained(spark, d):
    rows = table(spark, d, "sample_results").where("ground_truth < double('inf') and prediction < double('inf')")  # infinity stands for no number
    return rows.groupBy("run_id").agg(
        R6(A.clip_ratio(F.length("model_output"), F.lit(30))).alias("clipped"), F.round(A.explained_variance(F.col("prediction"), F.col("ground_truth")), 5).alias("explained")
    )


@query("SELECT event_type AS key, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a10_mean_of_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(R6(F.avg("value")).alias("mean"))


@query(
    """WITH t AS (SELECT ds_name, sum(len(input_ids)) AS tokens FROM packed_inputs GROUP BY 1), p AS (SELECT ds_name, count(*) * 0.25 AS seconds FROM packed_inputs GROUP BY 1)
 SELECT ds_name, round(seconds * 1000 / tokens, 6)::DOUBLE AS ms_per_token, round(tokens / (seconds * 4), 6)::DOUBLE AS tokens_per_gpu_second FROM t JOIN p USING (ds_name)"""
)
def a11_throughput(spark, d):
    p = table(spark, d, "packed_inputs")
    tokens = p.groupBy("ds_name").agg(F.sum(F.size("input_ids")).alias("tokens"))
    seconds = p.groupBy("ds_name").agg((F.count("*") * 0.25).alias("seconds"))
    both = tokens.join(seconds, "ds_name")
    return both.select("ds_name", R6(F.col("seconds") * 1000 / F.col("tokens")).alias("ms_per_token"), R6(F.col("tokens") / (F.col("seconds") * 4)).alias("tokens_per_gpu_second"))


@query("SELECT user_id, min(value) AS min_len, round(avg(value), 6) AS mean_len, count(value) AS cnt FROM events GROUP BY 1")
def a12_running_stats(spark, d):
    out = A.running_stats(table(spark, d, "events"), ["user_id"], "value")
    return out.withColumn("mean_len", R6("mean_len"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS seen FROM events GROUP BY 1")
def a13_sticky_or(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("seen"))


@query("SELECT l_returnflag, round(sum((l_linestatus = 'F')::INT * l_quantity) / (sum((l_linestatus = 'F')::INT) + 1e-8), 6) AS mean FROM lineitem GROUP BY 1")
def a14_conditional_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(R6(A.mean_when_right(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("mean"))


@query("SELECT l_shipdate < TIMESTAMPTZ '1995-01-01' AS early, round(avg(l_discount), 6) AS mean, round(1.96 * stddev_pop(l_discount) / sqrt(count(l_discount)), 8) AS half FROM lineitem GROUP BY 1")
def a15_confidence(spark, d):
    x = F.col("l_discount")
    early = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")
    return table(spark, d, "lineitem").groupBy(early.alias("early")).agg(R6(F.avg(x)).alias("mean"), F.round(A.confidence(x), 8).alias("half"))


@query(
    """WITH m AS (SELECT avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'N')
 SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - m) / sqrt(v + 1e-8), 6) AS white FROM lineitem, m""",
    name="masked_whiten",
)
def a16_masked_whiten(spark, d):
    rows = table(spark, d, "lineitem").withColumn("kept", F.col("l_returnflag") == "N")
    out = A.whiten(rows, "l_extendedprice", "kept")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", R6("white").alias("white"))


@query("SELECT user_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS x FROM events) GROUP BY 1")
def a17_nan_stats(spark, d):
    rows = table(spark, d, "events").withColumn("x", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")))
    out = A.nan_stats(rows, ["user_id"], "x")
    return out.select("user_id", R6("mean").alias("mean"), R6("std").alias("std"), "min", "max")


@query("SELECT event_id, round(0.5 * value + 2.0 * CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END, 6) AS reward FROM events")
def a18_weighted_nansum(spark, d):
    second = F.when(F.col("user_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double"))
    reward = A.weighted_nansum(F.array("value", second), F.array(F.lit(0.5), F.lit(2.0)))
    return table(spark, d, "events").select("event_id", R6(reward).alias("reward"))


@query(
    """SELECT split, dataset, round(avg(cot_word_count), 6) AS mean_length, round(1 - avg((answer IS NOT NULL AND steps IS NOT NULL)::INT), 6) AS clipped_ratio,
 round(coalesce(avg(cot_word_count) FILTER (answer IS NOT NULL AND steps IS NOT NULL), 0), 6) AS mean_terminated, coalesce(min(cot_word_count) FILTER (answer IS NOT NULL AND steps IS NOT NULL), 0)::DOUBLE AS min_terminated,
 coalesce(max(cot_word_count) FILTER (answer IS NOT NULL AND steps IS NOT NULL), 0)::DOUBLE AS max_terminated FROM cot_records GROUP BY 1, 2"""
)
def a19_terminated_stats(spark, d):
    rows = table(spark, d, "cot_records").withColumn("done", F.col("answer").isNotNull() & F.col("steps").isNotNull())
    out = A.terminated_stats(rows, ["split", "dataset"], "cot_word_count", "done")
    return out.select("split", "dataset", *(R6(c).alias(c) for c in out.columns[2:]))


@query("SELECT v AS value, count(label) AS n FROM (SELECT unnest(range(0, 24)) AS v) LEFT JOIN embeddings ON label = v GROUP BY 1")
def a20_bincount_full(spark, d):
    return A.bincount(table(spark, d, "embeddings"), "label", 24)


@query("SELECT series, count(*) AS n_clusters, round(avg(n), 6) AS mean_members, round(avg(a), 6) AS mean_accuracy FROM (SELECT series, lang, count(*) AS n, avg((n_chars > 800)::INT) AS a FROM documents GROUP BY 1, 2) GROUP BY 1")
def a21_cluster_stats(spark, d):
    rows = table(spark, d, "documents").withColumn("ok", F.col("n_chars") > 800)
    out = A.cluster_stats(rows, "series", "lang", "ok")
    return out.select("series", "n_clusters", R6("mean_members").alias("mean_members"), R6("mean_accuracy").alias("mean_accuracy"))


@query(
    """SELECT dataset, round(avg(a / greatest(b, 1)), 6) AS ratio, round(avg((1 - b / a) * 100), 6) AS saved_pct FROM (SELECT dataset, length(cot)::DOUBLE AS a, length(answer)::DOUBLE AS b FROM cot_records WHERE cot IS NOT NULL AND answer IS NOT NULL) WHERE a > 0 GROUP BY 1"""
)
def a22_compression(spark, d):
    rows = table(spark, d, "cot_records").where("cot is not null and answer is not null").select("dataset", F.length("cot").cast("double").alias("a"), F.length("answer").cast("double").alias("b"))
    out = A.compression(rows, ["dataset"], "a", "b")
    return out.select("dataset", R6("ratio").alias("ratio"), R6("saved_pct").alias("saved_pct"))


@query("SELECT count(*) AS total, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*), 9) AS accuracy FROM sample_results")
def a23_partial_counts(spark, d):
    """Partial sums per partition, then one final sum: Spark's own two-phase aggregate."""
    return table(spark, d, "sample_results").agg(F.count("*").alias("total"), F.count_if("correct").alias("n_correct")).withColumn("accuracy", F.round(F.col("n_correct") / F.col("total"), 9))


@query("SELECT ds_name, 6 * 1000.0::DOUBLE * sum(n) + 12 * sum(n * n) * 64 * 4 AS flops, sum(n) AS tokens FROM (SELECT ds_name, len(input_ids)::DOUBLE AS n FROM packed_inputs) GROUP BY 1")
def a24_training_flops(spark, d):
    return A.training_flops(table(spark, d, "packed_inputs").withColumn("n", F.size("input_ids")), ["ds_name"], "n", 64, 4, 1000.0)


@query("SELECT min(s)::BIGINT AS min, max(s)::BIGINT AS max, (max(s) - min(s))::BIGINT AS diff, round(avg(s), 6) AS mean FROM (SELECT doc_id % 7 AS k, sum(n_chars) AS s FROM documents GROUP BY 1)")
def a25_imbalance(spark, d):
    out = A.imbalance(table(spark, d, "documents").withColumn("k", F.col("doc_id") % 7), "k", "n_chars")
    return out.withColumn("mean", R6("mean"))


@query("SELECT dataset, round(avg(a), 6) AS accuracy FROM (SELECT dataset, run_id, avg((prediction = ground_truth)::INT) AS a FROM sample_results GROUP BY 1, 2) GROUP BY 1")
def a26_mean_over_runs(spark, d):
    rows = table(spark, d, "sample_results").withColumn("x", (F.col("prediction") == F.col("ground_truth")).cast("double"))
    return A.macro_mean(rows, ["dataset"], ["run_id"], "x", "accuracy").withColumn("accuracy", R6("accuracy"))


def _logs(spark, d):
    """Two arrays of log probabilities, both halves of an embedding, and a mask."""
    half = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", half(1).alias("p"), half(33).alias("q"), F.expr("transform(sequence(1, 32), i -> if((i + label) % 3 > 0, 1, 0))").alias("m"))


_LOGS = """logs AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS p, embedding[i + 32]::DOUBLE AS q, (i + label) % 3 > 0 AS m FROM embeddings, range(1, 33) r(i))"""


@query(
    f"""WITH {_LOGS}, s AS (SELECT vec_id, label, avg(p - q) AS kl, avg(abs(p - q)) AS ab, avg((p - q) ** 2 / 2) AS mse, avg(least(greatest(exp(q - p) - (q - p) - 1, -10), 10)) AS low FROM logs WHERE m GROUP BY 1, 2)
, f AS (SELECT vec_id, avg(t) AS whole FROM (SELECT vec_id, (i - 1) // 8 AS token, sum(exp(q) * (q - p)) AS t FROM logs GROUP BY 1, 2) GROUP BY 1)
 SELECT label, round(avg(kl), 6) AS kl, round(avg(ab), 6) AS abs, round(avg(mse), 6) AS mse, round(avg(low), 6) AS low_var_kl, round(avg(whole), 6) AS "full" FROM s JOIN f USING (vec_id) GROUP BY 1"""
)
def a27_kl_penalty(spark, d):
    rows = _logs(spark, d)
    per = [A.array_mean(A.kl_terms(F.col("p"), F.col("q"), k), F.col("m")).alias(k) for k in A.KL_KINDS]
    # A distribution of eight per token for the divergence of whole distributions.
    spread = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.slice(c, t * 8 + 1, F.lit(8)))
    terms = A.kl_terms(spread(F.col("q")), spread(F.col("p")), "full")
    per.append((A.total(terms) / F.size(terms)).alias("full"))
    return rows.select("label", *per).groupBy("label").agg(*(R6(F.avg(k)).alias(k) for k in (*A.KL_KINDS, "full")))


@query(
    f"""WITH {_LOGS}, t AS (SELECT *, label % 3 - 1.0 AS a, exp(p - q) AS r FROM logs WHERE m), l AS (SELECT vec_id, -a * r AS plain, -a * least(greatest(r, 0.8), 1.3) AS cut, -a * 3.0 AS far, a, q - p AS kl FROM t),
 u AS (SELECT *, greatest(plain, cut) AS upper FROM l)
 SELECT vec_id, round(avg(CASE WHEN a < 0 THEN least(upper, far) ELSE upper END), 6) AS loss, round(avg((plain < cut)::INT), 6) AS clipped_high, round(avg((upper > far AND a < 0)::INT), 6) AS clipped_low, round(avg(kl), 6) AS kl FROM u GROUP BY 1"""
)
def a28_policy_loss(spark, d):
    rows = _logs(spark, d).withColumn("a", F.transform("p", lambda x: F.col("label") % 3 - 1.0))
    terms = rows.select("vec_id", "m", A.policy_terms(F.col("q"), F.col("p"), F.col("a")).alias("t"))
    mean = lambda f: R6(A.array_mean(F.transform("t", lambda x: x[f]), F.col("m")))
    return terms.select("vec_id", mean("loss").alias("loss"), mean("high").alias("clipped_high"), mean("low").alias("clipped_low"), mean("kl").alias("kl"))


@query(
    f"""WITH {_LOGS}, t AS (SELECT vec_id, (p - 0.1) ** 2 AS e, (least(greatest(p, q - 0.05), q + 0.05) - 0.1) ** 2 AS c FROM logs WHERE m)
 SELECT vec_id, round(avg(greatest(e, c) / 2), 6) AS loss, round(avg((e < c)::INT), 6) AS clipped FROM t GROUP BY 1"""
)
def a29_value_loss(spark, d):
    target = F.transform("p", lambda x: F.lit(0.1))
    terms = _logs(spark, d).select("vec_id", "m", A.value_terms(F.col("p"), target, F.col("q"), 0.05).alias("t"))
    mean = lambda f: R6(A.array_mean(F.transform("t", lambda x: x[f]), F.col("m")))
    return terms.select("vec_id", mean("loss").alias("loss"), mean("clipped").alias("clipped"))


@query("SELECT split, round(avg((array_to_string(steps, chr(10)) = cot)::INT), 6) AS cot_match, round(avg((answer = regexp_extract_all(cot, '[0-9]+')[-1])::INT), 6) AS answer_match FROM cot_records WHERE cot IS NOT NULL AND answer IS NOT NULL AND steps IS NOT NULL GROUP BY 1")
def a30_exact_matches(spark, d):
    rows = table(spark, d, "cot_records").where("cot is not null and answer is not null and steps is not null")
    last = F.try_element_at(F.regexp_extract_all("cot", F.lit("[0-9]+"), F.lit(0)), F.lit(-1))
    return rows.groupBy("split").agg(R6(F.avg((F.array_join("steps", "\n") == F.col("cot")).cast("int"))).alias("cot_match"), R6(F.avg((F.col("answer") == last).cast("int"))).alias("answer_match"))


@query(
    """WITH RECURSIVE b AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_nationkey / 10.0::DOUBLE AS kl FROM nation),
 f AS (SELECT k, 0::BIGINT AS i, 0.2::DOUBLE AS c FROM (SELECT DISTINCT k FROM b) UNION ALL SELECT f.k, b.i, f.c * (1 + least(greatest(b.kl / 1.0 - 1, -0.2), 0.2) * 8 / 100) FROM f JOIN b ON b.k = f.k AND b.i = f.i + 1)
 SELECT k AS n_regionkey, round(arg_max(c, i), 9) AS coefficient FROM f GROUP BY 1"""
)
def a31_adaptive_kl(spark, d):
    batch = F.struct("n_nationkey", (F.col("n_nationkey") / 10.0).alias("kl"), F.lit(8).alias("n"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(batch)).alias("b"))
    return rows.select("n_regionkey", F.round(A.adaptive_kl(F.col("b"), 0.2, 1.0, 100.0), 9).alias("coefficient"))


@query(
    """WITH v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS a, embedding[i + 32]::DOUBLE AS b FROM embeddings, range(1, 33) r(i)),
 s AS (SELECT *, exp(a - max(a) OVER w) / sum(exp(a)) OVER w * exp(max(a) OVER w) AS p, exp(b) / sum(exp(b)) OVER w AS q FROM v WINDOW w AS (PARTITION BY vec_id)),
 l AS (SELECT vec_id, avg((a - b) ** 2) AS mse, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cos, avg(q * (ln(q) - ln(p))) AS kl, avg(CASE WHEN abs(a - b) <= 1 THEN (a - b) ** 2 / 2 ELSE abs(a - b) - 0.5 END) AS huber FROM s GROUP BY 1)
 SELECT vec_id, round(mse, 6) AS mse, round(cos, 6) AS cosine, round(kl, 6) AS kl, round(huber, 6) AS huber, round(0.5 * mse + 0.3 * cos + 0.2 * kl, 6) AS combined FROM l"""
)
def a32_vector_losses(spark, d):
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    losses = {"mse": A.vector_mse, "cosine": A.vector_cosine_loss, "kl": A.vector_kl, "huber": A.vector_huber, "combined": A.combined_loss}
    return table(spark, d, "embeddings").select("vec_id", *(R6(f(a, b)).alias(k) for k, f in losses.items()))


@query("SELECT run_name, count(*) FILTER (attack_success AND len(scores) < 10) AS stopped_early, round(avg(CASE WHEN attack_success THEN len(scores) + 1 ELSE 50 END), 6) AS mean_iterations FROM search_results GROUP BY 1")
def a33_iterations(spark, d):
    n = F.size("scores")
    ran = F.when(F.col("attack_success"), n + 1).otherwise(50)
    return table(spark, d, "search_results").groupBy("run_name").agg(F.count_if(F.col("attack_success") & (n < 10)).alias("stopped_early"), R6(F.avg(ran)).alias("mean_iterations"))


@query(
    """SELECT dataset, round(n / evaluated, 6) AS accuracy, round(n / whole, 6) AS parity FROM (SELECT dataset, count(*) FILTER (correct) AS n, count(*) AS evaluated FROM sample_results GROUP BY 1)
 JOIN (SELECT dataset, count(*) AS whole FROM cot_records GROUP BY 1) USING (dataset)"""
)
def a34_denominators(spark, d):
    """Correct rows over evaluated rows, and over the whole dataset as a known quirk."""
    done = table(spark, d, "sample_results").groupBy("dataset").agg(F.count_if("correct").alias("n"), F.count("*").alias("evaluated"))
    whole = table(spark, d, "cot_records").groupBy("dataset").agg(F.count("*").alias("whole"))
    return done.join(whole, "dataset").select("dataset", R6(F.col("n") / F.col("evaluated")).alias("accuracy"), R6(F.col("n") / F.col("whole")).alias("parity"))
