"""Projections, joins, set operations, row shapes (P, J, U, Q12 to Q16).

Query names of projections begin with "sel_" as "p" followed by a number
belongs to the training-data problems.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import relational as R
from .base import query, table, turn, turn_sql


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def sel_p01_select(spark, d):
    return R.select(table(spark, d, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderstatus, 'popped' AS part FROM orders UNION ALL SELECT o_orderkey, NULL, o_orderstatus, 'rest' FROM orders")
def sel_p02_pop(spark, d):
    popped, rest = R.pop(table(spark, d, "orders").drop("o_orderdate", "o_custkey", "o_orderpriority"), ["o_orderkey"], ["o_totalprice"])
    none = F.lit(None)
    return popped.select("o_orderkey", "o_totalprice", none.cast("string").alias("o_orderstatus"), F.lit("popped").alias("part")).unionByName(
        rest.select("o_orderkey", none.cast("double").alias("o_totalprice"), "o_orderstatus", F.lit("rest").alias("part"))
    )


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def sel_p03_rename(spark, d):
    return R.rename(table(spark, d, "nation"), ["n_nationkey", "n_name"], ["id", "name"])


@query("SELECT event_id, event_type FROM events WHERE event_id >= 100 AND event_id < 300")
def sel_p04_key_range(spark, d):
    return R.key_range(table(spark, d, "events"), "event_id", 100, 300).select("event_id", "event_type")


@query("SELECT * FROM (VALUES (1, 'a', 0.5::DOUBLE), (2, 'b', NULL)) t(id, name, score)")
def sel_p05_build(spark, d):
    return R.build(spark, {"id": [1, 2], "name": ["a", "b"], "score": [0.5, None]}, "id int, name string, score double")


_CORRECT = "SELECT record_id, row_number() OVER (ORDER BY max(evaluated_at) DESC, record_id) AS pos FROM sample_results WHERE correct GROUP BY record_id"


@query(
    f"""WITH c AS ({_CORRECT}) SELECT 'first_correct' AS mode, record_id FROM cot_records SEMI JOIN (SELECT record_id FROM c ORDER BY pos LIMIT 7) USING (record_id)
 UNION ALL SELECT 'first', record_id FROM (SELECT record_id FROM cot_records ORDER BY record_id LIMIT 5)
 UNION ALL SELECT 'correct', record_id FROM cot_records SEMI JOIN c USING (record_id) UNION ALL SELECT 'single', record_id FROM cot_records WHERE record_id = 3"""
)
def sel_p06_choose_ids(spark, d):
    rows = table(spark, d, "cot_records").select("record_id")
    correct = table(spark, d, "sample_results").where("correct").groupBy("record_id").agg((-F.unix_micros(F.max("evaluated_at"))).alias("t"))
    correct = correct.select("record_id", F.struct("t", "record_id").alias("pos"))
    pick = lambda mode, **k: R.choose_ids(rows, "record_id", **k).select(F.lit(mode).alias("mode"), "record_id")
    return R.concat(pick("first_correct", first_correct=7, correct=correct), pick("first", first=5), pick("correct", correct=correct), pick("single", single=3))


@query(
    """SELECT dataset, record_id AS passed_id, source FROM (SELECT dataset, record_id, 'step' AS source FROM sample_results WHERE correct AND dataset <> 'svamp'
 UNION SELECT dataset, record_id, 'flat' FROM sample_results WHERE correct AND dataset = 'svamp')"""
)
def sel_p07_passed_ids(spark, d):
    """Ids from summaries whose layout differs by dataset: nested by step, else flat."""
    block = F.floor(F.col("record_id") / 1000).alias("block")  # a document of at most a thousand ids
    ok = table(spark, d, "sample_results").where("correct").groupBy("dataset", block).agg(F.collect_set("record_id").alias("ids"))
    ids = F.to_json(F.struct(F.col("ids").alias("correct_ids")))
    doc = F.when(F.col("dataset") == "svamp", ids).otherwise(F.concat(F.lit('{"step_1": '), ids, F.lit("}")))
    flat, step = F.from_json("doc", "correct_ids array<bigint>"), F.from_json("doc", "step_1 struct<correct_ids: array<bigint>>")
    got = ok.select("dataset", doc.alias("doc")).select("dataset", flat["correct_ids"].alias("flat"), step["step_1"]["correct_ids"].alias("step"))
    source = F.when(F.col("flat").isNotNull(), "flat").otherwise("step")
    return got.select("dataset", F.explode(F.coalesce("flat", "step")).alias("passed_id"), source.alias("source"))


@query(
    """SELECT problem_id, run_name, CASE problem_id % 4 WHEN 0 THEN prefix || ' ' WHEN 1 THEN prefix WHEN 2 THEN 'won' ELSE CASE WHEN len(scores) > 3 THEN 'first' ELSE '' END END AS used FROM search_results"""
)
def sel_p08_prefix_fallback(spark, d):
    kind = F.col("problem_id") % 4
    trial = lambda s, p: F.struct(F.lit(s).alias("success"), F.lit(p).alias("prefix"))
    trials = F.when(kind == 2, F.array(trial(True, "lost"), trial(True, "won"), trial(False, "no"))).when((kind == 3) & (F.size("scores") > 3), F.array(trial(False, "first"), trial(False, "no"))).otherwise(F.slice(F.array(trial(True, "")), 1, 0))
    used = R.prefix_of(F.when(kind == 0, F.col("prefix")), F.when(kind == 1, F.col("prefix")), trials)
    return table(spark, d, "search_results").select("problem_id", "run_name", used.alias("used"))


@query(r"SELECT record_id FROM cot_records WHERE len(list_filter(string_split_regex(question, '[ \t\n\r\f\v]+'), lambda w: w <> '')) <= 40")
def sel_p09_length_filter(spark, d):
    from ..functions.text import word_count

    return table(spark, d, "cot_records").where(word_count("question") <= 40).select("record_id")


@query("SELECT record_id FROM cot_records WHERE regexp_matches(string_split(answer, ' ')[-1], '^[0-9]')")
def sel_p10_numeric_last_word(spark, d):
    return table(spark, d, "cot_records").where(F.substring_index("answer", " ", -1).rlike("^[0-9]")).select("record_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING avg((o_orderstatus = 'F')::INT) <= 0.4)")
def sel_p11_difficulty_filter(spark, d):
    rows = table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F")
    return R.too_easy(rows, "o_custkey", "ok", 0.4).select("o_orderkey", "o_custkey")


def _turns(df):
    """Conversations of three turns per event; the middle one holds images."""
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    say = F.concat(F.repeat(F.lit("<image>"), (F.col("event_id") % 3).cast("int")), F.col("event_type"))
    images = F.transform(F.sequence(F.lit(1), F.lit(1) + (F.col("event_id") % 2).cast("int")), lambda i: item("image", F.lit(None).cast("string")))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    last = F.when(F.col("user_id") % 2 == 0, F.lit("observation")).otherwise(F.lit("end"))
    return df.select(
        "event_id", F.array(turn("user", F.array(item("text", say))), turn("assistant", images), turn("user", F.array(item("text", last)))).alias("turns")
    )


@query("SELECT event_id, event_id % 3 = 1 + event_id % 2 AND user_id % 2 = 0 AS valid FROM events")
def sel_p12_valid_conversation(spark, d):
    return _turns(table(spark, d, "events")).select("event_id", R.valid_conversation(F.col("turns")).alias("valid"))


@query("SELECT event_id, 2 AS items FROM events")
def sel_p13_drop_items(spark, d):
    kept = R.drop_items(F.col("turns"), "assistant", "image")
    return _turns(table(spark, d, "events")).select("event_id", F.size(F.flatten(F.transform(kept, lambda t: t["content"]))).alias("items"))


@query("SELECT event_id FROM events WHERE event_id % 8 = 3")
def sel_p14_stride_shard(spark, d):
    return R.stride_shard(table(spark, d, "events"), "event_id", 3, 8).select("event_id")


@query("SELECT record_id, strpos('ABCDE', answer) > 0 AS substring_test, answer IN ('A', 'B', 'C', 'D', 'E') AS letter_test FROM cot_records")
def sel_p15_letter_test(spark, d):
    return table(spark, d, "cot_records").select(
        "record_id", (F.instr(F.lit("ABCDE"), F.col("answer")) > 0).alias("substring_test"), F.col("answer").isin(*"ABCDE").alias("letter_test")
    )


@query(f"SELECT record_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM (SELECT record_id, {turn_sql('record_id')} AS u FROM cot_records)")
def sel_p16_hash_split(spark, d):
    return R.hash_split(table(spark, d, "cot_records").select("record_id"), "record_id", {"train": 0.8, "val": 0.1, "test": 0.1}, turn=turn("record_id"))


# -------------------------------------------------------------------- joins


@query("SELECT o_orderkey, coalesce(c_mktsegment, '') || '|' || o_orderstatus AS prompt FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j01_prefix_lookup(spark, d):
    prefixes = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = R.lookup(table(spark, d, "orders"), prefixes, "o_custkey", "c_mktsegment", "prefix", F.lit(""))
    return rows.select("o_orderkey", F.concat("prefix", F.lit("|"), "o_orderstatus").alias("prompt"))


@query(
    """SELECT r.dataset, r.record_id, s.n, s.best FROM cot_records r LEFT JOIN (SELECT dataset, record_id::VARCHAR AS id, count(*) AS n, bool_or(correct) AS best FROM sample_results GROUP BY 1, 2) s
 ON r.dataset = s.dataset AND r.record_id::VARCHAR = s.id WHERE r.split <> 'train'"""
)
def j02_composite_lookup(spark, d):
    sums = table(spark, d, "sample_results").groupBy("dataset", F.col("record_id").cast("string").alias("id")).agg(F.count("*").alias("n"), F.bool_or("correct").alias("best"))
    rows = table(spark, d, "cot_records").where("split <> 'train'").select("dataset", "record_id", F.col("record_id").cast("string").alias("id"))
    return rows.join(sums, ["dataset", "id"], "left").drop("id")


@query("SELECT record_id, dataset FROM cot_records WHERE record_id IN (SELECT record_id FROM search_results WHERE attack_success)")
def j03_id_semi(spark, d):
    ids = table(spark, d, "search_results").where("attack_success").select("record_id")
    return table(spark, d, "cot_records").join(ids, "record_id", "left_semi").select("record_id", "dataset")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j04_resume_anti(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.resume(table(spark, d, "orders"), done, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, upper(o_orderstatus) || '2' AS o_orderstatus, o_totalprice FROM orders")
def j05_union_columns(spark, d):
    o = table(spark, d, "orders")
    left = o.select("o_orderkey", "o_custkey", "o_orderstatus")
    right = o.select("o_orderkey", "o_custkey", F.concat(F.upper("o_orderstatus"), F.lit("2")).alias("o_orderstatus"), "o_totalprice")
    return R.union_columns(left, right, "o_orderkey", exempt=["o_orderstatus"])


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'swept/item_id=' || item_id ELSE 'plain/' || item_id END AS path FROM eval_items")
def j06_path_fallback(spark, d):
    """Preferred path where a listing of the sweep's folder has it, else the fallback; no file is opened."""
    from ..operators.tables import shared_dir
    from ..sources.readers import listing, with_existing

    root = f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex}"
    items = table(spark, d, "eval_items")
    # One folder with its file per swept item.
    items.where("item_id % 3 = 0").select("item_id", F.lit("png").alias("value")).write.partitionBy("item_id").text(f"{root}/swept")
    files = listing(spark, f"{root}/swept").select(F.regexp_extract("path", r"(swept/item_id=\d+)/[^/]*$", 1).alias("have"))
    rows = items.select("item_id", F.expr("'swept/item_id=' || item_id").alias("want"), F.expr("'plain/' || item_id").alias("other"))
    return with_existing(rows, "want", "other", files, "have").select("item_id", "path")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j07_required_lookup(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.lookup_required(table(spark, d, "orders"), names, "o_custkey", "c_name", "c_name").select("o_orderkey", "c_name")


@query(
    """SELECT p_partkey, arg_min(r_name, (round(abs(p_retailprice - 300.0 * r_regionkey), 6), r_regionkey)) AS best, min(round(abs(p_retailprice - 300.0 * r_regionkey), 6)) AS cost FROM part, region GROUP BY 1"""
)
def j08_best_of_cross(spark, d):
    """Each question with each of a handful of facts; the cheapest fact wins."""
    cost = F.round(F.abs(F.col("p_retailprice") - 300.0 * F.col("r_regionkey")), 6)
    return R.best_of_all(table(spark, d, "part").select("p_partkey", "p_retailprice"), table(spark, d, "region"), "p_partkey", cost, "r_name", "r_regionkey")


@query(
    """SELECT t.record_id, t.s, t.e, sp.a, sp.b FROM (SELECT record_id, i * 10 AS s, i * 10 + 10 AS e FROM cot_records, range(0, 12) r(i)) t
 JOIN (SELECT record_id, record_id % 50 AS a, record_id % 50 + 15 AS b FROM cot_records) sp ON t.record_id = sp.record_id AND greatest(t.s, sp.a) < least(t.e, sp.b)"""
)
def j09_overlap_join(spark, d):
    r = table(spark, d, "cot_records")
    tokens = r.select("record_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("i")).select("record_id", (F.col("i") * 10).alias("s"), (F.col("i") * 10 + 10).alias("e"))
    spans = r.select("record_id", (F.col("record_id") % 50).alias("a"), (F.col("record_id") % 50 + 15).alias("b"))
    return R.overlaps(tokens, spans, "record_id")


@query(
    """WITH m AS (SELECT series AS sample_id, text, min(doc_id % 9) AS cluster_id FROM documents WHERE n_chars < 600 GROUP BY 1, 2)
 SELECT doc_id, cluster_id FROM documents LEFT JOIN m ON series = sample_id AND documents.text = m.text"""
)
def j10_member_cluster(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("series").alias("sample_id"), "text", "n_chars")
    members = docs.where("n_chars < 600").select("sample_id", "text", (F.col("doc_id") % 9).alias("cluster_id"))
    return R.member_cluster(members, docs.select("doc_id", "sample_id", "text"), ["sample_id", "text"], "cluster_id").select("doc_id", "cluster_id")


@query("SELECT record_id, CASE WHEN rule = 0 AND api IS NOT NULL THEN api ELSE rule END AS score FROM (SELECT record_id, (record_id % 3 = 0)::INT AS rule, CASE WHEN record_id % 2 = 0 THEN 1 END AS api FROM cot_records)")
def j12_fallback_judge(spark, d):
    rows = table(spark, d, "cot_records").select("record_id", (F.col("record_id") % 3 == 0).cast("int").alias("rule"))
    api = rows.select("record_id", F.when(F.col("record_id") % 2 == 0, 1).alias("verdict"))
    return R.judged(rows, api, "record_id", "rule", "verdict", "score").select("record_id", "score")


@query(f"SELECT o_custkey, arg_min(o_orderkey, u) AS o_orderkey, arg_min(o_totalprice, u) AS o_totalprice FROM (SELECT *, {turn_sql('o_orderkey')} AS u FROM orders) GROUP BY 1")
def j13_pick_one(spark, d):
    pool = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.pick_one(pool, "o_custkey", "o_orderkey", turn=turn("o_orderkey"))


_MARKS = "t AS (SELECT row_id, ingested_at, x, i FROM (SELECT row_id, ingested_at, unnest(input_ids) AS x, generate_subscripts(input_ids, 1)::BIGINT AS i FROM packed_inputs) WHERE x IN (101, 102, 103))"


def _marked(spark, d):
    """The places of opening and closing marks within each token array."""
    at = lambda keep: F.filter(F.transform("input_ids", lambda x, i: F.when(keep(x), i.cast("bigint") + 1)), lambda p: p.isNotNull())
    rows = table(spark, d, "packed_inputs")
    return rows.select("row_id", F.unix_micros("ingested_at").alias("ingested"), at(lambda x: x == 101).alias("st"), at(lambda x: x.isin(102, 103)).alias("en"))


@query(f"WITH {_MARKS} SELECT s.row_id, epoch_us(s.ingested_at) AS ingested, s.i AS start, min(e.i) AS stop FROM t s JOIN t e ON s.row_id = e.row_id AND s.ingested_at = e.ingested_at AND s.x = 101 AND e.x <> 101 AND e.i > s.i GROUP BY ALL")
def j14_nearest_end(spark, d):
    """The profile in which starts may share an end."""
    pairs = _marked(spark, d).select("row_id", "ingested", F.explode(R.nearest_end(F.col("st"), F.col("en"))).alias("p"))
    return pairs.select("row_id", "ingested", "p.start", F.col("p.end").alias("stop"))


@query(
    f"""WITH {_MARKS}, w AS (SELECT *, sum(CASE WHEN x = 101 THEN 1 ELSE -1 END) OVER o AS walk FROM t WINDOW o AS (PARTITION BY row_id, ingested_at ORDER BY i)),
 k AS (SELECT *, greatest(0, -min(walk) OVER o) AS skipped FROM w WINDOW o AS (PARTITION BY row_id, ingested_at ORDER BY i)),
 u AS (SELECT *, skipped = coalesce(lag(skipped) OVER (PARTITION BY row_id, ingested_at ORDER BY i), 0) AS used FROM k),
 s AS (SELECT row_id, ingested_at, i, row_number() OVER (PARTITION BY row_id, ingested_at ORDER BY i) AS r FROM u WHERE x = 101),
 e AS (SELECT row_id, ingested_at, i, row_number() OVER (PARTITION BY row_id, ingested_at ORDER BY i) AS r FROM u WHERE x <> 101 AND used)
 SELECT row_id, epoch_us(ingested_at) AS ingested, s.i AS start, e.i AS stop FROM s JOIN e USING (row_id, ingested_at, r)"""
)
def j14_paired_ends(spark, d):
    """The profile in which a pair uses its end up."""
    pairs = _marked(spark, d).select("row_id", "ingested", F.explode(R.paired_ends(F.col("st"), F.col("en"))).alias("p"))
    return pairs.select("row_id", "ingested", "p.start", F.col("p.end").alias("stop"))


@query("SELECT r.record_id, coalesce(s.prefix, r.dataset) AS dataset, s.prefix IS NOT NULL AS rewritten FROM cot_records r LEFT JOIN (SELECT record_id, min(prefix) AS prefix FROM search_results GROUP BY 1) s USING (record_id)")
def j15_replace_by_lookup(spark, d):
    rewrites = table(spark, d, "search_results").groupBy("record_id").agg(F.min("prefix").alias("prefix"))
    return R.replace_by_lookup(table(spark, d, "cot_records").select("record_id", "dataset"), rewrites, "record_id", "prefix", "dataset", "rewritten")


@query(
    """WITH old AS (SELECT doc_id, n_chars AS v, doc_id % 5 AS t FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, n_chars + 1 AS v, 2 AS t FROM documents WHERE doc_id % 2 = 0)
 SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.v WHEN o.doc_id IS NULL OR n.t >= o.t THEN n.v ELSE o.v END AS v, CASE WHEN n.doc_id IS NULL THEN o.t WHEN o.doc_id IS NULL OR n.t >= o.t THEN n.t ELSE o.t END AS t
 FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"""
)
def j16_upsert(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.col("n_chars").alias("v"), (F.col("doc_id") % 5).alias("t"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") + 1).alias("v"), F.lit(2).cast("long").alias("t"))
    return R.upsert(old, new, "doc_id", "t")


@query(
    """SELECT u.user_id, t.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
 LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) c ON u.user_id = c.user_id AND t.event_type = c.event_type"""
)
def j17_dense_grid(spark, d):
    e = table(spark, d, "events")
    return R.dense_grid(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), e, e, "user_id", "event_type", "n", F.lit(0))


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS chosen, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS rejected FROM orders GROUP BY 1 HAVING max(o_totalprice) > min(o_totalprice)"""
)
def j18_preference_pairs(spark, d):
    return R.preference_pairs(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


# ------------------------------------------------------------------- unions


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def u01_concat(spark, d):
    a = table(spark, d, "nation").toDF("k", "name", "region")
    return R.concat(a, table(spark, d, "region").toDF("k", "name"))


@query("SELECT split, count(*) AS n FROM (SELECT split, question FROM cot_records WHERE split = 'train' UNION ALL SELECT split, question FROM eval_items) GROUP BY 1")
def u02_dataset_concat(spark, d):
    rows = R.concat(table(spark, d, "cot_records").where("split = 'train'").select("split", "question"), table(spark, d, "eval_items").select("split", "question"))
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT record_id FROM sample_results INTERSECT SELECT record_id FROM search_results")
def u03_shared_keys(spark, d):
    return R.shared_keys(table(spark, d, "sample_results"), table(spark, d, "search_results"), "record_id")


@query("SELECT record_id FROM cot_records WHERE split <> 'train' EXCEPT SELECT record_id FROM sample_results")
def u04_difference(spark, d):
    return R.resume(table(spark, d, "cot_records").where("split <> 'train'").select("record_id").distinct(), table(spark, d, "sample_results"), "record_id")


@query("SELECT DISTINCT record_id FROM sample_results")
def u05_distinct_ids(spark, d):
    return table(spark, d, "sample_results").select("record_id").distinct()


@query(
    """WITH s AS (SELECT user_id, event_id * 10 AS a, event_id * 10 + (floor(value)::BIGINT % 4000) AS b FROM events),
 m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
 SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, island"""
)
def u06_merge_spans(spark, d):
    spans = table(spark, d, "events").selectExpr("user_id", "event_id * 10 AS a", "event_id * 10 + (CAST(floor(value) AS BIGINT) % 4000) AS b")
    return R.merge_spans(spans, "user_id", "a", "b")


# --------------------------------------------------------------- row shapes


@query("SELECT n_nationkey, (n_nationkey * 5 // 25)::INT AS chunk FROM nation")
def q12_chunk(spark, d):
    return R.chunk(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 25, 5)


@query(
    """SELECT n_nationkey, copy, n_nationkey * 3 + copy AS interleaved, copy * 25 + n_nationkey AS tiled FROM nation, (SELECT unnest([0, 1, 2]) AS copy)"""
)
def q13_repeat(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey")
    a = R.repeat(rows, "n_nationkey", 3).withColumnRenamed("new_key", "interleaved")
    b = R.repeat(rows, "n_nationkey", 3, interleave=False, total=25).withColumnRenamed("new_key", "tiled")
    return a.join(b, ["n_nationkey", "copy"])


@query("SELECT k AS n_nationkey, n_name, k >= 25 AS is_pad FROM (SELECT unnest(range(32)) AS k) JOIN nation ON n_nationkey = k % 25")
def q14_pad_to_divisor(spark, d):
    return R.pad_rows(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), "n_nationkey", 25, 16)


@query("SELECT n_nationkey, n_name FROM nation")
def q14_unpad(spark, d):
    return R.unpad_rows(q14_pad_to_divisor(spark, d))


@query("SELECT event_id // 4 AS row, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY 1")
def q15_fold(spark, d):
    rows = R.fold(table(spark, d, "events"), "event_id", 4, ["event_type"])
    return rows.select("row", F.array_join("event_type", ",").alias("types"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def q16_collate(spark, d):
    rows = R.collate(table(spark, d, "nation").withColumn("key", F.col("n_nationkey")), "n_regionkey", "n_nationkey", ["n_name", "key"])
    return rows.select("n_regionkey", F.array_join("n_name", ",").alias("names"), F.array_join("key", ",").alias("keys"))
