"""Sequences, partitions, packing, clusters (Q, B, C, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import batches as B
from ..operators import clustering as C
from ..operators import partitioning as P
from .base import query, table

_LATEST = "latest AS (SELECT row_id, ds_name, arg_max(input_ids, ingested_at) AS ids, arg_max(labels, ingested_at) AS labels FROM packed_inputs GROUP BY 1, 2)"
TEXT = lambda c: F.array_join(c, ",")
TXT = lambda x: f"array_to_string({x}, ',')"


def latest(spark, d):
    rows = table(spark, d, "packed_inputs").groupBy("row_id", "ds_name")
    return rows.agg(F.max_by("input_ids", "ingested_at").alias("ids"), F.max_by("labels", "ingested_at").alias("labels"))


@query(
    f"""WITH {_LATEST} SELECT row_id, {TXT('ids[1:12] || list_resize([]::INT[], greatest(12 - len(ids), 0)::INT, 0)')} AS r, {TXT('(list_resize([]::INT[], greatest(12 - len(ids), 0)::INT, 0) || ids)[1:12]')} AS l FROM latest"""
)
def q01_pad(spark, d):
    x = F.col("ids")
    return latest(spark, d).select("row_id", TEXT(S.pad(x, 12, 0)).alias("r"), TEXT(S.pad(x, 12, 0, "left")).alias("l"))


@query(
    f"""WITH {_LATEST} SELECT row_id, {TXT('CASE WHEN len(ids) > 40 THEN ids[-40:] ELSE list_resize([]::INT[], (40 - len(ids))::INT, 0) || ids END')} AS l, {TXT('CASE WHEN len(ids) > 40 THEN ids[1:40] ELSE ids || list_resize([]::INT[], (40 - len(ids))::INT, 0) END')} AS r FROM latest"""
)
def q02_pad_or_cut(spark, d):
    x = F.col("ids")
    return latest(spark, d).select("row_id", TEXT(S.pad_or_cut(x, 40, 0, "left", "left")).alias("l"), TEXT(S.pad_or_cut(x, 40, 0, "right", "right")).alias("r"))


@query(f"WITH {_LATEST} SELECT row_id, {TXT('CASE WHEN len(ids) > 20 THEN ids[1:19] ELSE ids END || [2]')} AS ids FROM latest")
def q03_cut_with_end(spark, d):
    return latest(spark, d).select("row_id", TEXT(S.cut_with_end(F.col("ids"), 20, 2)).alias("ids"))


_AT = lambda pats, long: f"coalesce(list_min(list_filter(range(0, greatest(len(ids) - {long} + 1, 0)), lambda i: {' OR '.join(f'ids[i + 1:i + {len(p)}] = {p}' for p in pats)})), -1)"


@query(f"WITH {_LATEST} SELECT row_id, {_AT([[101, 102]], 2)}::BIGINT AS pair, {_AT([[103, 101, 101], [104, 101]], 3)}::BIGINT AS either FROM latest")
def q04_find(spark, d):
    x = F.col("ids")
    return latest(spark, d).select("row_id", S.find(x, [101, 102]).cast("long").alias("pair"), S.find(x, [103, 101, 101], [104, 101]).cast("long").alias("either"))


@query(
    f"""WITH {_LATEST}, a AS (SELECT row_id, ids, {_AT([[101, 102]], 2)} AS anchor FROM latest) SELECT row_id, {TXT('list_filter(range(0, greatest(len(ids) - 1, 0)), lambda i: ids[i + 1:i + 2] = [101, 103] AND i > anchor AND anchor >= 0)')} AS places FROM a"""
)
def q05_find_after(spark, d):
    return latest(spark, d).select("row_id", TEXT(S.find_after(F.col("ids"), [101, 102], [101, 103])).alias("places"))


@query(
    f"""WITH {_LATEST}, a AS (SELECT row_id, ids, {_AT([[101, 102]], 2)} AS place FROM latest) SELECT row_id, {TXT('list_transform(ids, lambda v, i: CASE WHEN place < 0 OR i - 1 < place + 2 OR v IN (30100, 106) THEN -100 ELSE v END)')} AS labels FROM a"""
)
def q06_labels_after(spark, d):
    return latest(spark, d).select("row_id", TEXT(S.labels_after(F.col("ids"), [101, 102], [30100, 106])).alias("labels"))


@query(f"WITH {_LATEST} SELECT row_id, {TXT('list_transform(ids, lambda v, i: CASE WHEN i - 1 IN (2, 5, 7) THEN v ELSE -100 END)')} AS labels FROM latest")
def q07_labels_at(spark, d):
    return latest(spark, d).select("row_id", TEXT(S.labels_at(F.col("ids"), F.array(F.lit(2), F.lit(5), F.lit(7)))).alias("labels"))


@query(
    f"""WITH {_LATEST}, t AS (SELECT row_id, array_to_string(list_transform(ids, lambda v: '<' || v || '>'), '') AS t FROM latest)
 SELECT row_id, replace(trim(regexp_replace(t, '<101>(<[0-9]+>)*?<102>', '<101><77><77><102>', 'g'), '<>'), '><', ',') AS ids FROM t"""
)
def q08_replace_spans(spark, d):
    return latest(spark, d).select("row_id", TEXT(S.replace_spans(F.col("ids"), 101, 102, 77, 2)).alias("ids"))


def _whole(spark, d):
    """Whole arrays of any length: the question ends with the first 103, the rest are two steps and the answer."""
    at = F.coalesce(F.array_position("ids", F.lit(103).cast("int")), F.lit(0)).cast("int")
    rows = latest(spark, d).select("row_id", "ds_name", "ids", at.alias("at")).withColumn("n", F.expr("CAST((size(ids) - at) DIV 3 AS INT)"))
    cut = lambda start, size: F.slice("ids", F.col("at") + F.col("n") * start + 1, size)
    rest = F.size("ids") - F.col("at") - F.col("n") * 2
    return rows.select("row_id", "ds_name", F.slice("ids", F.lit(1), F.col("at")).alias("q"), F.array(cut(0, F.col("n")), cut(1, F.col("n"))).alias("steps"), cut(2, rest).alias("a"))


#: The same in SQL.
_WHOLE = f"""{_LATEST}, w AS (SELECT row_id, ids, coalesce(list_position(ids, 103), 0) AS h, (len(ids) - coalesce(list_position(ids, 103), 0)) // 3 AS n FROM latest),
 c AS (SELECT row_id, ids, ids[1:h] AS q, ids[h + 1:h + n] AS s, ids[h + n + 1:h + 2 * n] AS t, ids[h + 2 * n + 1:len(ids)] AS a FROM w)"""


@query(
    f"""WITH {_WHOLE}, x AS (SELECT row_id, q || [11, 12, 12, 13] || t || a AS x, len(q) + 4 AS head, q || [11, 12, 12, 12, 12, 13] || a AS z FROM c)
 SELECT row_id, {TXT('x')} AS ids, {TXT('list_transform(x, lambda v, i: CASE WHEN i <= head THEN -100 ELSE v END)')} AS labels, len(x) - 1 AS last, {TXT('z')} AS skipped FROM x"""
)
def q09_staged(spark, d):
    return _staged(_whole(spark, d))


def _staged(rows):
    make = lambda stage, most=9: S.staged(F.col("q"), F.col("steps"), F.col("a"), stage, 2, 11, 12, 13, most)
    rows = rows.select("row_id", make(1).alias("s"), make(5, 4).alias("z"))
    return rows.select("row_id", TEXT("s.input_ids").alias("ids"), TEXT("s.labels").alias("labels"), F.array_max("s.position_ids").cast("long").alias("last"), TEXT("z.input_ids").alias("skipped"))


@query(
    f"""WITH {_LATEST}, p AS (SELECT row_id, ds_name, ids, coalesce(list_position(ids, 103), 0) AS place FROM latest), m AS (SELECT *, CASE WHEN place > 0 THEN max(place) OVER (PARTITION BY ds_name) - place ELSE 0 END::INT AS k FROM p)
 SELECT row_id, {TXT('list_resize([]::INT[], k, 0) || ids')} AS ids, {TXT('list_resize([]::INT[], k, -100) || ids')} AS labels, k + len(ids) AS n FROM m"""
)
def q10_align_on_token(spark, d):
    rows = latest(spark, d).select("row_id", "ds_name", "ids", F.col("ids").alias("lab"))
    out = B.align_on_token(rows, "ds_name", "ids", 103, {"lab": -100})
    return out.select("row_id", TEXT("ids").alias("ids"), TEXT("lab").alias("labels"), F.size("position_ids").cast("long").alias("n"))


@query("SELECT record_id, i AS drop, array_to_string(string_split(cot, ' ')[1:greatest(len(string_split(cot, ' ')) - i, 0)], ' ') AS cot FROM cot_records, range(0, 3) r(i) WHERE cot IS NOT NULL")
def q11_shrinking_prefixes(spark, d):
    rows = table(spark, d, "cot_records").where("cot is not null").select("record_id", F.posexplode(S.shrinking_prefixes(F.split("cot", " "), 3)).alias("drop", "cot"))
    return rows.withColumn("drop", F.col("drop").cast("long"))


def _packs(spark, d):
    rows = latest(spark, d).select(F.floor(F.col("row_id") / 3).alias("pack"), F.struct("row_id", "ids").alias("s"))
    packs = rows.groupBy("pack").agg(F.array_sort(F.collect_list("s")).alias("s"))  # three samples a pack
    return packs.select("pack", F.flatten(F.transform("s", lambda t: t["ids"])).alias("ids"), F.transform("s", lambda t: F.size(t["ids"])).alias("lengths"))


@query(
    f"""WITH {_LATEST}, n AS (SELECT row_id // 3 AS pack, len(ids) AS n, row_number() OVER (PARTITION BY row_id // 3 ORDER BY row_id) - 1 AS k FROM latest), e AS (SELECT pack, k, unnest(range(n)) AS j FROM n)
 SELECT pack, string_agg(k::VARCHAR, ',' ORDER BY k, j) AS segments FROM e GROUP BY 1"""
)
def q17_segment_ids(spark, d):
    return _packs(spark, d).select("pack", TEXT(S.segment_ids(F.col("lengths"))).alias("segments"))


@query(f"WITH {_LATEST} SELECT row_id // 3 AS pack, row_number() OVER (PARTITION BY row_id // 3 ORDER BY row_id) - 1 AS segment, {TXT('ids')} AS ids FROM latest")
def q18_unpack(spark, d):
    rows = _packs(spark, d).select("pack", F.posexplode(S.unpack(F.col("ids"), F.col("lengths"))).alias("segment", "x"))
    return rows.select("pack", F.col("segment").cast("long").alias("segment"), TEXT("x").alias("ids"))


@query(
    """WITH e AS (SELECT event_id // 5 AS batch, event_id % 5 AS row, user_id, 2 + event_id % 3 AS len FROM events), c AS (SELECT *, i, i < 6 AND (i + row) % 4 <> 0 AS m FROM e, range(0, 8) r(i)),
 o AS (SELECT batch, row, i, m, len, sum(m::INT) OVER (PARTITION BY batch ORDER BY row, i) - 1 AS idx FROM c)
 SELECT batch, row, 0 AS segment, i AS pos, idx::BIGINT AS index FROM o WHERE m AND i >= 1 AND i < 1 + len"""
)
def q20_stream_positions(spark, d):
    ids = F.expr("transform(sequence(0, 7), i -> CASE WHEN i = 1 THEN 7 WHEN i = 1 + 2 + event_id % 3 THEN 8 ELSE 1 END)")
    mask = F.expr("transform(sequence(0, 7), i -> IF(i < 6 AND (i + event_id % 5) % 4 <> 0, 1, 0))")
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("batch"), (F.col("event_id") % 5).alias("row"), ids.alias("ids"), mask.alias("mask"))
    out = B.stream_positions(rows, "batch", "row", "ids", "mask", 7, 8)
    return out.select("batch", "row", "segment", F.col("pos").cast("long").alias("pos"), F.col("index").cast("long").alias("index"))


@query(f"WITH {_LATEST}, n AS (SELECT row_id, ids, max(len(ids)) OVER (PARTITION BY ds_name) AS w FROM latest) SELECT row_id, {TXT('ids || list_resize([]::INT[], (w - len(ids))::INT, 0)')} AS ids FROM n")
def q21_flatten_steps(spark, d):
    nested = F.concat(F.array("q"), F.col("steps"), F.array("a"))
    rows = _whole(spark, d).select("row_id", "ds_name", nested.alias("nested"))
    return B.flatten_steps(rows, "ds_name", "nested").select("row_id", TEXT("nested").alias("ids"))


@query(f"WITH {_WHOLE} SELECT row_id, {TXT('q || s || [11, 12, 12, 13] || t || a')} AS ids, {TXT('s')} AS target FROM c")
def q22_staged_with_steps(spark, d):
    return _with_steps(_whole(spark, d))


def _with_steps(rows):
    made = S.staged_with_steps(F.col("q"), F.col("steps"), F.col("a"), 1, 2, 11, 12, 13)
    return rows.select("row_id", made.alias("s")).select("row_id", TEXT("s.input_ids").alias("ids"), TEXT(F.flatten("s.targets")).alias("target"))


@query(
    f"""WITH {_WHOLE}, a AS (SELECT row_id, ids, len(q) AS head, {_AT([[101, 102]], 2)} AS place FROM c)
 SELECT row_id, {TXT('list_transform(ids, lambda v, i: CASE WHEN i <= head THEN -100 ELSE v END)')} AS labels, CASE WHEN place >= 0 THEN place + 2 ELSE -1 END::BIGINT AS answer_at FROM a"""
)
def q23_train_row(spark, d):
    return _train_rows(_whole(spark, d))


def _train_rows(rows):
    row = S.train_row(F.col("q"), F.flatten("steps"), F.col("a"), [101, 102])
    return rows.select("row_id", row.alias("s")).select("row_id", TEXT("s.labels").alias("labels"), F.col("s.answer_at").cast("long").alias("answer_at"))


# ------------------------------------------------------- partitions and packs


def _batched(spark, d):
    """Batches of a hundred documents, however many there are."""
    return table(spark, d, "documents").select(F.floor((F.col("doc_id") - 1) / 100).alias("batch"), "doc_id", "n_chars")


@query("SELECT (doc_id - 1) // 100 AS batch, 4 AS parts, count(*) AS n, sum(n_chars)::BIGINT AS total, true AS tight FROM documents GROUP BY 1", name="balance_kk")
def b01_balance_kk(spark, d):
    """Tight: no part beyond the mean by more than the largest item."""
    out = P.balance(_batched(spark, d), "batch", "doc_id", "n_chars", 4)
    sums = out.groupBy("batch", "part").agg(F.sum("n_chars").alias("s"), F.count("*").alias("c"), F.max("n_chars").alias("m"))
    tight = F.max("s") - F.sum("s") / 4 <= F.max("m")
    return sums.groupBy("batch").agg(F.count("*").cast("int").alias("parts"), F.sum("c").alias("n"), F.sum("s").alias("total"), tight.alias("tight"))


@query(
    """WITH RECURSIVE o AS (SELECT (doc_id - 1) // 100 AS batch, doc_id, n_chars, row_number() OVER (PARTITION BY (doc_id - 1) // 100 ORDER BY doc_id) AS i FROM documents),
 p AS (SELECT batch, i, doc_id, n_chars, 1::BIGINT AS part, [n_chars, 0, 0, 0] AS loads FROM o WHERE i = 1
 UNION ALL SELECT o.batch, o.i, o.doc_id, o.n_chars, list_position(loads, list_min(loads))::BIGINT, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + o.n_chars ELSE x END) FROM p JOIN o ON o.batch = p.batch AND o.i = p.i + 1)
 SELECT batch, doc_id, n_chars, (part - 1)::INT AS part FROM p"""
)
def b02_least_loaded(spark, d):
    return P.balance(_batched(spark, d), "batch", "doc_id", "n_chars", 4, method="least_loaded")


@query("SELECT (doc_id - 1) // 100 AS batch, 5 AS parts, count(*) // 5 AS least, count(*) // 5 AS most FROM documents GROUP BY 1")
def b03_equal_parts(spark, d):
    out = P.balance(_batched(spark, d), "batch", "doc_id", "n_chars", 5, equal=True)
    sizes = out.groupBy("batch", "part").agg(F.count("*").alias("c"))
    return sizes.groupBy("batch").agg(F.count("*").cast("int").alias("parts"), F.min("c").alias("least"), F.max("c").alias("most"))


@query("SELECT (doc_id - 1) // 100 AS batch, least(count(*), greatest(1, ceil(sum(n_chars) / 30000)))::BIGINT AS parts, count(*) AS n FROM documents GROUP BY 1")
def b04_micro_batches(spark, d):
    out = P.micro_batches(_batched(spark, d), "batch", "doc_id", "n_chars", 30000)
    return out.groupBy("batch").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"))


@query("SELECT 24 - n_nationkey AS index, n_nationkey AS pos FROM nation")
def b05_inverse_order(spark, d):
    return P.inverse_order(table(spark, d, "nation").select(F.col("n_nationkey").alias("index"), (F.lit(24) - F.col("n_nationkey")).alias("pos")))


@query("SELECT (doc_id - 1) // 100 AS batch, count(*) AS n, count(*) - 1 AS last, true AS permutation FROM documents GROUP BY 1")
def b06_balanced_order(spark, d):
    order = P.balanced_order(P.balance(_batched(spark, d), "batch", "doc_id", "n_chars", 4), "batch", "doc_id")
    return order.groupBy("batch").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last"), (F.count_distinct("pos") == F.count("*")).alias("permutation"))


def _first_fit(spark, d):
    """Shards of at most 500 samples of one set."""
    shard = F.concat("ds_name", F.lit("/"), F.floor((F.col("row_id") - 1) / 500))
    return P.pack_first_fit(latest(spark, d).withColumn("shard", shard), "shard", "row_id", "ids", 1024, 4, 512, 32, uncut=(30100,))


@query(name="pack_first_fit")
def b07_pack_first_fit(spark, d):
    return _first_fit(spark, d)


@query(
    """WITH l AS (SELECT row_id, ds_name, arg_max(input_ids, ingested_at) AS ids FROM packed_inputs GROUP BY 1, 2)
 SELECT ds_name, count(*) FILTER (len(ids) <= 1024 OR coalesce(ids[1025], 0) <> 30100) AS placed, sum(least(len(ids), 1024)) FILTER (len(ids) <= 1024 OR coalesce(ids[1025], 0) <> 30100)::BIGINT AS tokens, true AS fits FROM l GROUP BY 1"""
)
def b08_pack_rules(spark, d):
    """Every sample is placed once unless its cut is forbidden, and no pack breaks a limit."""
    out = _first_fit(spark, d)
    packs = out.groupBy(F.substring_index("shard", "/", 1).alias("ds_name"), "shard", "pack").agg(F.count("*").alias("n"), F.sum("size").alias("t"))
    return packs.groupBy("ds_name").agg(F.sum("n").alias("placed"), F.sum("t").alias("tokens"), F.bool_and((F.col("t") <= 1024) & (F.col("n") <= 4)).alias("fits"))


# ----------------------------------------------------------------- clusters


def _sampled(spark, d):
    """Samples of twenty steps."""
    return table(spark, d, "embeddings").withColumn("sample", F.floor(F.col("vec_id") / 20))


@query(
    """WITH RECURSIVE e AS (SELECT vec_id // 20 AS sample, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS i FROM embeddings),
 c AS (SELECT sample, i, vec_id, 0::BIGINT AS cluster_id, [v] AS reps FROM e WHERE i = 1
 UNION ALL SELECT sample, i, vec_id, CASE WHEN list_max(near) > 0.1 THEN list_position(near, list_max(near)) - 1 ELSE len(reps) END::BIGINT, CASE WHEN list_max(near) > 0.1 THEN reps ELSE list_append(reps, v) END
  FROM (SELECT e.*, c.reps, list_transform(c.reps, lambda r: list_dot_product(r, e.v)) AS near FROM c JOIN e ON e.sample = c.sample AND e.i = c.i + 1))
 SELECT sample, vec_id, cluster_id FROM c"""
)
def c01_leader_cluster(spark, d):
    return C.leader_cluster(_sampled(spark, d), "sample", "vec_id", "embedding", 0.1, "first")


@query()
def c01_leader_cluster_modes(spark, d):
    rows = _sampled(spark, d)
    out = None
    for mode in C.REPRESENTATIVES:
        one = C.leader_cluster(rows, "sample", "vec_id", "embedding", 0.1, mode).groupBy("sample").agg(F.count_distinct("cluster_id").alias("n_clusters"))
        one = one.withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT series, lang, count(*) AS size, count(*) FILTER (n_chars > 800) AS n_correct, count(*) FILTER (n_chars > 800) / count(*) > 0.5 AS is_correct FROM documents GROUP BY 1, 2")
def c02_cluster_correctness(spark, d):
    rows = table(spark, d, "documents").withColumn("ok", F.col("n_chars") > 800)
    return C.cluster_correctness(rows, "series", "lang", "ok")


@query(
    """WITH e AS (SELECT vec_id // 20 AS sample, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings) SELECT x.sample, x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v), 6) AS similarity
 FROM e x JOIN e y ON x.sample = y.sample AND x.vec_id < y.vec_id AND list_dot_product(x.v, y.v) > 0.1"""
)
def j11_similar_pairs(spark, d):
    out = C.similar_pairs(_sampled(spark, d), "sample", "vec_id", "embedding", 0.1)
    return out.withColumn("similarity", F.round("similarity", 6))
