"""Sources and sinks (S): what is written in a format reads back as the table says."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.tables import shared_dir
from ..sources import readers as R
from ..sources import writers as W
from .answers import LAST_NUMBER
from .base import query, table


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}"


def _qa(spark, d):
    return table(spark, d, "cot_records").where("answer is not null and steps is not null").select("record_id", "question", "answer", "steps")


def _array_file(df, path: str) -> str:
    """Rows of a table of fixed size as one JSON array."""
    W.document(df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("value")), path)
    return path


def _array_files(df, path: str) -> str:
    """Rows as JSON arrays, the layout of question sets: a document of a thousand ids each, in the order of their names."""
    block = F.format_string("%09d", F.floor(F.col("record_id") / 1000).cast("long"))
    docs = df.groupBy(block.alias("block")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("value"))
    docs.write.partitionBy("block").text(path)
    return path


_PLACED = "SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS id FROM cot_records WHERE answer IS NOT NULL AND steps IS NOT NULL"


@query(f"SELECT id, question, round({LAST_NUMBER('answer')}, 6) AS gold, array_to_string(steps, chr(10)) AS cot FROM ({_PLACED})")
def s01_question_set(spark, d):
    path = _array_files(_qa(spark, d), _place(spark, "qa"))
    return R.question_set(spark, path, joined=True).select("id", "question", F.round("gold", 6).alias("gold"), "cot")


@query(rf"SELECT id, question, CASE WHEN contains(answer, '####') THEN coalesce(try_cast(nullif(regexp_extract(replace(answer, ',', ''), '####\s*([\d.\-]+)', 1), '') AS DOUBLE), {LAST_NUMBER('answer')}) ELSE {LAST_NUMBER('answer')} END AS gold FROM ({_PLACED})")
def s02_question_set_profile(spark, d):
    path = _array_files(_qa(spark, d), _place(spark, "qa"))
    return R.question_set(spark, path, "hash_then_number").select("id", "question", "gold")


@query(f"SELECT id, question, array_to_string(steps, chr(10)) AS cot FROM ({_PLACED})")
def s03_question_set_with_steps(spark, d):
    return R.question_set(spark, _array_files(_qa(spark, d), _place(spark, "qa")), joined=True).select("id", "question", "cot")


@query("SELECT record_id, question, answer FROM cot_records WHERE answer IS NOT NULL AND steps IS NOT NULL")
def s04_strict_lines(spark, d):
    path = _place(spark, "lines")
    W.json_lines(_qa(spark, d), path)
    return R.lines(spark, path, "record_id bigint, question string, answer string")


_LINE = "CASE WHEN event_id % 10 = 3 THEN '{broken' WHEN event_id % 10 = 4 THEN '' WHEN event_id % 10 = 5 THEN '{\"event_id\": ' || event_id || '}' ELSE '{\"event_id\": ' || event_id || ', \"kind\": \"' || event_type || '\"}' END"


@query("SELECT event_id, event_type AS kind FROM events WHERE event_id % 10 NOT IN (3, 4, 5)")
def s05_tolerant_lines(spark, d):
    path = _place(spark, "tolerant")
    table(spark, d, "events").select(F.expr(_LINE).alias("value")).write.text(path)
    return R.tolerant_lines(spark, path, "event_id bigint, kind string", required=["kind"])


@query("SELECT item_id::INT AS question_id, question AS query, 'a, \"b\"' AS options, upper(substr('abcd', cast(1 + item_id % 4 AS INT), 1)) AS label FROM eval_items")
def s06_choices_csv(spark, d):
    path = _place(spark, "csv")
    rows = table(spark, d, "eval_items").select(
        F.col("item_id").cast("int").alias("Index"), F.col("question").alias("Question"), F.lit('a, "b"').alias("Options"), F.expr("'(' || substr('abcd', cast(1 + item_id % 4 as int), 1) || ')'").alias("Correct Answer")
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return R.choices_csv(spark, path)


@query("SELECT item_id AS index, question, '' AS image_path, CASE WHEN item_id % 2 = 0 THEN '' ELSE benchmark END AS category, substr('ABCD', cast(1 + item_id % 4 AS INT), 1) AS label FROM eval_items")
def s07_choices_json(spark, d):
    rows = table(spark, d, "eval_items").select(
        F.col("item_id").alias("index"), "question", F.expr("'(' || substr('abcd', cast(1 + item_id % 4 as int), 1) || ')'").alias("answer"), F.when(F.col("item_id") % 2 == 1, F.col("benchmark")).alias("category")
    )
    return R.choices_json(spark, _array_file(rows, _place(spark, "mcq"))).select("index", "question", "image_path", "category", "label")


@query("SELECT 'q ' || event_id AS question, event_type || ' then-' || user_id AS steps, user_id::VARCHAR AS answer FROM events")
def s08_piped_text(spark, d):
    path = _place(spark, "piped")
    table(spark, d, "events").selectExpr("'q ' || event_id || '||' || event_type || '  then-' || user_id || ' ## ' || user_id AS value").write.text(path)
    out = R.piped_text(spark, path)
    return out.select("question", F.array_join("steps", " ").alias("steps"), "answer")


@query("SELECT n_name AS key, n_nationkey AS id, n_regionkey AS region FROM nation")
def s09_keyed_objects(spark, d):
    entries = F.struct("n_name", F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")))
    doc = table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entries))).alias("value"))
    path = _place(spark, "keyed")
    W.document(doc, path)
    return R.keyed_objects(spark, path, "id int, region int")


_ONE = "SELECT problem_id, run_name, dataset, any_value(prefix) AS prefix, any_value(adv_answer) AS adv_answer, any_value(len(scores)) AS n FROM search_results GROUP BY 1, 2, 3"


@query(_ONE)
def s10_results_by_name(spark, d):
    """Partitioned writing gives folders of run and dataset; the file name holds the id."""
    rows = table(spark, d, "search_results").dropDuplicates(["problem_id", "run_name", "dataset"])
    root = _place(spark, "results")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = rows.select("run_name", "dataset", F.col("problem_id").alias("id"), "prefix", "adv_answer", "scores").repartition(1)
    parts.write.partitionBy("run_name", "dataset", "id").json(f"{root}-parts")
    for status in fs.globStatus(hadoop.Path(f"{root}-parts/*/*/*/*.json")):
        run, dataset, key = (x.partition("=")[2] for x in str(status.getPath().toString()).split("/")[-4:-1])
        fs.mkdirs(hadoop.Path(f"{root}/{run}/{dataset}"))
        fs.rename(status.getPath(), hadoop.Path(f"{root}/{run}/{dataset}/problem_{key}.json"))
    out = R.results_by_name(spark, f"{root}/*/*/*.json")
    return out.select("problem_id", "run_name", "dataset", "prefix", "adv_answer", F.size("scores").cast("long").alias("n"))


@query("SELECT record_id, 'folder' AS source FROM cot_records WHERE split = 'val' UNION ALL SELECT record_id, 'column' FROM cot_records WHERE split = 'test'")
def s11_split_table(spark, d):
    rows = table(spark, d, "cot_records").select("record_id", "split")
    root = _place(spark, "split")
    rows.where("split = 'val'").drop("split").write.parquet(f"{root}/val")
    a = R.split_table(spark, f"{root}@val").select("record_id", F.lit("folder").alias("source"))
    return a.unionByName(R.split_table(spark, f"{d}/cot_records.parquet@test").select("record_id", F.lit("column").alias("source")))


@query("SELECT event_id, event_type AS folder FROM events WHERE event_type <> 'error'")
def s12_folders(spark, d):
    root = _place(spark, "folders")
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = table(spark, d, "events")
    for k in kinds:
        rows.where(F.col("event_type") == k).select("event_id").write.json(f"{root}/{k}")
    rest = rows.where(~F.col("event_type").isin(*kinds)).select("event_id", F.col("event_type").alias("folder"))
    return R.folders(spark, root, "event_id bigint", exclude=["error"]).unionByName(rest)


@query("SELECT item_id AS index, question FROM eval_items UNION ALL SELECT item_id + 1000, NULL FROM eval_items")
def s13_by_extension(spark, d):
    rows = table(spark, d, "eval_items")
    a, b = _place(spark, "ext") + ".json", _place(spark, "ext") + ".jsonl"
    _array_file(rows.select(F.col("item_id").alias("index"), "question"), a)
    W.json_lines(rows.select((F.col("item_id") + 1000).alias("index")), b)
    return R.by_extension(spark, [a, b], "index bigint, question string")


@query("SELECT record_id AS id, question, split FROM cot_records WHERE split <> 'train' UNION ALL SELECT item_id, question, split FROM eval_items")
def s14_mapped_columns(spark, d):
    a = R.mapped(table(spark, d, "cot_records").where("split <> 'train'"), {"record_id": "id"}, ["id", "question", "split"])
    return a.unionByName(R.mapped(table(spark, d, "eval_items"), {"item_id": "id"}, ["id", "question", "split"]))


@query("SELECT vec_id AS qid, label::VARCHAR AS dataset, 0 AS step, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::INT AS n FROM embeddings")
def s15_vectors(spark, d):
    path = _place(spark, "vectors")
    W.vectors(table(spark, d, "embeddings").select(F.col("label").cast("string").alias("dataset"), F.col("vec_id").alias("qid"), F.lit(0).alias("step"), F.col("embedding").alias("vec")), path)
    return spark.read.parquet(path).select("qid", "dataset", "step", F.round(F.col("vec")[0].cast("double"), 6).alias("first"), F.size("vec").alias("n"))


@query("SELECT event_id, event_type AS text FROM events")
def s16_decoded(spark, d):
    url = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("data:image/png;base64,")).otherwise(F.lit("")), F.base64(F.col("event_type").cast("binary")))
    return table(spark, d, "events").select("event_id", R.decoded(url).cast("string").alias("text"))


@query("SELECT dataset, count(*) AS num_samples, count(*) FILTER (correct) AS num_correct, count(DISTINCT record_id) AS ids FROM sample_results GROUP BY 1")
def s17_summary_document(spark, d):
    """The summary and its samples, read back."""
    rows = table(spark, d, "sample_results")
    summary = rows.groupBy("dataset").agg(F.count("*").alias("num_samples"), F.count_if("correct").alias("num_correct"))
    path = _place(spark, "summary")
    W.summary_lines(summary, rows.select("dataset", F.col("record_id").alias("id"), "correct"), path)
    ids = R.lines(spark, f"{path}/samples", "dataset string, id bigint, correct boolean").groupBy("dataset").agg(F.count_distinct("id").alias("ids"))
    top = R.lines(spark, f"{path}/summary", "dataset string, num_samples bigint, num_correct bigint")
    return top.join(ids.withColumnRenamed("dataset", "_dataset"), F.col("dataset").eqNullSafe(F.col("_dataset"))).drop("_dataset")


@query("SELECT doc_id, lang, n_chars FROM documents")
def s18_json_lines(spark, d):
    path = _place(spark, "jsonl")
    W.json_lines(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path)
    return R.lines(spark, path, "doc_id bigint, lang string, n_chars bigint")


@query("SELECT 'split: ' || split || chr(10) || 'n: ' || count(*) || chr(10) AS value FROM cot_records GROUP BY split")
def s19_report(spark, d):
    return W.report(table(spark, d, "cot_records").groupBy("split").agg(F.count("*").alias("n")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s20_save_batch(spark, d):
    path = _place(spark, "batch")
    W.save_batch(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey AS step, 'train/loss' AS name, n_nationkey / 2.0::DOUBLE AS value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey FROM nation")
def s21_metrics(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("step"), (F.col("n_nationkey") / 2).alias("train/loss"), F.col("n_regionkey").alias("region"))
    path = _place(spark, "metrics")
    W.metrics(rows, "step", path)
    return spark.read.parquet(path)


@query("SELECT doc_id FROM documents WHERE n_chars < 900")
def s22_valid_ids(spark, d):
    path = _place(spark, "ids")
    docs = table(spark, d, "documents")
    W.valid_ids(docs, "doc_id", F.col("n_chars") < 900, path, "chars-lt-900")
    return W.valid_ids(docs, "doc_id", F.col("n_chars") < 900, path, "chars-lt-900")


@query("SELECT event_id, event_type AS kind, NULL AS line FROM events WHERE event_id % 10 NOT IN (3, 4, 5) UNION ALL SELECT NULL, NULL, '{broken' FROM events WHERE event_id % 10 = 3")
def s23_events_and_rejects(spark, d):
    """Good lines as events, malformed ones kept in a side table instead of dropped."""
    path = _place(spark, "wire")
    table(spark, d, "events").select(F.expr(_LINE).alias("value")).write.text(path)
    schema = "event_id bigint, kind string"
    good = R.tolerant_lines(spark, path, schema, required=["kind"]).withColumn("line", F.lit(None).cast("string"))
    return good.unionByName(R.rejected_lines(spark, path, schema), allowMissingColumns=True)


@query(
    """WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
 SELECT user_id, max(event_type) FILTER (i = 1) AS event_type_1, max(value) FILTER (i = 1) AS value_1, max(event_type) FILTER (i = 2) AS event_type_2, max(value) FILTER (i = 2) AS value_2 FROM r WHERE i <= 2 GROUP BY 1""",
    name="pivot_samples",
)
def s24_pivot_samples(spark, d):
    return W.wide_generations(table(spark, d, "events"), "user_id", "event_id", ["event_type", "value"], 2)


@query("SELECT event_type AS name, arg_max(value, event_id) AS value, max(event_id) AS step FROM events GROUP BY 1")
def s25_latest_metrics(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), "value", F.col("event_id").alias("step"))
    return W.latest_metrics(rows, "step", "name", "value")
