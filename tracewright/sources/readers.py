"""Readers of question sets, results, summaries and shards.

Every reader takes an explicit schema or a default one; none infers. JSON
arrays in one document are read in multi-line mode (one task per file); line
files split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import label, number

QA = "question string, answer string, steps array<string>"
CHOICE_CSV = "Index int, Question string, Options string, `Correct Answer` string"
CHOICE_JSON = "index bigint, image_path string, question string, answer string, category string, l2_category string"
TRIAL = "trial int, prefix string, prefix_token_ids array<bigint>, generated_text string, pred_answer double, correct boolean, attack_success boolean"
#: All layouts of a search result; the answers are of mixed type and stay text.
RESULT = (
    "question string, ground_truth string, prefix string, clean_text string, adv_text string, prefix_token_ids array<bigint>, scores array<double>, "
    "best_logit_diff double, baseline_logit_diff double, clean_logit_diff double, adv_logit_diff double, clean_answer string, adv_answer string, "
    "clean_correct boolean, adv_correct boolean, attack_success boolean, baseline_token_id bigint, target_token_id bigint, baseline_token_str string, "
    f"target_token_str string, best_fact string, all_results array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in TRIAL.split(','))}>>"
)


def question_set(spark: SparkSession, path: str, profile: str = "last_number", joined: bool = False) -> DataFrame:
    """JSON arrays of questions with the gold answer as a double; ``joined`` adds the steps as one text.

    ``path`` is a document or a folder of them, read as one set. ``file`` is a
    row's document, ``place`` its place in it, and ``id`` its place in the
    whole set, documents in the order of their paths: unique and dense from 0.
    A document is one task's work; an empty one has no rows, a null answer no gold.
    """
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(QA).json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("_m", F.monotonically_increasing_id())
    # Rows of a document are read in order by one task.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("_m")).cast("long") - 1).drop("_m")
    sizes = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(QA).json(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("_n"))
    before = sizes.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))  # a row per document
    rows = rows.join(before, "file").withColumn("id", F.col("_before") + F.col("place")).drop("_before")
    rows = rows.withColumn("gold", number("answer", profile))
    return rows.withColumn("cot", F.array_join("steps", "\n")) if joined else rows


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines without malformed and blank ones and those that lack a required field."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    keep = F.col("_bad").isNull()
    for name in required:
        keep = keep & F.col(name).isNotNull()
    return rows.where(keep).drop("_bad")


def rejected_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The malformed lines themselves."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return text.select(F.col("value").alias("line"), parsed["_bad"].alias("_b")).where("_b is not null").select("line")


def choices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Multiple choice CSV with a header; labels become capital letters."""
    rows = spark.read.option("header", True).option("escape", '"').schema(CHOICE_CSV).csv(path)
    return rows.select(F.col("Index").alias("question_id"), F.col("Question").alias("query"), F.col("Options").alias("options"), label("Correct Answer").alias("label"))


def choices_json(spark: SparkSession, path: str) -> DataFrame:
    """Multiple choice JSON array; absent keys become empty texts."""
    rows = spark.read.option("multiLine", True).schema(CHOICE_JSON).json(path)
    texts = ("image_path", "question", "answer", "category", "l2_category")
    return rows.select("index", *(F.coalesce(c, F.lit("")).alias(c) for c in texts)).withColumn("label", label("answer"))


def piped_text(spark: SparkSession, path: str) -> DataFrame:
    """question||step step step ## answer."""
    line = spark.read.text(path).where(F.trim("value") != "")
    rest = F.substring_index("value", "||", -1)
    steps, answer = F.trim(F.substring_index(rest, "##", 1)), F.trim(F.substring_index(rest, "##", -1))
    return line.select(F.substring_index("value", "||", 1).alias("question"), F.filter(F.split(steps, " "), lambda s: s != "").alias("steps"), answer.alias("answer"))


def keyed_objects(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """One JSON object whose keys are row names: key and the fields of each value."""
    whole = spark.read.text(path, wholetext=True)
    fields = ", ".join(f.strip().replace(" ", ": ", 1) for f in value_schema.split(","))
    rows = whole.select(F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("key", "v"))
    return rows.select("key", "v.*")


def results_by_name(spark: SparkSession, path: str, schema: str = RESULT, pattern: str = r"problem_(\d+)\.json") -> DataFrame:
    """One JSON document per problem; the id is in the file name, dataset and run are its folders."""
    rows = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).schema(schema).json(path)
    name = F.col("_metadata.file_path")
    folder = lambda k: F.element_at(F.split(name, "/"), -k)
    return rows.select(F.regexp_extract(name, pattern, 1).cast("long").alias("problem_id"), folder(2).alias("dataset"), folder(3).alias("run_name"), "*")


def split_table(spark: SparkSession, location: str) -> DataFrame:
    """``path@split``: the split is a sub-folder if there is one, else a column."""
    path, _, split = location.partition("@")
    if not split:
        return spark.read.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{split}")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.parquet(f"{path}/{split}")
    return spark.read.parquet(path).where(F.col("split") == split)


def folders(spark: SparkSession, root: str, schema: str, exclude: Sequence[str] = (), pattern: str = "*/*.json") -> DataFrame:
    """All files below the sub-folders of a root but some, with the folder's name; one scan."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", False).json(f"{root}/{pattern}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    out = rows.select("*", folder.alias("folder"))
    return out.where(~F.col("folder").isin(*exclude)) if exclude else out


def by_extension(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """JSON arrays and JSON line files as one table."""
    out = None
    for p in paths:
        one = spark.read.schema(schema).option("multiLine", p.endswith(".json")).json(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def mapped(df: DataFrame, names: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """A landed dataset under common column names: theirs -> ours."""
    return df.withColumnsRenamed(names).select(*keep)


def decoded(data_url: Column) -> Column:
    """Bytes of base64 text or of a data URL."""
    return F.unbase64(F.regexp_replace(data_url, r"^data:[^,]*,", ""))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder whose names match; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(folder).select("path", "length")


def with_existing(rows: DataFrame, path: str, fallback: str, listing: DataFrame, listed: str, into: str = "path") -> DataFrame:
    """The preferred path where a listing has it, else the fallback."""
    have = listing.select(F.col(listed).alias("_have")).distinct()
    return rows.join(have, F.col(path) == F.col("_have"), "left").withColumn(into, F.coalesce("_have", fallback)).drop("_have")
