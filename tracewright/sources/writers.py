"""Writers: job commits give atomicity; single files only for small summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(df: DataFrame, path: str, keys: Sequence[str] = ("dataset", "qid", "step"), vector: str = "vec") -> None:
    """Vectors as a parquet table instead of archives of arrays."""
    df.select(*keys, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def summary_lines(summary: DataFrame, samples: DataFrame, path: str) -> None:
    """A run's summary and its evaluated samples as lines in two folders, so that no value grows with the table."""
    json_lines(summary, f"{path}/summary")
    json_lines(samples, f"{path}/samples")


def document(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(stats: DataFrame, path: str | None = None) -> DataFrame:
    """A text report of a short table: one "name: value" line per column, a blank line between rows."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in stats.columns), F.lit(""))
    out = stats.select(lines.alias("value"))
    if path:
        document(out, path)
    return out


def save_batch(df: DataFrame, path: str) -> None:
    """A batch as parquet; never pickled."""
    df.write.mode("overwrite").parquet(path)


def metrics(df: DataFrame, step: str, path: str | None = None) -> DataFrame:
    """A wide metrics table as rows (step, name, value), appended to a table if a path is given."""
    names = [c for c in df.columns if c != step]
    rows = df.select(step, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{c}`").cast("double") for c in names)))).alias("name", "value"))
    if path:
        rows.write.mode("append").parquet(path)
    return rows


def latest_metrics(rows: DataFrame, step: str, name: str, value: str) -> DataFrame:
    """The last written value of each name."""
    return rows.groupBy(name).agg(F.max_by(value, step).alias(value), F.max(step).alias(step))


def valid_ids(df: DataFrame, key: str, keep, path: str, fingerprint: str) -> DataFrame:
    """Ids that pass a costly filter, kept under the fingerprint of its rule and input.

    The job committer makes the folder appear whole or not at all; an existing
    one is reused.
    """
    spark = df.sparkSession
    where = f"{path}/{fingerprint}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.where(keep).select(key).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def wide_generations(df: DataFrame, step: str, order: str, fields: Sequence[str], samples: int) -> DataFrame:
    """One row per step with the fields of its first samples side by side."""
    w = Window.partitionBy(step).orderBy(order)
    ranked = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= samples)
    cells = [F.max(F.when(F.col("_i") == i + 1, F.col(f))).alias(f"{f}_{i + 1}") for i in range(samples) for f in fields]
    return ranked.groupBy(step).agg(*cells)
