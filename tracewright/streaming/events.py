"""Event streams: parsing, keyed append, running statistics, pools."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

EVENT = "ts double, pid bigint, req_ids array<string>, latents array<array<double>>, rank int, seq bigint"


def parse(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """Parsed events of line-delimited JSON, batch or stream; malformed lines have a null event."""
    return lines.select("value", F.from_json("value", schema).alias("e"))


def rejects(parsed: DataFrame) -> DataFrame:
    """Lines without a usable event, for a side table."""
    return parsed.where(F.col("e").isNull() | F.col("e.req_ids").isNull()).select("value")


def request_key(rid: Column) -> Column:
    """struct(parent, sample) of "sample_parent", "parent" or "..._parent"; else the id itself and 0."""
    strict, tail = F.regexp_extract(rid, r"^(\d+)[_-](\d+)$", 2), F.regexp_extract(rid, r"_(\d+)$", 1)
    first = F.regexp_extract(rid, r"^(\d+)[_-](\d+)$", 1)
    before = F.regexp_extract(rid, r"(?:^|_)(\d+)_\d+$", 1)
    parent = F.when(strict != "", strict).when(tail != "", tail).otherwise(rid)
    sample = F.when(strict != "", first).when((tail != "") & (before != ""), before).otherwise("0")
    return F.struct(parent.alias("parent"), sample.cast("int").alias("sample"))


def steps(parsed: DataFrame, rank: int | None = None) -> DataFrame:
    """(parent, sample, seq, latent): one row per request and event, empty latents left out.

    With a rank, events of other ranks and without one are dropped. ``seq``
    orders the list later, as arrival does not.
    """
    rows = parsed.where("e is not null").select("e.*")
    if rank is not None:
        rows = rows.where(F.col("rank") == rank)
    pairs = rows.select("seq", F.explode(F.arrays_zip("req_ids", "latents")).alias("p"))
    kept = pairs.where(F.size("p.latents") > 0)
    return kept.select(request_key(F.col("p.req_ids")).alias("k"), "seq", F.col("p.latents").alias("latent")).select("k.parent", "k.sample", "seq", "latent")


def appended(rows: DataFrame, keys: list[str], order: str, value: str, into: str = "items") -> DataFrame:
    """Batch form of keyed append: the list per key in sequence order."""
    pairs = F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(pairs), lambda s: s["v"]).alias(into))


def append_stream(rows: DataFrame, target: str) -> Callable[[DataFrame, int], None]:
    """Streaming form of keyed append: a ``foreachBatch`` function that writes the rows under the id of their micro-batch.

    Nothing is kept between micro-batches and nothing is written twice: a
    replay overwrites its own rows. ``appended`` makes the lists when they are
    read, in sequence order whatever the order of arrival.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.select(*rows.columns).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return run


def stats_stream(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Streaming form of min, mean, count and a sticky flag per key: constant state per key."""
    key_kind = dict(rows.dtypes)[key]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least, total, n, seen = state.get if state.exists else (float("inf"), 0.0, 0, False)
        for pdf in batches:
            x = pdf[value].dropna()
            if len(x):
                least, total, n = min(least, float(x.min())), total + float(x.sum()), n + len(x)
                seen = seen or bool((x > 0).any())
        state.update((least, total, n, seen))
        yield pd.DataFrame({key: [k[0]], "min_len": [least if n else None], "mean_len": [total / n if n else None], "cnt": [n], "seen": [seen]})

    return rows.groupBy(key).applyInPandasWithState(
        fold, f"{key} {key_kind}, min_len double, mean_len double, cnt bigint, seen boolean", "least double, total double, n bigint, seen boolean", "update", GroupStateTimeout.NoTimeout
    )


def until_full(target: str, size: int, consume: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows gather in a table until there are ``size``, then a consumer gets them with the batch id.

    Rows, their count and the list of drained batches are written under the id
    of the micro-batch, so a replay of it after a failure overwrites instead
    of doubling. A replay between consuming and recording hands the consumer
    the same rows under the same id again; a consumer that writes under that
    id keeps them once. Only counts are read per micro-batch, never the pool.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        written = spark.read.schema(batch.schema).parquet(f"{target}/rows/batch={batch_id}")
        written.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/counts/batch={batch_id}")
        open_ = spark.read.schema("n bigint, batch bigint").parquet(f"{target}/counts")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/drained")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            drained = spark.read.schema("batch bigint, by bigint").parquet(f"{target}/drained").where(F.col("by") < batch_id)
            open_ = open_.join(drained, "batch", "left_anti")
        if (open_.agg(F.sum("n")).first()[0] or 0) >= size:
            rows = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(f"{target}/rows")
            consume(rows.join(open_.select("batch"), "batch", "left_semi").drop("batch"), batch_id)
            open_.select("batch").write.mode("overwrite").parquet(f"{target}/drained/by={batch_id}")

    return run


def latest_checkpoint(spark: SparkSession, folder: str) -> int | None:
    """The last committed batch of a streaming checkpoint, as a tracker file would name it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n) for n in names if n.isdigit()]
    return max(done) if done else None


def windowed(rows: DataFrame, ts: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per event-time window; rows later than the watermark are left out."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n"))
