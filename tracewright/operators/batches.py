"""Batch-relative sequence operators: they need the longest or latest of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import matched_segments, pad


def pad_to_batch(df: DataFrame, batch: str, columns: dict[str, object], side: str = "right") -> DataFrame:
    """Every column padded to the longest row of its batch: column -> padding value."""
    w = Window.partitionBy(batch)
    out = df
    for name, value in columns.items():
        out = out.withColumn(name, pad(F.col(name), F.max(F.size(name)).over(w), value, side))
    return out


def align_on_token(df: DataFrame, batch: str, ids: str, token: int, parallel: dict[str, object], pad_id: int = 0) -> DataFrame:
    """Rows shifted right until their first ``token`` stands where the batch's latest does.

    ``parallel`` columns (labels, masks, ...) get their own value in front and
    ``position_ids`` count from 0 behind the padding; rows without the token stay.
    """
    at = F.array_position(ids, F.lit(token).cast("int"))
    latest = F.max(at).over(Window.partitionBy(batch))
    shift = F.when(at > 0, latest - at).otherwise(0)
    out = df.withColumn("_k", shift.cast("int")).withColumn("_n", F.size(ids))
    front = lambda value, name: F.concat(F.array_repeat(F.lit(value), F.col("_k")), F.col(name))
    out = out.withColumn("position_ids", F.concat(F.array_repeat(F.lit(0), F.col("_k")), F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn(ids, front(pad_id, ids))
    for name, value in parallel.items():
        out = out.withColumn(name, front(value, name))
    return out.drop("_k", "_n")


def flatten_steps(df: DataFrame, batch: str, nested: str, value: int = 0) -> DataFrame:
    """Nested step ids in one array, padded to the batch's longest."""
    return pad_to_batch(df.withColumn(nested, F.flatten(nested)), batch, {nested: value})


def stream_positions(df: DataFrame, batch: str, row: str, ids: str, mask: str, start: int, end: int, skip_first: bool = False) -> DataFrame:
    """Places, in the un-padded stream of a batch, of tokens from a start up to its end.

    Result: batch, row, segment, pos, index. The stream offset of a row is the
    running count of mask bits of the rows before it.
    """
    kept = F.aggregate(mask, F.lit(0), lambda a, m: a + m)
    w = Window.partitionBy(batch).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_o", F.coalesce(F.sum(kept).over(w), F.lit(0)))
    segments = placed.select(batch, row, mask, "_o", F.posexplode(matched_segments(F.col(ids), start, end)).alias("segment", "_s"))
    if skip_first:
        segments = segments.where("segment > 0")
    cells = segments.select(batch, row, "segment", mask, "_o", F.explode(F.sequence(F.col("_s.a"), F.col("_s.b") - 1)).alias("pos"))
    before = F.aggregate(F.slice(mask, F.lit(1), F.col("pos")), F.lit(0), lambda a, m: a + m)
    return cells.where(F.element_at(mask, F.col("pos") + 1) == 1).select(batch, row, "segment", "pos", (F.col("_o") + before).alias("index"))


def pivot_samples(df: DataFrame, step: str, position: str, samples: int, columns: Sequence[str]) -> DataFrame:
    """One wide row per step: the fields of each of its first samples."""
    cell = lambda i, c: F.max(F.when(F.col(position) == i, F.col(c))).alias(f"{c}_{i}")
    return df.groupBy(step).agg(*(cell(i, c) for i in range(samples) for c in columns))


def count_bits(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + m)
