"""Sorting, limits, top-k, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_with_refill(df: DataFrame, score: str, key: str, keep: Column, k: int, pool: DataFrame, seed: int = 42, turn: Column | None = None) -> DataFrame:
    """The k best rows that pass a test; if fewer pass, rows of a fallback pool in hashed order, or in that of ``turn``, fill up.

    Both sides are TakeOrdered, so at most k rows per task travel.
    """
    best = df.where(keep).orderBy(F.desc(score), key).limit(k).select(key, F.lit(0).alias("_g"), F.row_number().over(Window.orderBy(F.desc(score), key)).alias("_r"))
    turn = F.xxhash64(F.lit(seed), key) if turn is None else turn
    spare = pool.orderBy(turn, key).limit(k).select(key, F.lit(1).alias("_g"), F.row_number().over(Window.orderBy(turn, key)).alias("_r"))
    return best.unionByName(spare).orderBy("_g", "_r").limit(k).select(key, (F.col("_g") == 1).alias("refilled"))


def best_row(df: DataFrame, by: Sequence[str], score: str, tie: str, value: str, largest: bool = True) -> DataFrame:
    """Value of the best row per group: the last of equal maxima, the first of equal minima."""
    pick = F.max_by if largest else F.min_by
    return df.groupBy(*by).agg(pick(value, F.struct(score, tie)).alias(value), (F.max if largest else F.min)(score).alias(score))


def top_per_group(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int, into: str = "rank") -> DataFrame:
    """The k best rows per group with their rank; Spark prunes per partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn(into, F.row_number().over(w)).where(F.col(into) <= k)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42, turn: Column | None = None) -> DataFrame:
    """n rows in a seeded random order, or in that of ``turn``, ties by key; the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key) if turn is None else turn, key).limit(n)


def by_number_in_name(df: DataFrame, name: str, into: str = "number") -> DataFrame:
    """The number inside a file name, to sort by."""
    return df.withColumn(into, F.regexp_extract(name, r"(\d+)", 1).try_cast("long"))


def beyond_newest(df: DataFrame, by: Sequence[str], order: str, keep: int) -> DataFrame:
    """What to delete so that only the newest ``keep`` remain."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).drop("_r")


def newest(df: DataFrame, by: Sequence[str], order: str, keep: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def first_beyond(df: DataFrame, by: Sequence[str], order: str, value: str, threshold: float) -> DataFrame:
    """Per group the first place where the running maximum exceeds a threshold, and that maximum."""
    # The running maximum first exceeds it exactly where a value first does.
    return df.where(F.col(value) > threshold).groupBy(*by).agg(F.min(order).alias("stopped_at"), F.min_by(value, order).alias("best"))


def repeat_sampler(df: DataFrame, key: str, total: int, batch: int, repeats: int, mini: int, seed: int = 42) -> DataFrame:
    """Permuted rows in full batches, each batch ``repeats`` times, each row ``mini`` times in turn.

    Result: key and ``pos``, its place in the stream. ``key`` is dense from 0.
    """
    from .windows import number_rows

    order = df.select(key).withColumn("_h", F.xxhash64(F.lit(seed), key))
    placed = number_rows(order, ["_h", key], "_i").where(F.col("_i") < total - total % batch)
    out = placed.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_mini", F.explode(F.sequence(F.lit(0), F.lit(mini - 1))))
    b, j = F.floor(F.col("_i") / batch), F.col("_i") % batch
    pos = b * batch * repeats * mini + F.col("_rep") * batch * mini + j * mini + F.col("_mini")
    return out.select(key, pos.alias("pos"))


def weighted_mix(df: DataFrame, source: str, weights: dict[str, float], key: str, seed: int = 42, turn: Column | None = None) -> DataFrame:
    """Rows kept with their source's weight relative to the largest; a hash of the key decides, or ``turn``, a number in [0, 1).

    Sources without a weight, null among them, are left out.
    """
    top = max(weights.values())
    share = F.coalesce(F.create_map(*(F.lit(x) for s, w in weights.items() for x in (s, w / top)))[F.col(source)], F.lit(0.0))
    return df.where((F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000 if turn is None else turn) < share)


def scaled_epoch(df: DataFrame, key: str, total: int, length: int) -> DataFrame:
    """An epoch of any length: position i is row i modulo the real length."""
    rounds = -(-length // total)
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return out.withColumn("pos", F.col("_k") * total + F.col(key)).where(F.col("pos") < length).drop("_k")


def first_items(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)
