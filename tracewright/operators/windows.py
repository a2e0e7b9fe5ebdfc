"""Group-relative statistics and ordered recurrences over rollouts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise


def _with_stats(df: DataFrame, group: str, *stats: Column) -> DataFrame:
    """``df`` with aggregates of each row's group; partial sums are what is shuffled on the group."""
    sums = df.groupBy(F.col(group).alias("_group")).agg(*stats)
    return df.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def group_advantage(df: DataFrame, group: str, score: str, into: str = "advantage", eps: float = 1e-6, inside: bool = False, single: str = "error", scale: bool = True) -> DataFrame:
    """(score - mean) / (sample deviation + eps) within groups.

    ``single``: groups of one row are an error, dropped, or given 0. ``inside``
    puts eps under the root: sqrt(var + eps). Without ``scale`` only the mean
    is subtracted. Rows of a null group are a group. The moments are aggregated
    before they are shuffled and joined back, so a group that holds a third of
    all rows is no single task.
    """
    out = _with_stats(df, group, F.count("*").alias("_n"), F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    if single == "drop":
        out = out.where("_n > 1")
    below = F.sqrt(F.col("_s") * F.col("_s") + eps) if inside else F.col("_s") + eps
    value = F.col(score) - F.col("_m")
    value = value / below if scale else value
    if single == "error":
        value = F.when(F.col("_n") > 1, value).otherwise(F.raise_error(F.lit("a group has one row only")).cast("double"))
    elif single == "zero":
        value = F.when(F.col("_n") > 1, value).otherwise(0.0)
    return out.withColumn(into, value).drop("_n", "_m", "_s")


def fixed_groups(df: DataFrame, row: str, size: int, into: str = "group") -> DataFrame:
    """Groups of ``size`` consecutive rows by a dense key."""
    return df.withColumn(into, F.floor(F.col(row) / size))


def leave_one_out(df: DataFrame, group: str, score: str, into: str = "advantage") -> DataFrame:
    """Score minus the mean of the others of its group; groups of one row are dropped, null is a group."""
    out = _with_stats(df, group, F.count("*").alias("_n"), F.sum(score).alias("_t")).where("_n > 1")
    return out.withColumn(into, F.col(score) - (F.col("_t") - F.col(score)) / (F.col("_n") - 1)).drop("_n", "_t")


def broadcast_to_mask(value: Column, mask: Column) -> Column:
    """An array with the value where the mask is set, else 0."""
    return F.transform(mask, lambda m: value * m)


def backfill(df: DataFrame, by: Sequence[str], order: str, value: str, into: str) -> DataFrame:
    """Zeros take the next non-zero to the right; without one they stay 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(into, F.coalesce(F.first(F.nullif(F.col(value), F.lit(0.0)), ignorenulls=True).over(w), F.lit(0.0)))


def fill_from_right(x: np.ndarray) -> np.ndarray:
    """Zeros take the next non-zero to the right, or stay 0."""
    at = np.where(x != 0, np.arange(len(x)), len(x))
    nearest = np.minimum.accumulate(at[::-1])[::-1] if len(x) else at
    return np.append(x, 0.0)[nearest.astype(int)]


def backfill_array(values: Column) -> Column:
    """The same within an array of doubles; a fold in expressions would copy the array per element."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else fill_from_right(np.asarray(x, dtype=float)).tolist())

    return run(values)


def step_advantage(df: DataFrame, group: str, row: str, scores: str, ends: str, delimiters: str, mask: str, eps: float = 1e-6, normalize: bool = True, silent: int = 5) -> DataFrame:
    """Step scores normalised over the group's pooled steps, spread to the left, silent behind delimiters.

    ``scores`` and ``mask`` are arrays per token, ``ends`` and ``delimiters``
    0-based positions. Result: df with ``advantage``, an array per token.
    """
    steps = df.select(group, row, F.explode(ends).alias("_p"), scores).withColumn("_x", F.element_at(scores, F.col("_p") + 1))
    stats = steps.groupBy(group).agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"), F.count("*").alias("_k"))
    factor = F.lit(1.78) / (F.sqrt(F.col("_k") - 1) + eps) if normalize else F.lit(1.0)
    scaled = F.transform(
        scores, lambda x, i: F.when(F.array_contains(ends, i), (x - F.col("_m")) / (F.col("_s") + eps) * factor).otherwise(x)
    )
    filled = F.zip_with(backfill_array(scaled), mask, lambda x, m: x * m)
    last = F.size(scores) - 1
    quiet = lambda i: F.exists(delimiters, lambda p: F.exists(F.sequence(F.lit(0), F.lit(silent - 1)), lambda j: F.least(p + j, last) == i))
    return df.join(stats, group).withColumn("advantage", F.transform(filled, lambda x, i: F.when(quiet(i), 0.0).otherwise(x))).drop("_m", "_s", "_k")


def gae(rewards: np.ndarray, values: np.ndarray, gamma: float, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Advantages and returns of one sequence: A_t = delta_t + gamma lam A_(t+1)."""
    nxt = np.append(values[1:], 0.0)
    delta = rewards + gamma * nxt - values
    out, last = np.empty(len(delta)), 0.0
    for t in range(len(delta) - 1, -1, -1):
        last = delta[t] + gamma * lam * last
        out[t] = last
    return out, out + values


def discounted(rewards: np.ndarray, mask: np.ndarray, gamma: float) -> np.ndarray:
    """Discounted return; what is carried is zeroed behind a masked position."""
    out, carry = np.empty(len(rewards)), 0.0
    for t in range(len(rewards) - 1, -1, -1):
        carry = rewards[t] + gamma * carry
        out[t] = carry
        carry *= mask[t]
    return out


def with_gae(df: DataFrame, rewards: str, values: str, gamma: float, lam: float) -> DataFrame:
    """Columns advantages and returns (arrays): a reverse recurrence per row, in Arrow batches."""

    @F.pandas_udf("advantages array<double>, returns array<double>")
    def run(r: pd.Series, v: pd.Series) -> pd.DataFrame:
        both = [gae(np.asarray(a, dtype=float), np.asarray(b, dtype=float), gamma, lam) for a, b in zip(r, v)]
        return pd.DataFrame({"advantages": [a.tolist() for a, _ in both], "returns": [b.tolist() for _, b in both]})

    return df.withColumn("_g", run(rewards, values)).select("*", "_g.advantages", "_g.returns").drop("_g")


def with_discounted(df: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    """Column returns (array)."""

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([discounted(np.asarray(a, dtype=float), np.asarray(b, dtype=float), gamma).tolist() for a, b in zip(r, m)])

    return df.withColumn("returns", run(rewards, mask))


def reverse_scan(df: DataFrame, by: Sequence[str], order: str, gain: Column, add: Column, into: str, behind: bool = False, parts: int | None = None) -> DataFrame:
    """Column x with x_t = add_t + gain_t * x_(t+1) within groups in order, or with ``behind`` the x_(t+1) of each row; 0 stands behind the last.

    Rows are ranged by group and order, so a group that holds a third of all
    rows lies in many parts. Each part runs the recurrence as if 0 stood
    behind it and keeps the product of the gains; a group's parts are then
    joined by one row each, and every row adds its product times what really
    stands behind its part. Null groups are groups; ties in order come in any
    order; an empty table stays empty; a null gain or add makes x null from
    there on.
    """
    given = [c for c in df.columns if c != into]
    rows = df.withColumn("_gain", gain.cast("double")).withColumn("_add", add.cast("double"))
    ranged = rows.repartitionByRange(parts, *by, order) if parts else rows.repartitionByRange(*by, order)
    ranged = ranged.sortWithinPartitions(*by, F.desc(order)).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + ", _behind double, _product double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, product = None, 0.0, 1.0
        for b in batches:
            xs, products = [], []
            for key, g, a in zip(zip(*(b.column(c).to_pylist() for c in by)), b.column("_gain").to_pylist(), b.column("_add").to_pylist()):
                if key != last:
                    last, x, product = key, 0.0, 1.0
                xs.append(x)
                products.append(product)
                if x is not None:
                    x, product = (None, None) if g is None or a is None else (a + g * x, product * g)
            columns = [*b.columns, pa.array(xs, pa.float64()), pa.array(products, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "_behind", "_product"])

    scanned = materialise(ranged.mapInArrow(run, schema), "scanned")
    own = lambda x: F.col("_add") + F.col("_gain") * x
    piece = F.struct("_part", own(F.col("_behind")).alias("x"), (F.col("_gain") * F.col("_product")).alias("product"))
    pieces = scanned.groupBy(*by, "_part").agg(F.min_by(piece, F.struct(order, F.lit(0))).alias("_e"))
    # At most one row per part of each group that lies in several of them.
    chains = pieces.groupBy(*by).agg(F.sort_array(F.collect_list("_e"), asc=False).alias("_l")).where(F.size("_l") > 1)
    kind = "struct<x double, all array<struct<part int, carry double>>>"
    begin = F.struct(F.lit(0.0).alias("x"), F.array().alias("all")).cast(kind)

    def step(s, e):
        here = F.struct(e["_part"].alias("part"), s["x"].alias("carry"))
        return F.struct((e["x"] + e["product"] * s["x"]).alias("x"), F.concat(s["all"], F.array(here)).alias("all")).cast(kind)

    carried = chains.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.explode(F.aggregate("_l", begin, step, lambda s: s["all"])).alias("_c"))
    met = scanned["_part"] == F.col("_c.part")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = scanned.join(carried, met, "left")
    before = F.when(F.col("_c").isNull(), F.col("_behind")).otherwise(F.col("_behind") + F.col("_product") * F.col("_c.carry"))
    return out.select(*given, (before if behind else own(before)).alias(into))


def gae_rows(df: DataFrame, by: Sequence[str], order: str, reward: Column, value: Column, gamma: float, lam: float, parts: int | None = None) -> DataFrame:
    """Columns advantage and ret of rows, for sequences of any length.

    With z = v + lam A the recurrence needs no next value:
    z_t = lam r_t + (1 - lam) v_t + gamma lam z_(t+1), and A_t = r_t - v_t + gamma z_(t+1).
    """
    out = reverse_scan(df, by, order, F.lit(gamma * lam), lam * reward + (1 - lam) * value, "_z", True, parts)
    return out.withColumn("advantage", reward - value + gamma * F.col("_z")).withColumn("ret", F.col("advantage") + value).drop("_z")


def discounted_rows(df: DataFrame, by: Sequence[str], order: str, reward: Column, mask: Column, gamma: float, parts: int | None = None) -> DataFrame:
    """Column ret of rows: the discounted return; what is carried is zeroed behind a masked row."""
    out = reverse_scan(df, by, order, gamma * mask, mask * reward, "_z", True, parts)
    return out.withColumn("ret", reward + gamma * F.col("_z")).drop("_z")


def whiten_arrays(df: DataFrame, values: str, mask: str, into: str, eps: float = 1e-8) -> DataFrame:
    """Array elements whitened by the moments of all unmasked elements of the table."""
    from .aggregates import masked

    moments = df.select(F.explode(masked(F.col(values), F.col(mask))).alias("x")).agg(F.avg("x").alias("_m"), F.var_samp("x").alias("_v"))
    both = df.crossJoin(F.broadcast(moments))  # one row
    return both.withColumn(into, F.transform(values, lambda x: (x - F.col("_m")) / F.sqrt(F.col("_v") + eps))).drop("_m", "_v")


def mask_to_stop(tokens: Column, stop: int) -> Column:
    """1 through the first stop token, 0 behind it; all 1 without one."""
    at = F.array_position(tokens, F.lit(stop).cast("int"))
    return F.transform(tokens, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def rows_to_stop(df: DataFrame, by: Sequence[str], order: str, stop: Column, into: str) -> DataFrame:
    """The same over rows: 1 through the first stop row of each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, (F.coalesce(F.sum(stop.cast("int")).over(w), F.lit(0)) == 0).cast("int"))


def positions(df: DataFrame, by: Sequence[str], order: str, mask: str, into: str) -> DataFrame:
    """Position ids: running count of the mask minus one, at least 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.greatest(F.sum(mask).over(w) - 1, F.lit(0)))


def top_p(df: DataFrame, by: Sequence[str], prob: str, tie: str, p: float) -> DataFrame:
    """The smallest set of most probable rows whose mass exceeds p: mass before a row is at most p."""
    w = Window.partitionBy(*by).orderBy(F.desc(prob), tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(prob).over(w), F.lit(0.0))).where(F.col("_before") <= p).drop("_before")


def first_n(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The first n rows of each class."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def number_rows(df: DataFrame, order: Sequence[str], into: str = "row_id", blocks: int = 64) -> DataFrame:
    """Dense row numbers in a total order without one task seeing all rows.

    Rows are ranged into blocks, counted per block, and numbered within blocks;
    the offsets are one row per block. The ranged rows are written once, as
    bounds drawn twice from samples could differ.
    """
    ranged = materialise(df.repartitionByRange(blocks, *order).withColumn("_b", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_b").orderBy(*order)
    counts = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_o"))
    numbered = ranged.withColumn("_r", F.row_number().over(w)).join(F.broadcast(offsets), "_b")  # one row per block
    return numbered.withColumn(into, F.col("_o") + F.col("_r") - 1).drop("_b", "_n", "_o", "_r")


def place_scores(length: Column, width: int, score: Column) -> Column:
    """A reward at the last valid position of a row of ``width`` tokens."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == length - 1, score).otherwise(0.0))


def place_at(positions_: Column, scores: Column, width: int) -> Column:
    """Rewards at given 0-based positions, the last one of equal positions counting."""
    found = F.map_from_arrays(positions_, scores)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(found, i), F.lit(0.0)))


def joined_pairs(items: Column, separator: str = " ") -> Column:
    """Consecutive items joined two by two; an odd last one stands alone."""
    n = F.size(items)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(2))).otherwise(F.slice(F.array(F.lit(0)), 1, 0))
    return F.transform(at, lambda i: F.array_join(F.slice(items, i + 1, 2), separator))
