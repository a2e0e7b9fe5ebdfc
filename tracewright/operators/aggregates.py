"""Evaluation summaries, masked statistics and losses.

Everything is a partial aggregate that Spark combines map-side; nothing is
collected. Ratios guard their denominator unless a parity flag says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col, let


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b as a double, ``empty`` where b is zero."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def accuracy(pred: Column, gold: Column) -> Column:
    """Share of predictions that equal the gold; 0.0 for no rows."""
    return F.coalesce(F.avg((pred == gold).cast("double")), F.lit(0.0))


def membership_accuracy(preds: Column, gold: Column) -> Column:
    """Share of rows whose list of predictions holds the gold."""
    return F.coalesce(F.avg(F.array_contains(preds, gold).cast("double")), F.lit(0.0))


def summary(df: DataFrame, by: Sequence[str], correct: str) -> DataFrame:
    """Accuracy and counts per group; a null verdict is not correct."""
    ok = F.coalesce(F.col(correct), F.lit(False))
    return df.groupBy(*by).agg(F.avg(ok.cast("double")).alias("accuracy"), F.count("*").alias("num_samples"), F.count_if(ok).alias("num_correct"))


def correct_ids(df: DataFrame, by: Sequence[str], correct: str, row_id: str) -> DataFrame:
    """The ids of correct rows, each once per group: a row per id, so that no group is one value."""
    return df.where(F.col(correct)).select(*by, row_id).distinct()


def macro_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    """Mean over inner groups of their means."""
    per = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return per.groupBy(*outer).agg(F.avg("_m").alias(name)) if outer else per.agg(F.avg("_m").alias(name))


def counters(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows and rows per condition, with each condition's percentage of all rows."""
    counts = [F.count_if(c).alias(k) for k, c in conditions.items()]
    out = df.groupBy(*by).agg(F.count("*").alias("done"), *counts)
    for k in conditions:
        out = out.withColumn(f"{k}_pct", ratio(F.col(k) * 100.0, F.col("done"), 0.0))
    return out


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts per value; ``parity`` is the count that starts at zero."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("parity", F.col("n") - 1)


def describe(df: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Mean, population deviation, extremes, exact median and 95th percentile of measures."""
    aggs = []
    for name, m in measures.items():
        m = m.cast("double")
        aggs += [
            F.avg(m).alias(f"{name}_mean"),
            F.stddev_pop(m).alias(f"{name}_std"),
            F.min(m).alias(f"{name}_min"),
            F.max(m).alias(f"{name}_max"),
            F.percentile(m, F.lit(0.5)).alias(f"{name}_median"),
            F.percentile(m, F.lit(0.95)).alias(f"{name}_p95"),
        ]
    return df.groupBy(*by).agg(*aggs)


def masked(values: Column, mask: Column) -> Column:
    """Values of an array whose mask is set."""
    pairs = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda p: p["m"] != 0)
    return F.transform(pairs, lambda p: p["v"])


def masked_stats(df: DataFrame, values: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes and sample variance over all unmasked elements of array columns."""
    rows = df.select(*by, F.explode(masked(F.col(values), F.col(mask))).alias("_x"))
    return rows.groupBy(*by).agg(F.avg("_x").alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.var_samp("_x").alias("var"))


def clip_ratio(length: Column, most: Column) -> Column:
    """Share of rows whose length is the largest possible."""
    return F.avg((length == most).cast("double"))


def explained_variance(value: Column, target: Column, eps: float = 1e-5) -> Column:
    return 1 - F.var_samp(target - value) / (F.var_samp(target) + eps)


def running_stats(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min(value).alias("min_len"), F.avg(value).alias("mean_len"), F.count(value).alias("cnt"))


def mean_when_right(right: Column, x: Column, eps: float = 1e-8) -> Column:
    """Mean of x over right rows: sum(a x) / (sum(a) + eps)."""
    a = right.cast("double")
    return F.sum(a * x) / (F.sum(a) + eps)


def confidence(x: Column) -> Column:
    """Half width of the normal 95 % interval with the population deviation."""
    return 1.96 * F.stddev_pop(x) / F.sqrt(F.count(x))


def whiten(df: DataFrame, value: str, mask: str, by: Sequence[str] = (), eps: float = 1e-8, into: str = "white") -> DataFrame:
    """(x - mean) / sqrt(var + eps) with the moments of the unmasked rows (Bessel's correction).

    Moments are one aggregate, joined back to the rows of their group or, for
    the whole table, sent out as one row. Null groups are groups.
    """
    kept = F.when(F.col(mask), F.col(value))
    if by:
        sums = df.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.avg(kept).alias("_m"), F.var_samp(kept).alias("_v"))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by))
        both = df.join(sums, same).drop(*(f"_by_{c}" for c in by))
        return both.withColumn(into, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")
    moments = df.agg(F.avg(kept).alias("_m"), F.var_samp(kept).alias("_v"))
    return df.crossJoin(F.broadcast(moments)).withColumn(into, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")  # one row


def nan_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation and extremes without NaN."""
    x = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def weighted_nansum(values: Column, weights: Column) -> Column:
    """Sum of weighted rewards of an array, NaN counting as nothing."""
    return F.aggregate(F.zip_with(values, weights, lambda v, w: F.nanvl(v, F.lit(0.0)) * w), F.lit(0.0), lambda a, x: a + x)


def terminated_stats(df: DataFrame, by: Sequence[str], length: str, terminated: str) -> DataFrame:
    """Length statistics of all and of terminated rows; 0 where none terminated."""
    t = F.when(F.col(terminated), F.col(length))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(length).alias("mean_length"),
        (1 - F.avg(F.col(terminated).cast("double"))).alias("clipped_ratio"),
        zero(F.avg(t)).alias("mean_terminated"),
        zero(F.min(t).cast("double")).alias("min_terminated"),
        zero(F.max(t).cast("double")).alias("max_terminated"),
    )


def bincount(df: DataFrame, column: str, minlength: int) -> DataFrame:
    """Counts of 0, 1, ... up to the largest value, at least ``minlength`` rows, zeros filled.

    The range is a distributed one, however large the largest value is; nulls
    and negative values are not counted; an empty table gives ``minlength`` zeros.
    """
    counts = df.where(F.col(column) >= 0).groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("value").alias("top")).first().top
    every = df.sparkSession.range(max(minlength, 0 if top is None else top + 1)).withColumnRenamed("id", "value")
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_stats(members: DataFrame, sample: str, cluster: str, correct: str) -> DataFrame:
    """Per sample: clusters, mean members, and mean accuracy of clusters."""
    per = members.groupBy(sample, cluster).agg(F.count("*").alias("_n"), F.avg(F.col(correct).cast("double")).alias("_a"))
    return per.groupBy(sample).agg(F.count("*").alias("n_clusters"), F.avg("_n").alias("mean_members"), F.avg("_a").alias("mean_accuracy"))


def compression(df: DataFrame, by: Sequence[str], before: str, after: str) -> DataFrame:
    """Mean ratio and mean saved percentage of two sizes; rows with nothing before are left out."""
    rows = df.where(F.col(before) > 0)
    r = F.col(before) / F.greatest(F.col(after), F.lit(1))
    return rows.groupBy(*by).agg(F.avg(r).alias("ratio"), F.avg((1 - F.col(after) / F.col(before)) * 100).alias("saved_pct"))


def training_flops(df: DataFrame, by: Sequence[str], length: str, hidden: int, layers: int, dense: float) -> DataFrame:
    """Estimated operations of forward and backward passes: 6 n params + 12 n^2 hidden layers."""
    n = F.col(length).cast("double")
    return df.groupBy(*by).agg((6 * dense * F.sum(n) + 12 * F.sum(n * n) * hidden * layers).alias("flops"), F.sum(n).alias("tokens"))


def imbalance(df: DataFrame, part: str, size: str) -> DataFrame:
    """Smallest, largest and mean part and their spread."""
    sums = df.groupBy(part).agg(F.sum(size).alias("_s"))
    return sums.agg(
        F.min("_s").alias("min"), F.max("_s").alias("max"), (F.max("_s") - F.min("_s")).alias("diff"), F.avg("_s").alias("mean")
    )


# -------------------------------------------------------- element-wise losses


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(values: Column, mask: Column) -> Column:
    """Mean of the unmasked elements of an array; null if there are none."""
    m = masked(values, mask)
    return ratio(total(F.transform(m, lambda x: x.cast("double"))), F.size(m))


KL_KINDS = ("kl", "abs", "mse", "low_var_kl")


def kl_terms(logp: Column, ref: Column, kind: str = "kl") -> Column:
    """Per-token divergence of the policy from a reference, by one of ``KL_KINDS`` from two arrays of log probabilities.

    ``full``: both are arrays of one distribution per token (log probabilities
    of every symbol), and a token's term is the divergence of the policy's
    from the reference's, with the reference as what is expected: the sum of
    p (log p - log ref) over all symbols. Null where either array is null;
    arrays of unequal length give null terms.
    """
    if kind == "full":
        return F.zip_with(logp, ref, lambda p, q: total(F.zip_with(p, q, lambda x, y: F.exp(x.cast("double")) * (x.cast("double") - y.cast("double")))))

    def one(p, q):
        d = p.cast("double") - q.cast("double")
        if kind == "kl":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "mse":
            return d * d * 0.5
        if kind == "low_var_kl":
            r = F.least(F.greatest(-d, F.lit(-10.0)), F.lit(10.0))
            return F.least(F.greatest(F.exp(r) - r - 1, F.lit(-10.0)), F.lit(10.0))
        raise ValueError(f"unknown kind {kind!r}")

    return F.zip_with(logp, ref, one)


def policy_terms(old: Column, new: Column, advantage: Column, low: float = 0.2, high: float = 0.3, dual: float = 3.0) -> Column:
    """Per token struct(loss, high, low, kl): clipped ratio loss with a dual clip for negative advantages."""
    z = F.arrays_zip(old.alias("o"), new.alias("n"), advantage.alias("a"))

    def one(t):
        d = F.least(F.greatest(t["n"] - t["o"], F.lit(-20.0)), F.lit(20.0))
        r = F.exp(d)
        clipped = F.least(F.greatest(r, F.lit(1 - low)), F.lit(1 + high))
        plain, cut, far = -t["a"] * r, -t["a"] * clipped, -t["a"] * dual
        upper = F.greatest(plain, cut)
        loss = F.when(t["a"] < 0, F.least(upper, far)).otherwise(upper)
        hit = (plain < cut).cast("double")
        under = ((upper > far) & (t["a"] < 0)).cast("double")
        return F.struct(loss.alias("loss"), hit.alias("high"), under.alias("low"), (-d).alias("kl"))

    return F.transform(z, one)


def value_terms(pred: Column, target: Column, old: Column, clip: float = 0.5) -> Column:
    """Per token struct(loss, clipped) of the clipped squared value error."""
    z = F.arrays_zip(pred.alias("p"), target.alias("t"), old.alias("o"))

    def one(t):
        near = F.least(F.greatest(t["p"], t["o"] - clip), t["o"] + clip)
        a, b = (t["p"] - t["t"]) * (t["p"] - t["t"]), (near - t["t"]) * (near - t["t"])
        return F.struct((F.greatest(a, b) * 0.5).alias("loss"), (a < b).cast("double").alias("clipped"))

    return F.transform(z, one)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def vector_mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))) / F.size(a)


def vector_cosine_loss(a: Column, b: Column, least: float = 1e-6) -> Column:
    """1 - cosine; the squared error where a norm is too small for a direction."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < least) | (nb < least), vector_mse(a, b)).otherwise(1 - dot(a, b) / (na * nb))


def softmax(a: Column) -> Column:
    raised = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))
    return let(raised, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def vector_kl(a: Column, b: Column) -> Column:
    """KL of the softmax of b against the softmax of a, per element."""
    return total(F.zip_with(softmax(b), softmax(a), lambda q, p: q * (F.log(q) - F.log(p)))) / F.size(a)


def vector_huber(a: Column, b: Column, delta: float = 1.0) -> Column:
    def one(x, y):
        d = F.abs(x.cast("double") - y)
        return F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))

    return total(F.zip_with(a, b, one)) / F.size(a)


def combined_loss(a: Column, b: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    return weights[0] * vector_mse(a, b) + weights[1] * vector_cosine_loss(a, b) + weights[2] * vector_kl(a, b)


def adaptive_kl(batches: Column, start: float, target: float, horizon: float) -> Column:
    """The coefficient after folding ordered struct(kl, n) batches: each moves it by at most 20 %."""

    def step(c, b):
        error = F.least(F.greatest(b["kl"] / target - 1, F.lit(-0.2)), F.lit(0.2))
        return c * (1 + error * b["n"] / horizon)

    return F.aggregate(col(batches), F.lit(start), step)
