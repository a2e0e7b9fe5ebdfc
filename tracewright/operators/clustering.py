"""Leader clustering of step embeddings, and their similarity join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import dot

REPRESENTATIVES = ("first", "centroid", "medoid", "all")


def leaders(vectors: np.ndarray, threshold: float, mode: str = "first") -> np.ndarray:
    """Cluster number of each vector in order; vectors have unit length.

    A vector joins the cluster whose representative is most similar, if that
    exceeds the threshold, else it opens one. The representative is the first
    member, the normalised mean, or the member nearest to the mean; in mode
    ``all`` every member must exceed the threshold and the best mean decides.
    """
    if mode not in REPRESENTATIVES:
        raise ValueError(f"unknown mode {mode!r}")
    labels = np.empty(len(vectors), dtype=np.int64)
    members: list[list[int]] = []
    reps = np.empty((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    for i, v in enumerate(vectors):
        chosen = None
        if len(reps):
            similar = reps @ v
            if mode == "all":
                best = -1.0
                for c in np.flatnonzero(similar > threshold):
                    each = vectors[members[c]] @ v
                    if (each > threshold).all() and each.mean() > best:
                        chosen, best = int(c), float(each.mean())
            elif similar.max() > threshold:
                chosen = int(similar.argmax())
        if chosen is None:
            chosen = len(members)
            members.append([i])
            reps = np.vstack([reps, v[None, :]])
        else:
            members[chosen].append(i)
            own = vectors[members[chosen]]
            if mode == "centroid":
                mean = own.mean(axis=0)
                reps[chosen] = mean / max(np.linalg.norm(mean), 1e-12)
            elif mode == "medoid":
                reps[chosen] = own[(own @ own.mean(axis=0)).argmax()]
        labels[i] = chosen
    return labels


def leader_cluster(df: DataFrame, sample: str, order: str, vector: str, threshold: float, mode: str = "first") -> DataFrame:
    """(sample, order, cluster_id): one sample per task, in the order of its steps."""
    rows = df.select(sample, F.col(order).cast("long").alias(order), F.transform(vector, lambda x: x.cast("double")).alias("_v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        labels = leaders(np.stack(pdf["_v"].to_numpy()), threshold, mode)
        return pd.DataFrame({sample: pdf[sample].to_numpy(), order: pdf[order].to_numpy(), "cluster_id": labels})

    kind = dict(rows.dtypes)[sample]
    return rows.groupBy(sample).applyInPandas(run, f"{sample} {kind}, {order} long, cluster_id long")


def cluster_correctness(members: DataFrame, sample: str, cluster: str, correct: str, threshold: float = 0.5) -> DataFrame:
    """Size, correct members and whether their share exceeds the threshold, per cluster."""
    per = members.groupBy(sample, cluster).agg(F.count("*").alias("size"), F.count_if(F.col(correct)).alias("n_correct"))
    return per.withColumn("is_correct", F.col("n_correct") / F.col("size") > threshold)


def similar_pairs(df: DataFrame, sample: str, key: str, vector: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of one sample whose dot product exceeds the threshold.

    The equi-join keeps to one sample and the similarity is part of its
    condition; a sample is a problem's steps, a few dozen rows.
    """
    left = df.select(F.col(sample), F.col(key).alias("a"), F.col(vector).alias("_x"))
    right = df.select(F.col(sample).alias("_s"), F.col(key).alias("b"), F.col(vector).alias("_y"))
    near = (F.col(sample) == F.col("_s")) & (F.col("a") < F.col("b")) & (dot(F.col("_x"), F.col("_y")) > threshold)
    return left.join(right, near).select(sample, "a", "b", dot(F.col("_x"), F.col("_y")).alias("similarity"))
