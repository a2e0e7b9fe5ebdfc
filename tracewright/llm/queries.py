"""Queries of the training-data problems over the provided tables.

Each takes (spark, folder) and reads whole tables. ``oracle_sql`` in
``oracle.py`` holds the SQL twins of those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import defects, languages, leak, lookalike, mixing, neardup, packing, segjoin
from .shared import materialise


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _problems(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "cot_records").select(
        F.col("record_id").alias("id"), F.col("question").alias("text"), F.array_join("steps", "\n").alias("steps"), "split", "dataset"
    )


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per train record with the class of its problem."""
    classes = neardup.problem_classes(_problems(spark, folder).where("split = 'train'"))
    return classes.select(F.col("id").alias("record_id"), "class_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of train records that are one problem."""
    pairs = neardup.class_pairs(neardup.problem_classes(_problems(spark, folder).where("split = 'train'")))
    return pairs.select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    """The latest delivery of each sample, packed for every run."""
    latest = F.max_by("input_lengths", F.struct("ingested_at", "written_at", F.xxhash64("input_lengths")))
    total = F.aggregate("lengths", F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    rows = _table(spark, folder, "packed_inputs").where("row_id is not null").groupBy("row_id").agg(latest.alias("lengths")).select("row_id", total.alias("length"))
    return packing.pack_items(materialise(rows, "samples"), _table(spark, folder, "training_args"))


def p2_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Packs of every run with their samples and fill."""
    return packing.packs(_packed(spark, folder))


def p2_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Packs, pieces and fill per run."""
    return packing.pack_summary(_packed(spark, folder))


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    """What every packing must keep: all pieces, tokens and samples, whole samples, no limit broken."""
    items = _packed(spark, folder)
    limits = _table(spark, folder, "training_args").select("run_name", F.col("max_packed_tokens").alias("room"), F.col("max_instance_per_batch").alias("most"))
    samples = items.groupBy("run_name", "capacity", "row_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    whole = F.bool_and((F.col("pieces") == 1) | (F.col("tokens") > F.col("capacity")))
    per_run = samples.groupBy("run_name").agg(F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_samples"), whole.alias("whole"))
    sizes = items.groupBy("run_name", "pack_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).join(limits, "run_name")
    kept = (F.col("t") <= F.coalesce("room", "t")) & (F.col("n") <= F.coalesce("most", "n"))
    return per_run.join(sizes.groupBy("run_name").agg(F.bool_and(kept).alias("within")), "run_name")


def _mixed(spark: SparkSession, folder: str, temperature: bool = False) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.sized(_table(spark, folder, "documents"))
    plan = mixing.plan_mixes(sizes, _table(spark, folder, "mix_targets"), temperature)
    return mixing.mix_documents(sizes, plan), plan


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in each mix."""
    return _mixed(spark, folder)[0]


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares per mix and source."""
    return mixing.mix_report(*_mixed(spark, folder))


def p6_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """Shares when each mix tempers its token shares to the entropy of its targets."""
    return mixing.mix_report(*_mixed(spark, folder, temperature=True))


def _overlaps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _problems(spark, folder)
    return rows, segjoin.split_overlaps(rows.where("split in ('val', 'test')"), rows.where("split = 'train'"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a train record and a val or test record that are one problem."""
    _, pairs = _overlaps(spark, folder)
    return pairs.select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and dataset: records, overlapping records and pairs with the train split."""
    rows, pairs = _overlaps(spark, folder)
    links = pairs.groupBy(F.col("e").alias("id")).agg(F.count("*").alias("links"))
    return (
        rows.where("split in ('val', 'test')")
        .select("id", "split", "dataset")
        .join(links, "id", "left")
        .groupBy("split", "dataset")
        .agg(
            F.count("*").alias("n_records"),
            F.count("links").alias("n_overlapping"),
            F.coalesce(F.sum("links"), F.lit(0)).alias("n_pairs"),
            F.max("links").alias("most_links"),
        )
    )


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "cot_records").select(F.col("record_id").alias("id"), "question", "cot", "answer")
    return defects.defective_pairs(rows, languages.fit_profiles(_table(spark, folder, "documents")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective records with their type of defect."""
    return _defects(spark, folder).select(F.col("id").alias("record_id"), "defect")


def p4_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Defects per type."""
    return _defects(spark, folder).groupBy("defect").agg(F.count("*").alias("n_records"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    texts = _table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = _table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), F.col("question").alias("text"))
    return leak.leaked_spans(texts, items)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return leak.leaked_items(_leaks(spark, folder))


def p5_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Merged spans, in words, to remove from each document."""
    return _leaks(spark, folder)


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: documents it leaked into and the longest passage."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_passage"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but differ in their characters."""
    pairs = lookalike.lookalike_pairs(lookalike.lookalike_classes(_table(spark, folder, "documents"), "doc_id", "text"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with its class of one look and the number of documents that only look the same."""
    links = lookalike.lookalike_links(lookalike.lookalike_classes(_table(spark, folder, "documents"), "doc_id", "text"))
    return links.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def p7_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its text in one form."""
    df = _table(spark, folder, "documents").select("doc_id", "text")
    return lookalike.canonical_text(df, "text", "form").select("doc_id", "form", (F.col("form") != F.col("text")).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p2_packs, p2_summary, p2_check, p3_found, p3_report, p4_found, p4_summary,
        p5_found, p5_spans, p5_items, p6_mix, p6_shares, p6_temperature, p7_found, p7_classes, p7_canonical,
    )
}
