"""Mixing sources to target shares of a token budget, with capped repetition."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: A public byte-level BPE vocabulary; any file of ranks can be given instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of that family cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one source that are put in order in one task.
BLOCK_DOCUMENTS = 20_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return run


def source_name(column):
    """One spelling of a source: case, blanks and hyphens do not matter."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "_")


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; the text is read once.

    Null and empty texts have no tokens; a null source stays null and belongs
    to no mix, but its tokens count towards the size of all documents.
    """
    cols = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    return materialise(cols.mapInArrow(_count(path), "doc_id long, source string, n_tokens long"), "sizes")


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to an exponent and normalised; 1 is proportional, 0 uniform over what is there."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def bisect(rises, low: float = 0.0, high: float = 8.0, rounds: int = 60) -> float:
    """The smallest value in [low, high] for which a predicate that turns true once holds."""
    if rises(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if rises(mid) else (mid, high)
    return high


def temperature_weights(tokens: list[float], limits: list[float], budget: float, target_entropy: float) -> tuple[float, list[float]]:
    """(exponent, weights) of the flattest mix no flatter than the target entropy that keeps to the repetition limits.

    The entropy falls as the exponent rises, so the exponent that meets it is
    bisected; so is the one from which on no source with tokens would be
    repeated more often than its limit. The larger of both is taken. Where no
    exponent keeps to the limits, the budget is beyond them; then 1 is used
    and the caller's cap applies.
    """
    total = sum(tokens)
    shares = [t / total if total else 0.0 for t in tokens]
    flat = bisect(lambda e: entropy(tempered(shares, e)) <= target_entropy)
    fits = lambda e: all(w * budget <= r * t * (1 + 1e-9) for w, r, t in zip(tempered(shares, e), limits, tokens))
    limit = bisect(fits, 0.0, 1.0) if fits(1.0) else 1.0
    exponent = max(flat, limit)
    if not fits(exponent):
        exponent = limit
    return exponent, tempered(shares, exponent)


def plan_mixes(sizes: DataFrame, targets: DataFrame, temperature: bool = False) -> DataFrame:
    """Per mix and source of ``targets``: the tokens to take, as whole passes and a part.

    ``targets`` is a short table of settings and is collected, with one row of
    sums per source in it. A source gets its share of the budget, or all it
    has ``max_repeats`` times if that is less; others are not enlarged for it.
    With ``temperature`` the shares are the tempered token shares of the mix's
    sources instead, at the entropy of the target shares.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first().t
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_ratio")
    sums = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    rows = wanted.join(sums, "source", "left").orderBy("mix_name", "source").collect()
    out = []
    for mix in sorted({r.mix_name for r in rows}):
        own = [r for r in rows if r.mix_name == mix]
        tokens = [float(r.tokens or 0) for r in own]
        budget = float(own[0].budget_ratio) * total
        shares, exponent = [float(r.target_share) for r in own], None
        if temperature:
            limits = [float(r.max_repeats) if r.max_repeats is not None else math.inf for r in own]
            exponent, shares = temperature_weights(tokens, limits, budget, entropy(shares))
        for r, t, share in zip(own, tokens, shares):
            most = t * r.max_repeats if r.max_repeats is not None else math.inf
            take = min(share * budget, most) if t else 0.0
            passes = int(take // t) if t else 0
            blocks = max(1, -(-(r.n_docs or 0) // BLOCK_DOCUMENTS))
            out.append((mix, r.source, float(r.target_share), share, exponent, r.max_repeats, budget, t, r.n_docs or 0, passes, take - passes * t, blocks))
    schema = (
        "mix_name string, source string, target_share double, share double, exponent double, max_repeats int, budget double, "
        "source_tokens double, source_docs long, passes int, part double, blocks int"
    )
    return spark.createDataFrame(out, schema)


def mix_documents(sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, repeats): how often each document is used.

    Every mix permutes each source in blocks: a hash puts documents into
    blocks and orders them within. Whole passes use all of them; the part pass
    uses blocks from the first on, by their sums, and only in the block where
    the budget ends single documents, so that it is met to half a document.
    No task ever sees more than a block of a source. Documents without tokens
    are never used.
    """
    plan = F.broadcast(plan.where("source_tokens > 0").select("mix_name", "source", "passes", "part", "blocks"))  # settings
    h = F.xxhash64(F.lit(seed), "mix_name", "doc_id")
    docs = sizes.where("n_tokens > 0").join(plan, "source").withColumn("block", F.pmod(h, F.col("blocks"))).withColumn("turn", F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id"))
    key = ["mix_name", "source"]
    sums = docs.groupBy(*key, "block", "part").agg(F.sum("n_tokens").alias("t"))
    placed = sums.withColumn("end", F.sum("t").over(Window.partitionBy(*key).orderBy("block"))).select(*key, "block", (F.col("end") - F.col("t")).alias("start"), "end")
    docs = docs.join(placed, [*key, "block"])
    inside, cut = F.col("end") <= F.col("part"), (F.col("start") < F.col("part")) & (F.col("end") > F.col("part"))
    edge = docs.where(cut).withColumn("upto", F.col("start") + F.sum("n_tokens").over(Window.partitionBy(*key, "block").orderBy("turn", "doc_id")))
    edge = edge.withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("part")).cast("int")).drop("upto")
    rest = docs.where(~cut).withColumn("extra", inside.cast("int"))
    used = edge.unionByName(rest).withColumn("repeats", F.col("passes") + F.col("extra"))
    return used.where("repeats > 0").select("mix_name", "doc_id", "source", "n_tokens", "repeats")


def mix_report(mixed: DataFrame, plan: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """Target and actual shares per mix and source, with the tokenizer used."""
    taken = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("taken_tokens"), F.count("*").alias("used_docs"), F.max("repeats").alias("most_repeats")
    )
    every = Window.partitionBy("mix_name")
    tokens = F.coalesce("taken_tokens", F.lit(0))
    return plan.join(taken, ["mix_name", "source"], "left").select(
        "mix_name",
        "source",
        "target_share",
        "exponent",
        F.col("share").alias("planned_share"),
        (tokens / F.col("budget")).alias("share_of_budget"),
        (tokens / F.sum(tokens).over(every)).alias("share_of_mix"),
        tokens.alias("taken_tokens"),
        F.col("source_tokens").cast("long").alias("source_tokens"),
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "max_repeats",
        F.lit(tokenizer_path.rsplit("/", 1)[-1]).alias("tokenizer"),
    )
