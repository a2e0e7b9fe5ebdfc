"""Near-duplicate problems: sketches, banding, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import materialise, release
from .sketch import fast_similarity_sketch, mix
from .wording import LEAST_WORDS, SET_BITS, Question, same_problem, sort_quantities, tokens, word_hash, word_set_bits

#: Sketch coordinates, each one a band together with its twin in the word sketch.
COORDINATES = 28
#: Rows of a bucket that meet in one task at a time; only how the work is spread depends on it.
BLOCK = 4_000
#: Quantities of one element stand at most this far apart in the sorted order.
SPAN = 5

_LONGS = SET_BITS // 64
#: A set of words: how many, how many of them share their bit with another one, and the bits.
WORDS = "struct<size int, lost int, " + ", ".join(f"w{i} long" for i in range(_LONGS)) + ">"


def quantity_elements(numbers: list[str], words: list[str]) -> list[int]:
    """Set elements that few different problems share.

    Threes of quantities; texts with few of them also give twos and ones, so
    that one more quantity in a remark leaves enough in common; those without
    any give their threes of neighbouring words.
    """
    h = [word_hash(x) for x in sort_quantities(numbers)]
    n = len(h)
    out: list[int] = []
    if n >= 3:
        for i in range(n - 2):
            for j, k in combinations(range(i + 1, min(n, i + 1 + SPAN)), 2):
                out.append(hash((h[i], h[j], h[k])))
    if 2 <= n <= 4:
        out.extend(hash((3, *c)) for c in combinations(h, 2))
    if n == 2 or n == 1:
        out.extend(hash((5, c)) for c in h)
    if n == 0:
        w = [word_hash(x) for x in words]
        out.extend(hash((7, *w[i : i + 3])) for i in range(max(1, len(w) - 2)))
    return list(set(out))


def word_sets(sets: list[tuple[int, int]]) -> pa.StructArray:
    """A column of ``WORDS`` from (number of words, bits)."""
    raw = b"".join(bits.to_bytes(SET_BITS // 8, "little") for _, bits in sets)
    longs = np.frombuffer(raw, dtype="<i8").reshape(-1, _LONGS)
    columns = [pa.array([n for n, _ in sets], pa.int32()), pa.array([n - bits.bit_count() for n, bits in sets], pa.int32())]
    return pa.StructArray.from_arrays([*columns, *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(_LONGS))], ["size", "lost", *(f"w{i}" for i in range(_LONGS))])


def share_words(a: str, b: str) -> Column:
    """Whether two columns of ``WORDS`` can share ``LEAST_WORDS`` of their words.

    A share of t among n and m words is t / (1 + t) * (n + m) words, and on
    either side no more of them than it has lost can be missing in the bits.
    So this never drops a pair that ``same_problem`` accepts.
    """
    both = sum(F.bit_count(F.col(f"{a}.w{i}").bitwiseAND(F.col(f"{b}.w{i}"))) for i in range(_LONGS))
    needed = LEAST_WORDS / (1 + LEAST_WORDS) * (F.col(f"{a}.size") + F.col(f"{b}.size")) - F.least(f"{a}.lost", f"{b}.lost")
    return both >= needed - 1e-6


def band_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(signatures, an (n, COORDINATES) matrix of band keys, word sets) of the texts.

    The signature covers all quantities and the set of all words; texts
    without any word or quantity have signature 0 and no meaning in the keys.
    """
    n = len(texts)
    sig = np.zeros(n, dtype=np.int64)
    sets = [(0, 0)] * n
    el: tuple[list, list] = ([], [])
    at: tuple[list, list] = ([], [])
    for i, text in enumerate(texts):
        toks = tokens(text)
        if not toks:
            continue
        numbers = [t for t, number in toks if number]
        words = [t for t, number in toks if not number]
        distinct = set(words)
        sets[i] = len(distinct), word_set_bits(distinct)
        q, w = quantity_elements(numbers, words), {word_hash(x) for x in distinct} or {1}
        sig[i] = hash((len(numbers), *sorted(word_hash(x) for x in numbers), *sorted(w))) or 1
        el[0].extend(q)
        at[0].extend([i] * len(q))
        el[1].extend(w)
        at[1].extend([i] * len(w))
    with np.errstate(over="ignore"):
        sk = [
            fast_similarity_sketch(mix(np.array(e, dtype=np.int64).view(np.uint64)), np.array(a, dtype=np.int64), n, COORDINATES)
            for e, a in zip(el, at)
        ]
        keys = mix(mix(sk[0]) * np.uint64(3) + sk[1] + np.arange(COORDINATES, dtype=np.uint64))
    return sig, keys.view(np.int64), sets


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, keys, sets = band_keys(b.column("text").to_pylist())
        known = np.flatnonzero(sig)
        flat = pa.array(keys[known].ravel())
        offsets = pa.array(np.arange(len(known) + 1, dtype=np.int32) * COORDINATES)
        columns = [b.column("id").take(pa.array(known)), pa.array(sig[known]), word_sets([sets[i] for i in known]), pa.ListArray.from_arrays(offsets, flat)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "sig", "words", "bands"])


@lru_cache(maxsize=4096)
def _question(text: str | None, steps: str | None) -> Question:
    return Question(text, steps)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text_a, steps_a, text_b, steps_b = (b.column(c).to_pylist() for c in ("text_a", "steps_a", "text_b", "steps_b"))
        keep = [
            same_problem(_question(ta, sa), _question(tb, sb)) for ta, sa, tb, sb in zip(text_a, steps_a, text_b, steps_b)
        ]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose records(id, text, steps) are one problem."""
    side = lambda x: records.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"), F.col("steps").alias(f"steps_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a long, b long")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows(key, id, n, ...)``, n of a key, spread for a self join: each with its block ``own`` and every block ``other``."""
    parts = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))


def meetings(members: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of ``members(key, id, label)`` that share a key but no label and, by ``words(id, words)``, can share their words.

    All rows of a key meet, however many they are: they are hashed into blocks
    and every two blocks are one cell of the join, each pair of rows in one
    cell. Keys of a single label hold no such pair and never enter the join.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    spread = blocks(members.join(sizes.select("key", "n"), "key").join(words, "id"), BLOCK)
    side = lambda x, i, j: spread.select("key", F.col(i).alias("i"), F.col(j).alias("j"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "words"))).where("i <= j")
    met = side("a", "own", "other").join(side("b", "other", "own"), ["key", "i", "j"])
    met = met.where(F.expr("(i < j OR id_a < id_b) AND label_a <> label_b") & share_words("words_a", "words_b"))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def problem_classes(records: DataFrame) -> DataFrame:
    """(id, class_id) of every row of ``records(id, text, steps)``.

    Rows of one problem share their class; its id is the smallest row id. Any
    other column is ignored, so clashing names cannot arise. Rows whose text
    is null, empty or without any word or quantity are classes of their own;
    repeated rows and ties fall into one class; an empty table gives an empty
    result. Ids must be unique and not null.

    Equal signatures (all quantities, all words) collapse to their smallest id
    before anything is compared; the rest meet in buckets of one coordinate of
    the quantity sketch and one of the word sketch. In every bucket all rows
    are compared with its smallest id first; then all those of it that are not
    known to be one class by then with each other, as one problem is not
    transitive. Verified links are closed to classes.
    """
    records = records.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("steps").cast("string").alias("steps"))
    sketched = materialise(records.select("id", "text").mapInArrow(_sketches, f"id long, sig long, words {WORDS}, bands array<long>"), "sketches")
    first = sketched.groupBy("sig").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    banded = first.select(F.col("rep").alias("id"), F.explode("bands").alias("key"))
    # Counted before they are shuffled, so a bucket that a third of all rows share is a few rows here.
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")).where("n > 1")
    members = materialise(banded.join(buckets, "key"), "members")

    words = sketched.select("id", "words")
    side = lambda x: words.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"))
    starred = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    starred = starred.join(side("a"), "a").join(side("b"), "b").where(share_words("a_words", "b_words")).select("a", "b")
    links = materialise(verified(starred, records), "links")
    # What a row and its centre are known to belong to; any id of the class will do.
    nearest = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
    labels = nearest.join(nearest.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("label"))
    open_ = members.where("n > 2 and id <> centre").select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = materialise(verified(meetings(open_, words), records), "links")

    labels = connected_components(links.unionByName(more))
    # Copies hang on their representative, which keeps the class's smallest id.
    copies = sketched.select("id", "sig").join(sketched.groupBy("sig").agg(F.min("id").alias("rep")), "sig").select("id", "rep")
    known = copies.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", F.coalesce("label", "rep").alias("class_id"))
    out = materialise(records.select("id").join(known, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id")), "classes")
    release(sketched, members, links, more, labels)
    return out


def class_pairs(classes: DataFrame) -> DataFrame:
    """All pairs (a < b) within the classes; as many rows as the result has.

    Rows of one class come together by a join on the class, whose hot keys
    AQE splits; classes of one row never enter it.
    """
    more = classes.join(classes.where("id <> class_id").select("class_id").distinct(), "class_id", "left_semi")
    left, right = more.select("class_id", F.col("id").alias("a")), more.select("class_id", F.col("id").alias("b"))
    return left.join(right, "class_id").where("a < b").select("a", "b")
