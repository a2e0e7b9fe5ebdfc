"""Overlaps between splits: an edit-distance join by segments of the strings.

The string of a question is the sequence of its quantities, largest first, so
that order, wording and number format do not count as edits while an added
remark with a number is one insertion. An evaluation string is cut into k + 1
segments; k edits leave at least one of them whole, so a training string
within k edits contains a segment at a position that the edits before and
after it can explain. Only such pairs are verified: by dynamic programming
over the band of k diagonals, then by the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import WORDS, _question, share_words, word_sets
from .shared import materialise, release
from .wording import Question, same_problem, sort_quantities, tokens, word_hash, word_set_bits

#: Most edits of any string.
MOST_EDITS = 2
#: Rows of either side of a key that meet in one task at a time; only how the work is spread depends on it.
BLOCK = 4_000


def edits(length: int) -> int:
    """Edits allowed for an evaluation string of a length: each segment needs a symbol of its own."""
    return max(0, min(length - 1, MOST_EDITS))


def sequence(numbers: list[str], words: list[str]) -> list[str]:
    """The string of a question; one without quantities is its words in order."""
    return sort_quantities(numbers) if numbers else ["", *words]


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 segments, the later ones larger by at most one.

    >>> segments(5, 2)
    [(0, 1), (1, 2), (3, 2)]
    """
    size, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i > k - more)
        out.append((at, n))
        at += n
    return out


def starts(i: int, start: int, size: int, length: int, k: int, other: int) -> range:
    """Where segment i of a string may stand in one of length ``other``.

    With d = other - length, at most i edits before it and k - i behind it
    can be those that the other segments do not see.
    """
    d = other - length
    low = max(0, start - i, start + d - (k - i))
    high = min(other - size, start + i, start + d + (k - i))
    return range(low, high + 1)


def within(a: list[str], b: list[str], k: int) -> bool:
    """Whether the edit distance of two sequences is at most k.

    Only the 2k + 1 diagonals that k edits can reach are computed.
    """
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    row = {j: j for j in range(min(k, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            new[j] = min(best, far)
        if min(new.values()) > k:
            return False
        row = new
    return row.get(len(b), far) <= k


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed string of each text, the 64-bit set of its symbols and the set of its words."""
    for b in batches:
        strings, symbols, sets = [], [], []
        for text in b.column("text").to_pylist():
            toks = tokens(text)
            words = [t for t, number in toks if not number]
            h = [word_hash(x) for x in sequence([t for t, number in toks if number], words)] if toks else []
            seen = 0
            for x in h:
                seen |= 1 << (x & 63)
            strings.append(h)
            symbols.append(seen - (1 << 64) if seen >> 63 else seen)
            distinct = set(words)
            sets.append((len(distinct), word_set_bits(distinct)))
        columns = [b.column("id"), b.column("e"), pa.array(strings, pa.list_(pa.int64())), pa.array(symbols, pa.int64()), word_sets(sets)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "e", "string", "symbols", "words"])


def _edits(m: Column) -> Column:
    return F.greatest(F.lit(0), F.least(m - 1, F.lit(MOST_EDITS)))


def _segment(s: Column, m: Column, k: Column) -> tuple[Column, Column]:
    """(start, size) of segment s of k + 1 of a string of length m, as ``segments`` gives them."""
    size, more = F.floor(m / (k + 1)).cast("int"), m % (k + 1)
    longer = s - (k - more) - 1  # how many before this one are larger
    return s * size + F.greatest(F.lit(0), longer), size + (s > k - more).cast("int")


def _key() -> Column:
    return F.xxhash64("m", "s", F.slice("string", F.col("p") + 1, F.col("size")))


def segment_keys(parsed: DataFrame) -> DataFrame:
    """``parsed`` with one row per segment of its own string."""
    m, s, k = F.size("string"), F.col("s"), _edits(F.col("m"))
    start, size = _segment(s, F.col("m"), k)
    cut = parsed.withColumn("m", m).where("m > 0").withColumn("s", F.explode(F.sequence(F.lit(0), k)))
    return cut.withColumn("p", start).withColumn("size", size).select(_key().alias("key"), "id", "symbols", "words")


def substring_keys(parsed: DataFrame) -> DataFrame:
    """``parsed`` with one row per substring where a segment of a string in reach may stand.

    The positions are those of ``starts``: at most s edits before segment s and
    k - s behind it are ones that the other segments do not see.
    """
    n, m, s, k = F.col("n"), F.col("m"), F.col("s"), _edits(F.col("m"))
    lengths = parsed.withColumn("n", F.size("string")).where("n > 0").withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), n - MOST_EDITS), n + MOST_EDITS)))
    start, size = _segment(s, m, k)
    cut = lengths.where(F.abs(m - n) <= k).withColumn("s", F.explode(F.sequence(F.lit(0), k))).withColumn("start", start).withColumn("size", size)
    d = n - m
    low = F.greatest(F.lit(0), F.col("start") - s, F.col("start") + d - (k - s))
    high = F.least(n - F.col("size"), F.col("start") + s, F.col("start") + d + (k - s))
    placed = cut.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("p", F.explode(F.sequence("low", "high")))
    return placed.select(_key().alias("key"), "id", "symbols", "words")


def _overlap(a: Question, b: Question) -> bool:
    seqs = []
    for q in (a, b):
        numbers = list(q.numbers.elements())
        seqs.append(sequence(numbers, [t for t, _ in q.toks]))
    return bool(a.toks) and within(seqs[0], seqs[1], edits(len(seqs[0]))) and same_problem(a, b)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("text_e", "steps_e", "text_t", "steps_t")]
        keep = [_overlap(_question(te, se), _question(tt, st)) for te, se, tt, st in zip(*cols)]
        yield b.select(["e", "t"]).filter(pa.array(keep, pa.bool_()))


def _spread(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join by, with keys of many pairs cut into blocks on both sides.

    Counted before they are shuffled; a key that a third of all rows share
    becomes as many cells as it has pairs of blocks.
    """
    sizes = left.groupBy("key").agg(F.count("*").alias("nl")).join(right.groupBy("key").agg(F.count("*").alias("nr")), "key")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    hot = materialise(sizes.where(F.col("nl") * F.col("nr") > BLOCK * BLOCK).select("key", parts("nl").alias("li"), parts("nr").alias("ri")), "hot")
    if hot.isEmpty():
        release(hot)
        return left, right, ["key"]
    one = lambda c: F.coalesce(c, F.lit(1))

    def cells(side: DataFrame, mine: str, other: str) -> DataFrame:
        known = side.join(hot, "key", "left").withColumn("_m", one(mine)).withColumn("_o", one(other)).drop("li", "ri")
        own = F.pmod(F.xxhash64("id"), F.col("_m")).cast("int")
        return known.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_o") - 1))).drop("_m", "_o")

    return cells(left, "li", "ri"), cells(right, "ri", "li"), ["key", "li", "ri"]


def split_overlaps(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(e, t): the ids of ``evaluation`` and ``training`` rows that are one problem.

    Both tables have the columns id, text, steps; others are ignored. A null
    or empty text overlaps with nothing, repeated rows and ties each count,
    either table may be empty. Steps only help to tell a remark's quantity
    from one that matters and may be null.
    """
    pick = lambda t: t.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("steps").cast("string").alias("steps"))
    evaluation, training = pick(evaluation), pick(training)
    texts = evaluation.select("id", "text", F.lit(True).alias("e")).unionByName(training.select("id", "text", F.lit(False).alias("e")))
    parsed = materialise(texts.mapInArrow(_parse, f"id long, e boolean, string array<long>, symbols long, words {WORDS}"), "strings")
    left, right, by = _spread(segment_keys(parsed.where("e")), substring_keys(parsed.where("not e")))
    ends = lambda t, x: t.select(*by, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "symbols", "words")))
    size = lambda x: F.bit_count(F.col(x))
    # k edits leave all but k symbols of either string in common.
    near = F.bit_count(F.col("symbols_e").bitwiseAND(F.col("symbols_t"))) >= F.greatest(size("symbols_e"), size("symbols_t")) - MOST_EDITS
    met = ends(left, "e").join(ends(right, "t"), by).where(near & share_words("words_e", "words_t"))
    met = met.select(F.col("id_e").alias("e"), F.col("id_t").alias("t")).distinct()
    side = lambda t, x: t.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"), F.col("steps").alias(f"steps_{x}"))
    out = materialise(met.join(side(evaluation, "e"), "e").join(side(training, "t"), "t").mapInArrow(_verify, "e long, t long"), "overlaps")
    release(parsed)
    return out
