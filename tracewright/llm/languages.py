"""Languages told by character n-grams of words, fitted on a bounded sample of labelled texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts per language that profiles are fitted on; whole texts, chosen by a hash.
SAMPLE = 80
#: Lengths of n-grams within a word between blanks, and how often one must occur in the sample.
GRAMS = (2, 3, 4)
LEAST = 3
#: Most that a single n-gram counts against a language.
FLOOR = -3.0

WORD = re.compile(r"[^\W\d_]+")
#: Scripts without blanks between words are told by their characters, not by profiles.
_UNSPACED = re.compile("[⺀-鿿가-힯豈-﫿぀-ヿ฀-๿]")


def grams(word: str) -> list[str]:
    """
    >>> grams("à")
    [' à', 'à ', ' à ']
    """
    s = f" {word} "
    return [s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1)]


@dataclass
class Profiles:
    """Log-likelihoods of n-grams relative to the language in which each is most likely."""

    languages: tuple[str, ...]
    table: dict[str, np.ndarray]
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def of(self, words: list[str]) -> np.ndarray:
        """(words, languages): the scores of each word; kept for words seen before."""
        if self.scores is None or len(self.known) > 200_000:
            self.known, self.scores = {}, np.zeros((1024, len(self.languages)))
        places = []
        for w in words:
            i = self.known.get(w)
            if i is None:
                i = self.known[w] = len(self.known)
                if i == len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[i] = sum((x for g in grams(w) if (x := self.table.get(g)) is not None), np.zeros(len(self.languages)))
            places.append(i)
        return self.scores[places]

    def like(self, word: str) -> bool:
        """Whether a word is built as those of a known language are: most of its longest n-grams were seen."""
        long = [g for g in grams(word) if len(g) == min(GRAMS[-1], len(word) + 2)]
        return 2 * sum(g in self.table for g in long) > len(long)


def profiles_from(counts: dict[str, Counter]) -> Profiles:
    """Profiles from the n-gram counts of each language; n-grams seen fewer than ``LEAST`` times are left out."""
    languages = tuple(sorted(counts))
    totals = {x: sum(counts[x].values()) for x in languages}
    all_: Counter = Counter()
    for c in counts.values():
        all_.update(c)
    table = {}
    for g, n in all_.items():
        if n >= LEAST:
            v = np.array([math.log((counts[x][g] + 0.5) / (totals[x] + 0.5 * len(all_))) for x in languages])
            table[g] = np.maximum(v - v.max(), FLOOR)
    return Profiles(languages, table)


def gram_counts(texts) -> Counter:
    out: Counter = Counter()
    for text in texts:
        for w in WORD.findall((text or "").lower()):
            if not _UNSPACED.search(w):
                out.update(grams(w))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[str, list] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            found.setdefault(lang, []).append(text)
        rows = [(lang, g, n) for lang, texts in found.items() for g, n in gram_counts(texts).items()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def fit_profiles(texts: DataFrame, per_language: int = SAMPLE) -> Profiles:
    """Profiles fitted on at most ``per_language`` rows of each label of ``texts(lang, text)``.

    Rows without a label or a text are left out; some wrong labels do little.
    Rows are chosen by a hash of their text, so the same ones on every run.
    What reaches the driver are the n-grams of the sample, not of the table.
    Without any labelled row there are no languages to tell apart.
    """
    rows = texts.select(F.lower(F.trim("lang")).alias("lang"), F.col("text").cast("string").alias("text")).where("lang <> '' and text <> ''")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    some = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_language).drop("_r")
    counted = some.mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for r in counted.collect():
        counts.setdefault(r.lang, Counter())[r.gram] = r.n
    return profiles_from(counts)
