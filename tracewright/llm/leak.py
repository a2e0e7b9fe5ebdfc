"""Evaluation passages inside a corpus: an FM-index per shard of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .lookalike import Rewriter, representatives

#: Consecutive words that count as a leak.
PASSAGE = 15
#: Words of one shard; its index takes about 80 bytes a word.
SHARD_WORDS = 400_000
#: Words of the items that one pass searches for, about 28 bytes each; more items take more passes.
BLOCK_WORDS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"""</?[a-z][a-z0-9-]*(?:\s+[a-z-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s<>]+))*\s*/?>""")
_ENTITY = re.compile(r"&(?:[a-z]+|#\d+|#x[0-9a-f]+);")
# Commands of text markup that set how their argument looks.
_COMMAND = re.compile(r"\\(?:textbf|textit|texttt|textsc|text|emph|underline|mathrm|mathbf|mathit)\b")


@dataclass
class Searched:
    """What a task needs to know of the items: vocabulary, phrases, rewriting."""

    vocabulary: dict[str, int]
    symbols: np.ndarray  # all items' words, one after the other
    starts: np.ndarray  # (m,) place of each phrase's first word in ``symbols``
    items: np.ndarray  # (m,) item ids
    offsets: np.ndarray  # (m,) first word of the phrase within its item
    pairs: dict[str, str]
    passage: int

    @property
    def phrases(self) -> np.ndarray:
        """(places, passage): a view on the words, of which ``starts`` are the phrases."""
        return np.lib.stride_tricks.sliding_window_view(self.symbols, self.passage)


def words(text: str, rewrite: Rewriter) -> list[str]:
    """Lower-case words without markup, in one form of look-alikes."""
    if not text.isascii():
        text = rewrite(text)
    text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    return _WORD.findall(text)


def prepare(items: list[tuple[int, str]], passage: int) -> Searched:
    counts: dict[int, int] = {32: 1}
    for _, text in items:
        for c in text:  # in both cases: case is folded after the rewriting
            for x in {c, c.lower(), c.upper()}:
                if len(x) == 1:
                    counts[ord(x)] = counts.get(ord(x), 0) + 1
    pairs = representatives(counts, foreign=True)
    rewrite = Rewriter(pairs)
    vocabulary: dict[str, int] = {}
    symbols, sizes = [np.zeros(0, dtype=np.int32)], [0]
    for _, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text, rewrite)], dtype=np.int32)
        symbols.append(ids)
        sizes.append(len(ids))
    begins = np.cumsum(sizes)[:-1]
    n = np.maximum(np.array(sizes[1:], dtype=np.int64) - passage + 1, 0)
    offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owners = np.repeat(np.array([i for i, _ in items], dtype=np.int64), n)
    return Searched(vocabulary, np.concatenate(symbols), np.repeat(begins, n) + offsets, owners, offsets, pairs, passage)


class Shard:
    """Texts gathered until their index is worth building."""

    def __init__(self, passage: int):
        self.passage = passage
        self.runs: list[np.ndarray] = []
        self.owners: list[list[tuple[int, int]]] = []
        self.known: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc: int, symbols: np.ndarray) -> None:
        """Keep the stretches that can hold a passage; equal stretches once."""
        inside = np.flatnonzero(np.diff(np.concatenate([[0], symbols > 0, [0]]).astype(np.int8)))
        for a, b in zip(inside[::2].tolist(), inside[1::2].tolist()):
            if b - a >= self.passage:
                run = symbols[a:b]
                key = run.tobytes()
                at = self.known.get(key)
                if at is None:
                    at = self.known[key] = len(self.runs)
                    self.runs.append(run)
                    self.owners.append([])
                    self.size += b - a + 1
                self.owners[at].append((doc, a))

    def search(self, asked: Searched) -> Iterator[tuple[int, int, int, int, int]]:
        """(doc, item, first word in the text, first word in the item, words)."""
        if not self.runs or not len(asked.starts):
            return
        gap = np.zeros(1, dtype=np.int32)
        seq = np.concatenate([x for run in self.runs for x in (run, gap)])
        begins = np.cumsum([0] + [len(r) + 1 for r in self.runs])
        index = FMIndex(seq, len(asked.vocabulary))
        lo, hi = index.search(asked.phrases, asked.starts)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos = index.locate(rows)
        item, shift = asked.items[which], pos - asked.offsets[which]
        order = np.lexsort((pos, shift, item))
        pos, item, shift, off = pos[order], item[order], shift[order], asked.offsets[which][order]
        first = np.ones(len(pos), dtype=bool)
        first[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] != pos[:-1] + 1)
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(pos))) + self.passage - 1
        run = np.searchsorted(begins, pos[at], side="right") - 1
        for k, r, m in zip(at.tolist(), run.tolist(), length.tolist()):
            for doc, start in self.owners[r]:
                yield doc, int(item[k]), start + int(pos[k] - begins[r]), int(off[k]), m


_SPANS = "doc_id long, item_id long, start_word long, item_word long, n_words long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SPANS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)


def _search(asked, passage: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value
        rewrite, symbol = Rewriter(known.pairs), known.vocabulary.get
        shard = Shard(passage)
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if text:
                    shard.add(doc, np.array([symbol(w, 0) for w in words(text, rewrite)], dtype=np.int32))
                if shard.size >= shard_words:
                    yield _batch(list(shard.search(known)))
                    shard = Shard(passage)
        yield _batch(list(shard.search(known)))

    return run


def leaked_spans(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, item_word, n_words): merged spans of items in texts.

    ``documents`` has the columns id, text and ``items`` too; other columns
    are ignored. Case, punctuation, layout, markup and look-alike characters
    do not matter. Null and empty texts, and items shorter than ``passage``
    words, leak nothing; repeated texts each give their rows; either table
    may be empty. Held-out items are few and are sent to every task, at most
    ``BLOCK_WORDS`` words at a time; more of them take further passes.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = None
    block: list[tuple[int, str]] = []
    size = 0

    def passed(block):
        asked = spark.sparkContext.broadcast(prepare(block, passage))
        return texts.mapInArrow(_search(asked, passage, shard_words), _SPANS)

    wanted = items.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    for r in wanted.orderBy("id", "text").toLocalIterator():
        n = len(r.text) // 4 + 1
        if block and size + n > BLOCK_WORDS:
            done = passed(block)
            out, block, size = done if out is None else out.unionByName(done), [], 0
        block.append((r.id, r.text))
        size += n
    last = passed(block)
    return last if out is None else out.unionByName(last)


def leaked_items(spans: DataFrame) -> DataFrame:
    """One row per document and item."""
    return spans.select("doc_id", "item_id").distinct()
