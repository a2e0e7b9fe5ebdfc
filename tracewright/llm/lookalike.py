"""One form for texts that look the same.

Look-alike classes are the components of a graph over strings and code points.
Its edges come from Unicode's own decompositions (by rule) and from a short
list of letters of different scripts that share a glyph. Every class is
rewritten to one member: the one whose characters the corpus uses most. A
multi-pattern automaton finds all other members, longest match first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

# Letters that share their glyph with a Latin letter.
SAME_GLYPH = {
    "Cyrillic": "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ҺH ԚQ ԜW ӀI ӏl",
    "Greek": "οo νv ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ͿJ",
    "Armenian": "օo ոn սu հh յj ցg զq ՕO ՍU ԼL",
    "other": "ɡg ɩι ꓐB ꓑP ꓒd",
}
# Marks that have no width and leave no trace, besides the format characters of Unicode.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
# Format characters that are seen, or that join what stands around them.
SEEN_FORMAT = frozenset("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")
JOINERS = "‌‍"
# Ranges whose compatibility decomposition looks like the character itself.
SAME_LOOK_COMPAT = ((0xB5, 0xB5), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
SPACE = " "


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def _vanishes(c: str) -> bool:
    return c in INVISIBLE or unicodedata.category(c) == "Cf" and c not in SEEN_FORMAT


def build_classes() -> Classes:
    """All look-alike classes of Unicode, by rule and from the fixed lists."""
    u = Classes()
    for pairs in SAME_GLYPH.values():
        for a, b in pairs.split():
            if a != b:
                u.join(a, b)
    for hyphen in "\u2010\u2011":
        u.join(hyphen, "-")
    for n in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF or 0xE000 <= n <= 0xF8FF or n >= 0xF0000:
            continue  # Hangul syllables are composed by NFC; surrogates and private use have no look
        c = chr(n)
        if _vanishes(c):
            u.join(c, "")
            continue
        if unicodedata.category(c) == "Zs":
            u.join(c, SPACE)
            continue
        d = unicodedata.decomposition(c)
        if not d:
            continue
        kind, _, rest = d.partition(" ") if d[0] == "<" else ("", "", d)
        if kind == "" or kind in ("<wide>", "<narrow>") or kind == "<compat>" and any(a <= n <= b for a, b in SAME_LOOK_COMPAT):
            u.join(c, "".join(chr(int(x, 16)) for x in rest.split()))
    return u


def representatives(counts: dict[int, int], foreign: bool = False) -> dict[str, str]:
    """What each string is rewritten to, given how often the corpus has each code point.

    Strings with a code point that is not counted are left out, as they cannot
    occur. With ``foreign`` the counts are those of another text, such as test
    items that are searched for: then strings of any characters are rewritten,
    but only to what that text can contain.

    A class takes the member whose rarest character is most frequent; of equal
    ones the shortest, then the first in code point order; letters with marks are composed. A class with the
    empty string vanishes and one with a space becomes a space whatever the
    counts are. Members that stay as they are do not appear.
    """
    out = {}
    for members in build_classes().members().values():
        if "" in members:
            best = ""
        elif SPACE in members:
            best = SPACE
        else:
            best = max(members, key=lambda m: (min(counts.get(ord(c), 0) for c in m), -len(m), tuple(-ord(c) for c in m)))
        for m in members:
            if m != best:
                out[m] = best
    # A representative may hold characters of other classes: rewrite until it stays.
    def settle(text: str) -> str:
        seen = set()
        while text not in seen:  # classes that hold each other's characters would turn in circles
            seen.add(text)
            text = "".join(out.get(c, c) for c in text)
        return unicodedata.normalize("NFC", text)

    # A member with a character the corpus lacks cannot occur in it.
    known = lambda x: all(ord(c) in counts for c in x)
    settled = ((m, settle(best)) for m, best in out.items())
    return {m: best for m, best in settled if best != m and (known(best) if foreign else known(m))}


_MARK = re.compile("[̀-ͯ҃-֑҇-ֽً-ٟऀ-ः़᪰-᫿᷀-᷿⃐-゙゚⃰︠-︯ᄀ-ᇿ]")
_ENDS = re.compile(r"[ \t]+(?=\n|$)")


class Rewriter:
    """Rewrites texts to the representatives of their look-alike classes."""

    def __init__(self, to: dict[str, str]):
        self.to = to
        self.automaton = ahocorasick.Automaton()
        for pattern, new in to.items():
            if pattern:
                self.automaton.add_word(pattern, (len(pattern), new))
        self.automaton.make_automaton()
        #: Finds the texts worth running the automaton over: each pattern is
        #: known by a character that plain text lacks, if it has one.
        first = sorted({next((c for c in k if c > "\x7f"), k[0]) for k in to if k})
        plane = "".join(re.escape(c) for c in first if c <= "\uffff")
        options = ([f"[{plane}]"] if plane else []) + (["[\U00010000-\U0010ffff]"] if first and first[-1] > "\uffff" else [])
        self.first = re.compile("|".join(options)) if options else None

    @staticmethod
    def _joins(text: str, at: int) -> bool:
        """Whether a joiner at a place shapes letters or emoji around it."""
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if not before or not after:
            return False
        if ord(after) > 0x2190 and unicodedata.category(after) == "So":
            return True
        return 0x600 <= ord(before) < 0x1000 and 0x600 <= ord(after) < 0x1000

    def __call__(self, text: str) -> str:
        if text.isascii() or not _MARK.search(text):
            if self.first and self.first.search(text):
                text = self._replace(text)
        else:
            # Marks may sit on letters that are themselves rewritten.
            seen = set()
            while text not in seen:
                seen.add(text)
                text = unicodedata.normalize("NFC", self._replace(unicodedata.normalize("NFC", text)))
        return _ENDS.sub("", text.replace("\r\n", "\n"))

    def _replace(self, text: str) -> str:
        if not self.to:
            return text
        parts, done = [], 0
        for end, (size, new) in self.automaton.iter_long(text):
            start = end - size + 1
            if size == 1 and text[start] in JOINERS and self._joins(text, start):
                continue
            parts.append(text[done:start])
            parts.append(new)
            done = end + 1
        parts.append(text[done:])
        return "".join(parts)


def _count(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        for b in batches:
            for text in _joined(b.column(column)):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(points):
                    low = np.bincount(points)
                    total[: len(low)] += low
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["point", "n"])

    return run


def _joined(column: pa.Array, size: int = 1 << 20) -> Iterator[str]:
    part, length = [], 0
    for text in column.to_pylist():
        if text:
            part.append(text)
            length += len(text)
            if length >= size:
                yield "".join(part)
                part, length = [], 0
    yield "".join(part)


def code_points(df: DataFrame, column: str) -> dict[int, int]:
    """How often each code point occurs in all texts of a column.

    Counted per task and summed; the result cannot exceed the 1.1 million code
    points of Unicode however many texts there are.
    """
    counted = df.select(column).mapInArrow(_count(column), "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return {r.point: r.n for r in counted.collect()}


@lru_cache(maxsize=4)
def _rewriter(pairs: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(dict(pairs))


def rewriter_for(counts: dict[int, int]) -> tuple[tuple[str, str], ...]:
    """The rewriting pairs of a corpus, in a form that tasks can cache by."""
    return tuple(sorted(representatives(counts).items()))


def canonical_text(df: DataFrame, column: str, into: str, pairs: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """``df`` with column ``into`` holding the one form of ``column``.

    Two texts get the same form exactly if a reader cannot tell them apart:
    full-width forms, composed and decomposed letters, ligatures, invisible
    characters, kinds of blanks and letters of other scripts with the same
    glyph fall together, blanks at line ends vanish; accents, case, digits,
    superscripts, fractions and circled signs stay. Null stays null, an empty
    text stays empty, a text of invisible characters becomes empty. ``into``
    replaces a column of that name; other columns pass through.
    """
    pairs = rewriter_for(code_points(df, column)) if pairs is None else pairs
    out = df.drop(into) if into in df.columns and into != column else df

    @F.pandas_udf("string")
    def rewrite(texts):
        run = _rewriter(pairs)
        return texts.map(lambda t: t if t is None else run(t))

    return out.withColumn(into, rewrite(F.col(column).cast("string")))


def _fingerprints(pairs: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = _rewriter(pairs)
        for b in batches:
            ids, form, raw = [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if t is None:
                    continue
                ids.append(i)
                raw.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                form.append(xxhash.xxh3_128_digest(rewrite(t).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], ["id", "form", "raw"])

    return run


def lookalike_classes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form, raw): 128-bit fingerprints of each text's one form and of the text.

    Rows with a null text have no look and are left out; empty texts share one
    form with texts of invisible characters only.
    """
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    pairs = rewriter_for(code_points(texts, "text"))
    return materialise(texts.mapInArrow(_fingerprints(pairs), "id long, form binary, raw binary"), "forms")


def lookalike_links(classes: DataFrame) -> DataFrame:
    """(id, class_id, n_links): each row's class of one look, named by its smallest id, and how many rows look the same but differ in their characters.

    Sums per variant are what is shuffled, so a text that a third of all rows
    repeat is one row of them; rows that look like no other have no links.
    """
    variants = classes.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    forms = variants.groupBy("form").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"))
    per = variants.join(forms, "form").select("form", "raw", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return classes.join(per, ["form", "raw"]).select("id", "class_id", "n_links")


def lookalike_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: rows of one form whose texts differ in their characters.

    Copies of a text first collapse to one variant with a count, so a text
    that a third of all rows repeat costs nothing unless another variant of
    it exists; variants are paired, then each variant brings its rows.
    """
    variants = classes.groupBy("form", "raw").agg(F.count("*").alias("n"))
    several = variants.groupBy("form").agg(F.count("*").alias("variants")).where("variants > 1").select("form")
    rows = classes.join(several, "form", "left_semi")
    kinds = variants.join(several, "form", "left_semi")
    pairs = kinds.select("form", F.col("raw").alias("raw_a")).join(kinds.select("form", F.col("raw").alias("raw_b")), "form").where("raw_a < raw_b").drop("form")
    left, right = rows.select(F.col("raw").alias("raw_a"), F.col("id").alias("x")), rows.select(F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    return pairs.join(left, "raw_a").join(right, "raw_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
