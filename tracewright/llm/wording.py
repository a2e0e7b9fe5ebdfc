"""Words and quantities of a question, independent of how they are written."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from zlib import crc32

# English number words and their values.
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

NUMBER_WORDS = {w: n for n, w in enumerate(UNITS)} | {w: 20 + 10 * n for n, w in enumerate(TENS)}
MAGNITUDES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
#: "one" and "zero" are ordinary words far more often than quantities.
NOT_ALONE = frozenset({"one", "zero"})

_TOKEN = re.compile(r"\d[\d,.'’]*\d|\d|[^\W\d_]+")
_GROUP_BLANK = re.compile(r"(?<=\d)[\xa0\u2007\u2009\u202f](?=\d{3}(?!\d))")
_GROUPED = re.compile(r"\d{1,3}(?:[,.'’]\d{3})+$")
_WIDE_TOKEN = re.compile(r"\d[\d,.'’]*\d|\d|[⺀-鿿가-힯豈-﫿]|[^\W\d_⺀-鿿가-힯豈-﫿]+")
_WIDE = re.compile("[⺀-鿿가-힯豈-﫿]")


def canonical_number(text: str) -> str:
    """One spelling per value: no grouping, no leading or trailing zeros.

    >>> canonical_number("1,002"), canonical_number("007"), canonical_number("2.50")
    ('1002', '7', '2.5')
    """
    if text.isdecimal():
        return text.lstrip("0") or "0" if text[0] == "0" else text
    if _GROUPED.match(text):
        return re.sub(r"\D", "", text).lstrip("0") or "0"
    whole, _, part = re.sub(r"[,'’]", "", text).partition(".")
    part = re.sub(r"\D", "", part).rstrip("0")
    whole = whole.lstrip("0") or "0"
    return f"{whole}.{part}" if part else whole


def number_phrase(words: list[str], at: int) -> tuple[int, int]:
    """Value of the number words that begin at a place, and where they end.

    >>> number_phrase("two thousand one hundred twenty five mules".split(), 0)
    (2125, 6)
    """
    total = part = 0
    last, j = 10**9, at
    while j < len(words):
        w = words[j]
        if w in NUMBER_WORDS:
            size = 9 if NUMBER_WORDS[w] < 10 else 99
            if size >= last or (part % 100 and not (part % 100 >= 20 and part % 10 == 0 and size == 9)):
                break
            part, last = part + NUMBER_WORDS[w], size
        elif w in MAGNITUDES and part:
            if w == "hundred":
                part, last = part * 100, 100
            else:
                total, part, last = total + part * MAGNITUDES[w], 0, MAGNITUDES[w]
        else:
            break
        j += 1
    return total + part, j


def tokens(text: str | None) -> list[tuple[str, bool]]:
    """(token, is a quantity) in text order; number words become digits.

    Case, width, compatibility forms and punctuation do not matter; Han,
    kana and Hangul characters are words of their own.
    """
    if not text:
        return []
    if text.isascii():
        low = text.lower()
    else:
        # Narrow and fixed blanks that group digits would become ordinary ones.
        low = unicodedata.normalize("NFKC", _GROUP_BLANK.sub(",", text)).lower()
    wide = not low.isascii() and _WIDE.search(low) is not None
    found = (_WIDE_TOKEN if wide else _TOKEN).findall(low)
    out: list[tuple[str, bool]] = []
    i, n = 0, len(found)
    while i < n:
        tok = found[i]
        if tok[0].isdigit():
            out.append((canonical_number(tok), True))
        elif tok in NUMBER_WORDS:
            value, j = number_phrase(found, i)
            if tok in NOT_ALONE and j == i + 1:
                out.append((tok, False))
            else:
                out.append((str(value), True))
            i = j
            continue
        else:
            out.append((tok, False))
        i += 1
    return out


def quantities(text: str | None) -> list[str]:
    """The quantities of a text, in text order."""
    return [t for t, number in tokens(text) if number]


def sort_quantities(numbers: list[str]) -> list[str]:
    """Largest first; equal values keep one spelling, so this is canonical."""
    return sorted(numbers, key=lambda x: (len(x.partition(".")[0]), x), reverse=True)


def word_hash(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


#: Bits of a word set; more bits lose fewer words to collisions.
SET_BITS = 256


def word_set_bits(words) -> int:
    """The bits of a set of words; two sets share at least the bits of the words they share.

    >>> word_set_bits(["a", "b"]) & word_set_bits(["b", "c"]) >= word_set_bits(["b"])
    True
    """
    bits = 0
    for w in words:
        bits |= 1 << (word_hash(w) & SET_BITS - 1)
    return bits


class Question:
    """Parsed question: word set, quantity multiset and their contexts."""

    __slots__ = ("toks", "words", "numbers", "_steps", "_solution")

    def __init__(self, text: str | None, steps: str | None = None):
        self.toks = tokens(text)
        self.words = frozenset(t for t, number in self.toks if not number)
        self.numbers = Counter(t for t, number in self.toks if number)
        self._steps, self._solution = steps, None

    @property
    def solution(self) -> frozenset[str]:
        """The quantities of the steps; only read where the questions' own differ."""
        if self._solution is None:
            self._solution = frozenset(quantities(self._steps))
        return self._solution

    def contexts(self, value: str, reach: int = 4) -> list[frozenset[str]]:
        """The words around each place of a quantity."""
        out = []
        for i, (t, number) in enumerate(self.toks):
            if number and t == value:
                around = self.toks[max(0, i - reach) : i] + self.toks[i + 1 : i + 1 + reach]
                out.append(frozenset(w for w, n in around if not n))
        return out

    def remark(self, value: str) -> bool | None:
        """Whether a quantity plays no part in the solution; None if unknown."""
        if len(self.solution & self.numbers.keys()) < 2:
            return None
        return value not in self.solution


#: "About half" of the words: the share of all words of both texts that both have.
LEAST_WORDS = 0.42


def same_problem(a: Question, b: Question, least: float = LEAST_WORDS) -> bool:
    """Whether two questions tell one story with the same quantities.

    About half of the words must be shared (``least``; copies with another
    name, order, layout, synonyms and added remarks stay above it). Quantities
    found on one side only must be remarks: absent from that side's solution
    steps, or, where no steps are known, without a counterpart in the other
    text that stands between the same words.
    """
    union = len(a.words | b.words)
    if not union and not a.numbers:
        return False
    if union and len(a.words & b.words) < least * union:
        return False
    only_a, only_b = a.numbers - b.numbers, b.numbers - a.numbers
    if not only_a and not only_b:
        return True
    common = sum((a.numbers & b.numbers).values())
    if common < 2 or 2 * common < max(a.numbers.total(), b.numbers.total()):
        return False
    open_a = [x for x in only_a if not a.remark(x)]
    open_b = [x for x in only_b if not b.remark(x)]
    for mine, other, values in ((a, b, open_a), (b, a, open_b)):
        for x in values:
            if x in mine.solution and other.solution and x not in other.solution:
                return False
    for x in open_a:
        for y in open_b:
            for p in a.contexts(x):
                for q in b.contexts(y):
                    if 2 * len(p & q) >= min(len(p), len(q)):
                        return False
    return True
