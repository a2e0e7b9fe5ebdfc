"""Text to answer: one parameterised builder per family of extraction rules.

Every builder returns null for a null text unless it says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import NUMBER, after_last, before_first, col, filled, first_char, first_match, first_word, inf, last_match, matches, per_row, strip, to_float

BOXED = r"\\boxed\{([^}]+)\}"


def number(c: Column | str, profile: str = "last_number") -> Column:
    """The number of a text as a double; infinity stands for "none found".

    Profiles: ``last_number`` drops commas and takes the last number;
    ``boxed_then_number`` prefers the last box and keeps commas apart
    (``boxed_then_number_commas`` drops them in the fallback);
    ``whole_then_first`` takes a text that is a number as such, else its first
    number; ``hash_then_number`` prefers what follows ####.
    """
    c = col(c)
    bare = F.replace(c, F.lit(","), F.lit(""))
    last = to_float(last_match(bare, NUMBER))
    if profile == "last_number":
        found = last
    elif profile in ("boxed_then_number", "boxed_then_number_commas"):
        rest = last if profile.endswith("commas") else to_float(last_match(c, NUMBER))
        found = F.coalesce(to_float(last_match(c, BOXED, 1)), rest)
    elif profile == "whole_then_first":
        clean = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[#\n ]+|[#\n ]+$", ""), r"\.+$", ""), ",", ""))
        found = F.coalesce(to_float(clean), to_float(first_match(clean, NUMBER)))
    elif profile == "hash_then_number":
        marked = filled(F.regexp_extract(bare, r"####\s*([\d.\-]+)", 1))
        found = F.when(marked.isNotNull(), to_float(marked)).otherwise(last)
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return F.when(c.isNotNull(), F.coalesce(found, inf()))


def typed_answer(c: Column | str, kind: Column | str, strict: bool = False) -> Column:
    """The last number as text; without one a letter or True/False, by ``kind``.

    ``kind`` is "choice", "truth" or "number". A choice that is none of A to E
    becomes "C"; a truth value that is not stated is null, or an error when
    ``strict``.
    """
    c, kind = col(c), col(kind)
    digits = last_match(F.replace(c, F.lit(","), F.lit("")), NUMBER)
    letter = first_char(strip(after_last(c, "The answer is:")))
    choice = F.when(letter.isin(*"ABCDE"), letter).otherwise(F.lit("C"))
    unknown = F.raise_error(F.lit("neither True nor False")).cast("string") if strict else F.lit(None).cast("string")
    truth = F.when(c.contains("True"), F.lit("True")).when(c.contains("False"), F.lit("False")).otherwise(unknown)
    rest = F.when(kind == "choice", choice).when(kind == "truth", truth).otherwise(F.lit("inf"))
    return F.when(c.isNotNull(), F.coalesce(digits, rest))


# Where a final answer is announced, in order of precedence.
ANNOUNCED = (
    r"(?i)####\s*(\d+\.?\d*)",
    r"(?i)答案是[：:]\s*(\d+\.?\d*)",
    r"(?i)Therefore,?\s+.*?(\d+\.?\d*)",
    r"(?i)Answer[：:]\s*(\d+\.?\d*)",
    r"(?i)\$(\d+\.?\d*)",
    r"(?i)(\d+\.?\d*)\s*$",
)


def announced(c: Column | str, patterns: tuple[str, ...] = ANNOUNCED) -> Column:
    """The first pattern that occurs decides; without any, the stripped text."""
    c = col(c)
    return F.coalesce(*(filled(F.regexp_extract(c, p, 1)) for p in patterns), strip(c))


def reasoning(c: Column | str) -> Column:
    """The body of the last think block, or the whole text."""
    c = col(c)
    last = after_last(c, "<think>")
    closed = c.contains("<think>") & last.contains("</think>")
    return F.when(closed, strip(before_first(last, "</think>"))).otherwise(c)


def clean_reasoning(c: Column | str) -> Column:
    """The body of the last closed think block without a final answer line; empty if there is none."""
    body = F.coalesce(strip(last_match(col(c), r"(?s)<think>(.*?)</think>", 1)), F.lit(""))
    return strip(F.regexp_replace(body, r"(?i)\n*\s*final\s*answer\s*:\s*[A-D]\.?\s*$", ""))


def _boxed_letter(c: Column) -> Column:
    return F.upper(first_char(strip(first_match(c, BOXED, 1))))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def letter(c: Column | str, profile: str = "tag") -> Column:
    """The option letter of a response, or null (profile ``untagged``: maybe empty).

    ``tag``: first character of the first word of the last answer tag.
    ``untagged``: the same, but a text without a tag counts as its content.
    ``box_parens_phrases``: box, last "(X)", first line, announcing phrases, a
    letter standing alone. ``box_tag_parens_line``: box, answer tag, first
    "(X)", last line.
    """
    c = col(c)
    if profile == "tag":
        inner = first_word(strip(before_first(after_last(c, "<answer>"), "</answer>")))
        return F.when(c.contains("<answer>"), filled(first_char(inner)))
    if profile == "untagged":
        return first_char(first_word(strip(before_first(after_last(c, "<answer>"), "</answer"))))
    if profile == "box_parens_phrases":
        text = strip(c)
        line = F.try_element_at(_lines(text), F.lit(1))
        opening = F.when(line.isin(*"ABCD"), line).otherwise(filled(F.regexp_extract(line, r"^([A-Z])\.", 1)))
        said = [
            F.coalesce(filled(F.regexp_extract(rest, r"^\(([A-Z])\)", 1)), filled(F.regexp_extract(rest, r"^([A-Z])", 1)))
            for phrase in PHRASES
            for rest in [strip(F.when(F.lower(text).contains(phrase), F.substr(text, F.instr(F.lower(text), phrase) + len(phrase))))]
        ]
        alone = first_match(text, r"\b([A-D])\b", 1)
        return F.coalesce(_boxed_letter(text), last_match(text, r"\(([A-Z])\)", 1), opening, *said, alone, F.lit(""))
    if profile == "box_tag_parens_line":
        inner = F.when(c.contains("<answer>"), filled(first_word(strip(before_first(after_last(c, "<answer>"), "</answer")))))
        last_line = F.try_element_at(_lines(c), F.lit(-1))
        return F.coalesce(
            _boxed_letter(c), F.upper(first_char(inner)), first_match(c, r"\(([A-Z])\)", 1), F.upper(first_char(first_word(last_line))), F.lit("")
        )
    raise ValueError(f"unknown profile {profile!r}")


# Phrases that announce a choice, in order.
PHRASES = ("the correct answer is", "the answer is", "answer:", "so the answer is", "therefore the answer")
# Triggers of few-shot answers.
TRIGGERS = ("The answer is:", "The answer is", "the answer is")


def choice(c: Column | str, profile: str = "last", triggers: tuple[str, ...] = TRIGGERS) -> Column:
    """A cleaned choice letter, or the cleaned text where no letter A to E stands alone.

    ``last`` takes the last letter of the text; ``after_trigger`` the first one
    after the last trigger, and the last one without a trigger.
    """
    c = col(c)
    trigger = "|".join(re.escape(t) for t in triggers)
    if profile == "after_trigger":
        c = F.regexp_replace(c, r"^\n+|\n+$", "")
        many = None
        for t in triggers:
            twice = F.size(F.split(c, re.escape(t))) > 2
            many = twice if many is None else many | twice
        c = F.when(many, before_first(c, "\n\n")).otherwise(c)
        flagged = c.rlike(trigger)
        c = F.try_element_at(F.split(c, trigger), F.lit(-1))
    elif profile == "last":
        flagged = F.lit(False)
    else:
        raise ValueError(f"unknown profile {profile!r}")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\n+|\n+$", ""), r"\.+$", ""), r"/+$", ""), r"^ +| +$", "")
    text = F.regexp_replace(text, r"^:+", "")
    letters = matches(F.upper(text), r"\b(A|B|C|D|E)\b", 1)
    plain = F.regexp_replace(strip(text), r"^\.+|\.+$", "")
    picked = F.when(flagged, F.try_element_at(letters, F.lit(1))).otherwise(F.try_element_at(letters, F.lit(-1)))
    return F.regexp_replace(F.regexp_replace(F.coalesce(picked, plain), r"\.+$", ""), r"/+$", "")


def after_template(c: Column | str, template: str = "Answer:") -> Column:
    """What follows the last template, hashes at both ends removed."""
    return after_last(F.regexp_replace(col(c), r"^#+|#+$", ""), template)


def after_hashes(c: Column | str) -> Column:
    return after_last(col(c), "####")


def steps_and_answer(c: Column | str) -> Column:
    """struct(steps, answer): lines before and text after the "####" line."""
    parts = F.split(col(c), "\n####")
    return F.struct(F.element_at(parts, 1).alias("steps"), F.trim(F.try_element_at(parts, F.lit(2))).alias("answer"))


def boxed_split(c: Column | str) -> Column:
    """struct(step, answer) of a solution with exactly one box, else null."""
    text = strip(col(c))
    parts = F.split(text, r"\\boxed\{")
    rest = F.try_element_at(parts, F.lit(2))
    brace = F.length(rest) - F.instr(F.reverse(rest), "}") + 1
    cut = F.when(F.instr(rest, "}") > 0, brace).otherwise(F.length(rest))
    answer, tail = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut)
    return F.when(F.size(parts) == 2, F.struct(F.concat(F.element_at(parts, 1), tail).alias("step"), answer.alias("answer")))


def after_is(c: Column | str, parity: bool = False) -> Column:
    """The text after the last "is", up to </answer>; "None" without one.

    ``parity`` keeps a known quirk: without a closing tag the last character is lost.
    """
    c = col(c)
    rest = F.regexp_extract(c, r"(?is)^.*is(.*)$", 1)
    start = F.length(c) - F.length(rest)
    end = F.instr(c, "</answer>") - 1
    open_ = F.substr(c, start + 1, F.greatest(F.length(c) - 1 - start, F.lit(0))) if parity else rest
    found = F.when(end >= 0, F.substr(c, start + 1, F.greatest(end - start, F.lit(0)))).otherwise(open_)
    return F.when(F.lower(c).contains("is"), found).when(c.isNotNull(), F.lit("None"))


def label(c: Column | str) -> Column:
    """"(a)" and "a" become "A"."""
    text = strip(col(c))
    return F.upper(F.coalesce(filled(F.regexp_extract(text, r"^\((.)\)$", 1)), text))


def solution_steps(c: Column | str, mark: str = "### Step") -> Column:
    """Steps between marks, without their numbers."""
    return F.transform(F.split(col(c), re.escape(mark)), lambda s: strip(F.regexp_replace(s, r"^ \d+(\.\d+)?: ", "")))


def trace_parts(c: Column | str) -> Column:
    """Ordered array of struct(kind, text): images by name and thoughts without their numbers."""
    image = r"<image_start>\[(reasoning_image_\d+)\]<image_end>"
    parts = F.split(col(c), r"(?=<image_start>\[reasoning_image_\d+\]<image_end>)|(?<=<image_end>)")
    named = F.transform(
        F.transform(parts, strip),
        lambda s: F.when(s.rlike(f"^{image}"), F.struct(F.lit("image").alias("kind"), F.regexp_extract(s, image, 1).alias("text"))).otherwise(
            F.struct(F.lit("think").alias("kind"), F.regexp_replace(s, r"THOUGHT \d+:\s*", "").alias("text"))
        ),
    )
    return F.filter(named, lambda p: p["text"] != "")


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^0-9.\-]", "")


def with_thousands(c: Column | str) -> Column:
    """Commas into every run of more than three digits."""
    return F.regexp_replace(col(c), r"(?<=\d)(?=(?:\d{3})+(?!\d))", ",")


# Number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
LARGE = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
_VALUES = {w: i for i, w in enumerate(SMALL)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}


def parse_number_words(text: str) -> str:
    """Digits for a text that is one number in words, else the text itself.

    >>> parse_number_words("two hundred and forty-one"), parse_number_words("two hats")
    ('241', 'two hats')
    """
    total = part = 0
    words = [w for w in re.split(r"[\s-]+", text.strip().lower()) if w and w != "and"]
    for w in words:
        if w in _VALUES:
            part += _VALUES[w]
        elif w == "hundred" and part:
            part *= 100
        elif w in LARGE and part:
            total, part = total + part * LARGE[w], 0
        else:
            return text
    return str(total + part) if words else text


number_words = per_row(lambda t: t if t is None else parse_number_words(t), "string")


def last_box(text: str | None, inner: bool = False) -> str | None:
    """The last box with balanced braces; null if there is none or it never closes.

    >>> last_box(r"so \\boxed{\\frac{1}{2}} it is", inner=True)
    '\\\\frac{1}{2}'
    """
    if text is None:
        return None
    start = max(text.rfind("\\boxed"), text.rfind("\\fbox") if "\\boxed" not in text else -1)
    if start < 0:
        return None
    depth, opened = 0, None
    for m in re.finditer(r"[{}]", text[start:]):
        at = start + m.start()
        if m.group() == "{":
            opened = at if opened is None else opened
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return text[opened + 1 : at] if inner else text[start : at + 1]
    return None


#: Regular expressions cannot balance braces.
balanced_box = per_row(last_box, "string")


_CANDIDATE = re.compile(
    r"\\boxed\s*\{|(?P<interval>[\[(]\s*-?[\d./\\a-z]+\s*,\s*-?[\d./\\a-z]+\s*[\])])|"
    r"(?P<fraction>-?\\[dt]?frac\s*\{[^{}]*\}\s*\{[^{}]*\})|(?P<number>-?\d[\d,]*(?:\.\d+)?(?:\s*/\s*\d+)?\s*\\?%?)"
)


def symbol_candidates(text: str | None) -> list[str]:
    """Boxes, intervals, fractions and numbers in reading order; boxes hide what they hold."""
    if not text:
        return []
    out, at = [], 0
    while m := _CANDIDATE.search(text, at):
        at = m.end()
        if m.lastgroup is None:
            depth, i = 1, at
            while i < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[i], 0)
                i += 1
            out.append(text[at : i - (depth == 0)])
            at = i
        else:
            out.append(m.group().strip())
    return out


def pick_symbolic(text: str | None) -> str | None:
    """The last box if there is one, else the last candidate."""
    boxed = last_box(text, inner=True)
    found = symbol_candidates(text)
    return boxed if boxed is not None else found[-1] if found else None


symbolic_answer = per_row(pick_symbolic, "string")
