"""Whether two answers are the same: one builder per family with named profiles."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import answers
from .base import FLOAT, col, per_row, to_float
from .latex import normal_latex, same_value


def _pure(c: Column) -> Column:
    """Lower case without hashes, blanks and line ends around, final periods and commas."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[#\n ]+|[#\n ]+$", ""), r"\.+$", ""), ",", ""))


def same_number(pred: Column | str, gold: Column | str, profile: str = "exact", strict: bool = False) -> Column:
    """Compare two doubles; infinity stands for "no number".

    ``exact``: equal, so two missing numbers agree unless ``strict``.
    ``near_or_zero``: within 0.01, but exactly zero where the gold is zero.
    """
    p, g = col(pred), col(gold)
    if profile == "exact":
        same = p == g
    elif profile == "near_or_zero":
        near = F.coalesce(F.abs(p - g) < 0.01, F.lit(False)) & ~F.isnan(p - g)
        same = F.when(g == 0, p == g).otherwise((p == g) | near)
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return same & (p != float("inf")) if strict else same


def same_text(pred: Column | str, gold: Column | str, profile: str = "pure_close") -> Column:
    """Compare two answer texts.

    ``pure_close``: normalised, numbers within 1e-6, else equal texts.
    ``pure_exact``: normalised, numbers equal, else equal texts. ``trim_close``:
    trimmed, numbers within 1e-9, else equal texts. ``trim_exact``: equal
    texts or equal numbers. ``near_numeric_gold``: the gold must look like a
    number and lie within 0.01.
    """
    p, g = col(pred), col(gold)
    if profile in ("pure_close", "pure_exact"):
        a, b = _pure(p), _pure(g)
        x, y = to_float(a), to_float(b)
        numbers = F.abs(x - y) < 1e-6 if profile == "pure_close" else x == y
        return F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(a == b)
    if profile == "trim_close":
        a, b = F.trim(p), F.trim(g)
        x, y = to_float(a), to_float(b)
        return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(a == b)
    if profile == "trim_exact":
        x, y = to_float(p), to_float(g)
        return (F.trim(p) == F.trim(g)) | F.coalesce(x == y, F.lit(False))
    if profile == "near_numeric_gold":
        x, y = to_float(p), to_float(g)
        return F.coalesce(g.rlike(r"^-*\d+\.?\d*$") & ((p == g) | (F.abs(x - y) < 0.01)), F.lit(False))
    raise ValueError(f"unknown profile {profile!r}")


def parsed_digits(c: Column | str) -> Column:
    """A double: commas dropped, a percent sign (also escaped) divides by 100; else null."""
    bare = F.replace(col(c), F.lit(","), F.lit(""))
    percent = F.regexp_extract(bare, r"^(.*?)\\?%$", 1)
    return F.coalesce(to_float(bare), to_float(percent) / 100)


# --------------------------------------------------------- rules in Python


def parse_digits(text: str) -> float | None:
    bare = text.replace(",", "")
    scale = 1.0
    if bare.endswith("%"):
        bare, scale = bare[:-1].removesuffix("\\"), 100.0
    return float(bare) / scale if re.match(FLOAT, bare) else None


def symbolic_equal(a: str, b: str) -> bool:
    """Two expressions with one spelling, or with the same value wherever both are tried."""
    return normal_latex(a, skip_unit=True) == normal_latex(b, skip_unit=True) or same_value(a, b)


def clean_choice(text: str) -> str:
    t = text.strip("\n").rstrip(".").rstrip("/").strip(" ").lstrip(":")
    letters = re.findall(r"\b([A-E])\b", t.upper())
    return (letters[-1] if letters else t.strip().strip(".")).rstrip(".").rstrip("/")


def _cells(text: str) -> list[list[str]] | None:
    m = re.fullmatch(r"\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}", text, re.S)
    return [[c for c in row.split("&")] for row in m[1].split("\\\\") if row.strip()] if m else None


def math_equal(pred: str | None, gold: str | None, percent: bool = True) -> bool:
    """Equal as text, choice, number (also times or by 100, within 1e-4), tuple, matrix, equation or expression."""
    if pred is None or gold is None:
        return False
    p, g = pred.strip(), gold.strip()
    if p.lower() == g.lower():
        return True
    if gold in tuple("ABCDE") and clean_choice(pred) == gold:
        return True
    x, y = parse_digits(p), parse_digits(g)
    if x is not None and y is not None:
        return any(math.isclose(x, z, rel_tol=1e-4) for z in ((y / 100, y, y * 100) if percent else (y,)))
    if not p or not g:
        return False
    a, b = _cells(p), _cells(g)
    if a and b:
        return len(a) == len(b) and all(len(r) == len(s) and all(math_equal(u, v, percent) for u, v in zip(r, s)) for r, s in zip(a, b))
    drop = str.maketrans("", "", "{}()[]")
    boxed = lambda t: t[0] in "([" and t[-1] in ")]"
    same_brackets = not (boxed(p) and boxed(g)) or p[0] == g[0]
    if same_brackets and p.translate(drop).lower() == g.translate(drop).lower():
        return True
    if boxed(p) and boxed(g):
        u, v = p[1:-1].split(","), g[1:-1].split(",")
        if len(u) == len(v) and len(u) > 1:
            return all(math_equal(s, t, percent) for s, t in zip(u, v))
    if p.count("=") == 1 and g.count("=") == 1:
        sides = [[f"({s.strip()})" for s in t.split("=")] for t in (p, g)]
        one, two = (f"{s[0]} - {s[1]}" for s in sides)
        return symbolic_equal(one, two) or symbolic_equal(f"-({one})", two)
    for s, t in ((p, g), (g, p)):
        name, eq, value = s.partition("=")
        if eq and "=" not in value and "=" not in t and len(name.strip()) <= 2:
            return math_equal(value, t, percent)
    return symbolic_equal(p, g)


def same_latex(a: str | None, b: str | None) -> bool:
    """Equal after normalisation; two missing answers agree."""
    if a is None or b is None:
        return a is None and b is None
    return normal_latex(a) == normal_latex(b)


def latex_number_check(pred: str | None, gold: str | None) -> bool:
    """Literally equal, equal as numbers, or the prediction's only number is the gold's."""
    if pred is None or gold is None:
        return False
    if same_latex(pred, gold):
        return True
    x, y = parse_digits(normal_latex(pred)), parse_digits(normal_latex(gold))
    if x is not None and y is not None:
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    found = [c for c in answers.symbol_candidates(pred) if parse_digits(c) is not None]
    return y is not None and len(found) == 1 and math.isclose(parse_digits(found[0]), y, rel_tol=1e-9, abs_tol=1e-9)


def any_equal(a: str | None, b: str | None) -> bool:
    """Any of the checks, in either direction."""
    return same_latex(a, b) or math_equal(a, b) or math_equal(b, a) or latex_number_check(a, b) or latex_number_check(b, a)


def check_with_retries(pred: str | None, gold: str | None) -> bool:
    """The check on the prediction, on its last box, and on what follows its last ":" or "is"."""
    check = lambda t: same_latex(t, gold) or latex_number_check(t, gold)
    if pred is None or gold is None:
        return pred is None and gold is None
    if check(pred):
        return True
    inner = answers.last_box(pred, inner=True)
    text = re.sub(r"^\\text\{(.*)\}$", r"\1", inner if inner is not None else pred)
    if check(text):
        return True
    mark = ":" if ":" in text else "is" if "is" in text else None
    return mark is not None and check(text.split(mark)[-1].strip())


_python_math = per_row(math_equal, "boolean")


def equal_math(pred: Column | str, gold: Column | str) -> Column:
    """``math_equal`` of two columns; only rows that neither their texts nor their numbers settle reach Python."""
    p, g = col(pred), col(gold)
    x, y = parsed_digits(F.trim(p)), parsed_digits(F.trim(g))
    near = lambda z: F.abs(x - z) <= 1e-4 * F.greatest(F.abs(x), F.abs(z))
    settled = (
        F.when(p.isNull() | g.isNull(), False)
        .when(F.lower(F.trim(p)) == F.lower(F.trim(g)), True)
        .when(x.isNotNull() & y.isNotNull() & ~g.isin(*"ABCDE"), near(y / 100) | near(y) | near(y * 100))
    )
    return F.coalesce(settled, _python_math(F.when(settled.isNull(), p), F.when(settled.isNull(), g)))


def _unless_equal(rule, null_agrees: bool = True):
    """The rule as a Column; rows of equal texts are settled without Python."""
    run = per_row(rule, "boolean")

    def build(a: Column | str, b: Column | str) -> Column:
        a, b = col(a), col(b)
        settled = F.when(a.isNull() & b.isNull(), null_agrees).when(a == b, True)
        return F.coalesce(settled, run(F.when(settled.isNull(), a), F.when(settled.isNull(), b)))

    build.__doc__ = rule.__doc__
    return build


equal_symbolic = _unless_equal(lambda a, b: a is not None and b is not None and symbolic_equal(a, b), False)
equal_latex = _unless_equal(same_latex)
equal_latex_number = _unless_equal(latex_number_check, False)
equal_any = _unless_equal(any_equal)
equal_with_retries = _unless_equal(check_with_retries)
latex_form = per_row(lambda t: t if t is None else normal_latex(t), "string")
