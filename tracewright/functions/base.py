"""Small Column helpers with Python's string and number semantics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as answers print it: sign, digits, optional fraction.
NUMBER = r"-?\d+\.?\d*"
#: What may be cast to a double: Spark alone would also take "1d" or "1f".
FLOAT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inf() -> Column:
    """The sentinel for "no number"."""
    return F.lit(float("inf"))


def strip(c: Column) -> Column:
    """Trim all white space on both ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def to_float(c: Column) -> Column:
    """A double, or null where the text is not a plain number."""
    return F.when(c.rlike(FLOAT), F.trim(c)).try_cast("double")


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null."""
    return F.try_element_at(matches(c, pattern, group), F.lit(1))


def last_match(c: Column, pattern: str, group: int = 0) -> Column:
    """Last match, or null."""
    return F.try_element_at(matches(c, pattern, group), F.lit(-1))


def after_last(c: Column, mark: str) -> Column:
    """What follows the last occurrence of a mark; the whole text without one."""
    return F.substring_index(c, mark, -1)


def before_first(c: Column, mark: str) -> Column:
    """What precedes the first occurrence of a mark; the whole text without one."""
    return F.substring_index(c, mark, 1)


def first_word(c: Column) -> Column:
    return before_first(c, " ")


def first_char(c: Column) -> Column:
    return F.substring(c, 1, 1)


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in lambdas, which would otherwise repeat it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def per_row(rule: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """A Python rule of one or more texts as a Column builder over Arrow batches.

    For rules that no built-in expression has. The rule gets None for null;
    the function is only made when it is used, so importing needs no session.
    """

    def build(*columns: Column | str) -> Column:
        def run(*series: pd.Series) -> pd.Series:
            rows = zip(*(s.where(s.notna(), None) if s.dtype == object else s for s in series))
            return pd.Series([rule(*r) for r in rows], dtype=object)

        if len(columns) == 1:

            def one(a: pd.Series) -> pd.Series:
                return run(a)

            return F.pandas_udf(one, returns)(*map(col, columns))
        if len(columns) == 2:

            def two(a: pd.Series, b: pd.Series) -> pd.Series:
                return run(a, b)

            return F.pandas_udf(two, returns)(*map(col, columns))
        raise ValueError(f"rules take one or two columns, not {len(columns)}")

    build.__doc__ = rule.__doc__
    return build
