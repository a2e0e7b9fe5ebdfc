"""Registries of reward, judge and preparation functions, and bounded calls.

Functions are registered in code under a name; nothing is ever loaded from a
path found in data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    """Named functions in the order of registration, with bound options."""

    functions: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def register(self, name: str):
        def add(f):
            if name in self.functions:
                raise ValueError(f"{name!r} is registered already")
            self.functions[name] = f
            return f

        return add

    def get(self, name: str, **options) -> Callable[..., Any]:
        if name not in self.functions:
            raise KeyError(f"{name!r} is none of {list(self.functions)}")
        f = self.functions[name]
        return (lambda *a: f(*a, **options)) if options else f

    def names(self, suffix: str = "") -> list[str]:
        """Names ending in a suffix, in order of registration."""
        return [n for n in self.functions if n.endswith(suffix)]


rewards = Registry()
judges = Registry()
tasks = Registry()


def scalar_reward(rule: Callable[[str, str], dict[str, float]], fields: list[str]) -> Callable[[Column, Column], Column]:
    """A row-wise rule (text, gold) -> scores as a struct column, run over Arrow batches."""
    schema = ", ".join(f"{f} double" for f in fields)

    def run(texts: pd.Series, golds: pd.Series) -> pd.DataFrame:
        rows = [rule(t, g) for t, g in zip(texts, golds)]
        return pd.DataFrame({f: [r.get(f) for r in rows] for f in fields})

    run.__annotations__ = {"texts": pd.Series, "golds": pd.Series, "return": pd.DataFrame}
    return lambda a, b: F.pandas_udf(run, schema)(a, b)


def batch_reward(rule: Callable[[list[str], list[str]], list[dict[str, float]]], fields: list[str]) -> Callable[[Column, Column], Column]:
    """A rule over whole batches, for rules that vectorise."""
    schema = ", ".join(f"{f} double" for f in fields)

    def run(texts: pd.Series, golds: pd.Series) -> pd.DataFrame:
        rows = rule(texts.tolist(), golds.tolist())
        return pd.DataFrame({f: [r.get(f) for r in rows] for f in fields})

    run.__annotations__ = {"texts": pd.Series, "golds": pd.Series, "return": pd.DataFrame}
    return lambda a, b: F.pandas_udf(run, schema)(a, b)


def prepared(df: DataFrame, name: str, **options) -> DataFrame:
    """A registered DataFrame to DataFrame preparation."""
    return tasks.get(name, **options)(df)


def mapped(df: DataFrame, rule: Callable[[dict], dict], schema: str, remove: tuple[str, ...] = ()) -> DataFrame:
    """A Python rule per row that adds columns, others staying unless removed; Arrow batches, no shuffle."""
    keep = [c for c in df.columns if c not in remove]
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = pd.DataFrame([rule(r) for r in pdf.to_dict("records")], index=pdf.index)
            yield pd.concat([pdf[keep], new], axis=1)

    return df.mapInPandas(run, f"{kinds}, {schema}")


def one_to_all(df: DataFrame, value: Any) -> DataFrame:
    """One value for every row."""
    return df.withColumn("shared", F.lit(value))


def by_part(df: DataFrame, rule: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function per partition batch, results concatenated: dispatch and collect in one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield rule(pdf)

    return df.mapInPandas(run, schema)


def called(df: DataFrame, key: str, argument: str, call: Callable[[Any], str], threads: int = 8, retries: int = 5, enabled: bool = False) -> DataFrame:
    """(key, reply): a call per row with a bounded pool per task and retries; a call that never succeeds replies null.

    Off unless ``enabled``: the reply is null then and nothing is called.
    """
    rows = df.select(key, argument)
    kind = dict(rows.dtypes)[key]

    def attempt(x):
        for _ in range(retries):
            try:
                return call(x)
            except Exception:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for pdf in batches:
                replies = list(pool.map(attempt, pdf[argument].tolist())) if enabled else [None] * len(pdf)
                yield pd.DataFrame({key: pdf[key].to_numpy(), "reply": replies})

    return rows.mapInPandas(run, f"{key} {kind}, reply string")
