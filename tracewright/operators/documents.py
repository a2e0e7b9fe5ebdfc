"""Nested columns and tagged texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import per_row


def strip_nested(text: str | None, tag: str) -> tuple[str, list[tuple[int, int]]] | None:
    """The text without a tag at any depth, and the spans of it that stood inside.

    >>> strip_nested("a <t>b<t>c</t></t>d", "t")
    ('a bcd', [(2, 4)])
    """
    if text is None:
        return None
    out, spans, depth, at, length, start = [], [], 0, 0, 0, 0
    for m in re.finditer(rf"<(/?){re.escape(tag)}>", text):
        piece = text[at : m.start()]
        out.append(piece)
        length += len(piece)
        at = m.end()
        if not m[1]:
            if depth == 0:
                start = length
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0 and length > start:
                spans.append((start, length))
    out.append(text[at:])
    return "".join(out), spans


def strip_tags(c: Column, tag: str) -> Column:
    """struct(text, spans): nested tags need a depth counter, which no expression has."""

    def rule(text):
        found = strip_nested(text, tag)
        return None if found is None else {"text": found[0], "spans": [{"start": a, "stop": b} for a, b in found[1]]}

    packed = per_row(lambda t: _json(rule(t)), "string")(c)
    return F.from_json(packed, "text string, spans array<struct<start: int, stop: int>>")


def _json(x) -> str | None:
    import json

    return None if x is None else json.dumps(x)


def flatten_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested struct fields as flat columns named by their path."""

    def walk(fields, path: tuple[str, ...]):
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))

    return df.select(*walk(df.schema.fields, ()))


def nest_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """The inverse: columns named by a path become struct fields."""
    tree: dict = {}
    for name in df.columns:
        node = tree
        *path, leaf = name.split(separator)
        for p in path:
            node = node.setdefault(p, {})
        node[leaf] = F.col(f"`{name}`")

    def build(node: dict):
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))
