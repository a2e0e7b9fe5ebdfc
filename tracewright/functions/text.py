"""Text shaping: placeholders, roles, templates, options, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col


def replace_blocks(c: Column | str, tag: str = "abs_vis_token", by: str = "<latent>") -> Column:
    """Every tagged block becomes one placeholder."""
    return F.regexp_replace(col(c), rf"(?s)<{tag}>.*?</{tag}>", by)


def expand_placeholder(c: Column | str, token: str, copies: Column | str, unit: str) -> Column:
    """The i-th placeholder becomes copies[i] units; without an entry it stays one placeholder."""
    parts = F.split(col(c), _quote(token))
    counts = col(copies)
    tail = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.when(
            i < F.size(parts),
            F.concat(F.coalesce(F.repeat(F.lit(unit), F.try_element_at(counts, i)), F.lit(token)), F.element_at(parts, i + 1)),
        ).otherwise(F.lit("")),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


# Names of roles in chat files.
ROLES = {"human": "user", "gpt": "assistant"}


def role(c: Column | str) -> Column:
    c = col(c)
    out = c
    for old, new in ROLES.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def render(template: str, **values: Column | str) -> Column:
    """A template with {name} slots filled from columns; null values become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(value).cast("string"), F.lit("")))
    return out


def content_parts(c: Column | str, mark: str = "<image>") -> Column:
    """Array of struct(type, text): an image for every mark, text between."""
    pieces = F.split(col(c), _quote(mark))
    text = lambda s: F.struct(F.lit("text").alias("type"), s.alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    pairs = F.transform(pieces, lambda s, i: F.when(i == 0, F.array(text(s))).otherwise(F.array(image, text(s))))
    return F.filter(F.flatten(pairs), lambda p: (p["type"] == "image") | (p["text"] != ""))


def shuffled_options(options: Column | str, key: Column | str, seed: int = 42) -> Column:
    """Options in an order that a hash of key and option decides, the same on every run."""
    o = col(options)
    ranked = F.transform(o, lambda x, i: F.struct(F.xxhash64(F.lit(seed), col(key), x, i).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda s: s["x"])


def option_letter(options: Column | str, answer: Column | str) -> Column:
    """The letter of the answer among the options, or null."""
    at = F.array_position(col(options), col(answer))
    return F.when(at > 0, F.char(at + 64))


def without_urls(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"http\S+", "")


def body_and_question(body: Column | str, question: Column | str) -> Column:
    """Both parts trimmed, joined by one blank, the body closed by a period if it has no end mark."""
    b = F.trim(col(body))
    return F.concat_ws(" ", F.when(b.rlike(r"[.!?]$"), b).otherwise(F.concat(b, F.lit("."))), F.trim(col(question)))


def char_count(c: Column | str) -> Column:
    return F.length(col(c))


def word_count(c: Column | str) -> Column:
    """Words between white space; none in an empty text."""
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != ""))


def line_count(c: Column | str) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit("\n"), F.lit(""))) + 1


def flat_name(*parts: str) -> str:
    return "/".join(parts)
