"""Token sequences as array columns: padding, truncation, masks, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

IGNORE = -100


def empty(of: Column) -> Column:
    return F.slice(of, 1, 0)


def pad(x: Column, length: Column | int, value, side: str = "right") -> Column:
    """Padded to a length; longer arrays lose their right end on either side."""
    n = F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0)))
    out = F.concat(x, fill) if side == "right" else F.concat(fill, x)
    return F.slice(out, F.lit(1), n)


def pad_or_cut(x: Column, length: int, value, pad_side: str = "left", cut: str = "error") -> Column:
    """Exactly ``length`` items; too long ones are cut left or right, or are an error."""
    n = F.size(x)
    longer = {
        "left": F.slice(x, n - length + 1, length),
        "right": F.slice(x, 1, length),
        "error": F.when(n > length, F.raise_error(F.lit(f"longer than {length}"))).cast("array<int>"),
    }[cut]
    return F.when(n > length, longer).otherwise(pad(x, length, value, pad_side))


def cut_with_end(x: Column, length: int, end: int) -> Column:
    """Cut to length - 1 if longer than length; the end token is always appended."""
    return F.concat(F.when(F.size(x) > length, F.slice(x, 1, length - 1)).otherwise(x), F.array(F.lit(end)))


def _starts(x: Column, size: int) -> Column:
    n = F.size(x)
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.slice(F.array(F.lit(0)), 1, 0))


def find(x: Column, *patterns: list[int], start: Column | int = 0) -> Column:
    """0-based place of the first of several patterns, or -1; places behind the longest pattern's reach do not count."""
    first = F.lit(start) if isinstance(start, int) else start
    longest = max(len(p) for p in patterns)

    def here(i):
        hit = None
        for p in patterns:
            same = F.slice(x, i + 1, len(p)) == F.array(*(F.lit(v) for v in p))
            hit = same if hit is None else hit | same
        return hit & (i >= first)

    return F.coalesce(F.try_element_at(F.filter(_starts(x, longest), here), F.lit(1)), F.lit(-1))


def find_after(x: Column, anchor: list[int], *patterns: list[int]) -> Column:
    """All places of patterns strictly behind the first anchor; none without one."""
    longest = max(len(p) for p in patterns)

    def here(i, at):
        hit = None
        for p in patterns:
            same = F.slice(x, i + 1, len(p)) == F.array(*(F.lit(v) for v in p))
            hit = same if hit is None else hit | same
        return hit & (i > at) & (at >= 0)

    return let(find(x, anchor), lambda at: F.filter(_starts(x, longest), lambda i: here(i, at)))


def labels_after(x: Column, start: list[int], ignored: list[int] = ()) -> Column:
    """-100 through the first start pattern and on ignored ids; all -100 without the pattern."""
    hidden = lambda v, i, at: (at < 0) | (i < at + len(start)) | (v.isin(*ignored) if ignored else F.lit(False))
    return let(find(x, start), lambda at: F.transform(x, lambda v, i: F.when(hidden(v, i, at), IGNORE).otherwise(v)))


def labels_at(x: Column, allowed: Column) -> Column:
    """-100 everywhere but at allowed 0-based places."""
    return F.transform(x, lambda v, i: F.when(F.array_contains(allowed, i), v).otherwise(IGNORE))


def replace_spans(x: Column, start: int, end: int, token: int, copies: int) -> Column:
    """What lies between a start and the next end token becomes ``copies`` tokens.

    Pairs are greedy from the left; unmatched marks stay.
    """

    def cut(spans):
        # A start inside a span that is already open belongs to it.
        outer = F.filter(spans, lambda p: ~F.exists(spans, lambda q: (q["a"] < p["a"]) & (p["a"] < q["b"])))
        return let(outer, fill)

    def fill(spans):
        hidden = lambda i: F.exists(spans, lambda p: (i > p["a"]) & (i < p["b"]))
        opens = lambda i: F.exists(spans, lambda p: i == p["a"])
        return F.flatten(
            F.transform(
                x,
                lambda v, i: F.when(hidden(i), F.slice(F.array(v), 1, 0)).when(opens(i), F.concat(F.array(v), F.array_repeat(F.lit(token), copies))).otherwise(F.array(v)),
            )
        )

    n = F.size(x)
    places = lambda t: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(x, i + 1) == t)

    def pairs(ends):
        return F.transform(
            F.filter(places(start), lambda s: F.exists(ends, lambda e: e > s)),
            lambda s: F.struct(s.alias("a"), F.array_min(F.filter(ends, lambda e: e > s)).alias("b")),
        )

    return F.when(n > 0, let(places(end), lambda ends: let(pairs(ends), cut))).otherwise(x)


def staged(question: Column, steps: Column, answer: Column, stage: int, per_step: int, start: int, latent: int, end: int, most: int = 100, markers: bool = True, pad_to_most: bool = False) -> Column:
    """struct(input_ids, labels, position_ids): the first ``stage`` steps become latent tokens.

    Beyond ``most`` stages all steps are skipped, for at most ``most`` (exactly
    with ``pad_to_most``) latent steps. Question, markers and latents are not trained on.
    """
    n = F.size(steps)
    if stage > most:
        rest = empty(steps)
        count = F.lit(most) if pad_to_most else F.least(n, F.lit(most))
    else:
        rest = F.slice(steps, stage + 1, F.greatest(n - stage, F.lit(0)))
        count = F.lit(stage)
    head = F.concat(question, F.array(F.lit(start)) if markers else empty(question), F.array_repeat(F.lit(latent), count * per_step), F.array(F.lit(end)) if markers else empty(question))
    ids = F.concat(head, F.flatten(rest), answer)
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(head)), F.slice(ids, F.size(head) + 1, F.greatest(F.size(ids) - F.size(head), F.lit(0))))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), F.sequence(F.lit(0), F.size(ids) - 1).alias("position_ids"))


def staged_with_steps(question: Column, steps: Column, answer: Column, stage: int, per_step: int, start: int, latent: int, end: int) -> Column:
    """struct(input_ids, targets): the first ``stage`` steps stay before the latents and are the per-step targets."""
    n = F.size(steps)
    first = F.slice(steps, 1, stage)
    ids = F.concat(question, F.flatten(first), F.array(F.lit(start)), F.array_repeat(F.lit(latent), stage * per_step), F.array(F.lit(end)), F.flatten(F.slice(steps, stage + 1, F.greatest(n - stage, F.lit(0)))), answer)
    return F.struct(ids.alias("input_ids"), first.alias("targets"))


def shrinking_prefixes(words: Column, n: int) -> Column:
    """Texts of all words, of all but the last, and so on: n of them."""
    size = F.size(words)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.slice(words, F.lit(1), F.greatest(size - i, F.lit(0))), " "))


def unpack(x: Column, lengths: Column) -> Column:
    """Slices of consecutive lengths."""
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b))
    return let(x, lambda whole: F.zip_with(ends, lengths, lambda e, n: F.slice(whole, e - n + 1, n)))


def segment_ids(lengths: Column) -> Column:
    """0 for the tokens of the first sample of a pack, 1 for the second, and so on."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def train_row(source: Column, cot: Column, answer: Column, prompt: list[int]) -> Column:
    """struct(input_ids, labels, answer_at): the source is masked; answer_at is behind the last token of the prompt, or -1."""
    ids = F.concat(source, cot, answer)
    labels = F.transform(ids, lambda v, i: F.when(i < F.size(source), IGNORE).otherwise(v))
    at = find(ids, prompt)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), F.when(at >= 0, at + len(prompt)).otherwise(-1).alias("answer_at"))


def matched_segments(x: Column, start: int, end: int) -> Column:
    """Array of struct(a, b): each start with the next unused end behind it, two pointers from the left."""
    n = F.size(x)
    marks = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(x, i + 1).isin(start, end))
    none = F.slice(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), 1, 0)
    begin = F.struct(none.alias("out"), F.slice(F.array(F.lit(0)), 1, 0).alias("open"))

    def step(acc, i):
        opens = F.element_at(x, i + 1) == start
        waiting = F.size(acc["open"]) > 0
        pair = F.struct(F.try_element_at(acc["open"], F.lit(1)).alias("a"), i.alias("b"))
        return (
            F.when(opens, F.struct(acc["out"].alias("out"), F.concat(acc["open"], F.array(i)).alias("open")))
            .when(waiting, F.struct(F.concat(acc["out"], F.array(pair)).alias("out"), F.slice(acc["open"], F.lit(2), F.size(acc["open"])).alias("open")))
            .otherwise(acc)
        )

    return F.when(n > 0, F.aggregate(marks, begin, step, lambda acc: acc["out"])).otherwise(none)
