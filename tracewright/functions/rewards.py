"""Rewards, format checks and judge replies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, filled, strip

# Whole-response formats; only "tags_one_line" forbids line ends inside.
FORMATS = {
    "boxed": r"(?s)\\boxed\{.*?\}",
    "think_answer": r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$",
    "think_then_answer": r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$",
    "tags_one_line": r"^<\|\w+_start\|>.*?<\|\w+_end\|>\s*<answer>.*?</answer>$",
}


def format_reward(c: Column | str, profile: str = "boxed") -> Column:
    return col(c).rlike(FORMATS[profile]).cast("double")


def tight_tags(c: Column | str) -> Column:
    """No white space around <, > and /."""
    return F.regexp_replace(col(c), r"\s*(<|>|/)\s*", "$1")


def tag_content(c: Column | str) -> Column:
    """The stripped answer tag, or the stripped whole text."""
    c = col(c)
    return strip(F.coalesce(filled(F.regexp_extract(c, r"<answer>(.*?)</answer>", 1)), c))


def tag_accuracy(pred: Column | str, gold: Column | str) -> Column:
    return (tag_content(pred) == tag_content(gold)).cast("double")


def mixed_reward(accuracy, form, length=None, reference=None, weight: float = 0.1, penalty: float = 0.001) -> Column:
    """(1 - w) accuracy + w format - penalty for every token beyond a non-zero reference length."""
    out = (1 - weight) * col(accuracy) + weight * col(form)
    if length is None or reference is None:
        return out
    length, reference = col(length), col(reference)
    return out - penalty * F.when((length > reference) & (reference != 0), length - reference).otherwise(0)


def per_length(reward: Column | str, n: Column | str) -> Column:
    """A reward divided by the number of latent steps that earned it."""
    return col(reward) / col(n)


def judge_yes_no(c: Column | str, parity: bool = False) -> Column:
    """1.0 for yes, 0.0 for no or anything unclear.

    Words count; with ``parity`` substrings do, so that "yes, I know" is no yes.
    """
    t = F.lower(strip(col(c)))
    yes = t.contains("yes") if parity else t.rlike(r"\byes\b")
    no = t.contains("no") if parity else t.rlike(r"\bno\b")
    return F.when(yes & ~no, 1.0).otherwise(0.0)


def judge_three_way(c: Column | str) -> Column:
    """1.0, 0.0 or -1.0 by the digits of a reply; 0.0 if unclear."""
    t = F.lower(strip(col(c)))
    one, zero, minus = t.contains("1"), t.contains("0"), t.contains("-1")
    return F.when(one & ~zero & ~minus, 1.0).when(zero & ~one & ~minus, 0.0).when(minus & ~zero, -1.0).otherwise(0.0)
