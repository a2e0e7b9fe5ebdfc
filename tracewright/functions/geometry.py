"""Boxes on token grids, image sizes, norms and noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(col(v), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def to_corners(box: Column | str) -> Column:
    """[x, y, w, h] becomes [x1, y1, x2, y2]."""
    b = col(box)
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def box_cells(box: Column | str, width, height, columns: int, rows: int) -> Column:
    """Sorted cell indices that a box of corners covers; at least one cell."""
    b, w, h = col(box), col(width), col(height)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    x1, y1, x2, y2 = (clamp(b[i] / s) for i, s in ((0, w), (1, h), (2, w), (3, h)))
    first = lambda x, n: F.least(F.floor(x * n), F.lit(n - 1)).cast("int")
    last = lambda x, start, n: F.least(F.greatest(F.ceil(x * n).cast("int"), start + 1), F.lit(n))
    c1, r1 = first(x1, columns), first(y1, rows)
    c2, r2 = last(x2, c1, columns), last(y2, r1, rows)
    return F.flatten(F.transform(F.sequence(r1, r2 - 1), lambda r: F.transform(F.sequence(c1, c2 - 1), lambda c: r * columns + c)))


def cells_box(cells: Column | str, columns: int, rows: int) -> Column:
    """The normalised box [x1, y1, x2, y2] around cell indices; null for none."""
    c = col(cells)
    xs, ys = F.transform(c, lambda i: F.pmod(i, F.lit(columns))), F.transform(c, lambda i: F.floor(i / columns))
    box = F.array(
        F.array_min(xs) / columns, F.array_min(ys) / rows, (F.array_max(xs) + 1) / columns, (F.array_max(ys) + 1) / rows
    )
    return F.when(F.size(c) > 0, box)


def fit_pixels(width, height, least: int = 3136, most: int = 1003520, factor: int = 28) -> Column:
    """struct(width, height): multiples of ``factor`` whose product keeps to the pixel budget."""
    w, h = col(width).cast("double"), col(height).cast("double")
    near = lambda x: F.greatest(F.lit(factor), F.round(x / factor).cast("int") * factor)
    bw, bh = near(w), near(h)
    shrink, grow = F.sqrt(w * h / most), F.sqrt(F.lit(float(least)) / (w * h))
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / shrink / factor).cast("int") * factor)
    up = lambda x: F.ceil(x * grow / factor).cast("int") * factor
    pick = lambda base, x: F.when(bw * bh > most, down(x)).when(bw * bh < least, up(x)).otherwise(base)
    return F.struct(pick(bw, w).cast("int").alias("width"), pick(bh, h).cast("int").alias("height"))


def noisy(v: Column | str, amount: float, key: Column | str, seed: int = 42, turn: Callable[[Column], Column] | None = None) -> Column:
    """Uniform noise on values in [0, 1], clipped and cut to 1/255 steps; the same on every run.

    A hash of key and place decides, or ``turn``, which gives a number in [0, 1) for a place.
    """
    step = 1 / 255

    def one(x, i):
        u = F.pmod(F.xxhash64(F.lit(seed), col(key), i), F.lit(1_000_003)) / 1_000_003.0 if turn is None else turn(i)
        y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + (u * 2 - 1) * amount))
        return F.round(y / step) * step

    return F.transform(col(v), one)
