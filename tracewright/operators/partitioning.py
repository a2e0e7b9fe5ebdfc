"""Length-balanced partitions and packing with open buffers.

The heuristics are sequential by definition; each group (a batch, a shard) is
one task's work, and groups are independent.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest_differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k parts of item numbers with close sums (Karmarkar and Karp); with ``equal`` also of one length.

    A solution is k sums in falling order. The two solutions with the widest
    spread merge, largest sums onto smallest, until one is left. Ties go to
    the solution with the larger largest part, then to the earlier one.
    """
    if equal and len(sizes) % k:
        raise ValueError(f"{len(sizes)} items do not make {k} equal parts")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    if not groups:
        return [[] for _ in range(k)]

    def ranked(parts):
        return sorted(parts, key=lambda p: (-p[0], -len(p[1]), p[1]))

    heap = []
    for n, group in enumerate(groups):
        parts = ranked([(sizes[i], [i]) for i in group] + [(0, [])] * (k - len(group)))
        heap.append((parts[-1][0] - parts[0][0], -parts[0][0], n, parts))
    heapq.heapify(heap)
    n = len(groups)
    while len(heap) > 1:
        *_, a = heapq.heappop(heap)
        *_, b = heapq.heappop(heap)
        parts = ranked([(x[0] + y[0], sorted(x[1] + y[1])) for x, y in zip(a, reversed(b))])
        n += 1
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], -parts[0][0], n, parts))
    return [p[1] for p in heap[0][-1]]


def least_loaded(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each item in turn to the part with the smallest sum; with ``equal`` a bias keeps the lengths alike."""
    if equal and len(sizes) % k:
        raise ValueError(f"{len(sizes)} items do not make {k} equal parts")
    bias = sum(sizes) + 1 if equal else 0
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, j) for j in range(k)]
    for i, size in enumerate(sizes):
        load, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (load + size + bias, j))
    return parts


METHODS = {"differencing": largest_differencing, "least_loaded": least_loaded}


def checked(parts: list[list[int]], n: int) -> list[list[int]]:
    """The parts, or an error if one is empty or they do not cover all items once."""
    if any(not p for p in parts):
        raise ValueError("a part is empty")
    if sorted(i for p in parts for i in p) != list(range(n)):
        raise ValueError("the parts do not cover all items exactly once")
    return [sorted(p) for p in parts]


def balance(df: DataFrame, batch: str, key: str, size: str, k: int, equal: bool = False, method: str = "differencing") -> DataFrame:
    """(batch, key, size, part): every batch split into k parts of close total size.

    A batch must fit one worker; batches are spread over all.
    """
    rows = df.select(batch, F.col(key).cast("long").alias(key), F.col(size).cast("long").alias(size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        parts = checked(METHODS[method](pdf[size].tolist(), k, equal), len(pdf))
        pdf["part"] = 0
        for j, p in enumerate(parts):
            pdf.loc[p, "part"] = j
        return pdf

    kind = dict(rows.dtypes)[batch]
    return rows.groupBy(batch).applyInPandas(run, f"{batch} {kind}, {key} long, {size} long, part int")


def micro_batches(df: DataFrame, batch: str, key: str, size: str, most: int) -> DataFrame:
    """As ``balance`` with as many parts as the batch's total needs at ``most`` each, at most one per row."""
    rows = df.select(batch, F.col(key).cast("long").alias(key), F.col(size).cast("long").alias(size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        k = min(len(pdf), max(1, -(-int(pdf[size].sum()) // most)))
        parts = checked(largest_differencing(pdf[size].tolist(), k), len(pdf))
        pdf["part"] = 0
        for j, p in enumerate(parts):
            pdf.loc[p, "part"] = j
        return pdf

    kind = dict(rows.dtypes)[batch]
    return rows.groupBy(batch).applyInPandas(run, f"{batch} {kind}, {key} long, {size} long, part int")


def balanced_order(parts: DataFrame, batch: str, key: str, part: str = "part") -> DataFrame:
    """(batch, key, pos): the place of every row when parts follow one another."""
    from pyspark.sql import Window

    return parts.withColumn("pos", F.row_number().over(Window.partitionBy(batch).orderBy(part, key)) - 1).select(batch, key, "pos")


def inverse_order(order: DataFrame, index: str = "index", pos: str = "pos") -> DataFrame:
    """The inverse permutation: both columns change places."""
    return order.select(F.col(pos).alias(index), F.col(index).alias(pos))


class Buffer:
    """One open pack."""

    __slots__ = ("rows", "sizes")

    def __init__(self, row: int, size: int):
        self.rows, self.sizes = [row], [size]

    @property
    def total(self) -> int:
        return sum(self.sizes)


class FirstFit:
    """First-fit packing with open buffers, kept longest first.

    A sample of at least ``long`` tokens is a pack of its own, cut to the
    capacity and dropped if the cut falls on one of ``uncut`` tokens. Any other
    goes into the first buffer with room for it; once half of the allowed
    buffers are open and ``overflow`` is set, a full buffer may take it and
    gives back its last sample. Full buffers are emitted, and the longest ones
    whenever more than ``open_`` are open.
    """

    def __init__(self, capacity: int, instances: int | None = None, long: int | None = None, open_: int | None = None, overflow: bool = True):
        self.capacity = capacity
        self.instances = instances or 10**9
        self.long = long or capacity // 2
        self.open = open_ or 10**9
        self.overflow = overflow
        self.buffers: list[Buffer] = []

    def add(self, row: int, size: int, cut_ok: bool = True) -> Iterator[Buffer]:
        buffer = self._take(size)
        if buffer is None:
            buffer = Buffer(row, size)
        else:
            buffer.rows.append(row)
            buffer.sizes.append(size)
        yield from self._settle(buffer, cut_ok)
        while len(self.buffers) > self.open:
            yield self.buffers.pop(0)

    def rest(self) -> Iterator[Buffer]:
        yield from self.buffers
        self.buffers = []

    def _take(self, size: int) -> Buffer | None:
        if size >= self.long:
            return None
        spill = None
        for i, b in enumerate(self.buffers):
            if len(b.rows) < self.instances:
                if b.total + size <= self.capacity:
                    return self.buffers.pop(i)
                if self.overflow and len(self.buffers) >= self.open // 2:
                    spill = i
        return None if spill is None else self.buffers.pop(spill)

    def _place(self, total: int, count: int, cut_ok: bool) -> str:
        """What becomes of a pack by its tokens and samples: emitted, lost, divided, or kept open."""
        over, several = total >= self.capacity, count > 1
        if several:
            return "divided" if over else "emitted" if count >= self.instances else "open"
        if total < self.long:
            return "open"
        return "emitted" if cut_ok or total <= self.capacity else "lost"

    def _settle(self, b: Buffer, cut_ok: bool) -> Iterator[Buffer]:
        place = self._place(b.total, len(b.rows), cut_ok)
        if place == "emitted":
            b.sizes = b.sizes if len(b.sizes) > 1 else [min(b.total, self.capacity)]
            yield b
        if place in ("emitted", "lost"):
            return
        # The last sample of a divided pack leaves it; of both parts the larger is done, the other goes on.
        while len(b.rows) > 1 and b.total >= self.capacity:
            parts = [b, Buffer(b.rows.pop(), b.sizes.pop())]
            done = parts.pop(int(parts[1].total > parts[0].total))
            b = parts[0]
            yield done
        at = next((i for i, x in enumerate(self.buffers) if x.total < b.total), len(self.buffers))
        self.buffers.insert(at, b)


def pack_first_fit(df: DataFrame, shard: str, key: str, ids: str, capacity: int, instances: int | None = None, long: int | None = None, open_: int | None = None, uncut: tuple[int, ...] = ()) -> DataFrame:
    """(shard, pack, segment, key, size): every shard packed in key order.

    ``ids`` is the token array. Only lengths and whether a cut would be allowed
    travel to the shard's task, never the tokens.
    """
    blocked = F.coalesce(F.try_element_at(ids, F.lit(capacity + 1)).isin(*uncut), F.lit(False)) if uncut else F.lit(False)
    rows = df.select(shard, F.col(key).cast("long").alias(key), F.size(ids).cast("long").alias("size"), (~blocked).alias("cut_ok"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        fit = FirstFit(capacity, instances, long, open_)
        done: list[Buffer] = []
        for row, size, ok in zip(pdf[key], pdf["size"], pdf["cut_ok"]):
            done.extend(fit.add(row, size, ok))
        done.extend(fit.rest())
        name = pdf[shard].iloc[0]
        out = [(name, p, s, r, n) for p, b in enumerate(done) for s, (r, n) in enumerate(zip(b.rows, b.sizes))]
        return pd.DataFrame(out, columns=[shard, "pack", "segment", key, "size"])

    kind = dict(rows.dtypes)[shard]
    return rows.groupBy(shard).applyInPandas(run, f"{shard} {kind}, pack long, segment int, {key} long, size long")
