"""Filling packs of fixed capacity: histogram patterns by non-negative least squares.

The plan only depends on how many items there are of each length, which is a
table of at most ``capacity`` rows however many items there are. Lengths are
gathered into a few levels; combinations of levels that fill the capacity with
at most the allowed number of items are the columns of a non-negative least
squares problem whose rows are the levels' counts, with one more row that
holds the number of packs down. There are too many combinations to list, so
the one with the steepest gradient is made when it is needed, by dynamic
programming over capacity and number of items. Repeat counts are rounded,
combinations filled with lengths that fit, what is left is solved again, and
the last few items are packed best-fit or balanced, whichever takes fewer
packs. Items then find their pack by their rank among the items of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of length.
LEVELS = 48
#: Steps of the capacity in the dynamic program, and combinations entered per round at most.
STEPS = 512
ENTERED = 200
#: Rounds of solving what the rounding of the one before has left.
ROUNDS = 5
#: Weight of a pack against an item of a level: small, so that counts are met first.
PACK_WEIGHT = 0.01
#: Items of one length that are ranked in one task.
RANKED_AT_ONCE = 50_000


def nnls_entering(target: np.ndarray, enter: Callable[[np.ndarray], tuple[object, np.ndarray] | None], most: int) -> tuple[list, np.ndarray]:
    """Lawson-Hanson over columns that are made when they are needed.

    ``enter`` gets the residual and gives a (name, column) whose product with
    it is positive, or None at the optimum. Returns the names and values of
    the columns that stay above 0; at most ``most`` are entered.
    """
    names: list = []
    a, x = np.zeros((len(target), 0)), np.zeros(0)
    residual = target
    for _ in range(most):
        found = enter(residual)
        if found is None or found[0] in names:
            break
        names.append(found[0])
        a, x = np.column_stack([a, found[1]]), np.append(x, 0.0)
        while True:
            s = np.linalg.lstsq(a, target, rcond=None)[0]
            low = s <= 1e-12
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            keep = x > 1e-12
            if keep.all():
                keep[np.argmin(x)] = False
            a, x, names = a[:, keep], x[keep], [n for n, k in zip(names, keep) if k]
            if not len(x):
                break
        residual = target - a @ x
    return names, x


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 that minimises the norm of a x - b."""
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))

    def steepest(residual):
        gradient = a.T @ residual
        j = int(np.argmax(gradient)) if len(gradient) else -1
        return (j, a[:, j]) if j >= 0 and gradient[j] > tolerance else None

    x = np.zeros(a.shape[1])
    names, values = nnls_entering(b, steepest, most)
    x[names] = values
    return x


def length_levels(histogram: dict[int, int], n: int) -> list[list[int]]:
    """The lengths in at most ``n`` runs, such that the items' distance from the mean of their run is least (in squares)."""
    lengths = np.array(sorted(histogram), dtype=float)
    m = len(lengths)
    if m <= n:
        return [[int(k)] for k in lengths]
    w = np.array([histogram[int(k)] for k in lengths], dtype=float)
    sums = [np.concatenate([[0.0], np.cumsum(w * lengths**p)]) for p in (0, 1, 2)]
    best, cuts = np.full(m + 1, np.inf), []
    best[0] = 0.0
    for _ in range(n):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            c, s1, s2 = (t[j] - t[:j] for t in sums)
            cost = best[:j] + s2 - s1 * s1 / c
            i = int(np.argmin(cost))
            new[j], cut[j] = cost[i], i
        best = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        i = int(cut[j])
        if j > i:
            out.append([int(k) for k in lengths[i:j]])
        j = i
        if not j:
            break
    return out[::-1]


class Combinations:
    """The best combination of levels for given values: of all that fit the steps and the number of items."""

    def __init__(self, sizes: np.ndarray, steps: int, most: int):
        self.sizes, self.steps, self.most = sizes, steps, min(most, steps)
        place = np.arange(steps + 1)[None, :] - sizes[:, None]
        self.place = np.where(place < 0, steps + 1, place)  # the place behind the last is worth nothing

    def best(self, values: np.ndarray) -> tuple[float, tuple[int, ...]]:
        """(value, levels) of the combination with the largest sum of values."""
        use = np.flatnonzero(values > 1e-12)
        if not len(use):
            return 0.0, ()
        worth, place = values[use][:, None], self.place[use]
        now, picks = np.zeros(self.steps + 2), []
        now[-1] = -np.inf
        for _ in range(self.most):
            gained = now[place] + worth
            pick = gained.argmax(axis=0)
            top = gained[pick, np.arange(self.steps + 1)]
            better = top > now[:-1] + 1e-12
            if not better.any():
                break
            picks.append(np.where(better, use[pick], -1))
            now[:-1] = np.where(better, top, now[:-1])
        out, room = [], self.steps
        for pick in reversed(picks):
            if pick[room] >= 0:
                out.append(int(pick[room]))
                room -= int(self.sizes[out[-1]])
        return float(now[self.steps]), tuple(sorted(out, reverse=True))


@dataclass
class Plan:
    """Packs of equal content: each pattern of lengths with its number of packs."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def n_packs(self) -> int:
        return sum(n for _, n in self.patterns)

    def ranges(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: first ranks, first packs and items per pack of its ranges."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: Counter[int] = Counter()
        pack = 0
        for pattern, n in self.patterns:
            for length, times in Counter(pattern).items():
                found[length].append((used[length], pack, times))
                used[length] += times * n
            pack += n
        return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in found.items()}


def plan_packs(histogram: dict[int, int], capacity: int, most: int | None) -> Plan:
    """The packs for ``histogram`` (length -> items, 1 <= length <= capacity)."""
    most = most or 10**9
    plan = Plan(capacity)
    if histogram.get(capacity):
        plan.patterns.append(((capacity,), histogram[capacity]))
    whole = Counter({k: v for k, v in histogram.items() if 0 < k < capacity and v > 0})
    packs, left = _solved(whole, capacity, most)
    # The few that are left: into the room of those packs, or on their own.
    plans = [_best_fit(packs, left, capacity, most), sorted(packs, reverse=True) + _balanced(left, capacity, most)]
    plan.patterns.extend(min(plans, key=lambda p: sum(n for _, n in p)))
    return plan


def _solved(whole: Counter, capacity: int, most: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """Packs by the solved and rounded combinations, and the items that no round has placed."""
    left = Counter(whole)
    packs: list[tuple[tuple[int, ...], int]] = []
    unit = max(1, -(-capacity // STEPS))
    for turn in range(ROUNDS):
        if not left:
            break
        runs = length_levels(left, LEVELS)
        counts = np.array([float(sum(left[k] for k in run)) for run in runs])
        means = np.array([sum(k * left[k] for k in run) for run in runs]) / counts
        sizes = np.maximum(1, np.ceil(means / unit - (0.5 if unit > 1 else 1e-9))).astype(np.int64)
        combinations = Combinations(sizes, capacity // unit, most)

        def enter(residual: np.ndarray) -> tuple[tuple[int, ...], np.ndarray] | None:
            value, chosen = combinations.best(np.maximum(residual[:-1], 0.0))
            if not chosen or value + PACK_WEIGHT * residual[-1] <= 1e-7 * counts.max():
                return None
            return chosen, np.append(np.bincount(chosen, minlength=len(counts)), PACK_WEIGHT)

        names, repeats = nnls_entering(np.append(counts, 0.0), enter, ENTERED)
        made = 0
        for j in np.argsort(-repeats, kind="stable"):
            # Later rounds have few of each, so that cutting would place none.
            made += _realise(packs, left, runs, names[j], int(repeats[j] + (0.5 if turn else 1e-6)), capacity)
        left = +left
        if not made:
            break
    return packs, left


def _realise(packs: list[tuple[tuple[int, ...], int]], left: Counter, runs: list[list[int]], chosen: tuple[int, ...], n: int, capacity: int) -> int:
    """Up to ``n`` packs of a combination, each filled with the longest lengths that leave room for the rest; how many were made."""
    made = 0
    while made < n:
        picked: list[int] = []
        taken: Counter[int] = Counter()
        lows = [next((k for k in runs[x] if left[k]), capacity + 1) for x in chosen]
        room, behind = capacity, sum(lows)
        for x, low in zip(chosen, lows):
            behind -= low
            k = next((k for k in reversed(runs[x]) if k <= room - behind and left[k] > taken[k]), None)
            if k is None:
                return made
            picked.append(k)
            taken[k] += 1
            room -= k
        run = min([n - made, *(left[k] // t for k, t in taken.items())])
        for k, t in taken.items():
            left[k] -= run * t
        packs.append((tuple(sorted(picked, reverse=True)), run))
        made += run
    return made


def _balanced(left: Counter, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs of about equally many items: the longest first, then such that the free places share the room."""
    left = Counter(left)
    lengths = sorted(left)
    items, tokens = left.total(), sum(k * v for k, v in left.items())
    out = []
    while lengths:
        places = min(most, max(1, -(-capacity * items // tokens)))
        first = lengths[-1]
        picked, room = [first], capacity - first
        taken = Counter(picked)
        while len(picked) < most and room:
            free = max(1, places - len(picked))
            aim = room if free == 1 else max(room // free, lengths[0])
            i = bisect_left(lengths, min(aim, room) + 1) - 1
            while i >= 0 and left[lengths[i]] <= taken[lengths[i]]:
                i -= 1
            if i < 0:
                # Nothing so short is left: the shortest that fits.
                i = next((j for j, k in enumerate(lengths) if k <= room and left[k] > taken[k]), -1)
                if i < 0:
                    break
            picked.append(lengths[i])
            taken[lengths[i]] += 1
            room -= lengths[i]
        n = min(left[k] // t for k, t in taken.items())
        for k, t in taken.items():
            left[k] -= n * t
            items, tokens = items - n * t, tokens - n * t * k
            if not left[k]:
                lengths.remove(k)
        out.append((tuple(sorted(picked, reverse=True)), n))
    return out


def _best_fit(packs: list[tuple[tuple[int, ...], int]], left: Counter, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left, longest first, where it leaves least room; many equal packs at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    closed: dict[tuple[int, ...], int] = defaultdict(int)
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not room or len(pattern) >= most:
            closed[pattern] += n
            return
        if not open_[room]:
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for pattern, n in packs:
        put(tuple(sorted(pattern, reverse=True)), n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                # As many of this length in new packs as fit; the rest of the last one stays open.
                each = min(capacity // length, most)
                if n >= each:
                    put((length,) * each, n // each)
                    n %= each
                if n:
                    put((length,) * n, 1)
                    n = 0
                break
            room = rooms[i]
            pattern, count = next(iter(open_[room].items()))
            each = min(room // length, most - len(pattern), n)
            take = min(count, n // each)
            if take == count:
                del open_[room][pattern]
                if not open_[room]:
                    rooms.pop(i)
            else:
                open_[room][pattern] = count - take
            put(tuple(sorted((*pattern, *(length,) * each), reverse=True)), take)
            n -= take * each
    for group in open_.values():
        for pattern, n in group.items():
            closed[pattern] += n
    return sorted(closed.items(), reverse=True)


def _plan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, room, most, sizes, counts in zip(*(b.column(c).to_pylist() for c in ("run_name", "room", "most", "sizes", "counts"))):
            patterns = plan_packs(dict(zip(sizes, counts)), room, most).patterns
            columns = [pa.array([name] * len(patterns), pa.string()), pa.array([list(p) for p, _ in patterns], pa.list_(pa.int32())), pa.array([n for _, n in patterns], pa.int64()), pa.array(range(len(patterns)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["run_name", "pattern", "n", "place"])


def pack_items(samples: DataFrame, args: DataFrame) -> DataFrame:
    """Every piece of every sample with its pack, for every row of ``args``.

    ``samples(row_id, length)`` has unique row ids; ``args(run_name,
    max_packed_tokens, max_instance_per_batch)`` is a short table of settings,
    null meaning no limit; other columns of either are ignored. A sample longer
    than the capacity gives full packs of its own and one remainder; every
    other sample stays whole. Samples of null or non-positive length have
    nothing to place: their pack_id is null. Without a token limit only the
    number of samples counts, and without either limit each sample is a pack.

    Result: run_name, capacity, pack_id, row_id, piece, length.
    """
    spark = samples.sparkSession
    runs = [(r[0], r[1], r[2]) for r in args.select("run_name", "max_packed_tokens", "max_instance_per_batch").orderBy("run_name").collect()]
    settings = [(name, cap, most, int(cap or most or 1), int(cap is not None)) for name, cap, most in runs]
    table = spark.createDataFrame(settings, "run_name string, capacity int, most int, room int, by_tokens int")
    items = (
        samples.select(F.col("row_id").cast("long").alias("row_id"), F.col("length").cast("long").alias("length"))
        .crossJoin(F.broadcast(table))  # the settings: a handful of rows
        .withColumn("whole", F.when(F.col("by_tokens") == 1, F.col("length")).otherwise(F.when(F.col("length") > 0, F.lit(1))))
        .withColumn("piece", F.explode(F.when(F.col("whole") > 0, F.sequence(F.lit(0), ((F.col("whole") - 1) / F.col("room")).cast("int"))).otherwise(F.array(F.lit(0)))))
        .withColumn("size", F.when(F.col("whole") > 0, F.least("room", F.col("whole") - F.col("piece") * F.col("room"))))
        .withColumn("length", F.when(F.col("by_tokens") == 1, F.col("size")).otherwise(F.col("length")))
        .select("run_name", "capacity", "row_id", "piece", "length", F.col("size").cast("int").alias("size"))
    )
    # At most one row per run and length up to its capacity; each run is planned by a task of its own.
    counted = items.where("size is not null").groupBy("run_name", "size").agg(F.count("*").alias("n")).collect()
    limits = {name: (room, most if by_tokens else None) for name, _, most, room, by_tokens in settings}
    histogram: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counted:
        histogram[r.run_name][r["size"]] = r.n
    plans = {}
    if histogram:
        asked = [(name, *limits[name], list(h), list(h.values())) for name, h in sorted(histogram.items())]
        tasks = spark.createDataFrame(asked, "run_name string, room int, most int, sizes array<int>, counts array<long>").repartitionByRange(len(asked), "run_name")
        # At most a few combinations per length of a run; sorted here, as ordering in Spark would plan everything twice.
        for r in sorted(tasks.mapInArrow(_plan_rows, "run_name string, pattern array<int>, n long, place int").collect(), key=lambda r: (r.run_name, r.place)):
            plans.setdefault(r.run_name, Plan(limits[r.run_name][0])).patterns.append((tuple(r.pattern), r.n))
    plans = {name: p.ranges() for name, p in plans.items()}
    shared = spark.sparkContext.broadcast(plans)

    largest = max([1, *(n for h in histogram.values() for n in h.values())])
    blocks = -(-largest // RANKED_AT_ONCE)
    key = ["run_name", "size"]
    placed = items.where("size is not null").withColumn("block", F.pmod(F.xxhash64("row_id", "piece"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy(*key, "block").agg(F.count("*").alias("n"))
    before = counts.select(
        *key, "block", (F.sum("n").over(Window.partitionBy(*key).orderBy("block")) - F.col("n")).alias("before")
    )
    ranked = (
        placed.withColumn("at", F.row_number().over(Window.partitionBy(*key, "block").orderBy("row_id", "piece")))
        .join(before, [*key, "block"])
        .select("run_name", "capacity", "row_id", "piece", "length", "size", (F.col("before") + F.col("at") - 1).alias("rank"))
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes = b.column("run_name").to_pylist(), b.column("size").to_numpy(zero_copy_only=False)
            ranks = b.column("rank").to_numpy(zero_copy_only=False)
            packs = np.empty(len(sizes), dtype=np.int64)
            groups: dict[tuple, list[int]] = defaultdict(list)
            for i, k in enumerate(zip(names, sizes.tolist())):
                groups[k].append(i)
            for (name, size), rows in groups.items():
                start, pack, times = shared.value[name][size]
                rank = ranks[rows]
                j = np.searchsorted(start, rank, side="right") - 1
                packs[rows] = pack[j] + (rank - start[j]) // times[j]
            columns = [b.column("run_name"), b.column("capacity"), pa.array(packs), b.column("row_id"), b.column("piece"), b.column("length")]
            yield pa.RecordBatch.from_arrays(columns, ["run_name", "capacity", "pack_id", "row_id", "piece", "length"])

    schema = "run_name string, capacity int, pack_id long, row_id long, piece int, length long"
    nowhere = items.where("size is null").select("run_name", "capacity", F.lit(None).cast("long").alias("pack_id"), "row_id", "piece", "length")
    return ranked.mapInArrow(assign, schema).unionByName(nowhere)


def packs(items: DataFrame) -> DataFrame:
    """One row per pack with its samples (at most as many as its capacity) and its fill."""
    return (
        items.where("pack_id is not null")
        .groupBy("run_name", "capacity", "pack_id")
        .agg(
            F.count("*").alias("n_samples"),
            F.sum("length").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("row_id", "piece", "length"))).alias("samples"),
        )
        .withColumn("fill", F.col("n_tokens") / F.col("capacity"))
    )


def pack_summary(items: DataFrame) -> DataFrame:
    """Per run: samples, packs, tokens and the share of all room that is used."""
    per_pack = items.where("pack_id is not null").groupBy("run_name", "capacity", "pack_id").agg(F.count("*").alias("k"), F.sum("length").alias("t"))
    return per_pack.groupBy("run_name", "capacity").agg(
        F.count("*").alias("n_packs"),
        F.sum("k").alias("n_pieces"),
        F.sum("t").alias("n_tokens"),
        F.max("k").alias("most_samples"),
        (F.sum("t") / (F.count("*") * F.first("capacity"))).alias("fill"),
    )
