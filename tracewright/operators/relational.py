"""Column algebra, lookups, set operations: keyed where the reference aligns by position.

No operator collects; small sides are left to the optimizer, which broadcasts
them when their size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import in_blocks


# ------------------------------------------------------------- projections


def select(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and some columns; a missing column is an error of the analyser."""
    return df.select(*keys, *columns)


def pop(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): some columns as a table of their own; both keep the row keys."""
    return df.select(*keys, *columns), df.drop(*columns)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old and {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new)))


def key_range(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows whose key lies in [start, stop); reaches the scan as a filter."""
    return df.where((F.col(key) >= start) & (F.col(key) < stop))


def build(spark, columns: dict[str, Sequence], schema: str) -> DataFrame:
    """A small table from columns of one length, under an explicit schema."""
    sizes = {k: len(v) for k, v in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of different length: {sizes}")
    fields = T._parse_datatype_string(schema)
    rows = list(zip(*(columns[f.name] for f in fields.fields)))
    return spark.createDataFrame(rows, fields)


def stride_shard(df: DataFrame, key: str, worker: int, workers: int) -> DataFrame:
    """Every ``workers``-th row from ``worker`` on, by key."""
    return df.where(F.pmod(F.col(key), F.lit(workers)) == worker)


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42, into: str = "split", turn: Column | None = None) -> DataFrame:
    """A reproducible random split without a shuffle: the hash of a row's key decides, or ``turn``, a number in [0, 1).

    Equal keys share a split; a null key has its own hash; an empty table stays empty.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000 if turn is None else turn
    total, edge, out = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        edge += share / total
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return df.withColumn(into, out.otherwise(list(shares)[-1]))


def choose_ids(
    rows: DataFrame, key: str, single: int | None = None, first_correct: int | None = None, first: int | None = None, correct: DataFrame | None = None, order: str = "pos"
) -> DataFrame:
    """Row selection by precedence: one id, first N of the correct ids in their own order, first N rows, all correct ids, all rows."""
    if single is not None:
        return rows.where(F.col(key) == single)
    if first_correct is not None and correct is not None:
        return rows.join(correct.orderBy(order).limit(first_correct).select(key), key, "left_semi")
    if first is not None:
        return rows.orderBy(key).limit(first)
    if correct is not None:
        return rows.join(correct.select(key), key, "left_semi")
    return rows


def prefix_of(best_fact: Column, prefix: Column, trials: Column) -> Column:
    """The prefix of a result: best fact, prefix, last successful trial, first trial, else empty."""
    won = F.try_element_at(F.filter(trials, lambda t: t["success"]), F.lit(-1))["prefix"]
    first = F.try_element_at(trials, F.lit(1))["prefix"]
    return F.coalesce(F.concat(best_fact, F.lit(" ")), prefix, won, first, F.lit(""))


def too_easy(rows: DataFrame, group: str, correct: str, most: float) -> DataFrame:
    """Rows of the groups whose accuracy is at most ``most``."""
    kept = rows.groupBy(group).agg(F.avg(F.col(correct).cast("double")).alias("_rate")).where(F.col("_rate") <= most)
    return rows.join(kept.select(group), group, "left_semi")


def valid_conversation(turns: Column, mark: str = "<image>") -> Column:
    """As many image items as image marks in the texts, and an observation somewhere."""
    items = F.flatten(F.transform(turns, lambda t: t["content"]))
    images = F.size(F.filter(items, lambda i: i["type"] == "image"))
    marks = F.aggregate(items, F.lit(0), lambda n, i: n + F.coalesce(F.size(F.split(i["text"], mark)) - 1, F.lit(0)))
    seen = F.exists(items, lambda i: F.coalesce(i["text"].contains("observation"), F.lit(False)))
    return (images == marks) & seen


def drop_items(turns: Column, role: str, kind: str) -> Column:
    """Turns without the items of one type in one role's turns."""
    return F.transform(
        turns,
        lambda t: t.withField("content", F.when(t["role"] == role, F.filter(t["content"], lambda i: i["type"] != kind)).otherwise(t["content"])),
    )


# -------------------------------------------------------------------- joins


def lookup(rows: DataFrame, table: DataFrame, on: str | Sequence[str], value: str, into: str, default: Column | None = None) -> DataFrame:
    """Left lookup of one column under a new name, null or ``default`` on a miss.

    Clashing column names of ``table`` cannot leak: only keys and value are read.
    """
    keys = [on] if isinstance(on, str) else list(on)
    found = rows.join(table.select(*keys, F.col(value).alias("_value")), keys, "left")
    got = F.col("_value") if default is None else F.coalesce("_value", default)
    return found.withColumn(into, got).drop("_value")


def lookup_required(rows: DataFrame, table: DataFrame, on: str, value: str, into: str) -> DataFrame:
    """As ``lookup``, but a missing key is an error when the row is read."""
    miss = F.raise_error(F.concat(F.lit(f"no {value} for "), F.col(on).cast("string"))).cast(table.schema[value].dataType)
    found = rows.join(table.select(on, F.struct(F.col(value)).alias("_hit")), on, "left")
    return found.withColumn(into, F.when(F.col("_hit").isNull(), miss).otherwise(F.col("_hit")[value])).drop("_hit")


def replace_by_lookup(rows: DataFrame, table: DataFrame, on: str, value: str, column: str, flag: str) -> DataFrame:
    """A looked-up value replaces the column; a flag tells where."""
    found = lookup(rows, table, on, value, "_new")
    return found.withColumn(flag, F.col("_new").isNotNull()).withColumn(column, F.coalesce("_new", column)).drop("_new")


def resume(rows: DataFrame, done: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    keys = [on] if isinstance(on, str) else list(on)
    return rows.join(done.select(*keys), keys, "left_anti")


def union_columns(left: DataFrame, right: DataFrame, key: str, exempt: Sequence[str] = ()) -> DataFrame:
    """Columns of both tables by key; a shared column must agree and exempt ones come from the right."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(key, *(F.col(c).alias(f"_r_{c}") for c in right.columns if c != key))
    both = left.join(r, key)

    def pick(c: str) -> Column:
        if c not in shared:
            return F.col(c) if c in left.columns else F.col(f"_r_{c}").alias(c)
        if c in exempt:
            return F.col(f"_r_{c}").alias(c)
        differs = F.raise_error(F.lit(f"column {c} differs")).cast(left.schema[c].dataType)
        return F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(differs).alias(c)

    new = [c for c in right.columns if c != key and c not in shared]
    return both.select(key, *(pick(c) for c in left.columns if c != key), *(pick(c) for c in new))


def judged(rows: DataFrame, api: DataFrame, key: str, rule: str, verdict: str, into: str) -> DataFrame:
    """Rule verdicts, replaced by the judge's where the rule said no and the judge said anything."""
    failed = rows.where(F.col(rule) == 0).select(key)
    asked = failed.join(api.select(key, F.col(verdict).alias("_v")), key)
    return rows.join(asked, key, "left").withColumn(into, F.coalesce("_v", rule)).drop("_v")


def pick_one(pool: DataFrame, key: str, order: str, seed: int = 42, turn: Column | None = None) -> DataFrame:
    """One row per key, chosen by a seeded hash of the row or by ``turn``, ties by ``order``; partial aggregation, no window."""
    cols = [c for c in pool.columns if c != key]
    best = F.min_by(F.struct(*cols), F.struct(F.xxhash64(F.lit(seed), key, order) if turn is None else turn, F.col(order)))
    return pool.groupBy(key).agg(best.alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in cols))


def nearest_end(starts: Column, ends: Column) -> Column:
    """Array of struct(start, end): each start with the first end behind it; starts may share an end.

    Both are ascending arrays of places in one sequence. A start without an
    end behind it gives no pair, empty arrays give none, null gives null.
    """
    pairs = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_min(F.filter(ends, lambda e: e > s)).alias("end")))
    return F.filter(pairs, lambda p: p["end"].isNotNull())


def paired_ends(starts: Column, ends: Column) -> Column:
    """Array of struct(start, end): starts in order, each with the first end behind it that no earlier start has.

    Ends pass by once: one that does not lie behind the first start still
    waiting is skipped. Places as in ``nearest_end``; equal ones are no pair.
    """
    kind = "struct<at int, pairs array<struct<start bigint, end bigint>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().alias("pairs")).cast(kind)

    def step(state, end):
        start = F.try_element_at(starts, state["at"] + 1)
        pair = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        taken = F.struct((state["at"] + 1).alias("at"), F.concat(state["pairs"], pair).alias("pairs"))
        return F.when(start < end, taken).otherwise(state).cast(kind)

    return F.aggregate(ends, begin, step, lambda s: s["pairs"])


def overlaps(tokens: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """Token intervals [s, e) that meet a span [a, b) of their group: one row per pair.

    The equi-join on the group keeps it local; the interval condition is part
    of the join, so no pair beyond it is made.
    """
    t, s = tokens.alias("t"), spans.alias("s")
    meet = F.greatest("t.s", "s.a") < F.least("t.e", "s.b")
    return t.join(s, (F.col(f"t.{group}") == F.col(f"s.{group}")) & meet).select(f"t.{group}", "t.s", "t.e", "s.a", "s.b")


def member_cluster(members: DataFrame, queries: DataFrame, on: Sequence[str], cluster: str) -> DataFrame:
    """The first cluster a text belongs to, by exact membership."""
    first = members.groupBy(*on).agg(F.min(cluster).alias(cluster))
    return queries.join(first, list(on), "left")


def best_of_all(rows: DataFrame, facts: DataFrame, key: str, cost: Column, fact: str, tie: str) -> DataFrame:
    """(key, best, cost): the cheapest of all facts for each row, the smaller ``tie`` of equal ones.

    Facts are a short list by nature. They are sent out in blocks of at most
    ``SMALL_ROWS``, and each row keeps the best of a block right there, so
    pairs are never shuffled. A row whose costs are all null, and any row
    where there are no facts, has no best and is left out.
    """
    best = None
    for block in in_blocks(facts, tie):
        one = rows.crossJoin(F.broadcast(block)).withColumn("_c", cost).where("_c is not null")  # a block of facts
        one = one.groupBy(key).agg(F.min(F.struct("_c", F.col(tie).alias("_t"), F.col(fact).alias("_f"))).alias("_b"))
        best = one if best is None else best.unionByName(one)
    return best.groupBy(key).agg(F.min("_b").alias("_b")).select(key, F.col("_b._f").alias("best"), F.col("_b._c").alias("cost"))


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str], latest: str) -> DataFrame:
    """Saved rows with new ones merged in: one row per key, the latest wins, new before old on ties."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in (*keys, "_new")]
    last = F.max_by(F.struct(*cols), F.struct(latest, "_new"))
    return rows.groupBy(*keys).agg(last.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in cols))


def dense_grid(cells: DataFrame, rows: DataFrame, columns: DataFrame, row: str, column: str, value: str, fill: Column) -> DataFrame:
    """Every (row, column) cell; absent ones get ``fill``.

    The grid is the result: rows times columns. Columns are sent out in blocks
    of at most ``SMALL_ROWS``; null is a row or column like any other, but no
    cell of one is ever found. Either side empty gives an empty grid.
    """
    every, grid = rows.select(row).distinct(), None
    for block in in_blocks(columns.select(column).distinct(), column):
        one = every.crossJoin(F.broadcast(block))  # a block of columns
        grid = one if grid is None else grid.unionByName(one)
    return grid.join(cells.select(row, column, value), [row, column], "left").withColumn(value, F.coalesce(value, fill))


def preference_pairs(rows: DataFrame, prompt: str, answer: str, score: str) -> DataFrame:
    """Best and worst answer of each prompt; prompts whose answers all score alike give none."""
    best = F.max_by(answer, F.struct(F.col(score), F.col(answer)))
    worst = F.min_by(answer, F.struct(F.col(score), F.col(answer)))
    both = rows.groupBy(prompt).agg(best.alias("chosen"), worst.alias("rejected"), F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    return both.where(F.col("_hi") > F.col("_lo")).drop("_hi", "_lo")


# ----------------------------------------------------------- set operations


def concat(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def merge_spans(df: DataFrame, group: str | Sequence[str], start: str, end: str) -> DataFrame:
    """Union of spans per group; overlapping and adjacent ones merge."""
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


# ---------------------------------------------------------------- row shape


def _field(items: str, name: str) -> Column:
    return F.transform(items, lambda s: s[name]).alias(name)


def chunk(df: DataFrame, key: str, total: int, chunks: int) -> DataFrame:
    """Equal parts by a dense key 0..total-1; an uneven split is an error."""
    if total % chunks:
        raise ValueError(f"{total} rows do not split into {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(key) * chunks / total).cast("int"))


def repeat(df: DataFrame, key: str, times: int, interleave: bool = True, total: int | None = None) -> DataFrame:
    """Each row ``times`` times with a new dense key: copies side by side, or whole tables one after the other."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    new = F.col(key) * times + F.col("copy") if interleave else F.col("copy") * total + F.col(key)
    return out.withColumn("new_key", new)


def pad_rows(df: DataFrame, key: str, total: int, divisor: int) -> DataFrame:
    """Rows repeated cyclically until their number divides; ``is_pad`` marks the added ones.

    More added rows than there are go round again, so any divisor works.
    """
    extra = -total % divisor
    real = df.withColumn("is_pad", F.lit(False))
    if not extra or not total:
        return real
    rounds = -(-extra // total)
    more = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).where(F.col("_k") * total + F.col(key) < extra)
    return real.unionByName(more.withColumn(key, F.col("_k") * total + F.col(key) + total).drop("_k").withColumn("is_pad", F.lit(True)))


def unpad_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def fold(df: DataFrame, key: str, size: int, columns: Sequence[str]) -> DataFrame:
    """Groups of ``size`` consecutive keys become one row of arrays in key order."""
    items = F.sort_array(F.collect_list(F.struct(key, *columns)))
    folded = df.groupBy(F.floor(F.col(key) / size).cast("long").alias("row")).agg(items.alias("_i"))
    return folded.select("row", *(_field("_i", c) for c in columns))


def collate(df: DataFrame, batch: str, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per batch with an array per column, in key order."""
    items = F.sort_array(F.collect_list(F.struct(key, *columns)))
    return df.groupBy(batch).agg(items.alias("_i")).select(batch, *(_field("_i", c) for c in columns))


def reorder(df: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """Rows at new places: ``index(pos, key)`` names the row that comes to each place."""
    return index.select("pos", key).join(df, key)
