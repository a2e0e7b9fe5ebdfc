"""Properties and edge cases: nulls, ties, repeated rows, empty tables, clashing columns."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.operators import aggregates as A
from tracewright.operators import batches as B
from tracewright.operators import clustering as C
from tracewright.operators import partitioning as P
from tracewright.operators import ranking as K
from tracewright.operators import relational as R
from tracewright.operators import registry as X
from tracewright.operators import windows as W
from tracewright.sources import readers, writers
from tracewright.streaming import events as E


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_group_advantage_sums_to_zero(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 2.0), (3, 2.0)], "g int, s double")
    out = rows(W.group_advantage(df, "g", "s", single="drop").select("g", "advantage"))
    assert len(out) == 4 and abs(sum(a for g, a in out if g == 1)) < 1e-9
    assert [a for g, a in out if g == 3] == [0.0, 0.0]
    with pytest.raises(Exception, match="one row only"):
        W.group_advantage(df, "g", "s").collect()
    assert W.group_advantage(df.limit(0), "g", "s").count() == 0


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0), (2, 5.0)], "g int, s double")
    assert [r[1] for r in rows(W.leave_one_out(df, "g", "s").select("s", "advantage"))] == [-3.0, -1.5, 4.5]


def test_union_columns_checks_shared_columns(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2)], "k int, c string, v int")
    b = spark.createDataFrame([(1, "x", 9), (2, None, 8)], "k int, c string, w int")
    assert rows(R.union_columns(a, b, "k")) == [(1, "x", 1, 9), (2, None, 2, 8)]
    with pytest.raises(Exception, match="column c differs"):
        R.union_columns(a, b.withColumn("c", F.lit("y")), "k").collect()
    assert rows(R.union_columns(a, b.withColumn("c", F.lit("y")), "k", exempt=["c"]).select("k", "c")) == [(1, "y"), (2, "y")]


def test_lookup_ignores_clashing_columns(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, name string")
    b = spark.createDataFrame([(1, "z", "other")], "k int, v string, name string")
    assert rows(R.lookup(a, b, "k", "v", "got", F.lit("-"))) == [(1, "a", "z"), (2, "b", "-"), (None, "c", "-")]
    with pytest.raises(Exception, match="no v for 2"):
        R.lookup_required(a, b, "k", "v", "got").collect()


def test_upsert_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 0)], "k int, v string, t int")
    assert rows(R.upsert(old, new, "k", "t").select("k", "v")) == [(1, "c"), (2, "b"), (3, "e")]
    assert rows(R.upsert(old.limit(0), new.limit(0), "k", "t")) == []


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 10)), max_size=8))
@settings(max_examples=15, deadline=None)
def test_merged_spans_are_disjoint(spark, spans):
    df = spark.createDataFrame([(1, a, a + n) for a, n in spans], "g int, a int, b int")
    got = sorted((r.a, r.b) for r in R.merge_spans(df, "g", "a", "b").collect())
    want: list[list[int]] = []
    for a, b in sorted((a, a + n) for a, n in spans):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(x) for x in want]


def test_pad_rows_round_trip(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(5)], "k long, v string")
    for divisor in (1, 4, 8, 16):
        padded = R.pad_rows(df, "k", 5, divisor)
        assert padded.count() % divisor == 0
        assert rows(R.unpad_rows(padded)) == rows(df)
    with pytest.raises(ValueError):
        R.chunk(df, "k", 5, 2)


def test_repeat_counts(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "k long")
    for kind in (dict(interleave=True), dict(interleave=False, total=4)):
        assert sorted(r.new_key for r in R.repeat(df, "k", 3, **kind).collect()) == list(range(12))


def test_hash_split_is_complete_and_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a, b = (rows(R.hash_split(df, "k", {"x": 0.5, "y": 0.5})) for _ in range(2))
    assert a == b and len(a) == 2000 and 800 < sum(s == "x" for _, s in a) < 1200


def test_histogram_and_bincount_of_nothing(spark):
    empty = spark.createDataFrame([], "v int")
    assert rows(A.histogram(empty, "v")) == []
    assert rows(A.bincount(empty, "v", 3)) == [(0, 0), (1, 0), (2, 0)]
    assert rows(A.bincount(spark.createDataFrame([(4,), (4,), (None,)], "v int"), "v", 2)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 2)]


def test_nan_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", math.nan), ("b", None)], "k string, x double")
    assert rows(A.nan_stats(df, ["k"], "x").select("k", "mean", "max")) == [("a", 1.0, 1.0), ("b", None, None)]
    assert rows(A.terminated_stats(spark.createDataFrame([("a", 3, False)], "k string, n int, t boolean"), ["k"], "n", "t"))[0][3:] == (0.0, 0.0, 0.0)


def test_cosine_falls_back(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(A.vector_cosine_loss(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_dense_numbers(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 2, 2, 5, 4]], "v int").withColumn("u", F.monotonically_increasing_id())
    out = W.number_rows(df, ["v", "u"], blocks=3)
    assert [r.v for r in out.orderBy("row_id").collect()] == [1, 2, 2, 3, 4, 5]
    assert sorted(r.row_id for r in out.collect()) == list(range(6))


@given(st.lists(st.integers(1, 100), min_size=4, max_size=24), st.integers(1, 4))
@settings(deadline=None)
def test_partitions_cover_everything_once(sizes, k):
    for method in P.METHODS.values():
        parts = method(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in p) for p in parts]
        if method is P.largest_differencing:
            assert max(sums) - sum(sizes) / k <= max(sizes)
    even = sizes[: len(sizes) // k * k]
    for method in P.METHODS.values():
        assert {len(p) for p in method(even, k, True)} == {len(even) // k}
    with pytest.raises(ValueError):
        P.largest_differencing(sizes + [1] * (1 if len(sizes) % 2 == 0 else 0), 2, True)


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(2, 5), st.integers(1, 6))
@settings(deadline=None)
def test_first_fit_keeps_its_limits(sizes, most, open_):
    fit = P.FirstFit(30, most, 20, open_)
    packs = [b for i, n in enumerate(sizes) for b in fit.add(i, n)] + list(fit.rest())
    assert sorted(i for b in packs for i in b.rows) == list(range(len(sizes)))
    for b in packs:
        assert len(b.rows) == 1 or b.total < 30 or len(b.rows) <= most
        assert all(n == min(sizes[i], 30) if len(b.rows) == 1 else n == sizes[i] for i, n in zip(b.rows, b.sizes))


def test_forbidden_cuts_drop_the_sample():
    fit = P.FirstFit(10, 4, 5, 4)
    assert list(fit.add(0, 12, cut_ok=False)) == [] and [b.sizes for b in fit.add(1, 12)] == [[10]]


@pytest.mark.parametrize("mode", C.REPRESENTATIVES)
def test_leaders_are_separate(mode):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = C.leaders(v, 0.6, mode)
    assert labels[0] == 0 and set(labels) == set(range(labels.max() + 1))
    if mode == "first":
        firsts = [np.flatnonzero(labels == c)[0] for c in range(labels.max() + 1)]
        assert all(v[a] @ v[b] <= 0.6 for i, a in enumerate(firsts) for b in firsts[:i])
        assert all(v[i] @ v[firsts[c]] > 0.6 or i == firsts[c] for i, c in enumerate(labels))
    if mode == "all":
        assert all((v[labels == c] @ v[labels == c].T > 0.6).all() or (labels == c).sum() == 1 for c in set(labels))


def test_leader_cluster_handles_single_rows(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "s int, o int, v array<double>")
    assert rows(C.leader_cluster(df, "s", "o", "v", 0.5)) == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]


def test_sampler_chunks(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "k long")
    out = K.repeat_sampler(df, "k", 7, 3, 2, 1).orderBy("pos").collect()
    order = [r.k for r in out]
    assert len(order) == 12 and order[:3] == order[3:6] and order[6:9] == order[9:12] and len(set(order)) == 6


def test_refill_comes_from_the_pool(spark):
    df = spark.createDataFrame([(1, 9.0, "a"), (2, 8.0, "b1"), (3, 7.0, "c")], "k int, s double, t string")
    out = K.top_k_with_refill(df, "s", "k", ~F.col("t").rlike(r"\d"), 3, spark.createDataFrame([(50,), (51,)], "k int"))
    got = rows(out)
    assert [g[0] for g in got][:2] == [1, 3] and [g[1] for g in got] == [False, False, True]


def test_batches_align(spark):
    df = spark.createDataFrame([(1, [5, 9]), (1, [9]), (1, [4])], "b int, x array<int>")
    out = B.align_on_token(df.withColumn("y", F.col("x")), "b", "x", 9, {"y": -100})
    assert sorted(r.x for r in out.collect()) == [[0, 9], [4], [5, 9]]


def test_tolerant_reader_keeps_rejects(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2}\n')
    assert rows(readers.tolerant_lines(spark, str(p), "a bigint, b string", ["b"])) == [(1, "x")]
    assert rows(readers.rejected_lines(spark, str(p), "a bigint, b string")) == [("{broken",)]
    with pytest.raises(Exception):
        readers.lines(spark, str(p), "a bigint, b string").collect()


def test_valid_ids_are_reused(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    a = writers.valid_ids(df, "k", F.col("k") < 3, str(tmp_path), "v1")
    b = writers.valid_ids(df, "k", F.col("k") < 9, str(tmp_path), "v1")
    assert rows(a) == rows(b) == [(0,), (1,), (2,)]


def test_request_keys(spark):
    ids = ["0_1", "3", "a_2_5", "x_7", "abc"]
    got = [(r[0].parent, r[0].sample) for r in spark.createDataFrame([(i,) for i in ids], "r string").select(E.request_key(F.col("r"))).collect()]
    assert got == [("1", 0), ("3", 0), ("5", 2), ("7", 0), ("abc", 0)]


def test_calls_retry_and_give_up(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "k int, q string")

    def call(q):
        if q == "bad":
            raise RuntimeError
        return q.upper()

    assert rows(X.called(df, "k", "q", call, enabled=True)) == [(1, "OK"), (2, None)]
    assert rows(X.called(df, "k", "q", call)) == [(1, None), (2, None)]
    with pytest.raises(KeyError):
        X.rewards.get("unknown")


def test_a_cluster_needs_a_shared_folder():
    """A machine's own folder is never used where executors run elsewhere."""
    from types import SimpleNamespace

    from tracewright.operators.tables import shared_dir

    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=dict, setCheckpointDir=lambda x: None)
        return SimpleNamespace(sparkContext=context)

    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_tables_are_removed_when_released(spark):
    import os

    from tracewright.operators.tables import materialise, release

    t = materialise(spark.range(3), "some")
    path = t._tracewright_table.removeprefix("file:")
    assert t.count() == 3 and os.path.isdir(path)
    release(t)
    assert not os.path.exists(path)


def test_replayed_batches_are_consumed_once(spark, tmp_path):
    """A crash between consuming and recording, and after recording, doubles nothing."""
    got = {}
    consume = lambda df, i: got.__setitem__(i, sorted(r.x for r in df.collect()))
    batches = [spark.createDataFrame([(10 * i + k,) for k in range(3)], "x long") for i in range(4)]
    run = E.until_full(f"{tmp_path}/pool", 6, consume)

    def crash(df, i):
        consume(df, i)
        raise RuntimeError("lost")

    run(batches[0], 0)
    run(batches[0], 0)
    with pytest.raises(RuntimeError):
        E.until_full(f"{tmp_path}/pool", 6, crash)(batches[1], 1)
    run(batches[1], 1)
    run(batches[1], 1)  # recorded, but its commit was lost
    assert got == {1: [0, 1, 2, 10, 11, 12]}
    run(batches[2], 2)
    run(batches[3], 3)
    assert got == {1: [0, 1, 2, 10, 11, 12], 3: [20, 21, 22, 30, 31, 32]}


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    """Event time: rows behind the watermark of earlier micro-batches do not count; others do, in any order."""
    import datetime as dt
    import os
    import time

    t0 = dt.datetime(2024, 1, 1, 12)
    parts = [[0, 5, 61, 200], [190], [3, 400], [500]]  # minutes; 3 comes when the watermark of an earlier batch is at 190
    for i, minutes in enumerate(parts):
        rows = [(t0 + dt.timedelta(minutes=m), m) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp, m long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            os.utime(f, (time.time() + i, time.time() + i))
    stream = spark.readStream.schema("ts timestamp, m long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = E.windowed(stream, "ts", "1 hour")
    seen = {}
    keep = lambda df, i: seen.update({(r.window.start - t0).total_seconds() // 3600: r.n for r in df.collect()})
    out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == {0.0: 2, 1.0: 1, 3.0: 2, 6.0: 1}


def test_pairs_use_up_their_ends(spark):
    cases = [([1, 3], [2, 4]), ([1, 2], [5]), ([1, 2, 6], [3, 4]), ([5], [1, 2, 7]), ([], [1]), ([1], []), ([1, 2, 3], [4, 5]), ([3], [3, 4])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s array<bigint>, e array<bigint>")
    got = [(r.p, r.q) for r in df.orderBy("i").select(R.paired_ends(F.col("s"), F.col("e")).alias("p"), R.nearest_end(F.col("s"), F.col("e")).alias("q")).collect()]
    pairs = [[tuple(x) for x in p] for p, _ in got]
    assert pairs == [[(1, 2), (3, 4)], [(1, 5)], [(1, 3), (2, 4)], [(5, 7)], [], [], [(1, 4), (2, 5)], [(3, 4)]]
    assert [[tuple(x) for x in q] for _, q in got][1] == [(1, 5), (2, 5)]


def test_blocks_replace_products(spark, monkeypatch):
    from tracewright.operators import tables

    monkeypatch.setattr(tables, "SMALL_ROWS", 3)
    monkeypatch.setattr(tables.in_blocks, "__defaults__", (3,))
    facts = spark.createDataFrame([(i, float(i * i % 7)) for i in range(20)], "f int, w double")
    asked = spark.createDataFrame([(1, 2.2), (2, 6.0), (3, None)], "k int, x double")
    got = rows(R.best_of_all(asked, facts, "k", F.abs(F.col("x") - F.col("w")), "f", "f"))
    assert got == [(1, 3, pytest.approx(0.2)), (2, 5 if 25 % 7 == 6 else min(i for i in range(20) if i * i % 7 == 4), pytest.approx(2.0))]
    cells = spark.createDataFrame([(1, 4, 9)], "k int, f int, v int")
    grid = R.dense_grid(cells, asked, facts, "k", "f", "v", F.lit(0))
    assert grid.count() == 60 and grid.agg(F.sum("v")).first()[0] == 9
    assert R.dense_grid(cells, asked, facts.limit(0), "k", "f", "v", F.lit(0)).count() == 0


def test_ids_over_all_documents(spark, tmp_path):
    for i, n in enumerate((3, 0, 2)):
        (tmp_path / f"d{i}.json").write_text("[" + ",".join(f'{{"question": "q{i}{k}", "answer": "{k}"}}' for k in range(n)) + "]")
    got = sorted((r.id, r.question, r.place) for r in readers.question_set(spark, str(tmp_path)).collect())
    assert got == [(0, "q00", 0), (1, "q01", 1), (2, "q02", 2), (3, "q20", 0), (4, "q21", 1)]
    files = readers.listing(spark, str(tmp_path), "*.json").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    assert rows(files) == [("d0.json",), ("d1.json",), ("d2.json",)]


def test_divergence_of_whole_distributions(spark):
    p, q = [[math.log(0.2), math.log(0.8)], [0.0, -1.0]], [[math.log(0.5), math.log(0.5)], [0.0, -1.0]]
    df = spark.createDataFrame([(p, q), (None, q)], "p array<array<double>>, q array<array<double>>")
    got = [r[0] for r in df.select(A.kl_terms(F.col("p"), F.col("q"), "full")).collect()]
    assert got[0] == pytest.approx([0.2 * math.log(0.4) + 0.8 * math.log(1.6), 0.0]) and got[1] is None


@pytest.mark.parametrize("parts", [1, 7])
def test_recurrences_over_parts(spark, parts):
    """One group holds most rows and lies in several parts; null is a group."""
    import random

    rng = random.Random(parts)
    given = [(rng.choice([1, 1, 1, 1, 2, None, 3]), i, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice([0, 1, 1])) for i in range(300)]
    df = spark.createDataFrame(given, "k int, i int, r double, v double, m int").repartition(5)
    adv = {r.i: (r.advantage, r.ret) for r in W.gae_rows(df, ["k"], "i", F.col("r"), F.col("v"), 0.9, 0.8, parts).collect()}
    plain = {r.i: r.advantage for r in W.gae_rows(df, ["k"], "i", F.col("r"), F.col("v"), 0.9, 0.0, parts).collect()}
    ret = {r.i: r.ret for r in W.discounted_rows(df, ["k"], "i", F.col("r"), F.col("m"), 0.95, parts).collect()}
    for k in (1, 2, 3, None):
        own = [g for g in given if g[0] == k]
        r, v, m = (np.array([g[c] for g in own], dtype=float) for c in (2, 3, 4))
        a, back = W.gae(r, v, 0.9, 0.8)
        assert [adv[g[1]] for g in own] == [(pytest.approx(x), pytest.approx(y)) for x, y in zip(a, back)]
        assert [plain[g[1]] for g in own] == pytest.approx(W.gae(r, v, 0.9, 0.0)[0])
        assert [ret[g[1]] for g in own] == pytest.approx(W.discounted(r, m, 0.95))
    assert W.gae_rows(df.limit(0), ["k"], "i", F.col("r"), F.col("v"), 0.9, 0.8).count() == 0


def test_events_from_datagrams(spark, tmp_path):
    """Packets sent to a port while a query runs end in its table, malformed ones among the rejects."""
    import json
    import socket
    import time

    from tracewright.sources import datagrams

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    datagrams.register(spark)
    lines = spark.readStream.format("datagrams").option("port", port).load()
    got = {}
    run = lines.writeStream.foreachBatch(lambda df, i: got.__setitem__(i, [r.value for r in df.collect()])).option("checkpointLocation", str(tmp_path)).trigger(processingTime="200 milliseconds").start()
    event = {"ts": 1.0, "pid": 1, "req_ids": ["3_7"], "latents": [[0.5]], "rank": 0, "seq": 1}
    try:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        until = time.time() + 60
        while time.time() < until and not {"{broken"} <= {x for b in got.values() for x in b}:
            out.sendto(json.dumps(event).encode(), ("127.0.0.1", port))
            out.sendto(b"{broken", ("127.0.0.1", port))
            time.sleep(0.5)
        out.close()
    finally:
        run.stop()
    seen = [x for b in got.values() for x in b]
    parsed = E.parse(spark.createDataFrame([(x,) for x in seen], "value string"))
    assert {r.value for r in E.rejects(parsed).collect()} == {"{broken"}
    assert {(r.parent, r.sample, r.seq) for r in E.steps(parsed).collect()} == {("7", 3, 1)}
