"""Queries without an SQL twin run over whole tables: against brute force on small ones."""

import math

import pytest

from tracewright.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(EVENTS, "event_id long, user_id long, value double, event_type string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame(RESULTS, "record_id long, dataset string, correct boolean").write.parquet(f"{d}/sample_results.parquet")
    spark.createDataFrame(PACKED, "row_id long, ds_name string, input_ids array<int>, labels array<int>, ingested_at long").write.parquet(f"{d}/packed_inputs.parquet")
    return str(d)


EVENTS = [(i, 7 * i % 60, (i * i % 97) / 3, ("view", "error", "purchase")[i % 3]) for i in range(400)]

RESULTS = [(i // 2 * 5, ("svamp", "gsm8k", None)[i % 3], i % 4 == 0) for i in range(600)]

#: Lengths from 3 to 70; 103 stands early, behind the 20th place or nowhere, 101 and 102 late.
IDS = {i: [200 + (i * k) % 50 for k in range(3 + i * 7 % 68)] for i in range(20)}
for i, x in IDS.items():
    if i % 3:
        x[len(x) // (2 if i % 3 == 1 else 4)] = 103
    if len(x) > 30:
        x[-5:-3] = [101, 102]
PACKED = [(i, f"d{i % 2}", x, x, 2) for i, x in IDS.items()] + [(4, "d0", [1], [1], 1)]


def sequences():
    users = {}
    for e, u, value, kind in EVENTS:
        users.setdefault(u, []).append((e, value, int(kind != "error")))
    return users


def advantages():
    out = {}
    for u, s in sequences().items():
        a = 0.0
        for k in reversed(range(len(s))):
            following = s[k + 1][1] / 10 if k + 1 < len(s) else 0.0
            a = s[k][1] - s[k][1] / 10 + 0.9 * following + 0.9 * 0.8 * a
            out[u, s[k][0]] = a
    return out


def test_gae_of_all_users(spark, folder):
    want, value = advantages(), {e: v for e, _, v, _ in EVENTS}
    got = {(r.user_id, r.event_id): (r.advantage, r.ret) for r in catalog.QUERIES["gae"](spark, folder).collect()}
    assert got == {k: pytest.approx((a, a + value[k[1]] / 10), abs=2e-6) for k, a in want.items()}


def test_whitened_by_the_moments_of_all_users(spark, folder):
    want = advantages()
    kept = [want[u, e] for u, s in sequences().items() for e, _, m in s if m]
    mean = sum(kept) / len(kept)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in kept) / (len(kept) - 1) + 1e-8)
    got = {(r.user_id, r.event_id): r.white for r in catalog.QUERIES["w07_gae_whitened"](spark, folder).collect()}
    assert got == {k: pytest.approx((a - mean) / deviation, abs=2e-6) for k, a in want.items()}


def test_discounted_return_of_all_users(spark, folder):
    want = {}
    for u, s in sequences().items():
        a, mask = 0.0, 1
        for e, value, m in reversed(s):
            a = value + 0.95 * a * mask
            mask = m
            want[u, e] = a
    got = {(r.user_id, r.event_id): r.ret for r in catalog.QUERIES["discounted_return"](spark, folder).collect()}
    assert got == {k: pytest.approx(a, abs=1e-4) for k, a in want.items()}


def test_summary_of_all_records(spark, folder):
    got = {r.dataset: (r.num_samples, r.num_correct, r.ids) for r in catalog.QUERIES["s17_summary_document"](spark, folder).collect()}
    of = {name: [(i, ok) for i, n, ok in RESULTS if n == name] for name in ("svamp", "gsm8k", None)}
    assert got == {n: (len(l), sum(ok for _, ok in l), len({i for i, _ in l})) for n, l in of.items()}


def text(x):
    return ",".join(map(str, x))


def parts(x):
    at = x.index(103) + 1 if 103 in x else 0
    n = (len(x) - at) // 3
    return x[:at], x[at : at + n], x[at + n : at + 2 * n], x[at + 2 * n :]


def got(spark, folder, name, *columns):
    return {tuple(r) for r in catalog.QUERIES[name](spark, folder).select(*columns).collect()}


def test_whole_arrays_are_aligned(spark, folder):
    place = {i: x.index(103) + 1 if 103 in x else 0 for i, x in IDS.items()}
    latest = {b: max(p for i, p in place.items() if i % 2 == b) for b in (0, 1)}
    k = {i: latest[i % 2] - p if p else 0 for i, p in place.items()}
    want = {(i, text([0] * k[i] + x), text([-100] * k[i] + x), k[i] + len(x)) for i, x in IDS.items()}
    assert max(place.values()) > 20 and got(spark, folder, "q10_align_on_token", "row_id", "ids", "labels", "n") == want


def test_whole_arrays_in_packs(spark, folder):
    packs = {p: [IDS[i] for i in sorted(IDS) if i // 3 == p] for p in range(7)}
    want = {(p, text(k for k, x in enumerate(s) for _ in x)) for p, s in packs.items()}
    assert got(spark, folder, "q17_segment_ids", "pack", "segments") == want
    assert got(spark, folder, "q18_unpack", "pack", "segment", "ids") == {(p, k, text(x)) for p, s in packs.items() for k, x in enumerate(s)}
    longest = {b: max(len(x) for i, x in IDS.items() if i % 2 == b) for b in (0, 1)}
    assert got(spark, folder, "q21_flatten_steps", "row_id", "ids") == {(i, text(x + [0] * (longest[i % 2] - len(x)))) for i, x in IDS.items()}


def test_whole_arrays_are_staged(spark, folder):
    staged, steps, train = set(), set(), set()
    for i, x in IDS.items():
        q, s, t, a = parts(x)
        head, rest = q + [11, 12, 12, 13], t + a
        staged.add((i, text(head + rest), text([-100] * len(head) + rest), len(head + rest) - 1, text(q + [11, 12, 12, 12, 12, 13] + a)))
        steps.add((i, text(q + s + [11, 12, 12, 13] + rest), text(s)))
        at = next((k + 2 for k in range(len(x)) if x[k : k + 2] == [101, 102]), -1)
        train.add((i, text([-100] * len(q) + x[len(q) :]), at))
    assert got(spark, folder, "q09_staged", "row_id", "ids", "labels", "last", "skipped") == staged
    assert got(spark, folder, "q22_staged_with_steps", "row_id", "ids", "target") == steps
    assert got(spark, folder, "q23_train_row", "row_id", "labels", "answer_at") == train
