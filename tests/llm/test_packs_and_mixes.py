"""Packing and mixing: properties of every result."""

import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.llm import mixing, packing


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(1, 40), st.one_of(st.none(), st.integers(1, 6)))
@settings(deadline=None, max_examples=80)
def test_plans_place_every_item(sizes, capacity, most):
    histogram = Counter(s for s in sizes if s <= capacity)
    plan = packing.plan_packs(histogram, capacity, most)
    used = Counter()
    for pattern, n in plan.patterns:
        assert n > 0 and sum(pattern) <= capacity and len(pattern) <= (most or 10**9)
        for k in pattern:
            used[k] += n
    assert used == histogram


def test_plans_are_tight():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(5, 0.8, 4000).astype(int) + 1, 1024)
    plan = packing.plan_packs(Counter(sizes.tolist()), 1024, None)
    assert sizes.sum() / (plan.n_packs * 1024) > 0.98


@pytest.mark.parametrize("most", [3, 4, 8, 16])
def test_solved_plans_beat_the_greedy_ones(most):
    """Where the number of items binds, where the room does and between: against best-fit and balanced packs of everything."""
    rng = np.random.default_rng(3)
    histogram = Counter(np.minimum(rng.lognormal(5.1, 0.9, 3000).astype(int) + 1, 1023).tolist())
    packs, left = packing._solved(histogram, 1024, most)
    assert left.total() < 0.1 * histogram.total()
    count = lambda p: sum(n for _, n in p)
    least = max(-(-sum(k * n for k, n in histogram.items()) // 1024), -(-histogram.total() // most))
    mine = packing.plan_packs(histogram, 1024, most).n_packs
    greedy = min(count(packing._best_fit([], histogram, 1024, most)), count(packing._balanced(histogram, 1024, most)))
    assert least <= mine <= greedy + max(1, greedy // 200), (least, mine, greedy)



def test_combinations_are_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, values, most = rng.integers(1, 9, 4), rng.random(4), int(rng.integers(1, 5))
        value, chosen = packing.Combinations(sizes, 12, most).best(values)
        assert value == pytest.approx(sum(values[i] for i in chosen)) and sum(sizes[i] for i in chosen) <= 12 and len(chosen) <= most
        every = (c for n in range(most + 1) for c in itertools.combinations_with_replacement(range(4), n) if sum(sizes[i] for i in c) <= 12)
        assert value == pytest.approx(max(sum(values[i] for i in c) for c in every))


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.nnls(a, b)
    y = np.zeros(20)
    step = 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(20_000):
        y = np.maximum(0, y - step * (a.T @ (a @ y - b)))
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_pack_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 7)
    sizes = [1, 5, 5, 5, 9, 10, 23, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3]
    rows = [(i, n, "x") for i, n in enumerate(sizes)] + [(90, None, "x"), (91, 0, "x")]
    samples = spark.createDataFrame(rows, "row_id long, length int, pack_id string")
    args = spark.createDataFrame([("a", 10, 3), ("b", None, 4), ("c", None, None), ("d", 10, None)], "run_name string, max_packed_tokens int, max_instance_per_batch int")
    out = packing.pack_items(samples, args).collect()
    for run, cap, most in (("a", 10, 3), ("b", None, 4), ("c", None, 1), ("d", 10, None)):
        mine = [r for r in out if r.run_name == run]
        assert sorted({r.row_id for r in mine}) == sorted(r[0] for r in rows)
        assert {r.row_id for r in mine if r.pack_id is None} == {90, 91}
        tokens = Counter()
        packs: dict[int, list] = {}
        for r in mine:
            if r.pack_id is not None:
                tokens[r.row_id] += r.length
                packs.setdefault(r.pack_id, []).append(r)
        assert tokens == Counter(dict(enumerate(sizes)))
        assert sorted(packs) == list(range(len(packs)))
        for p in packs.values():
            assert len(p) <= (most or 10**9) and (cap is None or sum(r.length for r in p) <= cap)
        if cap:
            assert sorted((r.piece, r.length) for r in mine if r.row_id == 6) == [(0, 10), (1, 10), (2, 3)]
            assert all(len([r for r in mine if r.row_id == i]) == 1 for i in range(len(sizes)) if sizes[i] <= cap)
    assert packing.pack_items(samples.limit(0), args).count() == 0 and packing.pack_items(samples, args.limit(0)).count() == 0
    report = {r.run_name: r for r in packing.pack_summary(packing.pack_items(samples, args)).collect()}
    assert report["a"].n_tokens == sum(sizes) and 0 < report["a"].fill <= 1
    assert packing.packs(packing.pack_items(samples, args)).where("run_name = 'a'").agg(F.sum("n_samples")).first()[0] == len(sizes) + 2


def test_temperature():
    shares = [0.7, 0.2, 0.1]
    assert mixing.tempered(shares, 1.0) == pytest.approx(shares) and mixing.tempered(shares, 0.0) == pytest.approx([1 / 3] * 3)
    target = mixing.entropy([0.5, 0.3, 0.2])
    e, w = mixing.temperature_weights([700, 200, 100], [math.inf] * 3, 500, target)
    assert mixing.entropy(w) == pytest.approx(target, abs=1e-6) and 0 < e < 1
    e, w = mixing.temperature_weights([700, 200, 100], [5, 5, 1], 900, math.log(3))
    assert w[2] * 900 <= 100 * (1 + 1e-6)
    e, w = mixing.temperature_weights([700, 0, 100], [1, 1, 1], 10_000, 0.1)
    assert w[1] == 0 and sum(w) == pytest.approx(1)


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")
def test_mixes(spark, shared, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", 9)
    text = "some words of a page that repeat "
    rows = [(i, text * (1 + i % 4), "Web-Crawl" if i % 3 else "web_crawl ", 1) for i in range(200)]
    rows += [(300 + i, text, "notes", 1) for i in range(10)] + [(400, None, "notes", 1), (401, "", "notes", 1), (402, "tail", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int")
    targets = spark.createDataFrame([("m", "web_crawl", 0.6, 1, 0.5), ("m", "notes", 0.3, 2, 0.5), ("m", "absent", 0.1, 4, 0.5), ("big", "notes", 1.0, 3, 1.0)], "mix_name string, source string, target_share double, max_repeats int, budget_ratio double")
    sizes = mixing.sized(docs)
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    plan = mixing.plan_mixes(sizes, targets)
    mixed = mixing.mix_documents(sizes, plan)
    out = mixed.collect()
    assert len({(r.mix_name, r.doc_id) for r in out}) == len(out) and all(r.n_tokens > 0 for r in out)
    limits = {("m", "web_crawl"): 1, ("m", "notes"): 2, ("big", "notes"): 3}
    largest = max(r.n_tokens for r in out)
    for (mix, source), most in limits.items():
        mine = [r for r in out if (r.mix_name, r.source) == (mix, source)]
        assert max(r.repeats for r in mine) <= most
    web = sum(r.n_tokens * r.repeats for r in out if (r.mix_name, r.source) == ("m", "web_crawl"))
    assert abs(web - 0.6 * 0.5 * total) <= largest
    notes = [r for r in out if r.mix_name == "big"]
    assert {r.repeats for r in notes} == {3} and len(notes) == 10
    report = {(r.mix_name, r.source): r for r in mixing.mix_report(mixed, plan).collect()}
    assert report["m", "absent"].taken_tokens == 0 and report["m", "web_crawl"].tokenizer == "byte_bpe_50k.tiktoken"
    assert report["m", "web_crawl"].share_of_budget == pytest.approx(0.6, abs=largest / (0.5 * total) + 1e-9)
    assert sorted(map(tuple, mixing.mix_documents(sizes, plan).collect())) == sorted(map(tuple, out))
    assert mixing.mix_documents(sizes, plan.limit(0)).count() == 0
    assert mixing.mix_documents(mixing.sized(docs.limit(0)), mixing.plan_mixes(mixing.sized(docs.limit(0)), targets)).count() == 0
