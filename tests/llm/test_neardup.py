"""Near-duplicate problems and split overlaps against brute force."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import graph, neardup, segjoin, sketch, wording

NAMES = "Abrask Fenouth Talyth Oskizin Vaskelma Kavidra".split()
THINGS = "bricks kettles lambs shingles trays".split()
REMARKS = ["Rain falls on the old mill that day.", "Tram number 77 stops near the barn.", "It is 21 steps from the inn to the quay.", "Everyone agreed that this was fair."]


def problem(rng, numbers):
    who, what = rng.choice(NAMES), rng.choice(THINGS)
    a, b, c = numbers
    return [f"{who} keeps {a} dusty {what} in a cellar behind the northern brewery", f"A shepherd from the market brings {b} more before winter", f"Mice spoil {c} of them after closing time", f"How many {what} does {who} have in the end"], f"{a} + {b} = {a + b}\n{a + b} - {c} = {a + b - c}"


def copy_of(rng, sentences):
    s = list(sentences)
    if rng.random() < 0.5:
        s.insert(rng.randrange(len(s)), rng.choice(REMARKS).rstrip("."))
    if rng.random() < 0.5:
        s[1], s[2] = s[2], s[1]
    text = rng.choice([". ", ".\n", ".  "]).join(s) + "?"
    if rng.random() < 0.3:
        text = text.upper()
    return text


def table(seed, groups=40):
    rng = random.Random(seed)
    rows, key = [], 0
    for _ in range(groups):
        numbers = (rng.randint(300, 900), rng.randint(10, 299), rng.randint(1, 9) * 10 + 3)
        sentences, steps = problem(rng, numbers)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((key, copy_of(rng, sentences), steps))
            key += 1
    rng.shuffle(rows)
    return rows


def truth(rows, cross=None):
    parsed = {i: wording.Question(t, s) for i, t, s in rows}
    ids = sorted(parsed)
    return {(a, b) for a, b in itertools.combinations(ids, 2) if (cross is None or (a in cross) != (b in cross)) and (parsed[a].toks or parsed[b].toks) and wording.same_problem(parsed[a], parsed[b])}


def closed(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**62, 120)
    x = np.concatenate([a[:90], a[30:]]).astype(np.uint64)
    rows = np.repeat([0, 1], 90)
    s = sketch.fast_similarity_sketch(sketch.mix(x), rows, 3, 3000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05
    assert (s[:2] != sketch.EMPTY).all() and (s[2] == sketch.EMPTY).all()
    few = sketch.fast_similarity_sketch(sketch.mix(np.array([5], dtype=np.uint64)), np.array([0]), 1, 50)
    assert (few != sketch.EMPTY).all()


@pytest.mark.parametrize("text, values", [("twenty-five mules and one cart", ["25"]), ("1,002 or 1\u202f002 or 1\xa0002", ["1002"] * 3), ("two thousand one hundred and three", ["2100", "3"]), ("3.50 of 007", ["3.5", "7"]), ("", []), (None, [])])
def test_quantities(text, values):
    assert wording.quantities(text) == values


def test_same_problem_rules():
    q = wording.Question
    base = "Abrask counts 219 dusty bricks inside the garden. Mice spoil 120 of them. How many bricks remain?"
    steps = "219 - 120 = 99"
    assert wording.same_problem(q(base, steps), q(base.replace("120", "one hundred twenty"), steps))
    assert wording.same_problem(q(base, steps), q(base + " It is 21 steps to the inn.", steps))
    assert not wording.same_problem(q(base, steps), q(base.replace("219", "220").replace("120", "121"), "220 - 121 = 99"))
    assert not wording.same_problem(q(base, None), q(base.replace("219", "220").replace("120", "121"), None))
    assert not wording.same_problem(q(None), q(None)) and not wording.same_problem(q(""), q(base))


@pytest.mark.parametrize("seed, block", [(1, 4_000), (2, 2), (3, 5)])
def test_classes_match_brute_force(spark, shared, monkeypatch, seed, block):
    """Also with buckets that take many blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = table(seed) + [(10_000, None, None), (10_001, "", None), (10_002, "?!", "1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, steps string, class_id string")
    got = {r.id: r.class_id for r in neardup.problem_classes(df).collect()}
    want = closed(truth(rows))
    assert got == {i: want.get(i, i) for i, _, _ in rows}
    pairs = {(r.a, r.b) for r in neardup.class_pairs(neardup.problem_classes(df)).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a] == want[b]}


def chain(seed, around=300):
    """Texts of which all but the last match the one in the middle and each other; the last matches only that one."""
    rng = random.Random(seed)
    pool = ["".join(w) for w in itertools.product("bdfg", "aeiou", "klmnp", "aeiou")]
    rng.shuffle(pool)
    middle, last, own = pool[:60], pool[:45] + pool[60:75], pool[75:]
    sets = [middle + rng.sample(own, 35) for _ in range(2 * around)]
    return [" ".join(words) + " 123 456 789" for words in (*sets[:around], middle, *sets[around:], last)]


@pytest.mark.parametrize("block", [4_000, 100])
def test_chain_in_a_large_bucket(spark, shared, monkeypatch, block):
    """A row that matches a member of a class but not its first one belongs to the class."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = chain(1)
    y, x = len(texts) // 2 - 1, len(texts) - 1
    q = [wording.Question(t) for t in texts]
    assert [i for i in range(x) if wording.same_problem(q[i], q[x])] == [y] and all(wording.same_problem(q[i], q[y]) for i in range(x))
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, text string, steps string")
    assert {r.class_id for r in neardup.problem_classes(df).collect()} == {0}


def test_template_bucket_against_brute_force(spark, shared):
    """Many problems of one template and the same quantities, each with a reordered copy: one bucket, compared completely."""
    rng = random.Random(1)
    pool = ["".join(w) for w in itertools.product("bdfg", "aeiou", "klmnp", "aeiou")]
    rows = []
    for i in range(120):
        own = rng.sample(pool, 18)
        for k in range(2):
            rows.append((2 * i + k, " ".join(["template words that every single row of this table shares with others", *rng.sample(own, 18)[k:], "12 34 56"]), None))
    started = time.perf_counter()
    got = {r.id: r.class_id for r in neardup.problem_classes(spark.createDataFrame(rows, "id long, text string, steps string")).collect()}
    assert time.perf_counter() - started < 60
    want = closed(truth(rows))
    assert got == {i: want.get(i, i) for i, _, _ in rows} and 100 <= len(set(got.values())) <= 120


@given(st.sets(st.sampled_from([f"w{i}" for i in range(400)]), max_size=80), st.sets(st.sampled_from([f"w{i}" for i in range(400)]), max_size=80))
@settings(max_examples=20, deadline=None)
def test_word_sets_drop_no_pair(spark, a, b):
    """The test on bits never rejects what the words themselves accept."""
    column = neardup.word_sets([(len(x), wording.word_set_bits(x)) for x in (a, b)]).to_pylist()
    df = spark.createDataFrame([tuple(tuple(v.values()) for v in column)], f"x {neardup.WORDS}, y {neardup.WORDS}")
    union = a | b
    accepted = not union or len(a & b) >= wording.LEAST_WORDS * len(union)
    assert df.select(neardup.share_words("x", "y").alias("k")).first().k or not accepted


def test_copies_and_empty_tables(spark, shared):
    schema = "id long, text string, steps string"
    same = spark.createDataFrame([(i, "Abe has 12 red hats and 30 blue ones", None) for i in range(40)], schema)
    assert {r.class_id for r in neardup.problem_classes(same).collect()} == {0}
    assert neardup.problem_classes(same.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 50_000 + "12 and 13", None), (2, "word " * 50_000 + "12 and 13", None)], schema)
    assert {r.class_id for r in neardup.problem_classes(long).collect()} == {1}


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
@settings(max_examples=6, deadline=None)
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.label for r in graph.connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == closed(real)


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j] + 1, new[j - 1] + 1, d[j - 1] + (x != y)))
        d = new
    assert segjoin.within(a, b, k) == (d[-1] <= k)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.data())
@settings(max_examples=300)
def test_a_segment_survives_every_edit(a, data):
    """Whatever k edits do, some segment stands at a position that is looked at."""
    k = segjoin.edits(len(a))
    b = list(a)
    for _ in range(data.draw(st.integers(0, k))):
        kind, at = data.draw(st.sampled_from("ids")), data.draw(st.integers(0, len(b)))
        if kind == "i":
            b.insert(at, data.draw(st.integers(0, 4)))
        elif b and at < len(b):
            if kind == "d":
                del b[at]
            else:
                b[at] = data.draw(st.integers(0, 4))
    # The columns of the join are those of the functions that are tested here.
    hit = any(a[s : s + n] == b[p : p + n] for i, (s, n) in enumerate(segjoin.segments(len(a), k)) for p in segjoin.starts(i, s, n, len(a), k, len(b)))
    assert hit


@pytest.mark.parametrize("block", [4_000, 2])
def test_overlaps_match_brute_force(spark, shared, monkeypatch, block):
    """Also with keys that are cut into blocks."""
    monkeypatch.setattr(segjoin, "BLOCK", block)
    rows = table(7, 60) + [(9_000, None, None), (9_001, "", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, steps string, e int")
    evaluation = {i for i, _, _ in rows if i % 3 == 0}
    got = {tuple(sorted((r.e, r.t))) for r in segjoin.split_overlaps(df.where("id % 3 = 0"), df.where("id % 3 <> 0")).collect()}
    want = truth(rows, evaluation)
    far = {p for p in want if not _near(rows, p)}
    assert got == want - far and len(far) <= 0.05 * len(want)
    assert segjoin.split_overlaps(df.limit(0), df).count() == 0 and segjoin.split_overlaps(df, df.limit(0)).count() == 0


@given(st.lists(st.lists(st.integers(0, 3), max_size=9), min_size=2, max_size=8))
@settings(max_examples=10, deadline=None)
def test_join_keys_meet_where_segments_do(spark, strings):
    words = (0, 0, *[0] * (wording.SET_BITS // 64))
    df = spark.createDataFrame([(i, x, 0, words) for i, x in enumerate(strings)], f"id long, string array<long>, symbols long, words {neardup.WORDS}")
    left, right = segjoin.segment_keys(df), segjoin.substring_keys(df)
    got = {(r.a, r.b) for r in left.selectExpr("key", "id a").join(right.selectExpr("key", "id b"), "key").collect()}
    want = set()
    for i, a in enumerate(strings):
        k = segjoin.edits(len(a))
        for j, b in enumerate(strings):
            if a and b and abs(len(a) - len(b)) <= k and any(a[s : s + n] == b[p : p + n] for x, (s, n) in enumerate(segjoin.segments(len(a), k)) for p in segjoin.starts(x, s, n, len(a), k, len(b))):
                want.add((i, j))
    assert got == want


def _near(rows, pair):
    text = {i: t for i, t, _ in rows}
    a, b = (wording.sort_quantities(wording.quantities(text[i])) for i in pair)
    e, t = (a, b) if pair[0] % 3 == 0 else (b, a)
    return segjoin.within(e, t, segjoin.edits(len(e)))
