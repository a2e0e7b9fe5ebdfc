"""Look-alikes, leaks and defective pairs."""

import itertools
import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import defects, fmindex, languages, leak, lookalike


def rewriter(*texts):
    counts = {}
    for t in texts:
        for c in t:
            counts[ord(c)] = counts.get(ord(c), 0) + 1
    return lookalike.Rewriter(lookalike.representatives(counts))


SAME = [("naïve cafe", "naïve cafe"), ("scope", "ѕсоре"), ("code 12", "ｃｏｄｅ　１２"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd"), ("word", "wo­rd"), ("ofﬁce", "office"),
        ("µm", "μm"), ("5 \u03a9", "5 \u2126"), ("3 K", "3 \u212a"), ("well-known", "well‑known"), ("é", "е́"), ("end", "end \n".strip("\n")), ("a\nb", "a\r\nb"), ("x", "x﻿⁠‌")]
DIFFERENT = [("cafe", "café"), ("x2", "x²"), ("1/2", "½"), ("(1)", "①"), ("Rose", "rose"), ("12", "13"), ("α", "a"), ("𝐚", "a"), ("a  b", "a b"), ("o", "ö")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    run = rewriter(a, b, "plain latin letters of all kinds abcdefghijklmnopqrstuvwxyzK " * 5)
    assert a != b and run(a) == run(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_look(a, b):
    run = rewriter(a, b)
    assert run(a) != run(b)


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ae оеаﬁfí​１1Ωé")), max_size=12))
def test_rewriting_is_stable(text):
    run = rewriter(text, "abcdefi1 ")
    assert run(run(text)) == run(text)


def test_joiners_that_matter_stay():
    family = "👨‍👩‍👧"
    assert rewriter(family)(family) == family


def test_lookalike_pairs(spark, shared):
    rng = random.Random(3)
    swaps = {"a": "а", "e": "е", "o": "ο", " ": " "}
    base = ["one plain sentence", "another plain line", "a café note", "", None]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        if t and rng.random() < 0.6:
            t = "".join(swaps.get(c, c) if rng.random() < 0.4 else c for c in t)
            if rng.random() < 0.3:
                t = unicodedata.normalize("NFD", t)
        rows.append((i, t, 1.0))
    df = spark.createDataFrame(rows, "doc_id long, text string, form double")
    run = rewriter(*(t for _, t, _ in rows if t))
    want = {(a, b) for (a, s, _), (b, t, _) in itertools.combinations(rows, 2) if s is not None and t is not None and s != t and run(s) == run(t)}
    got = {(r.a, r.b) for r in lookalike.lookalike_pairs(lookalike.lookalike_classes(df, "doc_id", "text")).collect()}
    assert got == want
    links = {r.id: (r.class_id, r.n_links) for r in lookalike.lookalike_links(lookalike.lookalike_classes(df, "doc_id", "text")).collect()}
    shown = {i: (t, run(t)) for i, t, _ in rows if t is not None}
    assert links == {i: (min(j for j, (_, g) in shown.items() if g == f), sum(g == f and s != t for s, g in shown.values())) for i, (t, f) in shown.items()}
    out = {r.doc_id: r.form for r in lookalike.canonical_text(df, "text", "form").collect()}
    assert out == {i: None if t is None else run(t) for i, t, _ in rows}
    assert lookalike.lookalike_pairs(lookalike.lookalike_classes(df.limit(0), "doc_id", "text")).count() == 0


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 9))
@settings(deadline=None)
def test_fm_index(seq, pattern, sample):
    index = fmindex.FMIndex(np.array(seq), 3, sample)
    lo, hi = index.search(np.array([pattern]))
    got = sorted(index.locate(np.arange(lo[0], hi[0])))
    assert got == [i for i in range(len(seq) - len(pattern) + 1) if seq[i : i + len(pattern)] == pattern]


def _longest(a, b):
    best, row = 0, {}
    for x in a:
        new = {}
        for j, y in enumerate(b):
            if x == y:
                new[j] = row.get(j - 1, 0) + 1
                best = max(best, new[j])
        row = new
    return best


@pytest.mark.parametrize("shard, block", [(400_000, 4_000_000), (30, 30)])
def test_leaks_match_brute_force(spark, shared, monkeypatch, shard, block):
    monkeypatch.setattr(leak, "BLOCK_WORDS", block)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 50)))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(200, None), (201, ""), (202, "<b>" * 500)]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        item = rng.choice(items[:12])[1].split()
        if len(item) > 12:
            a = rng.randint(0, len(item) - 12)
            piece = item[a : a + rng.randint(10, 25)]
            words[len(words) // 2 : len(words) // 2] = [rng.choice([w, w.upper(), f"<b>{w}</b>", f"**{w}**", w.replace("w", "ｗ")]) for w in piece]
        docs.append((i, rng.choice([" ", "\n> ", ", "]).join(words)))
    docs.append((300, docs[10][1]))
    run = lookalike.Rewriter(leak.prepare([x for x in items if x[1]], 15).pairs)
    want = {(d, i) for d, t in docs if t for i, q in items if q and _longest(leak.words(t, run), leak.words(q, run)) >= 15}
    a = spark.createDataFrame([(d, t, 0) for d, t in docs], "id long, text string, item_id int")
    b = spark.createDataFrame(items, "id long, text string")
    spans = leak.leaked_spans(a, b, shard_words=shard).collect()
    assert {(s.doc_id, s.item_id) for s in spans} == want
    texts, asked = dict(docs), dict(items)
    for s in spans:
        assert leak.words(texts[s.doc_id], run)[s.start_word : s.start_word + s.n_words] == leak.words(asked[s.item_id], run)[s.item_word : s.item_word + s.n_words]
    assert leak.leaked_spans(a.limit(0), b).count() == 0 and leak.leaked_spans(a, b.limit(0)).count() == 0


TEXTS = {
    "en": "The farmer counts the bricks inside the garden and brings more of them before the winter. How many remain after that? Removing the rest we get the new total. This is the final answer, so it stays there with all of the others. We start from what is known and go on until nothing is left. Once they are sold, the baker keeps what was not used.",
    "de": "Der Bauer zählt die Ziegel im Garten und bringt vor dem Winter noch weitere dazu. Wie viele bleiben danach übrig? Daraus folgt die neue Summe. Die Antwort ist also das, was am Ende zusammen noch da ist. Wir beginnen mit dem, was bekannt ist, und zählen weiter, bis nichts mehr übrig ist.",
    "fr": "Le fermier compte les briques dans le jardin et en apporte encore avant l'hiver. Combien en reste-t-il après cela ? On obtient ainsi le nouveau total. La réponse est donc ce qui reste à la fin avec tous les autres. On commence par ce qui est connu et on ajoute ce qui arrive.",
    "es": "El granjero cuenta los ladrillos en el jardín y trae más antes del invierno. ¿Cuántos quedan después de eso? Por lo tanto tenemos el nuevo total. La respuesta es lo que queda al final con todos los demás. Empezamos con lo que se sabe y sumamos lo que llega.",
}
PROFILES = languages.profiles_from({k: languages.gram_counts([t] * 3) for k, t in TEXTS.items()})
Q = "Abrask counts 219 dusty bricks inside the shaded garden. Mice spoil 120 of them after closing time. How many bricks remain with Abrask?"
COT = "Removing the bricks 219 - 120 = <<219-120=99>>99 bricks."


@pytest.mark.parametrize(
    "cot, answer, found",
    [
        (COT, "99", None), (None, "99", None), ("", "99 bricks", None), (COT, "The answer is 98.", None), (COT.rstrip("."), "\\boxed{99}", None),
        (COT, None, "empty_answer"), (COT, " ​", "empty_answer"), (COT, "N/A", "empty_answer"), (COT, "\\boxed{}", "empty_answer"), (COT, "<answer></answer>", "empty_answer"), (COT, "Answer:", "empty_answer"), (COT, "'...'", "empty_answer"),
        (None, "I'm sorry, but I can't help with that.", "refusal"), (None, "Diese Frage darf ich nicht beantworten.", "refusal"), (None, "我不能处理这样的请求。", "refusal"),
        (None, "我不能回答", "refusal"), (None, "我不太方便解答这道题。", "refusal"), (None, "I'm sorry, but I cannot help with question 3.", "refusal"), (None, "To be honest, no answer can be offered from my side.", "refusal"), (None, "Je préfère ne pas résoudre l'exercice 12.", "refusal"), (None, "No me es posible responder a esto.", "refusal"),
        (None, "There is nothing left in the barn.", None), (None, "The baker cannot sell the rest.", None),
        (COT, "I'm sorry for the detour, but the result stays 99 bricks.", None), (COT, "Unable to find a shorter way, we simply count and arrive at 99 bricks.", None),
        (None, Q, "copied_question"), (None, "You asked: " + Q.upper(), "copied_question"), (None, "How many bricks remain with Abrask?", "copied_question"), (None, "Mice spoill 120 of them after closing time.", "copied_question"),
        ("Daraus folgt 219 - 120 = 99 Ziegel.\nDie Antwort ist 99.", "99", "other_language"), ("Removing them 219 - 120 = 99.\nВсего получается 99.", "99", "other_language"),
        ("Removing the bricks 219 - 120 = <<219-1", "99", "truncated_answer"), ("Removing the bricks 219 -", "99", "truncated_answer"), (COT + "\nAfter that lo", "99", "truncated_answer"), ("Without them: $219 - 120 = 9", "99", "truncated_answer"),
        ("219 - 120 = 99\n9", "9", "truncated_answer"), (COT, "\\boxed{99", "truncated_answer"), (COT, "99 bri", "truncated_answer"), (COT, "99 Bricks", None), (COT, "99 florins", None), (COT, "<answer>99", "truncated_answer"), (COT, "So in the end Abrask is left with", "truncated_answer"), ("219 - 100 = 11", "119", "truncated_answer"),
        (COT + "\nRefusing to round keeps this exact.", "99", None), ("1) start: 219\n2) 219 - 120 = 99", "99", None),
    ],
)
def test_defects(cot, answer, found):
    assert defects.defect(Q, cot, answer, PROFILES) == found


def test_shared_language_is_fine():
    q = "In der Scheune liegen 80 Hefte. Danach bringt Kavisk noch 3 dazu. Wie viele Hefte sind es am Ende?"
    assert defects.defect(q, "Daraus folgt 80 + 3 = 83 Hefte.", "Zusammen sind es 83.", PROFILES) is None
    assert defects.defect(q, "Removing nothing, the new total of the notebooks is 80 + 3 = 83.\nThis is the final answer.", "83", PROFILES) == "other_language"
    assert defects.defect(q, "Removing nothing, the new total is 80 + 3 = 83.", "83") is None  # without profiles only scripts are told apart
    assert defects.defect(None, None, None) == "empty_answer" and defects.defect(None, "1 + 1 = 2", "2") is None


@pytest.mark.parametrize("text, open_", [("a (b [c", ["(", "["]), ("1) x", []), ("```py\nx = (", ["```"]), ("$x$ and $y", ["$"]), ("costs $5 now", []), ("<b>x</b>", []), ("<b>x", ["<b"]), ("«a", ["«"]), ("<<1+1=2>>2", []), ("\\begin{a} x", ["\\a"])])
def test_pushdown(text, open_):
    assert defects.left_open(text) == open_


@given(st.lists(st.integers(0, 2), max_size=14), st.lists(st.integers(0, 2), max_size=14))
def test_tiles_do_not_overlap(a, b):
    tiles = defects.tile(list(map(str, a)), list(map(str, b)), 3)
    used_a = [i + k for i, _, n in tiles for k in range(n)]
    used_b = [j + k for _, j, n in tiles for k in range(n)]
    assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
    assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in tiles)
    assert [n for *_, n in tiles] == sorted((n for *_, n in tiles), reverse=True)


def test_profiles_are_fitted_on_a_bounded_sample(spark):
    rows = [(k, t) for k, t in TEXTS.items() for _ in range(5)] + [(None, "nothing"), ("en", None), ("", "x"), (" EN ", TEXTS["en"])]
    p = languages.fit_profiles(spark.createDataFrame(rows, "lang string, text string"), per_language=3)
    assert p.languages == ("de", "en", "es", "fr") and p.table.keys() == PROFILES.table.keys()
    best = lambda t: p.languages[p.of(languages.WORD.findall(t.lower())).sum(axis=0).argmax()]
    assert [best(t) for t in ("Also bleiben noch die Ziegel übrig.", "So the rest of them is there.", "Entonces quedan los ladrillos.", "Donc il reste les briques.")] == ["de", "en", "es", "fr"]
    assert languages.fit_profiles(spark.createDataFrame([], "lang string, text string")).languages == ()


def _tiles_by_definition(a, b, least):
    """Longest common free stretch first, earliest places first."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    for size in range(min(len(a), len(b)), least - 1, -1):
        for i in range(len(a) - size + 1):
            for j in range(len(b) - size + 1):
                if a[i : i + size] == b[j : j + size] and all(free_a[i : i + size]) and all(free_b[j : j + size]):
                    out.append((i, j, size))
                    free_a[i : i + size] = free_b[j : j + size] = [False] * size
    return out


@given(st.lists(st.integers(0, 2), max_size=24), st.lists(st.integers(0, 2), max_size=24))
@settings(max_examples=200, deadline=None)
def test_tiles_are_those_of_the_definition(a, b):
    a, b = list(map(str, a)), list(map(str, b))
    assert defects.tile(a, b, 2) == _tiles_by_definition(a, b, 2)


def test_long_repetitive_texts_are_tiled_quickly():
    started = time.perf_counter()
    assert defects.tile(["x"] * 10_000, ["x"] * 10_000) == [(0, 0, 10_000)]
    assert defects.is_copy("ab cd ef gh. " * 4000, "ab cd ef gh. " * 4000)
    assert not defects.is_copy("ab cd ef gh. " * 4000, "ab cd xx " * 4000)
    assert time.perf_counter() - started < 5


def test_defective_table(spark):
    rows = [(1, Q, COT, "99", 5), (2, Q, COT, None, 5), (2, Q, COT, None, 5), (3, Q, "x " * 100_000, "99", 5), (4, None, None, "", 5)]
    df = spark.createDataFrame(rows, "id long, question string, cot string, answer string, defect int")
    assert sorted((r.id, r.defect) for r in defects.defective_pairs(df).collect()) == [(2, "empty_answer"), (2, "empty_answer"), (3, "truncated_answer"), (4, "empty_answer")]
    assert defects.defective_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("capital", ["\uff38", "\u0425", "\u03a7"])
def test_capital_look_alikes_that_no_item_has(capital):
    """Full-width, Cyrillic and Greek capitals read as the items' small letter."""
    item = "six boxes of wax stood behind the old mill while the fox went around the northern brewery"
    searched = leak.prepare([(1, item)], 15)
    text = item.upper().replace("X", capital)
    assert leak.words(text, lookalike.Rewriter(searched.pairs)) == item.split()
