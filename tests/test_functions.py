"""Rules on literal cases, quirks included."""

import doctest
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import answers as A
from tracewright.functions import equivalence as E
from tracewright.functions import latex as L
from tracewright.functions import rewards as R
from tracewright.functions import sequences as S
from tracewright.functions import text as X
from tracewright.operators import documents as D
from tracewright.operators import windows as W


def one(spark, rows, schema, *columns):
    got = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in got]


@pytest.mark.parametrize("module", [A, L, D])
def test_examples(module):
    failed, run = doctest.testmod(module)
    assert run and not failed


def test_last_number(spark):
    texts = ["1,234", "abc", "", "-3.5", "12.", "a 1 b 2", None, "1d"]
    got = one(spark, [(t,) for t in texts], "t string", A.number("t"))
    assert got == [1234.0, math.inf, math.inf, -3.5, 12.0, 2.0, None, 1.0]


def test_boxed_then_number(spark):
    texts = [r"\boxed{7} or 8", r"\boxed{x} 9", r"\boxed{1} \boxed{2}", "1,234"]
    assert one(spark, [(t,) for t in texts], "t string", A.number("t", "boxed_then_number")) == [7.0, 9.0, 2.0, 234.0]
    assert one(spark, [("1,234",)], "t string", A.number("t", "boxed_then_number_commas")) == [1234.0]


def test_other_number_profiles(spark):
    assert one(spark, [("#### 1,002.",), ("n/a",), ("3 of 4",)], "t string", A.number("t", "whole_then_first")) == [1002.0, math.inf, 3.0]
    assert one(spark, [("5 #### 6",), ("5 and 7",), ("#### .-.",)], "t string", A.number("t", "hash_then_number")) == [6.0, 7.0, math.inf]
    with pytest.raises(ValueError):
        A.number(F.lit("1"), "nothing")


def test_typed_answer(spark):
    rows = [("The answer is: B", "choice"), ("The answer is: Z", "choice"), ("so True", "truth"), ("hm", "truth"), ("hm", "number"), ("4,5", "choice")]
    assert one(spark, rows, "t string, k string", A.typed_answer("t", "k")) == ["B", "C", "True", None, "inf", "45"]


def test_strict_truth_is_an_error(spark):
    with pytest.raises(Exception, match="neither True nor False"):
        one(spark, [("hm", "truth")], "t string, k string", A.typed_answer("t", "k", strict=True))


def test_letters(spark):
    text = "<think>x</think> <answer> B. yes </answer>"
    assert one(spark, [(text,), ("none",)], "t string", A.letter("t", "tag")) == ["B", None]
    assert one(spark, [("C",), ("(A) or (D)",), ("therefore the answer (B)",), ("so B",), ("",)], "t string", A.letter("t", "box_parens_phrases")) == ["C", "D", "B", "B", ""]
    assert one(spark, [("<answer>b x</answer>",), ("first (C)",), ("x\ndog",)], "t string", A.letter("t", "box_tag_parens_line")) == ["B", "C", "D"]


def test_boxes_balance(spark):
    texts = [r"a \boxed{\frac{1}{2}} b", r"\boxed{1", r"\fbox{3}", "none", None]
    assert one(spark, [(t,) for t in texts], "t string", A.balanced_box("t")) == [r"\boxed{\frac{1}{2}}", None, r"\fbox{3}", None, None]


def test_after_is_quirk(spark):
    assert one(spark, [("it is 12",)], "t string", A.after_is("t"), A.after_is("t", parity=True)) == [(" 12", " 1")]


def test_thousands(spark):
    assert one(spark, [("Hello 1234324asdasd",), ("Hello 123",), ("1234",)], "t string", A.with_thousands("t")) == ["Hello 1,234,324asdasd", "Hello 123", "1,234"]


def test_infinity_quirk(spark):
    inf = math.inf
    rows = [(inf, inf), (1.0, 1.0), (1.0, inf)]
    assert one(spark, rows, "p double, g double", E.same_number("p", "g")) == [True, True, False]
    assert one(spark, rows, "p double, g double", E.same_number("p", "g", strict=True)) == [False, True, False]


@pytest.mark.parametrize(
    "a, b, same",
    [("50%", "0.5", True), ("(1, 2)", "(1,2.0)", True), ("[1,2]", "(1,2)", True), ("[1,2]", "(1,3)", False), ("x=5", "5", True), ("1/2", "0.5", True), ("2x+1", "1 + x*2", True),
     ("x+1", "x+2", False), (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{bmatrix}1&2.0\\3&4\end{bmatrix}", True), ("A.", "A", True), (None, "1", False), ("", "1", False)],
)
def test_math_equal(a, b, same):
    assert E.math_equal(a, b) is same


def test_latex_checks():
    assert E.same_latex(None, None) and not E.same_latex(None, "1")
    assert E.same_latex("12 apple.", "$12$")
    assert E.latex_number_check("The sum is 12 apples", "12") and not E.latex_number_check("3 and 12", "12")
    assert E.check_with_retries(r"so \boxed{12}", "12") and E.check_with_retries("value: 12", "12") and not E.check_with_retries("13", "12")
    assert E.symbolic_equal("(x+1)^2", "x^2+2x+1") and not E.symbolic_equal("x", "y")


@pytest.mark.parametrize(
    "a, b, same",
    [("+".join(["x"] * 120), "120*x", True), ("+".join(["x"] * 500), "499x", False), ("(" * 400 + "x" + ")" * 400, "x", True), (r"\frac{\frac{1}{2}}{3}x", "x/6", True), (r"\sqrt{x}\sqrt{x}", "x", True),
     (r"\frac{1}{3}", "0.33333", True), ("-x^2", "-(x^2)", True), ("x^2^3", "x^8", True), ("2^{-3}", "1/8", True), ("x+", "x", False), ("1/(x-x)", "2", False), ("sin(x)^2+cos(x)^2", "1", True), (r"\int x", "x", False)],
)
def test_expressions_of_any_length(a, b, same):
    assert E.symbolic_equal(a, b) is same


@pytest.mark.parametrize(
    "text, form",
    [("5 sq . m", "5"), ("12 lb", "12"), ("7 deg", "7"), ("3 monkey", "3"), ("apple", "apple"), ("2x", "2x"), (r"(-\infty, \infty)", r"\mathbb{R}"), (r"\begin{array}{cc}1&2\\3&4\end{array}", r"\begin{pmatrix}1&2\\3&4\end{pmatrix}"),
     (r"x\in[1,2]", "[1,2]"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac123", r"\frac{1}{2}3"), ("two hundred and forty-one", "241"), ("thousand hands", "thousandhands"), ("3.50", "3.50"), ("", ""), ("%", "")],
)
def test_latex_forms(text, form):
    assert E.normal_latex(text) == form


def test_math_equal_columns(spark):
    """What is settled without Python is what the rule says."""
    texts = ["5", "5.0", "500", "0.05", "5%", "a", "A", "A.", "", " 5 ", None, "(1,2)", "x=5", "1e3", "1,000"]
    rows = [(a, b) for a in texts for b in texts]
    assert one(spark, rows, "a string, b string", E.equal_math("a", "b")) == [E.math_equal(a, b) for a, b in rows]
    assert one(spark, rows, "a string, b string", E.equal_latex("a", "b")) == [E.same_latex(a, b) for a, b in rows]
    assert one(spark, rows, "a string, b string", E.equal_any("a", "b")) == [E.any_equal(a, b) for a, b in rows]


def test_judges(spark):
    rows = [("Yes",), ("yes, I know",), ("no",), ("",)]
    assert one(spark, rows, "t string", R.judge_yes_no("t")) == [1.0, 1.0, 0.0, 0.0]
    assert one(spark, rows, "t string", R.judge_yes_no("t", parity=True)) == [1.0, 0.0, 0.0, 0.0]


def test_length_penalty_needs_a_reference(spark):
    reward = R.mixed_reward("a", "f", "n", "r", weight=0.0, penalty=0.1)
    assert one(spark, [(1.0, 0.0, 12, 10), (1.0, 0.0, 12, 0)], "a double, f double, n int, r int", reward) == [pytest.approx(0.8), 1.0]


def test_counts_of_empty_text(spark):
    assert one(spark, [("",), ("a\nb c",)], "t string", X.char_count("t"), X.word_count("t"), X.line_count("t")) == [(0, 0, 1), (5, 3, 2)]


def test_masks(spark):
    tokens = [0, 0, 2, 4, 3, 5, 1, 0, 0]
    assert one(spark, [(tokens,), ([2, 3],)], "x array<int>", W.mask_to_stop(F.col("x"), 1)) == [[1, 1, 1, 1, 1, 1, 1, 0, 0], [1, 1]]
    assert W.fill_from_right(np.array([0, 0, 2, 0, 5, 0.0])).tolist() == [2, 2, 2, 5, 5, 0]
    assert W.fill_from_right(np.array([])).tolist() == []


def test_padding_inverts(spark):
    x = F.col("x")
    assert one(spark, [([1, 2, 3],), ([],)], "x array<int>", S.pad(x, 5, 0), S.pad(x, 5, 0, "left"), S.pad(x, 2, 0)) == [
        ([1, 2, 3, 0, 0], [0, 0, 1, 2, 3], [1, 2]),
        ([0] * 5, [0] * 5, [0, 0]),
    ]
    with pytest.raises(Exception, match="longer than 2"):
        one(spark, [([1, 2, 3],)], "x array<int>", S.pad_or_cut(F.col("x"), 2, 0))


def test_find_and_labels(spark):
    x = F.col("x")
    rows = [([5, 1, 2, 7, 1, 2, 9],), ([3],), ([],)]
    assert one(spark, rows, "x array<int>", S.find(x, [1, 2])) == [1, -1, -1]
    assert one(spark, rows, "x array<int>", S.find_after(x, [5, 1], [1, 2])) == [[1, 4], [], []]
    assert one(spark, rows, "x array<int>", S.labels_after(x, [1, 2], [9])) == [[-100, -100, -100, 7, 1, 2, -100], [-100], []]


def test_spans_are_replaced(spark):
    rows = [([5, 1, 8, 8, 2, 6, 1, 2, 1],), ([2, 1],), ([],)]
    assert one(spark, rows, "x array<int>", S.replace_spans(F.col("x"), 1, 2, 0, 2)) == [[5, 1, 0, 0, 2, 6, 1, 0, 0, 2, 1], [2, 1], []]
    assert one(spark, rows, "x array<int>", F.size(S.matched_segments(F.col("x"), 1, 2))) == [2, 0, 0]


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=12), st.floats(0, 1), st.floats(0, 1))
def test_gae_against_definition(rewards, gamma, lam):
    r = np.array(rewards)
    v = r[::-1] / 2
    got, returns = W.gae(r, v, gamma, lam)
    nxt = np.append(v[1:], 0)
    delta = r + gamma * nxt - v
    want = [sum((gamma * lam) ** (k - t) * delta[k] for k in range(t, len(r))) for t in range(len(r))]
    assert np.allclose(got, want) and np.allclose(returns, got + v)


def test_discounted_carry_is_cut():
    assert W.discounted(np.array([1.0, 1, 1]), np.array([1, 0, 1]), 0.5).tolist() == [1.0, 1.5, 1.0]
