"""Equivalence, rewards and text shaping (E1 to E32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import equivalence as E
from ..functions import geometry as G
from ..functions import rewards as R
from ..functions import text as X
from ..operators import documents as D
from .answers import FLOAT, LAST_NUMBER, STRIP
from .base import RESPONSES, query, responses, table, turn, turn_sql


@query("SELECT run_id, record_id, prediction = ground_truth AS same, prediction = ground_truth AND prediction <> 'inf'::DOUBLE AS same_strict, count(*) AS n FROM sample_results GROUP BY ALL")
def e01_float_equal(spark, d):
    rows = table(spark, d, "sample_results")
    same, strict = E.same_number("prediction", "ground_truth"), E.same_number("prediction", "ground_truth", strict=True)
    return rows.groupBy("run_id", "record_id", same.alias("same"), strict.alias("same_strict")).agg(F.count("*").alias("n"))


_PURE = lambda x: rf"lower(replace(regexp_replace(regexp_replace({x}, '^[#\n ]+|[#\n ]+$', '', 'g'), '\.+$', ''), ',', ''))"


def _pure(test: str) -> str:
    return f"""WITH t AS (SELECT problem_id, run_name, {_PURE('adv_answer')} AS a, {_PURE('ground_truth')} AS b FROM search_results),
 n AS (SELECT *, {FLOAT('a')} AS x, {FLOAT('b')} AS y FROM t)
 SELECT problem_id, run_name, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {test} ELSE a = b END AS same FROM n"""


@query(_pure("abs(x - y) < 1e-6"))
def e02_pure_close(spark, d):
    return table(spark, d, "search_results").select("problem_id", "run_name", E.same_text("adv_answer", "ground_truth", "pure_close").alias("same"))


@query(_pure("x = y"))
def e02b_pure_exact(spark, d):
    return table(spark, d, "search_results").select("problem_id", "run_name", E.same_text("adv_answer", "ground_truth", "pure_exact").alias("same"))


@query(
    f"""WITH t AS (SELECT problem_id, run_name, trim(adv_answer) AS a, trim(ground_truth) AS b FROM search_results), n AS (SELECT *, {FLOAT('a')} AS x, {FLOAT('b')} AS y FROM t)
 SELECT problem_id, run_name, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) < 1e-9 ELSE a = b END AS same FROM n"""
)
def e03_trim_close(spark, d):
    return table(spark, d, "search_results").select("problem_id", "run_name", E.same_text("adv_answer", "ground_truth", "trim_close").alias("same"))


@query(
    f"""SELECT problem_id, run_name, trim(clean_answer) = trim(ground_truth) OR coalesce({FLOAT('clean_answer')} = {FLOAT('ground_truth')}, false) AS same FROM search_results"""
)
def e04_trim_exact(spark, d):
    return table(spark, d, "search_results").select("problem_id", "run_name", E.same_text("clean_answer", "ground_truth", "trim_exact").alias("same"))


@query(
    rf"""SELECT problem_id, run_name, coalesce(regexp_matches(ground_truth, '^-*\d+\.?\d*$') AND (clean_answer = ground_truth OR abs({FLOAT('clean_answer')} - {FLOAT('ground_truth')}) < 0.01), false) AS same FROM search_results"""
)
def e05_near_numeric_gold(spark, d):
    return table(spark, d, "search_results").select("problem_id", "run_name", E.same_text("clean_answer", "ground_truth", "near_numeric_gold").alias("same"))


@query(
    """SELECT run_id, record_id, CASE WHEN ground_truth = 0 THEN prediction = ground_truth ELSE prediction = ground_truth OR
  (NOT isinf(prediction) AND NOT isinf(ground_truth) AND abs(prediction - ground_truth) < 0.01) END AS same, count(*) AS n FROM sample_results GROUP BY ALL"""
)
def e05b_near_or_zero(spark, d):
    same = E.same_number("prediction", "ground_truth", "near_or_zero")
    return table(spark, d, "sample_results").groupBy("run_id", "record_id", same.alias("same")).agg(F.count("*").alias("n"))


def _numeric_pairs(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 100).cast("string").alias("a"), F.col("l_linenumber").cast("string").alias("b"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    """SELECT l_quantity AS q, l_linenumber AS k, count(*) AS n,
 bool_and(abs(l_quantity - k100) <= 1e-4 * greatest(l_quantity, k100) OR abs(l_quantity - l_linenumber) <= 1e-4 * greatest(l_quantity, l_linenumber) OR abs(l_quantity - k1) <= 1e-4 * greatest(l_quantity, k1)) AS same
 FROM (SELECT l_quantity, l_linenumber, l_linenumber * 100.0 AS k100, l_linenumber / 100.0 AS k1 FROM lineitem) GROUP BY ALL"""
)
def e06_math_equal(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"))
    return rows.withColumn("same", E.equal_math(F.col("q").cast("string"), F.col("k").cast("string")))


# Whole quantities and line numbers, each pair once with its rows.
_PAIRS = "(SELECT l_quantity::INT AS q, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY ALL)"


def _pairs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"))


@query(f"SELECT q, k, n, q = k AS expands, q = k AS sum, q = 7 * k AS ratio FROM {_PAIRS}")
def e07_symbolic_equal(spark, d):
    square, expanded = F.expr("'(x+' || q || ')^2'"), F.expr("'x^2 + 2*' || k || '*x + ' || k || '^2'")
    # Long sums of equal terms, and a fraction against an implied product.
    terms, product = F.expr("array_join(array_repeat('y', q), '+')"), F.expr("k || 'y'")
    ratio, times = F.expr("chr(92) || 'frac{' || q || 'z}{7}'"), F.expr("k || 'z'")
    return _pairs(spark, d).select("q", "k", "n", E.equal_symbolic(square, expanded).alias("expands"), E.equal_symbolic(terms, product).alias("sum"), E.equal_symbolic(ratio, times).alias("ratio"))


@query(f"SELECT q, k, n, q = k AND (q + n) % 3 <> 0 AS only_number FROM {_PAIRS}")
def e08_latex_number(spark, d):
    said = F.expr("'The sum is $' || q || '.0$' || if((q + n) % 3 = 0, ' and 1999 more', ' in all')")
    return _pairs(spark, d).select("q", "k", "n", E.equal_latex_number(said, F.col("k").cast("string")).alias("only_number"))


@query(
    f"""SELECT q, k, n, CASE (q + k) % 6 WHEN 0 THEN chr(92) || 'frac{{' || q || '}}{{' || k || '}}' WHEN 1 THEN q || '' WHEN 2 THEN q || '.5' WHEN 3 THEN chr(92) || 'frac{{' || q || '}}{{' || k || '}}'
 WHEN 4 THEN chr(92) || 'sqrt{{' || q || '}}' ELSE k || ',' || q END AS form FROM {_PAIRS}"""
)
def e09_latex_form(spark, d):
    text = F.expr(
        """CASE (q + k) % 6 WHEN 0 THEN q || '/' || k WHEN 1 THEN '$' || q || '.0$ sq m.' WHEN 2 THEN 'x = ' || q || '.5 ' || chr(92) || 'text{ cm}'
 WHEN 3 THEN chr(92) || 'left' || chr(92) || 'dfrac{' || q || '}{' || k || '}' WHEN 4 THEN chr(92) || 'sqrt' || q || '^' || chr(92) || 'circ' ELSE k || ', ' || q || chr(92) || '% profit' END"""
    )
    return _pairs(spark, d).select("q", "k", "n", E.latex_form(text).alias("form"))


@query(f"SELECT q, k, n, q = k AND q % 2 = 0 AS latex, q = k AS any FROM {_PAIRS}")
def e10_any_equal(spark, d):
    a = F.expr("CASE WHEN q % 2 = 0 THEN q || ' apple' ELSE q || '%' END")
    b = F.expr("CASE WHEN q % 2 = 0 THEN '$' || k || '$' ELSE CAST(k / 100.0 AS DECIMAL(12, 2)) || '' END")
    return _pairs(spark, d).select("q", "k", "n", E.equal_latex(a, b).alias("latex"), E.equal_any(a, b).alias("any"))


@query(
    rf"""SELECT record_id, coalesce({FLOAT("replace(t, ',', '')")}, {FLOAT(r"nullif(regexp_extract(replace(t, ',', ''), '^(.*?)\\?%$', 1), '')")} / 100) AS value FROM
 (SELECT record_id, CASE record_id % 4 WHEN 0 THEN answer WHEN 1 THEN answer || '%' WHEN 2 THEN answer || chr(92) || '%' ELSE 'n/a' END AS t FROM cot_records)"""
)
def e11_parsed_digits(spark, d):
    text = F.expr("CASE record_id % 4 WHEN 0 THEN answer WHEN 1 THEN answer || '%' WHEN 2 THEN answer || chr(92) || '%' ELSE 'n/a' END")
    return table(spark, d, "cot_records").select("record_id", E.parsed_digits(text).alias("value"))


@query(f"SELECT q, k, n, q = k AS same FROM {_PAIRS}")
def e12_check_with_retries(spark, d):
    said = F.expr("CASE n % 3 WHEN 0 THEN 'so ' || chr(92) || 'boxed{' || q || '}' WHEN 1 THEN 'value: ' || q ELSE 'for 1999 the sum is ' || q END")
    return _pairs(spark, d).select("q", "k", "n", E.equal_with_retries(said, F.col("k").cast("string")).alias("same"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(0.9 * (l_returnflag = 'R')::INT + 0.1 * (l_linestatus = 'F')::INT
 - 0.001 * CASE WHEN l_quantity > 20 + l_linenumber AND l_linenumber <> 3 THEN l_quantity - (20 + l_linenumber) ELSE 0 END, 6) AS reward FROM lineitem"""
)
def e13_mixed_reward(spark, d):
    rows = table(spark, d, "lineitem")
    reference = F.when(F.col("l_linenumber") == 3, 0).otherwise(F.lit(20) + F.col("l_linenumber"))
    reward = R.mixed_reward((F.col("l_returnflag") == "R").cast("int"), (F.col("l_linestatus") == "F").cast("int"), "l_quantity", reference)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(reward, 6).alias("reward"))


@query(
    rf"""WITH {RESPONSES}, t AS (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN '<|latent_start|>' || text || '<|latent_end|> <answer>A</answer>' WHEN record_id % 3 = 1 THEN '<think>' || text || '</think><answer>B</answer>' ELSE text END AS t FROM responses)
 SELECT record_id, regexp_matches(t, '(?s)\\boxed\{{.*?\}}')::DOUBLE AS boxed, regexp_matches(t, '(?s)^<think>.*?</think>\s*<answer>.*?</answer>$')::DOUBLE AS think_then_answer,
 regexp_matches(t, '^<\|\w+_start\|>.*?<\|\w+_end\|>\s*<answer>.*?</answer>$')::DOUBLE AS one_line FROM t"""
)
def e14_format_reward(spark, d):
    text = F.expr("CASE WHEN record_id % 3 = 0 THEN '<|latent_start|>' || text || '<|latent_end|> <answer>A</answer>' WHEN record_id % 3 = 1 THEN '<think>' || text || '</think><answer>B</answer>' ELSE text END")
    rows = responses(spark, d).select("record_id", text.alias("t"))
    return rows.select("record_id", R.format_reward("t", "boxed").alias("boxed"), R.format_reward("t", "think_then_answer").alias("think_then_answer"), R.format_reward("t", "tags_one_line").alias("one_line"))


@query(
    rf"""WITH {RESPONSES} SELECT record_id, ({STRIP("coalesce(nullif(regexp_extract(text, '<answer>(.*?)</answer>', 1), ''), text)")} = letter || '. sure')::INT::DOUBLE AS accuracy FROM responses"""
)
def e15_tag_accuracy(spark, d):
    rows = responses(spark, d)
    return rows.select("record_id", R.tag_accuracy("text", F.concat(F.lit(" <answer> "), "letter", F.lit(". sure</answer>"))).alias("accuracy"))


@query("SELECT event_id, round((event_type = 'purchase')::INT / (1 + user_id % 7), 9) AS reward FROM events")
def e16_reward_per_length(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", F.round(R.per_length((F.col("event_type") == "purchase").cast("int"), 1 + F.col("user_id") % 7), 9).alias("reward"))


_REPLY = "CASE event_id % 6 WHEN 0 THEN ' Yes.' WHEN 1 THEN 'no' WHEN 2 THEN 'yes, I know' WHEN 3 THEN 'Score: -1' WHEN 4 THEN '1' ELSE 'not sure 0' END"


@query(
    rf"""SELECT event_id, (regexp_matches(t, '\byes\b') AND NOT regexp_matches(t, '\bno\b'))::DOUBLE AS words, (contains(t, 'yes') AND NOT contains(t, 'no'))::DOUBLE AS parity,
 CASE WHEN contains(t, '1') AND NOT contains(t, '0') AND NOT contains(t, '-1') THEN 1.0 WHEN contains(t, '0') AND NOT contains(t, '1') THEN 0.0
  WHEN contains(t, '-1') AND NOT contains(t, '0') THEN -1.0 ELSE 0.0 END::DOUBLE AS three FROM (SELECT event_id, lower(trim({_REPLY})) AS t FROM events)"""
)
def e17_judge_reply(spark, d):
    r = F.expr(_REPLY)
    return table(spark, d, "events").select("event_id", R.judge_yes_no(r).alias("words"), R.judge_yes_no(r, parity=True).alias("parity"), R.judge_three_way(r).alias("three"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def e18_l2_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(G.l2_norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT record_id, 'see <latent>' || ' then ' || '<latent>' || answer AS text FROM cot_records WHERE answer IS NOT NULL")
def e19_replace_blocks(spark, d):
    text = F.expr("'see <abs_vis_token>a' || chr(10) || 'b</abs_vis_token>' || ' then ' || '<abs_vis_token></abs_vis_token>' || answer")
    return table(spark, d, "cot_records").where("answer is not null").select("record_id", X.replace_blocks(text).alias("text"))


@query(rf"WITH {RESPONSES} SELECT record_id, regexp_replace(text, '\s*(<|>|/)\s*', '\1', 'g') AS text FROM responses")
def e20_tight_tags(spark, d):
    return responses(spark, d).select("record_id", R.tight_tags("text").alias("text"))


@query("SELECT event_id, 'a' || repeat('<p>', cast(event_id % 4 AS INT)) || 'b' || repeat('<p>', cast(user_id % 3 AS INT)) || 'c' AS text FROM events")
def e21_expand_placeholder(spark, d):
    counts = F.array((F.col("event_id") % 4).cast("int"), (F.col("user_id") % 3).cast("int"))
    return table(spark, d, "events").select("event_id", X.expand_placeholder(F.lit("a<image>b<image>c"), "<image>", counts, "<p>").alias("text"))


_ROLE = "CASE event_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'gpt' ELSE 'system' END"


@query(f"SELECT event_id, CASE {_ROLE} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE {_ROLE} END AS role FROM events")
def e22_roles(spark, d):
    return table(spark, d, "events").select("event_id", X.role(F.expr(_ROLE)).alias("role"))


@query(
    """SELECT item_id, 0 AS pos, 'text' AS type, 'Look: ' AS text FROM eval_items UNION ALL SELECT item_id, 1, 'image', NULL FROM eval_items
 UNION ALL SELECT item_id, 2, 'text', ' ' || question || ' (' || benchmark || ')' FROM eval_items"""
)
def e23_template_parts(spark, d):
    text = X.render("Look: <image> {question} ({benchmark})", question="question", benchmark="benchmark")
    rows = table(spark, d, "eval_items").select("item_id", F.posexplode(X.content_parts(text)).alias("pos", "p"))
    return rows.select("item_id", "pos", "p.type", "p.text")


@query("SELECT item_id, 4 AS n_options, true AS kept, true AS found FROM eval_items")
def e24_shuffled_options(spark, d):
    rows = table(spark, d, "eval_items").withColumn("options", F.array(F.col("answer"), F.lit("x1"), F.lit("x2"), F.lit("x3")))
    rows = rows.withColumn("mixed", X.shuffled_options("options", "item_id")).withColumn("letter", X.option_letter("mixed", "answer"))
    kept = F.size(F.array_except("options", "mixed")) == 0
    return rows.select("item_id", F.size("mixed").alias("n_options"), kept.alias("kept"), F.element_at("mixed", F.ascii("letter") - 64).eqNullSafe(F.col("answer")).alias("found"))


@query(r"SELECT doc_id, regexp_replace('see http://a.b/' || doc_id || ' and ' || text, 'http\S+', '', 'g') AS text FROM documents")
def e25_without_urls(spark, d):
    return table(spark, d, "documents").select("doc_id", X.without_urls(F.expr("'see http://a.b/' || doc_id || ' and ' || text")).alias("text"))


@query(
    """SELECT record_id, trim(dataset) || '. ' || trim(question) AS question, string_split(cot, chr(10))[1] AS first_step FROM cot_records WHERE cot IS NOT NULL AND question IS NOT NULL"""
)
def e26_body_and_question(spark, d):
    rows = table(spark, d, "cot_records").where("cot is not null and question is not null")
    return rows.select("record_id", X.body_and_question(F.concat(F.lit(" "), "dataset"), "question").alias("question"), F.try_element_at(F.split("cot", "\n"), F.lit(1)).alias("first_step"))


@query(
    r"""SELECT doc_id, length(text)::INT AS n_chars, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''))::INT AS n_words, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines FROM documents"""
)
def e27_text_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.char_count("text").alias("n_chars"), X.word_count("text").alias("n_words"), X.line_count("text").alias("n_lines"))


_BOX = "SELECT p_partkey, p_size AS w0, p_partkey % 37 AS x, p_partkey % 23 AS y, 1 + p_size % 30 AS w, 1 + p_partkey % 19 AS h FROM part"
_CELLS = f"""WITH b AS ({_BOX}), n AS (SELECT p_partkey, least(1.0, x / 64.0) AS x1, least(1.0, y / 48.0) AS y1, least(1.0, (x + w) / 64.0) AS x2, least(1.0, (y + h) / 48.0) AS y2 FROM b),
 c AS (SELECT p_partkey, least(floor(x1 * 8), 7)::INT AS c1, least(floor(y1 * 6), 5)::INT AS r1, ceil(x2 * 8)::INT AS cx, ceil(y2 * 6)::INT AS rx FROM n),
 g AS (SELECT p_partkey, c1, r1, least(greatest(cx, c1 + 1), 8) AS c2, least(greatest(rx, r1 + 1), 6) AS r2 FROM c)"""


def _boxes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr("array(p_partkey % 37, p_partkey % 23, 1 + p_size % 30, 1 + p_partkey % 19)").alias("box"))


@query(f"{_CELLS} SELECT p_partkey, array_to_string(flatten(list_transform(range(r1, r2), lambda r: list_transform(range(c1, c2), lambda c: r * 8 + c))), ',') AS cells FROM g")
def e28_box_cells(spark, d):
    cells = G.box_cells(G.to_corners("box"), F.lit(64.0), F.lit(48.0), 8, 6)
    return _boxes(spark, d).select("p_partkey", F.array_join(cells, ",").alias("cells"))


@query(f"{_CELLS} SELECT p_partkey, round(c1 / 8.0, 6)::DOUBLE AS x1, round(r1 / 6.0, 6)::DOUBLE AS y1, round(c2 / 8.0, 6)::DOUBLE AS x2, round(r2 / 6.0, 6)::DOUBLE AS y2 FROM g")
def e28b_cells_box(spark, d):
    cells = G.box_cells(G.to_corners("box"), F.lit(64.0), F.lit(48.0), 8, 6)
    b = _boxes(spark, d).select("p_partkey", G.cells_box(cells, 8, 6).alias("b"))
    return b.select("p_partkey", *(F.round(F.col("b")[i], 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


@query(
    """WITH s AS (SELECT p_partkey, (p_partkey % 1900 + 1)::DOUBLE AS w, (p_size * 40 + 1)::DOUBLE AS h FROM part),
 b AS (SELECT *, greatest(28, round(w / 28)::INT * 28) AS bw, greatest(28, round(h / 28)::INT * 28) AS bh FROM s)
 SELECT p_partkey, CASE WHEN bw * bh > 1003520 THEN greatest(28, floor(w / sqrt(w * h / 1003520) / 28)::INT * 28) WHEN bw * bh < 3136 THEN ceil(w * sqrt(3136.0::DOUBLE / (w * h)) / 28)::INT * 28 ELSE bw END AS width,
 CASE WHEN bw * bh > 1003520 THEN greatest(28, floor(h / sqrt(w * h / 1003520) / 28)::INT * 28) WHEN bw * bh < 3136 THEN ceil(h * sqrt(3136.0::DOUBLE / (w * h)) / 28)::INT * 28 ELSE bh END AS height FROM b"""
)
def e29_fit_pixels(spark, d):
    size = G.fit_pixels(F.col("p_partkey") % 1900 + 1, F.col("p_size") * 40 + 1)
    return table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT record_id, 'a ' || answer || ' b' AS text, 2 AS start, (2 + length(answer))::INT AS stop FROM cot_records WHERE answer IS NOT NULL AND answer <> '' AND answer NOT LIKE '%<%'")
def e30_strip_observations(spark, d):
    rows = table(spark, d, "cot_records").where("answer is not null and answer not like '%<%'")
    text = F.expr("'a <observation><observation>' || substr(answer, 1, 1) || '</observation>' || substr(answer, 2) || '</observation> b'")
    out = rows.select("record_id", D.strip_tags(text, "observation").alias("s")).select("record_id", "s.text", F.explode_outer("s.spans").alias("span"))
    return out.select("record_id", "text", F.col("span.start").alias("start"), F.col("span.stop").alias("stop")).where("start is not null")


@query("SELECT event_id, value AS \"train/value\", user_id AS \"train/user/id\" FROM events")
def e31_flatten_nested(spark, d):
    nested = table(spark, d, "events").select("event_id", F.struct("value", F.struct(F.col("user_id").alias("id")).alias("user")).alias("train"))
    return D.flatten_columns(D.nest_columns(D.flatten_columns(nested)))


@query(
    f"""SELECT vec_id, list_transform(embedding, lambda x, i: round(greatest(0, least(1, (x::DOUBLE + 1) / 2 + ({turn_sql("vec_id || '|' || (i - 1)")} * 2 - 1) * (8 / 255))) / (1 / 255)) / 255) AS noisy FROM embeddings"""
)
def e32_noise(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("v"))
    place = lambda i: turn(F.concat("vec_id", F.lit("|"), i))
    return rows.select("vec_id", F.transform(G.noisy("v", 8 / 255, "vec_id", turn=place), lambda x: F.round(x * 255) / 255).alias("noisy"))
