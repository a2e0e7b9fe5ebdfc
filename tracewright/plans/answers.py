"""Extraction of answers from text (F1 to F22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from .base import RESPONSES, query, responses, table

NUM = r"-?\d+\.?\d*"
GATE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
FLOAT = lambda x: f"CASE WHEN regexp_matches({x}, '{GATE}') THEN try_cast({x} AS DOUBLE) END"
LAST_NUMBER = lambda x: f"coalesce(try_cast(regexp_extract_all(replace({x}, ',', ''), '{NUM}')[-1] AS DOUBLE), 'inf'::DOUBLE)"
BOX = r"\\boxed\{([^}]+)\}"


@query(f"SELECT record_id, run_id, {LAST_NUMBER('model_output')} AS pred, count(*) AS n FROM sample_results WHERE model_output IS NOT NULL GROUP BY ALL")
def f01_last_number(spark, d):
    rows = table(spark, d, "sample_results").where("model_output is not null")
    return rows.groupBy("record_id", "run_id", A.number("model_output").alias("pred")).agg(F.count("*").alias("n"))


_BOX_LAST = rf"regexp_extract_all(answer, '{BOX}', 1)[-1]"


@query(
    f"""SELECT record_id, coalesce({FLOAT(_BOX_LAST)}, try_cast(regexp_extract_all(answer, '{NUM}')[-1] AS DOUBLE), 'inf'::DOUBLE) AS pred,
 coalesce({FLOAT(_BOX_LAST)}, {LAST_NUMBER('answer')}) AS pred_commas FROM cot_records WHERE answer IS NOT NULL"""
)
def f02_boxed_then_number(spark, d):
    rows = table(spark, d, "cot_records").where("answer is not null")
    return rows.select("record_id", A.number("answer", "boxed_then_number").alias("pred"), A.number("answer", "boxed_then_number_commas").alias("pred_commas"))


_KIND = "CASE record_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'truth' ELSE 'number' END"
_TYPED = "CASE WHEN record_id % 2 = 0 THEN 'The answer is: ' || substr('ABXDE', cast(1 + record_id % 5 as int), 1) WHEN record_id % 7 = 0 THEN 'That is False' WHEN record_id % 5 = 0 THEN 'It is True' ELSE answer END"


@query(
    f"""WITH r AS (SELECT record_id, {_KIND} AS kind, {_TYPED} AS text FROM cot_records WHERE answer IS NOT NULL),
 l AS (SELECT *, substr({STRIP("string_split(text, 'The answer is:')[-1]")}, 1, 1) AS letter FROM r)
 SELECT record_id, kind, coalesce(regexp_extract_all(replace(text, ',', ''), '{NUM}')[-1],
  CASE kind WHEN 'choice' THEN CASE WHEN letter IN ('A', 'B', 'C', 'D', 'E') THEN letter ELSE 'C' END
   WHEN 'truth' THEN CASE WHEN contains(text, 'True') THEN 'True' WHEN contains(text, 'False') THEN 'False' END ELSE 'inf' END) AS pred FROM l"""
)
def f03_typed_answer(spark, d):
    rows = table(spark, d, "cot_records").where("answer is not null").select("record_id", F.expr(_KIND).alias("kind"), F.expr(_TYPED).alias("text"))
    return rows.select("record_id", "kind", A.typed_answer("text", "kind").alias("pred"))


_ANNOUNCED = ", ".join(
    f"nullif(regexp_extract(text, '{p}', 1, 'i'), '')"
    for p in (r"####\s*(\d+\.?\d*)", r"答案是[：:]\s*(\d+\.?\d*)", r"Therefore,?\s+.*?(\d+\.?\d*)", r"Answer[：:]\s*(\d+\.?\d*)", r"\$(\d+\.?\d*)", r"(\d+\.?\d*)\s*$")
)


@query(
    f"""WITH t AS (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'Therefore, x is ' || answer ELSE answer END AS text FROM cot_records WHERE answer IS NOT NULL)
 SELECT record_id, coalesce({_ANNOUNCED}, {STRIP('text')}) AS pred FROM t"""
)
def f04_announced(spark, d):
    rows = table(spark, d, "cot_records").where("answer is not null")
    text = F.expr("CASE WHEN record_id % 3 = 0 THEN 'Therefore, x is ' || answer ELSE answer END")
    return rows.select("record_id", A.announced(text).alias("pred"))


_TAG = "string_split(string_split(text, '<answer>')[-1], '</answer>')[1]"
_UNTAG = "string_split(string_split(text, '<answer>')[-1], '</answer')[1]"


@query(
    f"""WITH {RESPONSES} SELECT record_id,
 CASE WHEN contains(text, '<think>') AND contains(string_split(text, '<think>')[-1], '</think>')
  THEN {STRIP("string_split(string_split(text, '<think>')[-1], '</think>')[1]")} ELSE text END AS reasoning,
 CASE WHEN contains(text, '<answer>') THEN nullif(substr(string_split({STRIP(_TAG)}, ' ')[1], 1, 1), '') END AS pred FROM responses"""
)
def f05_reasoning_and_letter(spark, d):
    return responses(spark, d).select("record_id", A.reasoning("text").alias("reasoning"), A.letter("text", "tag").alias("pred"))


@query(f"WITH {RESPONSES} SELECT record_id, substr(string_split({STRIP(_UNTAG)}, ' ')[1], 1, 1) AS pred FROM responses")
def f06_letter_untagged(spark, d):
    return responses(spark, d).select("record_id", A.letter("text", "untagged").alias("pred"))


_BOXL = rf"upper(substr({STRIP(f"regexp_extract_all(t, '{BOX}', 1)[1]")}, 1, 1))"
_LINES = rf"list_filter(list_transform(string_split(t, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '')"


def _phrase(p: str) -> str:
    rest = STRIP(f"substr(t, strpos(lower(t), '{p}') + {len(p)})")
    got = rf"coalesce(nullif(regexp_extract({rest}, '^\(([A-Z])\)', 1), ''), nullif(regexp_extract({rest}, '^([A-Z])', 1), ''))"
    return f"CASE WHEN contains(lower(t), '{p}') THEN {got} END"


@query(
    rf"""WITH {RESPONSES}, s AS (SELECT record_id, {STRIP('text')} AS t FROM responses), l AS (SELECT *, {_LINES}[1] AS line FROM s)
 SELECT record_id, coalesce({_BOXL}, regexp_extract_all(t, '\(([A-Z])\)', 1)[-1],
  CASE WHEN line IN ('A', 'B', 'C', 'D') THEN line ELSE nullif(regexp_extract(line, '^([A-Z])\.', 1), '') END,
  {', '.join(_phrase(p) for p in A.PHRASES)}, regexp_extract_all(t, '\b([A-D])\b', 1)[1], '') AS pred FROM l"""
)
def f07_letter_phrases(spark, d):
    return responses(spark, d).select("record_id", A.letter("text", "box_parens_phrases").alias("pred"))


@query(
    rf"""WITH {RESPONSES}, s AS (SELECT record_id, text AS t FROM responses), l AS (SELECT *, {_LINES}[-1] AS line,
  CASE WHEN contains(t, '<answer>') THEN nullif(string_split({STRIP(_UNTAG.replace('text', 't'))}, ' ')[1], '') END AS tagged FROM s)
 SELECT record_id, coalesce({_BOXL}, upper(substr(tagged, 1, 1)), regexp_extract_all(t, '\(([A-Z])\)', 1)[1], upper(substr(string_split(line, ' ')[1], 1, 1)), '') AS pred FROM l"""
)
def f08_letter_tag_line(spark, d):
    return responses(spark, d).select("record_id", A.letter("text", "box_tag_parens_line").alias("pred"))


@query("SELECT record_id, string_split(regexp_replace('#Q Answer:' || answer || '##', '^#+|#+$', '', 'g'), 'Answer:')[-1] AS pred FROM cot_records WHERE answer IS NOT NULL")
def f09_after_template(spark, d):
    rows = table(spark, d, "cot_records").where("answer is not null")
    return rows.select("record_id", A.after_template(F.concat(F.lit("#Q Answer:"), "answer", F.lit("##"))).alias("pred"))


_NESTED = "'so ' || chr(92) || 'boxed{' || chr(92) || 'frac{' || record_id || '}{7}} or ' || chr(92) || 'boxed{' || chr(92) || 'sqrt{' || record_id || '}} end'"


@query(f"SELECT record_id, chr(92) || 'boxed{{' || chr(92) || 'sqrt{{' || record_id || '}}}}' AS pred FROM cot_records")
def f10_balanced_box(spark, d):
    return table(spark, d, "cot_records").select("record_id", A.balanced_box(F.expr(_NESTED.replace("{", "{").replace("}", "}"))).alias("pred"))


@query(
    r"""WITH t AS (SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'This IS fine; it is ' || answer || '</answer>' WHEN record_id % 3 = 0 THEN 'the sum is ' || answer ELSE answer END AS text
  FROM cot_records WHERE answer IS NOT NULL),
 r AS (SELECT *, regexp_extract(text, '(?is)^.*is(.*)$', 1) AS rest, strpos(text, '</answer>') - 1 AS stop FROM t),
 s AS (SELECT *, length(text) - length(rest) AS start FROM r)
 SELECT record_id,
  CASE WHEN NOT contains(lower(text), 'is') THEN 'None' WHEN stop >= 0 THEN substr(text, start + 1, greatest(stop - start, 0)) ELSE rest END AS pred,
  CASE WHEN NOT contains(lower(text), 'is') THEN 'None' WHEN stop >= 0 THEN substr(text, start + 1, greatest(stop - start, 0)) ELSE substr(text, start + 1, greatest(length(text) - 1 - start, 0)) END AS pred_parity
 FROM s"""
)
def f11_after_is(spark, d):
    text = F.expr(
        "CASE WHEN record_id % 2 = 0 THEN 'This IS fine; it is ' || answer || '</answer>' WHEN record_id % 3 = 0 THEN 'the sum is ' || answer ELSE answer END"
    )
    rows = table(spark, d, "cot_records").where("answer is not null").select("record_id", text.alias("text"))
    return rows.select("record_id", A.after_is("text").alias("pred"), A.after_is("text", parity=True).alias("pred_parity"))


@query(
    """WITH t AS (SELECT record_id, coalesce(cot, '') || chr(10) || '#### ' || coalesce(answer, '') AS text FROM cot_records)
 SELECT record_id, string_split(text, '####')[-1] AS pred, string_split(text, chr(10) || '####')[1] AS steps, trim(string_split(text, chr(10) || '####')[2], ' ') AS answer FROM t"""
)
def f12_hashes(spark, d):
    text = F.expr("coalesce(cot, '') || chr(10) || '#### ' || coalesce(answer, '')")
    rows = table(spark, d, "cot_records").select("record_id", text.alias("text"), A.steps_and_answer(text).alias("s"))
    return rows.select("record_id", A.after_hashes("text").alias("pred"), "s.steps", "s.answer")


@query(
    r"""WITH t AS (SELECT record_id, 'we get ' || chr(92) || 'boxed{' || record_id || '} cm. {x} ' || CASE WHEN record_id % 5 = 0 THEN chr(92) || 'boxed{2}' ELSE 'end' END AS text FROM cot_records),
 p AS (SELECT *, string_split(text, chr(92) || 'boxed{') AS parts FROM t),
 c AS (SELECT *, parts[2] AS rest, length(parts[2]) - strpos(reverse(parts[2]), '}') + 1 AS brace FROM p WHERE len(parts) = 2)
 SELECT record_id, parts[1] || substr(rest, brace) AS step, substr(rest, 1, brace - 1) AS answer FROM c"""
)
def f13_boxed_split(spark, d):
    text = F.expr("'we get ' || chr(92) || 'boxed{' || record_id || '} cm. {x} ' || CASE WHEN record_id % 5 = 0 THEN chr(92) || 'boxed{2}' ELSE 'end' END")
    rows = table(spark, d, "cot_records").select("record_id", A.boxed_split(text).alias("s")).where("s is not null")
    return rows.select("record_id", "s.step", "s.answer")


@query(
    rf"""WITH {RESPONSES}, b AS (SELECT record_id, coalesce({STRIP("regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1)[-1]")}, '') AS body FROM responses)
 SELECT record_id, {STRIP(r"regexp_replace(body, '(?i)\n*\s*final\s*answer\s*:\s*[A-D]\.?\s*$', '')")} AS body FROM b"""
)
def f14_clean_reasoning(spark, d):
    return responses(spark, d).select("record_id", A.clean_reasoning("text").alias("body"))


_LABELS = "CASE record_id % 3 WHEN 0 THEN ' (' || substr('abcd', cast(1 + record_id % 4 as int), 1) || ') ' WHEN 1 THEN substr('abcd', cast(1 + record_id % 4 as int), 1) ELSE 'yes' END"


@query(rf"SELECT record_id, upper(coalesce(nullif(regexp_extract(trim({_LABELS}), '^\((.)\)$', 1), ''), trim({_LABELS}))) AS label FROM cot_records")
def f15_label(spark, d):
    return table(spark, d, "cot_records").select("record_id", A.label(F.expr(_LABELS)).alias("label"))


_CHOICE = "CASE record_id % 4 WHEN 0 THEN 'A or B? The answer is: C, not D.' WHEN 1 THEN 'first a then ' || {l} || '.' WHEN 2 THEN ': ' || {l} || './' ELSE 'none here.' END".replace(
    "{l}", "substr('abcde', cast(1 + record_id % 5 as int), 1)"
)


@query(
    rf"""WITH t AS (SELECT record_id, {_CHOICE} AS t FROM cot_records),
 x AS (SELECT record_id, contains(t, 'The answer is') AS flagged, t AS whole, string_split_regex(t, 'The answer is:|The answer is|the answer is')[-1] AS piece FROM t),
 y AS (SELECT record_id, flagged,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(whole, '\.+$', ''), '/+$', ''), '^ +| +$', '', 'g'), '^:+', '') AS a,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece, '\.+$', ''), '/+$', ''), '^ +| +$', '', 'g'), '^:+', '') AS b FROM x)
 SELECT record_id,
  regexp_replace(coalesce(regexp_extract_all(upper(a), '\b(A|B|C|D|E)\b', 1)[-1], regexp_replace(trim(a), '^\.+|\.+$', '', 'g')), '[./]+$', '') AS last_letter,
  regexp_replace(coalesce(CASE WHEN flagged THEN regexp_extract_all(upper(b), '\b(A|B|C|D|E)\b', 1)[1] ELSE regexp_extract_all(upper(b), '\b(A|B|C|D|E)\b', 1)[-1] END,
   regexp_replace(trim(b), '^\.+|\.+$', '', 'g')), '[./]+$', '') AS triggered FROM y"""
)
def f16_choice(spark, d):
    text = F.expr(_CHOICE)
    return table(spark, d, "cot_records").select("record_id", A.choice(text).alias("last_letter"), A.choice(text, "after_trigger").alias("triggered"))


@query(
    rf"""WITH t AS (SELECT record_id, '### Step 1: ' || coalesce(cot, '') || '### Step 2.5: done ' AS text FROM cot_records)
 SELECT record_id, array_to_string(list_transform(string_split(text, '### Step'), lambda s: {STRIP(r"regexp_replace(s, '^ \d+(\.\d+)?: ', '')")}), '|') AS steps FROM t"""
)
def f17_solution_steps(spark, d):
    text = F.expr("'### Step 1: ' || coalesce(cot, '') || '### Step 2.5: done '")
    return table(spark, d, "cot_records").select("record_id", F.array_join(A.solution_steps(text), "|").alias("steps"))


@query(
    """SELECT record_id, 0 AS pos, 'think' AS kind, 'look at ' || record_id AS text FROM cot_records
 UNION ALL SELECT record_id, 1, 'image', 'reasoning_image_' || (record_id % 3) FROM cot_records
 UNION ALL SELECT record_id, 2, 'think', 'done' FROM cot_records"""
)
def f18_trace_parts(spark, d):
    text = F.expr("'THOUGHT 0: look at ' || record_id || ' <image_start>[reasoning_image_' || (record_id % 3) || ']<image_end> THOUGHT 1: done'")
    rows = table(spark, d, "cot_records").select("record_id", F.posexplode(A.trace_parts(text)).alias("pos", "part"))
    return rows.select("record_id", "pos", "part.kind", "part.text")


@query(
    r"""SELECT record_id, regexp_replace(answer, '[^0-9.\-]', '', 'g') AS digits, 'n ' || format('{:,}', record_id * 977) || ' end' AS grouped FROM cot_records WHERE answer IS NOT NULL"""
)
def f19_digits_and_thousands(spark, d):
    rows = table(spark, d, "cot_records").where("answer is not null")
    return rows.select("record_id", A.digits_only("answer").alias("digits"), A.with_thousands(F.expr("'n ' || (record_id * 977) || ' end'")).alias("grouped"))


_WORDS = "CASE record_id % 4 WHEN 0 THEN 'twenty one' WHEN 1 THEN 'two thousand three hundred' WHEN 2 THEN 'two hats' ELSE 'Seven' END"


@query("SELECT record_id, CASE record_id % 4 WHEN 0 THEN '21' WHEN 1 THEN '2300' WHEN 2 THEN 'two hats' ELSE '7' END AS value FROM cot_records")
def f19_number_words(spark, d):
    return table(spark, d, "cot_records").select("record_id", A.number_words(F.expr(_WORDS)).alias("value"))


@query()
def f20_symbolic_answer(spark, d):
    return table(spark, d, "cot_records").select("record_id", A.symbolic_answer(F.col("cot")).alias("found"))


_CLEAN = r"lower(regexp_replace(regexp_replace(regexp_replace(adv_answer, '^[#\n ]+|[#\n ]+$', '', 'g'), '\.+$', ''), ',', '', 'g'))"


@query(
    f"""WITH t AS (SELECT problem_id, run_name, {_CLEAN} AS t FROM search_results WHERE adv_answer IS NOT NULL)
 SELECT problem_id, run_name, coalesce({FLOAT('t')}, {FLOAT(f"regexp_extract_all(t, '{NUM}')[1]")}, 'inf'::DOUBLE) AS pred FROM t"""
)
def f21_whole_then_first(spark, d):
    return table(spark, d, "search_results").where("adv_answer is not null").select("problem_id", "run_name", A.number("adv_answer", "whole_then_first").alias("pred"))


_BARE = "replace(answer, ',', '')"
_MARKED = rf"nullif(regexp_extract({_BARE}, '####\s*([\d.\-]+)', 1), '')"


@query(
    f"""SELECT record_id, CASE WHEN {_MARKED} IS NOT NULL THEN coalesce({FLOAT(_MARKED)}, 'inf'::DOUBLE) ELSE {LAST_NUMBER('answer')} END AS gold FROM cot_records WHERE answer IS NOT NULL"""
)
def f22_hash_then_number(spark, d):
    return table(spark, d, "cot_records").where("answer is not null").select("record_id", A.number("answer", "hash_then_number").alias("gold"))
