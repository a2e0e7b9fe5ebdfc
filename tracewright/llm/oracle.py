"""SQL twins of the queries that SQL can express.

They state the same results by plainer means: look-alikes by translating
characters, leaks by joining all windows of 15 words, equal problems by joining
all records that share two quantities.
"""

from __future__ import annotations

from .leak import _COMMAND, _ENTITY, _TAG, PASSAGE
from .lookalike import representatives
from .wording import NOT_ALONE, NUMBER_WORDS


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(column: str) -> str:
    # Any member of a class will do; plain letters keep words together.
    counts = {n: 10 if chr(n).isalpha() else 1 for n in range(127, 0x10000) if not 0xD800 <= n <= 0xDFFF} | {n: 1000 for n in range(32, 127)}
    pairs = representatives(counts)
    one = {k: v for k, v in pairs.items() if len(k) == 1 and len(v) == 1}
    gone = [k for k, v in pairs.items() if len(k) == 1 and not v]
    many = {k: v for k, v in pairs.items() if len(k) == 1 and len(v) > 1}
    source, target = "".join(one) + "".join(gone), "".join(one.values())
    out = f"nfc_normalize(translate(nfc_normalize({column}), {_lit(source)}, {_lit(target)}))"
    for k, v in many.items():
        out = f"replace({out}, {_lit(k)}, {_lit(v)})"
    lines = f"replace({out}, chr(13) || chr(10), chr(10))"
    return rf"regexp_replace({lines}, '[ \t]+(\n|$)', '\1', 'g')"


def _words(column: str) -> str:
    text = f"lower({_form(column)})"
    for pattern in (_TAG, _ENTITY, _COMMAND):
        text = f"regexp_replace({text}, {_lit(pattern.pattern)}, ' ', 'g')"
    return rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+')"


def _windows(table: str, key: str, column: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {PASSAGE - 1}], ' ') AS p FROM (SELECT {key}, w, unnest(range(1, len(w) - {PASSAGE - 2})) AS i FROM (SELECT {key}, {_words(column)} AS w FROM {table}))"""


_VALUES = "MAP {" + ", ".join(f"'{w}': '{n}'" for w, n in NUMBER_WORDS.items() if w not in NOT_ALONE) + "}"
_UNGROUPED = r"regexp_replace(regexp_replace(lower({}), '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '([0-9]),([0-9]{{3}})', '\1\2', 'g')"


def _problems(where: str) -> str:
    """Words, sorted quantities and the quantities of the steps of each record."""
    tokens = rf"regexp_extract_all({_UNGROUPED.format('question')}, '\p{{Han}}|[0-9]+(?:\.[0-9]+)?|[\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}]+')"
    steps = rf"list_distinct(regexp_extract_all({_UNGROUPED.format("coalesce(array_to_string(steps, ' '), '')")}, '[0-9]+(?:\.[0-9]+)?'))"
    return f"""SELECT record_id, split, list_distinct(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]'))) AS w, list_sort(list_filter(t, lambda x: regexp_matches(x, '^[0-9]'))) AS n, s
  FROM (SELECT record_id, split, list_transform({tokens}, lambda x: coalesce({_VALUES}[x], x)) AS t, {steps} AS s FROM cot_records WHERE {where})"""


def _same_problems(left: str, right: str, pick: str) -> str:
    """Pairs that share two quantities, compared as the docstring of ``same_problem`` says.

    Where both sides have quantities of unknown part, the pair counts as
    different; the operator also looks at the words around them.
    """
    count = lambda n, x: f"len(list_filter({n}, lambda q: q = {x}))"
    common = f"coalesce(list_sum(list_transform(list_distinct(a.n), lambda x: least({count('a.n', 'x')}, {count('b.n', 'x')}))), 0)"
    only = lambda p, q: f"list_filter(list_distinct({p}.n), lambda x: {count(p + '.n', 'x')} > {count(q + '.n', 'x')})"
    open_ = lambda p, q: f"list_filter({only(p, q)}, lambda x: NOT (len(list_intersect({p}.s, {p}.n)) >= 2 AND NOT list_contains({p}.s, x)))"
    return f"""WITH l AS ({_problems(left)}), r AS ({_problems(right)}),
 lp AS (SELECT DISTINCT record_id, x, y FROM (SELECT record_id, unnest(n) AS x, n FROM l), LATERAL (SELECT unnest(n) AS y) WHERE x < y),
 rp AS (SELECT DISTINCT record_id, x, y FROM (SELECT record_id, unnest(n) AS x, n FROM r), LATERAL (SELECT unnest(n) AS y) WHERE x < y),
 c AS (SELECT DISTINCT lp.record_id AS i, rp.record_id AS j FROM lp JOIN rp USING (x, y) WHERE {pick}),
 m AS (SELECT i, j, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS jaccard, {common} AS common, len(a.n) AS na, len(b.n) AS nb, {open_('a', 'b')} AS oa, {open_('b', 'a')} AS ob, a.s AS sa, b.s AS sb
  FROM c JOIN l a ON a.record_id = i JOIN r b ON b.record_id = j)
 SELECT least(i, j) AS record_id_a, greatest(i, j) AS record_id_b FROM m WHERE jaccard >= 0.42 AND (common = na AND common = nb OR 2 * common >= greatest(na, nb)
  AND (len(oa) = 0 OR len(ob) = 0) AND len(list_filter(oa, lambda x: list_contains(sa, x) AND len(sb) > 0 AND NOT list_contains(sb, x))) = 0
  AND len(list_filter(ob, lambda x: list_contains(sb, x) AND len(sa) > 0 AND NOT list_contains(sa, x))) = 0)"""


def _placed(table: str, key: str, column: str) -> str:
    return f"""SELECT {key}, i, array_to_string(w[i:i + {PASSAGE - 1}], ' ') AS p FROM (SELECT {key}, w, unnest(range(1, len(w) - {PASSAGE - 2})) AS i FROM (SELECT {key}, {_words(column)} AS w FROM {table}))"""


_P1 = _same_problems("split = 'train'", "split = 'train'", "lp.record_id < rp.record_id")
_P3 = _same_problems("split <> 'train'", "split = 'train'", "true")
# Windows of one diagonal that follow one another are one span.
_SPANS = f"""WITH d AS ({_placed('documents', 'doc_id', 'text')}), e AS ({_placed('eval_items', 'item_id', 'question')}),
 h AS (SELECT doc_id, item_id, d.i, e.i AS j, d.i - row_number() OVER (PARTITION BY doc_id, item_id, d.i - e.i ORDER BY d.i) AS island FROM d JOIN e USING (p))
 SELECT doc_id, item_id, min(i) - 1 AS start_word, min(j) - 1 AS item_word, count(*) + {PASSAGE - 1} AS n_words FROM h GROUP BY doc_id, item_id, i - j, island"""

ORACLE: dict[str, str] = {
    "p1_found": _P1,
    # The relation is an equivalence on these tables, so the smallest partner names the class.
    "p1_classes": f"""WITH p AS ({_P1}), s AS (SELECT record_id_b AS record_id, min(record_id_a) AS first FROM p GROUP BY 1)
 SELECT record_id, coalesce(first, record_id) AS class_id FROM cot_records LEFT JOIN s USING (record_id) WHERE split = 'train'""",
    "p2_check": """WITH s AS (SELECT row_id, list_sum(arg_max(input_lengths, ingested_at)) AS n FROM packed_inputs GROUP BY 1)
 SELECT run_name, sum(ceil(n / max_packed_tokens))::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens, count(*) AS n_samples, true AS whole, true AS within FROM s, training_args GROUP BY 1""",
    "p3_found": _P3,
    "p3_report": f"""WITH p AS ({_P3}), e AS (SELECT record_id, split, dataset, count(record_id_a) AS links FROM cot_records LEFT JOIN p ON record_id IN (record_id_a, record_id_b) WHERE split <> 'train' GROUP BY ALL)
 SELECT split, dataset, count(*) AS n_records, count(*) FILTER (links > 0) AS n_overlapping, sum(links)::BIGINT AS n_pairs, max(nullif(links, 0)) AS most_links FROM e GROUP BY 1, 2""",
    "p5_found": f"WITH d AS ({_windows('documents', 'doc_id', 'text')}), e AS ({_windows('eval_items', 'item_id', 'question')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (p)",
    "p5_spans": _SPANS,
    "p5_items": f"SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(n_words) AS longest_passage FROM ({_SPANS}) GROUP BY 1",
    "p7_classes": f"""WITH f AS (SELECT doc_id, text, {_form('text')} AS form FROM documents WHERE text IS NOT NULL), w AS (SELECT *, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n FROM f)
 SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, n::BIGINT AS n_links FROM w""",
    "p7_found": f"WITH f AS (SELECT doc_id, text, {_form('text')} AS form FROM documents) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
}
