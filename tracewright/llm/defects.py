"""Broken prompt and response pairs, each with its type of defect."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import WORD, Profiles

# ------------------------------------------------------------------ empty

# What stands where an answer is missing.
PLACEHOLDERS = frozenset(
    "n/a na none null nil nan tbd tba todo - -- --- – — . .. ... … ? ?? ??? _ __ ___ * x xx xxx empty blank missing unknown undefined "
    "pending unanswered placeholder void nothing #n/a #ref! (none) k.a. keine aucune ninguno ninguna nenhum nenhuma нет 无 なし".split()
) | {"no answer", "not available", "not applicable", "no response", "to be done", "to do", "answer here", "your answer", "insert answer here", "your answer here"}

# Markers that announce an answer.
_MARKER = re.compile(
    r"^(?:\#{2,}|(?:the\s+)?(?:final\s+)?(?:answer|antwort|réponse|respuesta|resposta|ответ|答案|response|result|solution|output|a)(?:\s+is|\s+ist|\s+est|\s+es|\s+é|是)?\s*[:：=]|"
    r"(?:the\s+)?(?:final\s+)?answer(?:\s+is)?)\s*",
    re.I,
)
_WRAPPED = (
    re.compile(r"^\\boxed\s*\{(.*)\}$", re.S),
    re.compile(r"^<([a-z]+)>(.*)</\1>$", re.S | re.I),
    re.compile(r"^\$+(.*?)\$+$", re.S),
    re.compile(r"^`+(.*?)`+$", re.S),
    re.compile(r"^\[(.*)\]$", re.S),
    re.compile(r"^\((.*)\)$", re.S),
    re.compile(r"^<([^<>]*)>$", re.S),
    re.compile(r"^[\"'“”‘’«»*_~]+(.*?)[\"'“”‘’«»*_~]+$", re.S),
)


def _bare(text: str) -> str:
    return "".join(" " if unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp") else c for c in text).strip()


def is_empty(answer: str | None) -> bool:
    """Null, blank, a placeholder or a bare marker, however it is wrapped."""
    if answer is None:
        return True
    text = _bare(answer)
    while True:  # each turn shortens the text
        low = text.lower()
        if not low or low in PLACEHOLDERS:
            return True
        inner = _MARKER.sub("", text)
        if inner == text:
            for w in _WRAPPED:
                m = w.match(text)
                if m:
                    inner = m.group(m.lastindex)
                    break
            else:
                break
        text = inner.strip()
    return not any(c.isalnum() for c in text) and not re.search(r"[=<>+∞π∅]", text)


# ---------------------------------------------------------------- refusal

# Words of the refusal grammar, per language; an ending "~" stands for any ending, "_" for a blank.
#   negated: negations and words that hold one, such as cannot;  able: ability, leave, will and readiness;
#   act: what a reader asks for;  decline: words that decline by themselves;  bound: what holds a speaker back;
#   limit: rules that do;  speaker: who declines;  regret: openings of an apology or a disclaimer.
GRAMMAR = {
    "en": {
        "negated": "not no cannot can't can’t won't don't unable never nothing wouldn't couldn't shouldn't mustn't neither",
        "able": "can cannot can't could able unable allowed permitted may will won't would do don't feel comfortable right appropriate position willing ready wish want expect couldn't wouldn't",
        "act": "help~ assist~ answer~ respond~ solve~ solving solution~ provid~ giv~ offer~ work~ comply discuss~ deal~ handle~ process take_part go~ support~ complete~ fulfil~ address~ share~ say~ speak~ talk~ tell~ continue~ proceed~ do",
        "decline": "decline~ refus~ unanswered rather_not prefer_not pass_on have_to_pass another_topic something_else_instead abstain~ different_topic",
        "bound": "outside beyond against keep~ prevent~ forbid~ prohibit~ stop~ let allow~ violat~",
        "limit": "policy policies guidelines rules instructions programming allowed may principles what_i permitted me",
        "speaker": "i i'm i'd i'll i've me my mine we we're us our myself assistant",
        "regret": "sorry i'm_sorry i_am_sorry so_sorry very_sorry i_apologi~ unfortunately regrettably as_an_ai under_my_guidelines my_apologies my_instructions my_guidelines my_policy",
    },
    "de": {
        "negated": "nicht keine keinen kein nie",
        "able": "kann darf möchte will werde können muss dürfen möglich erlaubt gestattet lieber imstande",
        "act": "helf~ beantwort~ antwort~ lös~ bearbeit~ behilflich mach~ geb~ übernehm~ anbiet~ eingeh~ weiterhelf~ möglich",
        "decline": "lehne~ ablehn~ verweiger~ lieber_nicht",
        "bound": "gegen außerhalb hindern verbieten",
        "limit": "richtlinie~ regeln vorgaben anweisungen",
        "speaker": "ich wir mir mich meine~ uns",
        "regret": "es_tut_mir_leid tut_mir_leid leider entschuldig~ bedauerlich~",
    },
    "fr": {
        "negated": "ne n'~ pas impossible non",
        "able": "peux puis pouvons suis mesure permis possible impossible veux préfère souhaite vais dois",
        "act": "répondre répond~ aider aide résoudre trait~ donner fournir faire assister",
        "decline": "refuse~ préfère_ne décline~ regrette",
        "bound": "contre empêch~ interdi~",
        "limit": "règles consignes directives instructions",
        "speaker": "je j'~ me m'~ mon ma mes nous moi",
        "regret": "désolé désolée malheureusement pardon je_suis_désolé je_regrette",
    },
    "es": {
        "negated": "no nunca imposible",
        "able": "puedo podemos posible permitido permite condiciones voy debo quiero deseo prefiero imposible",
        "act": "respond~ ayud~ resolv~ contest~ dar tratar hacer atend~ proporcion~",
        "decline": "prefiero_no rechaz~ me_niego declino",
        "bound": "contra impid~ prohíb~",
        "limit": "reglas normas política directrices instrucciones",
        "speaker": "me mi mis yo puedo prefiero voy debo podemos nosotros estoy",
        "regret": "lo_siento lamentablemente disculpa~ perdón",
    },
    "pt": {
        "negated": "não nunca impossível",
        "able": "posso podemos consigo possível permitido vou devo autorizad~ quero prefiro impossível",
        "act": "respond~ ajud~ resolv~ dar tratar fazer atend~ fornec~",
        "decline": "prefiro_não recus~ declino",
        "bound": "contra impede~ proíb~",
        "limit": "regras normas política diretrizes instruções",
        "speaker": "me meu minha eu posso prefiro vou devo consigo podemos nós estou",
        "regret": "desculp~ lamento sinto_muito infelizmente",
    },
    "ru": {
        "negated": "не нельзя нет невозможно",
        "able": "могу можем буду будем смогу стану имею хочу готов~ можно нельзя разрешено вправе хотел~ возможно невозможно",
        "act": "помо~ ответ~ отвеч~ реш~ дать давать выполн~ обсужд~ обработ~ заним~ браться",
        "decline": "отказ~ предпочитаю_не вынужден~ воздерж~",
        "bound": "против запрещ~ вне",
        "limit": "правил~ инструкц~ политик~",
        "speaker": "я мы мне мой моих мои нам меня буду могу хочу готов~ отказ~ предпочитаю",
        "regret": "извините простите к_сожалению прошу_прощения",
    },
    "it": {
        "negated": "non impossibile",
        "able": "posso possiamo grado possibile permesso voglio preferisco devo",
        "act": "rispond~ aiut~ risolv~ dare trattare fare fornire",
        "decline": "preferisco_non rifiut~ declino",
        "bound": "contro impedi~",
        "limit": "regole linee istruzioni",
        "speaker": "mi mio mia io posso preferisco devo possiamo noi sono",
        "regret": "mi_dispiace purtroppo scusa~ spiacente",
    },
}
# The same for a script without blanks, as parts of a clause.
GRAMMAR_HAN = {
    "negated": "不 无法 没法 没有办法 不能 恕 勿 别",
    "able": "能 可 可以 会 便 愿 想 予 无法 没法 应 适合 允许 方便",
    "act": "回答 解答 帮 处理 提供 回应 答复 解决 协助 讨论 作答 满足 完成",
    "decline": "拒绝 谢绝 婉拒",
    "speaker": "我 恕 本人 抱歉 对不起 这 请",
    "regret": "抱歉 对不起 很遗憾",
}
#: Nouns whose number names a task and is no result.
_NUMBERED = re.compile(
    r"(?:question|problem|exercise|task|part|item|number|no\.?|prompt|request|chapter|frage|aufgabe|exercice|numéro|pregunta|ejercicio|problema|questão|exercício|вопрос\w*|задач\w*|题)\s*(?:#|№|no\.?|nr\.?)?\s*\d+|第\s*\d+\s*[题问个]",
    re.I,
)
_CLAUSE = re.compile(r"[^.!?;:。！？；：…\n]+")
_SAID = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*['’]?")


def _word_class(words: str) -> re.Pattern:
    """The words of a class in a text of words between single blanks."""
    one = lambda w: re.escape(w.rstrip("~").replace("_", " ")) + ("[^ ]*" if w.endswith("~") else "")
    return re.compile("(?:^| )(?:" + "|".join(one(w) for w in words.split()) + ")(?= |$)")


_GRAMMAR = {lang: {kind: _word_class(words) for kind, words in kinds.items()} for lang, kinds in GRAMMAR.items()}
_HAN = {kind: re.compile("|".join(words.split())) for kind, words in GRAMMAR_HAN.items()}


def _declines(said: str, g: dict[str, re.Pattern]) -> bool:
    """Whether a clause declines: a negated ability to act, a word of declining, or a rule that holds the speaker back."""
    has = lambda kind: kind in g and g[kind].search(said) is not None
    return has("negated") and has("able") and has("act") or has("decline") or has("bound") and has("limit")


def is_refusal(answer: str) -> bool:
    """A text without any result that declines, apologises or disclaims.

    A number is a result unless it counts a question or a task. The speaker
    declines in some clause by the grammar of the language, or opens with an
    apology or a disclaimer; of a text that breaks off, only the former counts.
    """
    if any(c.isdigit() for c in _NUMBERED.sub(" ", answer)):
        return False
    low = answer.lower().replace("’", "'")
    whole = not broken_off(low, prose=True)
    if _SCRIPTS[0][1].search(low):
        return bool(_HAN["speaker"].search(low)) and any(_declines(c, _HAN) for c in _CLAUSE.findall(low)) or whole and bool(_HAN["regret"].match(low.strip()))
    clauses = [" ".join(_SAID.findall(c)) for c in _CLAUSE.findall(low)]
    said = " ".join(clauses)
    for g in _GRAMMAR.values():
        if whole and (m := g["regret"].search(said)) and m.start() == 0:
            return True
        if not whole and said.count(" ") < 3:
            continue
        if any(_declines(c, g) for c in clauses) and (g["speaker"].search(said) or g["decline"].search(said)):
            return True
    return False


# ---------------------------------------------------------- copied question

_TOKEN = re.compile(r"\d[\d.,]*\d|\d|[一-鿿぀-ヿ가-힯]|[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?;。！？；\n\t]+")
#: Shortest tile, and the share of a sentence that tiles must cover.
TILE = 3
COVERED = 0.7


def tile(a: list[str], b: list[str], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, size), longest tiles first.

    Every token belongs to at most one tile; ties go to the earliest place.
    Stretches of any length get names by doubling, equal ones the same name;
    the longest length that two free stretches share is found by bisection,
    and all tiles of that length are set from a queue of places per name. So
    each length that occurs costs a few passes, however repetitive the texts are.
    """
    n, total = len(a), len(a) + len(b)
    ids: dict[str, int] = {}
    named = [np.array([ids.setdefault(t, len(ids)) for t in (*a, *b)], dtype=np.int64)]
    free = np.ones(total, dtype=bool)

    def names(size: int) -> np.ndarray:
        k = size.bit_length() - 1
        while len(named) <= k:
            half, last = 1 << len(named) - 1, named[-1]
            named.append(np.unique(last[:-half] * total + last[half:], return_inverse=True)[1])
        gap, whole = size - (1 << k), named[k]
        return whole[:-gap] * total + whole[gap:] if gap else whole

    def stretches(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free places of a and of b, and the names of their stretches."""
        until = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(until[size:] - until[:-size] == size)
        name = names(size)
        mine, its = at[at + size <= n], at[at >= n]
        return mine, name[mine], its, name[its]

    def shared(size: int) -> bool:
        _, x, _, y = stretches(size)
        return len(x) > 0 and len(y) > 0 and bool(np.isin(x, y).any())

    tiles, size = [], min(n, len(b))
    while size >= least:
        low, high = least - 1, size
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        size = low
        if size < least:
            break
        mine, x, its, y = stretches(size)
        places: dict[int, deque[int]] = {}
        wanted = np.isin(y, x)
        for j, name in zip(its[wanted].tolist(), y[wanted].tolist()):
            places.setdefault(name, deque()).append(j)
        held = np.isin(x, y)
        for i, name in zip(mine[held].tolist(), x[held].tolist()):
            queue = places[name]
            if not free[i] or not free[i + size - 1]:
                continue  # tiles of this length are as long as the stretch, so its ends tell
            while queue and not (free[queue[0]] and free[queue[0] + size - 1]):
                queue.popleft()
            if queue:
                j = queue.popleft()
                tiles.append((i, j - n, size))
                free[i : i + size] = False
                free[j : j + size] = False
        size -= 1
    return tiles


def is_copy(question: str | None, answer: str) -> bool:
    """The answer repeats a whole sentence of the question and hardly anything else."""
    if not question:
        return False
    a = _TOKEN.findall(answer.lower())
    if len(a) < 4:
        return False
    q, ends = [], []
    for s in _SENTENCE.findall(question.lower()):
        toks = _TOKEN.findall(s)
        if toks:
            ends.append((len(q), len(q) + len(toks)))
            q.extend(toks)
    # Tiles lie within runs of TILE tokens that the question has, so those bound what tiles can cover.
    runs, reach, bound = {tuple(q[i : i + TILE]) for i in range(len(q) - TILE + 1)}, 0, 0
    for i in range(len(a) - TILE + 1):
        if tuple(a[i : i + TILE]) in runs:
            bound += i + TILE - max(i, reach)
            reach = i + TILE
    if bound < COVERED * len(a):
        return False
    hit_a, hit_q = [False] * len(a), [False] * len(q)
    for i, j, n in tile(a, q):
        hit_a[i : i + n] = [True] * n
        hit_q[j : j + n] = [True] * n
    if sum(hit_a) < COVERED * len(a):
        return False
    whole = any(sum(hit_q[s:e]) >= COVERED * (e - s) for s, e in ends if e - s >= 4)
    return whole or sum(hit_q) >= COVERED * len(q)


# ---------------------------------------------------------- other language

_LETTERS = WORD
_SCRIPTS = (("Hani", re.compile("[㐀-鿿]")), ("Cyrl", re.compile("[Ѐ-ӿ]")), ("Kana", re.compile("[぀-ヿ]")), ("Hang", re.compile("[가-힯]")), ("Arab", re.compile("[؀-ۿ]")), ("Deva", re.compile("[ऀ-ॿ]")), ("Grek", re.compile("[Ͱ-Ͽ]")), ("Hebr", re.compile("[֐-׿]")), ("Thai", re.compile("[฀-๿]")))
_UNICODE_LATIN = re.compile("[a-zÀ-ɏ]")


def script(low: str) -> str | None:
    """The script that most letters have, or None without letters."""
    if low.isascii():
        return "Latn" if _UNICODE_LATIN.search(low) else None
    counts = {name: len(found) for name, pattern in _SCRIPTS if (found := pattern.findall(low))}
    latin = len(_UNICODE_LATIN.findall(low))
    if not counts and not latin:
        return None
    name = max(counts, key=counts.get) if counts else "Latn"
    # One Han character says about as much as three letters.
    return name if counts and counts[name] * (3 if name in ("Hani", "Kana", "Hang") else 1) > latin else "Latn"


#: Log-likelihood by which the steps must be more likely in another language than in the question's.
SWITCHED = 60.0
#: The same by which a question's own language must lead the next one.
SURE = 8.0


def switches_language(question: str | None, cot: str | None, profiles: Profiles | None = None) -> bool:
    """Whether the steps, from some place to the last, are in another language than the question.

    Another script tells by itself; languages of one script are told by the
    profiles, from the words that the question does not have, as those are its
    names and things.
    """
    if not question or not cot:
        return False
    asked, said = question.lower(), cot.lower()
    own_script = script(asked)
    if own_script is None:
        return False
    for line in reversed(said.split("\n")):
        s = script(line)
        if s is None:
            continue
        if s == own_script:
            break
        # Letters of formulas and names are Latin in every script.
        words = _LETTERS.findall(line)
        if s == "Latn" and (len(words) < 3 or profiles is not None and sum(map(profiles.like, words)) < 2):
            continue
        return True
    if profiles is None or len(profiles.languages) < 2:
        return False
    mine = _LETTERS.findall(asked)
    new = set(_LETTERS.findall(said)).difference(mine)
    if not new:
        return False
    total = profiles.of(mine).sum(axis=0)
    own = int(total.argmax())
    if total[own] - np.partition(total, -2)[-2] < SURE:
        return False
    until = profiles.of([w for w in reversed(_LETTERS.findall(said)) if w in new]).cumsum(axis=0)
    return bool((until - until[:, own : own + 1]).max() >= SWITCHED)


# --------------------------------------------------------------- truncation

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "（": "）", "【": "】", "「": "」", "《": "》"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_MARKUP = re.compile(r"```|~~~|`|<<|>>|\$\$|\$|\*\*|</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?>|\\begin\{(\w+)\}|\\end\{(\w+)\}|[()\[\]{}“”«»（）【】「」《》]|</?[a-zA-Z]*$")
# Tags that stand alone.
_VOID = frozenset("br hr img p li".split())


def left_open(text: str) -> list[str]:
    """The stack of a pushdown parse at the end of a text: what was opened and not closed.

    Knows code fences and spans, double angle brackets, formulas, emphasis,
    tags, environments, brackets and quotation marks. In code nothing else
    counts. A closer without opener (a list number such as "1)") is skipped; a
    closer also closes what was left open inside it.
    """
    stack: list[str] = []
    for m in _MARKUP.finditer(text):
        t = m.group()
        code = stack and stack[-1] in ("```", "~~~", "`")
        if code:
            if t == stack[-1]:
                stack.pop()
        elif t in ("```", "~~~", "`", "$$", "$", "**"):
            if t in stack:
                del stack[stack.index(t) :]
            elif t == "$" and m.end() < len(text) and text[m.end()].isdigit() and not re.search(r"[=+*/^\\]", text[m.end() : m.end() + 40]):
                pass  # an amount of money, such as $5
            else:
                stack.append(t)
        elif t == "<<":
            stack.append("<<")
        elif t == ">>":
            if "<<" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("<<") :]
        elif t in _OPEN:
            stack.append(t)
        elif t in _CLOSE:
            if _CLOSE[t] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_CLOSE[t]) :]
        elif m.group(1) or m.group(2):
            name = f"\\{m.group(1) or m.group(2)}"
            if m.group(1):
                stack.append(name)
            elif name in stack:
                del stack[stack.index(name) :]
        elif t.startswith("<"):
            if not t.endswith(">"):
                if len(t) > 1:
                    stack.append("<")
                continue
            name = re.match(r"</?(\w+)", t).group(1).lower()
            if t.endswith("/>") or name in _VOID:
                continue
            if t[1] == "/":
                if f"<{name}" in stack:
                    del stack[stack.index(f"<{name}") :]
            else:
                stack.append(f"<{name}")
    return stack


_END = re.compile(r"""[.!?。！？…؟।]["'”’»」)\]}*_`$]*$""")
_EQUATION = re.compile(r"(?P<a>-?\d[\d,.]*)\s*(?P<op>[-+*/x×÷])\s*(?P<b>-?\d[\d,.]*)\s*=\s*(?:<<[^<>]*>>)?\$?\s*(?P<c>-?\d[\d,]*(?:\.\d+)?)\$?")
_SOLVED = re.compile(r"=\s*(?:<<[^<>]*>>)?\s*\$?\s*-?\d[\d,]*(?:\.\d+)?\s*(?:\$|>>|\)|\])*")
_OPERATION = re.compile(r"\d\s*[-+*/x×÷]\s*\d")
_DANGLING = re.compile(r"[-+*/x×÷=,;:(\[{<&、，；：]\s*$")
_LIST_MARK = re.compile(r"^\s*(?:[-*•]|\(?\d+[.)]|step\s+\d+\s*:|schritt\s+\d+\s*:)\s*(?=\S)", re.I)


def _value(text: str) -> float:
    return float(text.rstrip(".,").replace(",", "") or "nan")


def cut_number(line: str) -> bool:
    """Whether the line ends in the first digits of the result of its last operation."""
    last = None
    for last in _EQUATION.finditer(line):
        pass
    if last is None or line[last.end() :].strip(" $"):
        return False
    try:
        a, b, c = _value(last["a"]), _value(last["b"]), last["c"].replace(",", "")
        op = last["op"]
        r = a + b if op == "+" else a - b if op == "-" else a * b if op in "*x×" else a / b
    except (ValueError, ZeroDivisionError):
        return False
    full = str(int(r)) if r == int(r) else repr(r)
    return full != c and full.startswith(c)


def broken_off(text: str, prose: bool = False, known: frozenset[str] = frozenset()) -> bool:
    """Whether a line or an answer breaks off in the middle.

    ``prose``: a text is expected to end with an end mark or a result.
    ``known``: words of the rest of the record; a last word that only begins
    one of them is cut.
    """
    line = text.strip()
    if not line:
        return False
    if left_open(line) or _DANGLING.search(line):
        return True
    if _END.search(line):
        return False
    if cut_number(line):
        return True
    rest, solved = line, None
    for solved in _SOLVED.finditer(line):
        pass
    if solved is not None:
        rest = line[solved.end() :].strip()
        if not rest:
            return False
        words = _LETTERS.findall(rest)
        if words and len(words) <= 2 and not any(c.isdigit() for c in rest):
            last = words[-1].lower()
            return bool(known) and last not in known and any(w.startswith(last) for w in known)
        return True
    if not prose:
        return False
    body = _LIST_MARK.sub("", line)
    return len(_LETTERS.findall(body)) >= (2 if body == line else 1) or bool(re.search(r"[一-鿿]{2}", body)) or bool(_OPERATION.search(body))


def cot_broken(question: str | None, cot: str | None) -> bool:
    """Whether the last line of the steps breaks off."""
    if not cot or not cot.strip():
        return False
    lines = [x for x in cot.split("\n") if x.strip()]
    last = lines[-1].strip()
    fences = [x for x in left_open(cot) if x in ("```", "~~~", "$$") or x[0] in "<\\"] if ("`" in cot or "~~~" in cot or "$$" in cot or "\\begin" in cot or "<" in cot) else []
    if fences:
        return True
    known = frozenset(w.lower() for w in _LETTERS.findall((question or "") + " " + "\n".join(lines[:-1])))
    if broken_off(last, prose=True, known=known):
        return True
    if len(lines) > 1 and any("=" in x for x in lines[:-1]) and "=" not in last and not _END.search(last) and _LETTERS.search(_LIST_MARK.sub("", last)):
        return True
    if len(lines) > 1 and "=" in lines[-2] and re.fullmatch(r"\$?\s*\d[\d,]*", _LIST_MARK.sub("", last)):
        # The number a next operation would begin with, or its first digits.
        result = re.search(r"(-?\d[\d,]*(?:\.\d+)?)\D*$", lines[-2])
        return result is not None and result[1].replace(",", "").startswith(re.sub(r"\D", "", last))
    return False


_PLAIN = re.compile(r"\s*(?:\#{2,}\s*|\$\s*)?-?\d[\d,]*(?:\.\d*)?\s*[%$€]?\s*")
_UNIT = re.compile(r"\s*-?\d[\d,]*(?:\.\d+)?\s+([^\W\d_]+)\.?\s*")


def answer_broken(question: str | None, cot: str | None, answer: str) -> bool:
    """Whether the answer breaks off; a bare number never does, one with a unit only if the unit is the beginning of a word of the question."""
    text = answer.strip()
    if _PLAIN.fullmatch(answer):
        return False
    unit = _UNIT.fullmatch(answer)
    if unit:
        words = set(_LETTERS.findall((question or "").lower()))
        u = unit[1].lower()
        return not text.endswith(".") and u not in words and any(w.startswith(u) for w in words)
    if left_open(text):
        return True
    if re.fullmatch(r"[^\s]+", text):
        return bool(_DANGLING.search(text)) and len(text) > 1
    if _END.search(text):
        return False
    lines = [x for x in (cot or "").split("\n") if x.strip()]
    if lines and lines[-1].strip() == text:
        return cot_broken(question, cot)
    number = re.search(r"(-?\d[\d,]*(?:\.\d+)?)\s*[%$€]?$", text)
    if number and lines and not _OPERATION.search(text):
        results = re.findall(r"\d[\d,]*(?:\.\d+)?", lines[-1])
        if results and results[-1].replace(",", "") == number.group(1).replace(",", ""):
            return False
    return broken_off(text, prose=True)


# ------------------------------------------------------------------- whole


def defect(question: str | None, cot: str | None, answer: str | None, profiles: Profiles | None = None) -> str | None:
    """The defect of one pair, or None.

    An empty answer outranks everything; then refusals and copies, which have
    no result; then a change of language; then truncation.
    """
    plain = answer is not None and _PLAIN.fullmatch(answer) is not None and any(c.isdigit() for c in answer)
    if not plain:
        if is_empty(answer):
            return "empty_answer"
        if not _UNIT.fullmatch(answer):
            if is_refusal(answer):
                return "refusal"
            if is_copy(question, answer):
                return "copied_question"
    if switches_language(question, cot, profiles):
        return "other_language"
    if cot_broken(question, cot) or (not plain and answer_broken(question, cot, answer)):
        return "truncated_answer"
    return None


def _flag(profiles: Profiles | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("question", "cot", "answer")]
            found = pa.array([defect(*row, profiles) for row in zip(*cols)], pa.string())
            out = pa.RecordBatch.from_arrays([b.column("id"), found], ["id", "defect"])
            yield out.filter(found.is_valid())

    return run


def defective_pairs(pairs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(id, defect) of the defective rows of ``pairs(id, question, cot, answer)``.

    One pass without any shuffle. ``profiles`` (see ``languages.fit_profiles``)
    tell languages of one script apart; without them only another script is
    another language. A null or empty question only disables the checks that
    need it; a null or empty cot with a proper answer is no defect; repeated
    rows are each judged; other columns are ignored; an empty table gives an
    empty result.
    """
    cols = [F.col("id").cast("long").alias("id"), *(F.col(c).cast("string").alias(c) for c in ("question", "cot", "answer"))]
    return pairs.select(*cols).mapInArrow(_flag(profiles), "id long, defect string")
