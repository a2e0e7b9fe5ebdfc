"""Reading LaTeX answers: one spelling of an answer, and its value as an expression.

A text is cut into tokens (commands, numbers, words, signs) once; every rule
then is about tokens and groups, never about the letters inside a word.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from . import answers

_TOKEN = re.compile(r"\\[a-zA-Z]+|\\.|\d+(?:\.\d*)?|\.\d+|[^\W\d_]+|[ \t]+|\S")

# Units that may stand in an answer as words of their own; a dot
# in a unit stands for any one sign.
UNITS = (
    "east|degree|mph|kmph|ft|m sqaure| m east|sq m|deg|mile|q .|monkey|prime|ratio|profit of rs|rd|o|gm|p . m|lb|tile|per|dm|lt|gain|ab|way|west|"
    "a .|b .|c .|d .|e .|f .|g .|h .|t|a|h|no change|men|soldier|pie|bc|excess|st|inches|noon|percent|by|gal|kmh|c|acre|rise|a . m|th|π r 2|sq|mark|l|toy|coin|"
    "sq . m|gallon|° f|profit|minw|yr|women|feet|am|pm|hr|cu cm|square|v â € ™|are|rupee|rounds|cubic|cc|mtr|s|ohm|number|kmph|day|hour|minute|min|second|man|"
    "woman|sec|cube|mt|sq inch|mp|∏ cm ³|hectare|more|sec|unit|cu . m|cm 2|rs .|rs|kg|g|month|km|m|cm|mm|apple|liter|loss|yard|pure|year|increase|decrease|d|"
    "less|Surface|litre|pi sq m|s .|metre|meter|inch"
).split("|")
# Commands and signs that only set the layout, money, percent or angles.
SILENT = frozenset(["\\!", "\\left", "\\right", "\\$", "$", "\\(", "\\)", "\\%", "%", "\\mathbf"])
# Other names of one command.
SAME_COMMAND = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\neq": "\\ne", "\\leq": "\\le", "\\geq": "\\ge", "\\{": "{", "\\}": "}"}
# Environments that are read as one.
SAME_ENVIRONMENT = {"bmatrix": "pmatrix", "array": "pmatrix"}
# Letters that an answer may be bound to, and what binds them.
BOUND, BINDERS = frozenset("xyz"), frozenset(["=", "\\in", "\\to"])


def lex(text: str) -> list[str]:
    """Tokens; line ends vanish and any other blank is one " "."""
    return [" " if t.isspace() else t for t in _TOKEN.findall(re.sub(r"[\r\n]", "", text))]


def _group_end(tokens: list[str], at: int) -> int:
    """Behind the brace that closes the one at ``at``; the end of the text if it never closes."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "{") - (tokens[i] == "}")
        if not depth:
            return i + 1
    return len(tokens)


def _words(tokens: list[str]) -> bool:
    return any(t.strip() for t in tokens)


def _environments(tokens: list[str]) -> list[str]:
    """Matrices of any kind in one environment, without the columns of an array."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i] in ("\\begin", "\\end") and i + 1 < len(tokens) and tokens[i + 1] == "{":
            end = _group_end(tokens, i + 1)
            name = "".join(tokens[i + 2 : end - 1])
            out += [tokens[i], "{", SAME_ENVIRONMENT.get(name, name), "}"]
            if tokens[i] == "\\begin" and name == "array" and end < len(tokens) and tokens[end] == "{":
                end = _group_end(tokens, end)
            i = end
        else:
            out.append(tokens[i])
            i += 1
    return out


def _unit_phrases(units: list[str]) -> dict[str, list[list[str]]]:
    """Units as tokens without blanks, by their first one, longest first."""
    found: dict[str, list[list[str]]] = {}
    for u in units:
        phrase = [t for t in lex(u) if t != " "]
        found.setdefault(phrase[0], []).append(phrase)
    for phrases in found.values():
        phrases.sort(key=len, reverse=True)
    return found


_UNITS = _unit_phrases(UNITS)


def _without_units(tokens: list[str], phrases: dict[str, list[list[str]]]) -> list[str]:
    """Units that stand as words of their own are dropped, unless nothing would be left.

    A word beside a number without a blank, such as the x of 2x, is no unit.
    """
    out, i = [], 0
    while i < len(tokens):
        end = 0
        if not (out and (out[-1][-1].isalnum() or out[-1] == "_")):
            for phrase in phrases.get(tokens[i], ()):
                at, place = i, 0
                while place < len(phrase) and at < len(tokens):
                    if tokens[at] == " " and place:
                        at += 1
                        continue
                    if phrase[place] != tokens[at] and not (phrase[place] == "." and len(tokens[at]) == 1):
                        break
                    at, place = at + 1, place + 1
                if place == len(phrase) and not (at < len(tokens) and (tokens[at][0].isalnum() or tokens[at] == "_")):
                    end = at
                    break
        if end and (_words(out) or _words(tokens[end:])):
            i = end
        else:
            out.append(tokens[i])
            i += 1
    return out


def _number(token: str) -> str:
    """A number without a fraction of zeros and with a digit before its point."""
    whole, point, part = token.partition(".")
    return (whole or "0") + (point + part if part.strip("0") else "")


def _arguments(tokens: list[str]) -> list[str]:
    """Roots and fractions with arguments in braces.

    Without braces a root takes the whole word or number that follows it, a
    fraction single signs.
    """
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        out.append(t)
        i += 1
        if t == "\\sqrt":
            run = i
            while run < len(tokens) and re.fullmatch(r"\w+", tokens[run]):
                run += 1
            if run > i:
                out += ["{", *tokens[i:run], "}"]
                i = run
        elif t == "\\frac" and i < len(tokens) and tokens[i] != "{":
            rest = "".join(tokens[i : i + 2])
            if len(rest) >= 2 and rest[0] != "\\" and (rest[1] != "\\" or len(tokens[i]) > 1):
                spent = len(tokens[i])
                out += ["{", rest[0], "}"]
                if rest[1] == "{":
                    i += 1
                else:
                    out += ["{", rest[1], "}"]
                    left = tokens[i][2:] if spent >= 2 else (tokens[i + 1][1:] if i + 1 < len(tokens) else "")
                    i += 1 if spent >= 2 else 2
                    if left:
                        out.append(left)
    return out


def normal_latex(text: str, skip_unit: bool = False, units: dict[str, list[list[str]]] = _UNITS) -> str:
    """One spelling of a LaTeX answer: no layout, units, signs of money or percent; fractions and roots in braces.

    >>> normal_latex("\\\\dfrac12"), normal_latex("3/4"), normal_latex("12 apple."), normal_latex("k = 5.0")
    ('\\\\frac{1}{2}', '\\\\frac{3}{4}', '12', '5')
    """
    tokens = [SAME_COMMAND.get(t, t) for t in _environments(lex(text.strip().rstrip(".")))]
    last = max((i for i, t in enumerate(tokens) if t == "\\text"), default=-1)
    if last > 0 and _words(tokens[:last]) and last + 1 < len(tokens) and tokens[last + 1] == "{" and _group_end(tokens, last + 1) == len(tokens):
        tokens = tokens[:last]
    if not skip_unit:
        tokens = _without_units(tokens, units)
    plain: list[str] = []
    closing: list[int] = []  # ends of \text groups that are unwrapped
    i = 0
    while i < len(tokens):
        t = tokens[i]
        follows = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t in SILENT or t == "and" or closing and i == closing[-1]:
            if closing and i == closing[-1]:
                closing.pop()
            i += 1
        elif t == "^" and follows == "\\circ":
            i += 2
        elif t == "^" and tokens[i + 1 : i + 4] == ["{", "\\circ", "}"]:
            i += 4
        elif t == "\\mbox" and follows == "{":
            i = _group_end(tokens, i + 1)
        elif t == "\\text" and follows == "{":
            end = _group_end(tokens, i + 1)
            if tokens[end - 1] == "}":
                closing.append(end - 1)
            i += 2
        elif t in BOUND and follows in BINDERS:
            i += 2
        else:
            plain.append(_number(t) if t[0].isdigit() or t[0] == "." and len(t) > 1 else t)
            i += 1
    said = "".join(plain)
    counted = answers.parse_number_words(said)
    if counted != said:
        plain = lex(counted)
    names = {"\\emptyset": ["{", "}"], "infinity": ["\\infty"]} | ({} if "\\infty" in plain else {"inf": ["\\infty"]})
    plain = [x for t in plain if t != " " for x in names.get(t, [t])]
    if any("j" in t for t in plain) and not any("i" in t for t in plain):
        plain = [t.replace("j", "i") for t in plain]
    if plain.count("=") == 1 and len("".join(plain[: plain.index("=")])) <= 2:
        plain = plain[plain.index("=") + 1 :]
    if plain == ["(", "-", "\\infty", ",", "\\infty", ")"]:
        return "\\mathbb{R}"
    out = "".join(_arguments(plain))
    ratio = re.fullmatch(r"(-?\d+|[^/]*sqrt[^/]*)/(-?\d+|[^/]*sqrt[^/]*)", out)
    return f"\\frac{{{ratio[1]}}}{{{ratio[2]}}}" if ratio else out


# ------------------------------------------------------------ expressions

FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "ln": math.log, "exp": math.exp, "abs": abs}
_BINARY = {"+": (1, lambda x, y: x + y), "-": (1, lambda x, y: x - y), "*": (2, lambda x, y: x * y), "/": (2, lambda x, y: x / y), "^": (4, lambda x, y: x**y)}
_SPELT = {"\\cdot": "*", "\\times": "*", "×": "*", "\\div": "/", "÷": "/", "**": "^"}
_OPENING, _CLOSING = frozenset("({["), frozenset(")}]")
_PART = re.compile("|".join(sorted([*FUNCTIONS, "pi"], key=len, reverse=True)) + "|[a-z]")


class NotAnExpression(ValueError):
    """Notation that is not arithmetic, powers, roots, fractions and known functions."""


def _symbols(text: str) -> list[str]:
    """Numbers, names, operators and brackets of an answer; fractions are marked "frac"."""
    out: list[str] = []
    for t in lex(normal_latex(text, skip_unit=True).replace("**", "^")):
        t = _SPELT.get(t, t)
        name = t.removeprefix("\\").lower()
        if t == " ":
            continue
        if name == "frac" or name in FUNCTIONS or name == "pi":
            out.append(name)
        elif t[0] == "\\":
            raise NotAnExpression(t)
        elif name[0].isalpha():
            at = 0
            while at < len(name):
                m = _PART.match(name, at)
                if not m:
                    raise NotAnExpression(name)
                out.append(m.group())
                at = m.end()
        elif t[0].isdigit() or t[0] == "." and len(t) > 1 or t in _BINARY or t in _OPENING or t in _CLOSING:
            out.append(t)
        else:
            raise NotAnExpression(t)
    return out


def postfix(text: str) -> list[str]:
    """The operations of an expression in the order in which they are done.

    An operator stack, so neither length nor depth is limited. Products may be
    implied; powers bind to the right and before a sign, functions apply to
    the group, number or letter that follows.
    """
    out: list[str] = []
    stack: list[str] = []
    ready = False  # whether a value has just ended

    def level(x: str) -> int:
        return 3 if x == "neg" else 5 if x in FUNCTIONS else _BINARY[x][0] if x in _BINARY else 0

    def reduce_to(least: int) -> None:
        while stack and level(stack[-1]) >= least:
            out.append(stack.pop())

    def begin_value() -> None:
        if ready:
            reduce_to(2)
            stack.append("*")

    for t in _symbols(text):
        if t == "frac":
            begin_value()
            # Two groups that follow each other, divided: the first closes with a division.
            stack.append("frac")
            ready = False
        elif t in FUNCTIONS:
            begin_value()
            stack.append(t)
            ready = False
        elif t in _OPENING:
            if ready and stack and stack[-1] == "over":
                stack[-1] = "frac2"
            else:
                begin_value()
            stack.append(t)
            ready = False
        elif t in _CLOSING:
            if not ready:
                raise NotAnExpression(t)
            while stack and stack[-1] not in _OPENING:
                if stack[-1] in ("over", "frac"):
                    raise NotAnExpression("frac")
                out.append(stack.pop())
            if not stack:
                raise NotAnExpression(t)
            stack.pop()
            ready = True
            if stack and stack[-1] == "frac":
                stack[-1] = "over"
            elif stack and stack[-1] == "frac2":
                stack.pop()
                out.append("/")
            while stack and stack[-1] in FUNCTIONS:
                out.append(stack.pop())
        elif t in _BINARY:
            if not ready:
                if t == "-":
                    stack.append("neg")
                elif t != "+":
                    raise NotAnExpression(t)
                continue
            if t == "^":
                reduce_to(5)
            else:
                reduce_to(_BINARY[t][0])
            stack.append(t)
            ready = False
        else:
            begin_value()
            out.append(t)
            ready = True
            while stack and stack[-1] in FUNCTIONS:
                out.append(stack.pop())
    if not ready:
        raise NotAnExpression("end")
    while stack:
        t = stack.pop()
        if t in _OPENING or t in ("over", "frac", "frac2"):
            raise NotAnExpression(t)
        out.append(t)
    return out


def value(operations: list[str], letters: dict[str, float]) -> float:
    """The value of ``postfix`` operations; arithmetic errors are raised."""
    stack: list[float] = []
    for t in operations:
        if t in _BINARY:
            y = stack.pop()
            stack[-1] = _BINARY[t][1](stack[-1], y)
        elif t == "neg":
            stack[-1] = -stack[-1]
        elif t in FUNCTIONS:
            stack[-1] = FUNCTIONS[t](stack[-1])
        elif t == "pi":
            stack.append(math.pi)
        else:
            stack.append(letters[t] if t.isalpha() else float(t))
    return stack[0]


#: Assignments of the letters at which two expressions must agree.
POINTS = 5


def same_value(a: str, b: str, close: float = 1e-4) -> bool:
    """Whether two expressions have the same value wherever both are tried.

    Stands in for a computer algebra system: both sides are evaluated at
    ``POINTS`` fixed assignments of their letters, those where either has no
    real value left out. Equal expressions pass unless they have no value at
    any of them; different ones agree at all only by design. Without letters
    both are numbers, which agree within ``close`` of the larger. Texts of any
    length and depth are evaluated; notation beyond arithmetic, powers, roots,
    fractions and the functions of ``FUNCTIONS`` counts as different.
    """
    try:
        left, right = postfix(a), postfix(b)
    except NotAnExpression:
        return False
    constant = not any(len(t) == 1 and t.isalpha() for t in (*left, *right))
    tried = 0
    for k in range(1, 2 if constant else POINTS + 1):
        letters = {chr(97 + i): float(Fraction((i * 37 + k * 61) % 97 + 3, 29)) for i in range(26)}
        try:
            x, y = value(left, letters), value(right, letters)
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        if isinstance(x, complex) or isinstance(y, complex) or not math.isfinite(x) or not math.isfinite(y):
            continue
        if not math.isclose(x, y, rel_tol=close if constant else 1e-9, abs_tol=1e-9):
            return False
        tried += 1
    return tried > 0
