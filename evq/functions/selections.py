"""Selection strings in two dialects, rewritten token by token for ``F.expr``.

``a == 1 && b < 2`` and ``(a == True) & (b < 2)`` mean the same. Catalyst does
the parsing; only what it would read differently is rewritten here:

* ``&& || ! & | ~`` become ``AND OR NOT``, with NOT bound to the next operand;
* a flag compared with ``0/1`` or ``true/false``, or used bare, follows the
  column's type (a boolean never equals an integer in Spark's ANSI mode);
* a comparison with NaN is false (Spark sorts NaN above every number).
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from evq import config
from evq.functions.regions import Region, analysis_region

_TOKEN = re.compile(
    r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>&&|\|\||==|!=|<=|>=|[<>!~&|()+\-*/]))"
)
_LOGICAL = {"&&": "AND", "&": "AND", "||": "OR", "|": "OR", "!": "NOT", "~": "NOT"}
_COMPARE = {"==", "!=", "<", "<=", ">", ">="}
_FLIP = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_FUNCTIONS = {"abs", "sqrt", "exp", "log", "log10", "sin", "cos", "tan"}
_DIALECTS = {
    "numexpr": {"AND": "&", "OR": "|", "NOT": "~", "true": "True", "false": "False"},
    "root": {"AND": "&&", "OR": "||", "NOT": "!", "true": "true", "false": "false"},
}


def _is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] == "_"


def _is_column(token: str) -> bool:
    return _is_name(token) and token not in {"AND", "OR", "NOT", "true", "false"} | _FUNCTIONS


def _is_number(token: str) -> bool:
    return token[0].isdigit() or (token[0] == "." and len(token) > 1)


def _tokens(selection: str) -> list[str]:
    found, at = [], 0
    text = selection.rstrip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise ValueError(f"cannot read selection at {text[at:]!r}")
        token = match.group(match.lastgroup)
        if token in ("True", "False"):
            token = token.lower()
        found.append(token)
        at = match.end()
    if not found:
        raise ValueError("empty selection")
    return found


def _close(tokens: list[str], start: int) -> int:
    """Index of the bracket that closes the one at ``start``."""
    depth = 0
    for i in range(start, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i], 0)
        if depth == 0:
            return i
    raise ValueError("unbalanced brackets in selection")


def _operand_end(tokens: list[str], start: int) -> int:
    """One past the operand of a NOT: a name, a bracket group or a call."""
    if start >= len(tokens):
        raise ValueError("selection ends after a negation")
    if tokens[start] in ("!", "~", "NOT"):
        return _operand_end(tokens, start + 1)
    if tokens[start] in _FUNCTIONS:
        start += 1
    return _close(tokens, start) + 1 if tokens[start] == "(" else start + 1


def _bracketed(tokens: list[str]) -> list[str]:
    """Logical operators as AND/OR/NOT, every operand of AND/OR in brackets when it is a comparison."""
    segments, operators, current, i = [], [], [], 0
    single = compares = False
    while i < len(tokens):
        token = tokens[i]
        if token == "(":
            end = _close(tokens, i)
            current += ["(", *_bracketed(tokens[i + 1 : end]), ")"]
            i = end + 1
            continue
        if token == ")":
            raise ValueError("unbalanced brackets in selection")
        if token in ("!", "~"):
            end = _operand_end(tokens, i + 1)
            current += ["NOT", *_bracketed(tokens[i + 1 : end])]
            i = end
            continue
        if token in ("&&", "||", "&", "|"):
            single |= token in ("&", "|")
            segments.append(current)
            operators.append(_LOGICAL[token])
            current = []
        else:
            compares |= token in _COMPARE
            current.append(token)
        i += 1
    segments.append(current)
    if single and compares:
        raise ValueError("bracket every comparison joined by & or |: they bind tighter than comparisons")
    if not all(segments):
        raise ValueError("selection has an empty operand")
    if not operators:
        return segments[0]
    out = []
    for segment, operator in zip(segments, [*operators, None]):
        bare = segment[0] == "(" and _close(segment, 0) == len(segment) - 1
        wrap = not bare and any(t in _COMPARE for t in segment)
        out += ["(", *segment, ")"] if wrap else segment
        if operator:
            out.append(operator)
    return out


def _render(tokens: list[str]) -> str:
    text = re.sub(r"([~!]) ", r"\1", " ".join(tokens))
    text = re.sub(r"\(\s+", "(", text)
    text = re.sub(r"\s+\)", ")", text)
    return re.sub(r"\b(%s) \(" % "|".join(_FUNCTIONS), r"\1(", text)


def _dialect(selection: str, dialect: str) -> str:
    words = _DIALECTS[dialect]
    return _render([words.get(t, t) for t in _bracketed(_tokens(selection))])


def selection_as_numexpr(selection: str) -> str:
    return _dialect(selection, "numexpr")


def selection_as_root(selection: str) -> str:
    return _dialect(selection, "root")


def selection_columns(selection: str) -> set[str]:
    """Names of the columns a selection uses."""
    return {t for t in _tokens(selection) if _is_column(t)}


def selection_for(region: str | Region, additional: str | None = None) -> str:
    """Selection of a region, optionally narrowed by another one in either dialect."""
    base = config.SELECTIONS[analysis_region(region)]
    if additional is None:
        return base
    return f"({base}) & ({selection_as_numexpr(additional)})"


def _is_condition(tokens: list[str], start: int, end: int) -> bool:
    """Is ``tokens[start:end]``, once its own brackets are peeled, an operand of a logical operator?"""
    while start > 0 and end < len(tokens) and tokens[start - 1] == "(" and tokens[end] == ")":
        start, end = start - 1, end + 1
    before = tokens[start - 1] if start > 0 else "AND"
    after = tokens[end] if end < len(tokens) else "AND"
    return before in {"AND", "OR", "NOT", "("} and after in {"AND", "OR", ")"}


def _typed(tokens: list[str], types: dict[str, T.DataType]) -> list[str]:
    def boolean(token):
        return _is_column(token) and isinstance(types[token], T.BooleanType)

    def floating(token):
        return _is_column(token) and isinstance(types[token], (T.DoubleType, T.FloatType))

    def simple(token):
        return _is_column(token) or _is_number(token) or token in ("true", "false")

    def quoted(token):
        return f"`{token}`" if _is_column(token) else token

    def comparison(left, op, right):
        if not _is_column(left) and _is_column(right):
            left, op, right = right, _FLIP[op], left
        if boolean(left) and _is_number(right):
            if float(right) not in (0.0, 1.0):
                raise ValueError(f"flag {left} compared with {right}")
            right = "true" if float(right) else "false"
        elif boolean(left) and _is_column(right) and not boolean(right):
            return ["(", f"CAST({quoted(left)} AS INT)", op, quoted(right), ")"]
        elif _is_column(left) and not boolean(left):
            if boolean(right):
                right = f"CAST({quoted(right)} AS INT)"
            right = {"true": "1", "false": "0"}.get(right, right)
        unordered = []
        if op in (">", ">=") and floating(left):
            unordered = [left]
        elif op in ("<", "<=") and floating(right):
            unordered = [right]
        elif op == "==" and floating(left) and floating(right):
            unordered = [left]
        guards = "".join(f" AND NOT isnan(`{c}`)" for c in unordered)
        if right.startswith("CAST("):
            return ["(", quoted(left), op, right, guards, ")"]
        return ["(", quoted(left), op, quoted(right), guards, ")"]

    out, i = [], 0
    while i < len(tokens):
        token = tokens[i]
        window = tokens[i : i + 3]
        if (
            len(window) == 3
            and window[1] in _COMPARE
            and simple(window[0])
            and simple(window[2])
            and _is_condition(tokens, i, i + 3)
        ):
            out += comparison(*window)
            i += 3
            continue
        if _is_column(token):
            bare = _is_condition(tokens, i, i + 1)
            out.append(f"(`{token}` <> 0)" if bare and not boolean(token) else quoted(token))
        elif token == "NOT":
            end = _operand_end(tokens, i + 1)
            out += ["(", "NOT", *_typed_operand(tokens, i + 1, end, types), ")"]
            i = end
            continue
        else:
            out.append(token)
        i += 1
    return out


def _typed_operand(tokens, start, end, types):
    if tokens[start] == "(":
        return ["(", *_typed(tokens[start + 1 : end - 1], types), ")"]
    return _typed(tokens[start:end], types)


def selection_sql(selection: str, schema: T.StructType) -> str:
    """SQL text of a selection for a table with the given schema."""
    tokens = _tokens(selection)
    types = {field.name: field.dataType for field in schema.fields}
    unknown = sorted(t for t in tokens if _is_column(t) and t not in types)
    if unknown:
        raise ValueError(f"selection uses columns the table does not have: {', '.join(unknown)}")
    return " ".join(t for t in _typed(_bracketed(tokens), types) if t)
