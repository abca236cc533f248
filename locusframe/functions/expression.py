"""A small expression language over tags, compiled to columns.

Tags arrive as text, so the other operand decides how they compare: as doubles beside a real number, as integers beside an integer, else by
text. Null stands for an evaluation that is refused: an absent tag, text that is no number, a zero divisor.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>0[xX][0-9a-fA-F]+[lL]?|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[lLdDfFhHbB]?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>&&|\|\||[=!<>]=|=~|!~|[-+*/%<>!()]))""")
# Words that stand for operators.
_WORDS = {"and": "&&", "or": "||", "not": "!", "eq": "==", "ne": "!=", "lt": "<", "gt": ">", "le": "<=", "ge": ">=", "div": "/", "mod": "%"}
_REAL, _WHOLE = ("float", "double"), ("int", "long")


class ExpressionError(ValueError):
    """Text that is not in the language."""


@dataclass
class Value:
    kind: str  # text, int, long, float, double, bool or null
    column: Column

    def as_double(self) -> Column:
        return self.column.try_cast("double") if self.kind == "text" else self.column.cast("double")

    def as_long(self) -> Column:
        if self.kind == "text":
            return F.when(self.column == "", F.lit(0)).otherwise(F.when(self.column.rlike(r"^[+-]?[0-9]+$"), self.column.try_cast("long"))).cast("long")
        return self.column.cast("long")

    def as_text(self) -> Column:
        return self.column.cast("string")

    def as_bool(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "text":
            return F.lower(self.column) == "true"
        return F.lit(None).cast("boolean") if self.kind == "null" else self.column != 0


class _Parser:
    def __init__(self, text: str, variable: Callable[[str], Column]):
        self.text, self.variable, self.tokens, pos = text, variable, [], 0
        while text[pos:].strip():
            m = _TOKEN.match(text, pos)
            if not m:
                raise ExpressionError(f"can't read {text[pos:]!r}")
            kind, value = m.lastgroup, m[m.lastgroup]
            self.tokens.append(("op", _WORDS[value]) if kind == "name" and value in _WORDS else (kind, value))
            pos = m.end()
        self.at = 0

    def accept(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def parse(self) -> Value:
        out = self.disjunction()
        if self.at < len(self.tokens):
            raise ExpressionError(f"{self.tokens[self.at][1]!r} is not expected in {self.text!r}")
        return out

    def _chain(self, lower: Callable[[], Value], ops: tuple[str, ...], join: Callable[[str, Value, Value], Value]) -> Value:
        out = lower()
        while op := self.accept(*ops):
            out = join(op, out, lower())
        return out

    def disjunction(self) -> Value:
        return self._chain(self.conjunction, ("||",), lambda _, a, b: Value("bool", F.when(a.as_bool(), F.lit(True)).when(~a.as_bool(), b.as_bool())))

    def conjunction(self) -> Value:
        return self._chain(self.equality, ("&&",), lambda _, a, b: Value("bool", F.when(~a.as_bool(), F.lit(False)).when(a.as_bool(), b.as_bool())))

    def equality(self) -> Value:
        return self._chain(self.relation, ("==", "!="), lambda op, a, b: Value("bool", _equal(a, b) if op == "==" else ~_equal(a, b)))

    def relation(self) -> Value:
        return self._chain(self.sum, ("<", ">", "<=", ">="), _order)

    def sum(self) -> Value:
        return self._chain(self.product, ("+", "-"), _arithmetic)

    def product(self) -> Value:
        return self._chain(self.unary, ("*", "/", "%"), _arithmetic)

    def unary(self) -> Value:
        if self.accept("!"):
            return Value("bool", ~self.unary().as_bool())
        if self.accept("-"):
            v = self.unary()
            if v.kind == "text":
                return Value("long", -v.as_long())
            return Value(v.kind, -v.column)
        return self.primary()

    def primary(self) -> Value:
        if self.accept("("):
            out = self.disjunction()
            if not self.accept(")"):
                raise ExpressionError(f"a bracket is open in {self.text!r}")
            return out
        if self.at == len(self.tokens):
            raise ExpressionError(f"{self.text!r} ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return _number(value)
        if kind == "str":
            return Value("text", F.lit(re.sub(r"\\(.)", r"\1", value[1:-1])))
        if kind == "name":
            if value in ("true", "false"):
                return Value("bool", F.lit(value == "true"))
            if value == "null":
                return Value("null", F.lit(None).cast("string"))
            if value == "empty" and self.at < len(self.tokens):
                v = self.unary()
                return Value("bool", F.lit(True) if v.kind == "null" else v.as_text() == "")
            return Value("text", self.variable(value))
        raise ExpressionError(f"{value!r} is not expected in {self.text!r}")


def _number(text: str) -> Value:
    last = text[-1].lower()
    if text.lower().startswith("0x"):
        n = int(text.rstrip("lL"), 16)
    elif last in "hb":
        raise ExpressionError(f"big numbers are not supported: {text}")
    elif last in "df" or re.search(r"[.eE]", text):
        return Value("double" if last == "d" else "float", F.lit(float(text.rstrip("dDfF"))).cast("double" if last == "d" else "float"))
    else:
        digits = text.rstrip("lL")
        n = int(digits, 8) if len(digits) > 1 and digits[0] == "0" else int(digits)
    small = last != "l" and n < 2**31
    return Value("int" if small else "long", F.lit(n).cast("int" if small else "long"))


def _compare(a: Value, b: Value, test: Callable[[Column, Column], Column]) -> Column:
    """By double if either is real, by integer if either is whole, else by text. NaN equals itself and comes before all numbers."""
    if a.kind in _REAL or b.kind in _REAL:
        x, y = a.as_double(), b.as_double()
        rank = [F.when(F.isnan(v), F.lit(float("-inf"))).otherwise(v) for v in (x, y)]
        tie = [F.when(F.isnan(v), 0).otherwise(1) for v in (x, y)]
        return F.when(x.isNotNull() & y.isNotNull(), test(F.struct(rank[0].alias("v"), tie[0].alias("t")), F.struct(rank[1].alias("v"), tie[1].alias("t"))))
    if a.kind in _WHOLE or b.kind in _WHOLE:
        return test(a.as_long(), b.as_long())
    return test(a.as_text(), b.as_text())


def _equal(a: Value, b: Value) -> Column:
    if "null" in (a.kind, b.kind):
        return F.lit(a.kind == b.kind)
    if "bool" in (a.kind, b.kind):
        return a.as_bool() == b.as_bool()
    return _compare(a, b, lambda x, y: x == y)


def _order(op: str, a: Value, b: Value) -> Value:
    if "null" in (a.kind, b.kind):
        return Value("bool", F.lit(False))
    tests = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    return Value("bool", _compare(a, b, tests[op]))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    """In doubles beside a real number, else in integers; a sum of text that is no number joins the text."""
    if "null" in (a.kind, b.kind):
        return Value("long", F.lit(None).cast("long"))
    if a.kind in _REAL or b.kind in _REAL:
        x, y = a.as_double(), b.as_double()
        column = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y), "%": F.when(y != 0, x % y)}[op]
        if op == "+" and "text" in (a.kind, b.kind):
            joined = F.concat(a.as_text(), b.as_text())
            return Value("text", F.coalesce(column.cast("string"), joined))
        return Value("double", column)
    x, y = a.as_long(), b.as_long()
    whole = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, F.floor(F.abs(x) / F.abs(y)) * F.signum(x) * F.signum(y)).cast("long"), "%": F.when(y != 0, x % y)}[op]
    if op == "+" and "text" in (a.kind, b.kind):
        return Value("text", F.coalesce(whole.cast("string"), F.concat(a.as_text(), b.as_text())))
    return Value("long", whole)


def compile_expression(text: str, variable: Callable[[str], Column] | None = None) -> Value:
    """The value of an expression; variable gives the column of a name, by default the text of the tag so named."""
    from locusframe.operators.reads import tag

    return _Parser(text, variable or tag).parse()


def compile_predicate(text: str, variable: Callable[[str], Column] | None = None) -> Column:
    """true or false where the expression is boolean, false where it is anything else, null where it is refused or null."""
    v = compile_expression(text, variable)
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    return v.column if v.kind == "bool" else F.when(v.column.isNotNull(), F.lit(False))
