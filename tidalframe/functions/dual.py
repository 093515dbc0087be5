"""One formula, two renderings: a Spark column, or the text of an SQL expression.

Formulas in this package take a set of math functions ``m`` as first argument and use Python operators on their
other arguments. With ``COLUMN`` they build native columns, which stay inside whole-stage
code generation; with ``SQL`` they give the text for another engine to check them with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Text:
    """The text of an SQL expression of type double, bigint or boolean."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    @staticmethod
    def of(x) -> str:
        if isinstance(x, Text):
            return x.text
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return f"({x})" if isinstance(x, int) else f"({float(x):.17e})"

    def _two(self, op: str, other, swap: bool = False) -> Text:
        a, b = self.text, Text.of(other)
        return Text(f"({b} {op} {a})" if swap else f"({a} {op} {b})")

    def __add__(self, o):
        return self._two("+", o)

    def __radd__(self, o):
        return self._two("+", o, True)

    def __sub__(self, o):
        return self._two("-", o)

    def __rsub__(self, o):
        return self._two("-", o, True)

    def __mul__(self, o):
        return self._two("*", o)

    def __rmul__(self, o):
        return self._two("*", o, True)

    def __truediv__(self, o):
        return self._two("/", o)

    def __rtruediv__(self, o):
        return self._two("/", o, True)

    def __neg__(self):
        return Text(f"(-{self.text})")

    def __lt__(self, o):
        return self._two("<", o)

    def __le__(self, o):
        return self._two("<=", o)

    def __gt__(self, o):
        return self._two(">", o)

    def __ge__(self, o):
        return self._two(">=", o)

    def __and__(self, o):
        return self._two("AND", o)

    def __or__(self, o):
        return self._two("OR", o)


class _Column:
    """Math on Spark columns."""

    def col(self, name: str) -> Column:
        return F.col(name)

    def lit(self, x) -> Column:
        return F.lit(x)

    def when(self, test, yes, no):
        return F.when(test, yes).otherwise(no)

    def __getattr__(self, name: str):
        names = {"least": F.least, "greatest": F.greatest}
        if name in names:
            return lambda *x: names[name](*[y if isinstance(y, Column) else F.lit(y) for y in x])
        f = getattr(F, name)
        return lambda *x: f(*x)

    def round(self, x, digits: int):
        return F.round(x, digits) + F.lit(0.0)

    def shift_left(self, x, n: int):
        return F.shiftleft(x, n)

    def shift_right(self, x, n: int):
        return F.shiftright(x, n)

    def bit_and(self, x, y: int):
        return x.bitwiseAND(F.lit(y))

    def bit_or(self, x, y):
        return x.bitwiseOR(y)


class _Sql:
    """The same math as SQL text."""

    def col(self, name: str) -> Text:
        return Text(name)

    def lit(self, x) -> Text:
        return Text(Text.of(x))

    def when(self, test, yes, no):
        return Text(f"(CASE WHEN {Text.of(test)} THEN {Text.of(yes)} ELSE {Text.of(no)} END)")

    def __getattr__(self, name: str):
        return lambda *x: Text(f"{name}({', '.join(Text.of(y) for y in x)})")

    def round(self, x, digits: int):
        return Text(f"(round({Text.of(x)}, {digits}) + 0.0e0)")

    def shift_left(self, x, n: int):
        return Text(f"({Text.of(x)} << {n})")

    def shift_right(self, x, n: int):
        return Text(f"({Text.of(x)} >> {n})")

    def bit_and(self, x, y: int):
        return Text(f"({Text.of(x)} & {y})")

    def bit_or(self, x, y):
        return Text(f"({Text.of(x)} | {Text.of(y)})")


COLUMN, SQL = _Column(), _Sql()
