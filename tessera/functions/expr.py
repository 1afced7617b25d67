"""Expressions that take their meaning from the verb they stand in.

An expression is a small tree. A verb turns it into a Spark Column in its context: an aggregate is a plain aggregate
in `summarize` and a window function in `mutate`, wherever in the tree it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Context:
    """What a verb offers to its expressions. kind: 'summarize', 'window' or 'row'."""

    df: DataFrame
    kind: str = "row"
    window: Callable[..., WindowSpec] | None = None
    scopes: dict[str, dict[str, str]] = field(default_factory=dict)
    held: dict[int, Column] = field(default_factory=dict)  # aggregates (by id) that stand as columns already

    def name(self, name: str) -> str:
        """The current name of a column that may be qualified by a table."""
        if name not in self.df.columns and "." in name:
            table, _, column = name.rpartition(".")
            got = self.scopes.get(table, {}).get(column)
            if got in self.df.columns:
                return got
        return name

    def type(self, column: Column) -> T.DataType:
        return self.df.select(column).schema[0].dataType


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


class Expr:
    """Base of all expressions: operators and methods build larger ones."""

    def column(self, ctx: Context) -> Column:
        raise NotImplementedError

    def _op(self, symbol: str, other, swap: bool = False) -> Expr:
        a, b = (lift(other), self) if swap else (self, lift(other))
        return Op(symbol, (a, b))

    def __add__(self, o):
        return self._op("+", o)

    def __radd__(self, o):
        return self._op("+", o, True)

    def __sub__(self, o):
        return self._op("-", o)

    def __rsub__(self, o):
        return self._op("-", o, True)

    def __mul__(self, o):
        return self._op("*", o)

    def __rmul__(self, o):
        return self._op("*", o, True)

    def __truediv__(self, o):
        return self._op("/", o)

    def __rtruediv__(self, o):
        return self._op("/", o, True)

    def __mod__(self, o):
        return self._op("%", o)

    def __pow__(self, o):
        return self._op("^", o)

    def __rpow__(self, o):
        return self._op("^", o, True)

    def __eq__(self, o):
        return self._op("==", o)

    def __ne__(self, o):
        return self._op("!=", o)

    def __lt__(self, o):
        return self._op("<", o)

    def __le__(self, o):
        return self._op("<=", o)

    def __gt__(self, o):
        return self._op(">", o)

    def __ge__(self, o):
        return self._op(">=", o)

    def __and__(self, o):
        return self._op("&", o)

    def __rand__(self, o):
        return self._op("&", o, True)

    def __or__(self, o):
        return self._op("|", o)

    def __ror__(self, o):
        return self._op("|", o, True)

    def __invert__(self):
        return Call(lambda ctx, a: ~a, (self,))

    def __neg__(self):
        return Call(lambda ctx, a: -a, (self,))

    __hash__ = object.__hash__

    def __bool__(self):
        raise TypeError("use & | ~ in place of and, or, not")

    def isin(self, *values) -> Expr:
        items = values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values
        return Call(lambda ctx, a: a.isin(list(items)), (self,))

    def __getitem__(self, key) -> Expr:
        from .helpers import element

        return element(self, key)

    def field(self, name: str) -> Expr:
        """A field of a struct."""
        return Call(lambda ctx, a: a.getField(name), (self,))

    def __getattr__(self, name: str):
        """Any function by name, with this expression as first argument: col("x").upper()."""
        if name.startswith("_"):
            raise AttributeError(name)
        from . import helpers

        return lambda *args: getattr(helpers, name, None)(self, *args) if hasattr(helpers, name) else helpers.fn(name, self, *map(lift, args))


@dataclass(eq=False)
class Col(Expr):
    path: str

    def column(self, ctx: Context) -> Column:
        name = ctx.name(self.path)
        if name in ctx.df.columns or "." not in name:
            return F.col(quoted(name))
        head, _, rest = name.partition(".")
        return F.col(".".join(map(quoted, [head, *rest.split(".")])))


@dataclass(eq=False)
class Lit(Expr):
    value: object

    def column(self, ctx: Context) -> Column:
        return F.lit(self.value)


@dataclass(eq=False)
class Raw(Expr):
    """A Spark Column, or SQL text. No window is put around aggregates in it."""

    value: Column | str

    def column(self, ctx: Context) -> Column:
        return F.expr(self.value) if isinstance(self.value, str) else self.value


@dataclass(eq=False)
class Call(Expr):
    """A function of the row: build(ctx, *columns)."""

    build: Callable[..., Column]
    args: Sequence[Expr] = ()

    def column(self, ctx: Context) -> Column:
        return self.build(ctx, *(a.column(ctx) for a in self.args))


def divided(a: Column, b: Column) -> Column:
    """Float division; a zero divisor gives an infinity or NaN."""
    x, y = a.cast("double"), b.cast("double")
    sign = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    at_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).otherwise(sign)
    return F.when(y == 0, F.when(x.isNotNull(), at_zero)).otherwise(F.try_divide(x, y))


@dataclass(eq=False)
class Op(Expr):
    symbol: str
    args: tuple[Expr, Expr]

    def column(self, ctx: Context) -> Column:
        a, b = (x.column(ctx) for x in self.args)
        if self.symbol == "/":
            if isinstance(self.args[1], Lit) and self.args[1].value:
                return a.cast("double") / b.cast("double")
            return divided(a, b)
        if self.symbol == "^":
            return F.pow(a, b)
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "==": lambda: a == b, "!=": lambda: a != b,
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "&": lambda: a & b, "|": lambda: a | b,
        }[self.symbol]()


@dataclass(eq=False)
class Agg(Expr):
    """An aggregate: build(over, *columns), where `over` puts the verb's window around each plain aggregate."""

    label: str
    build: Callable[..., Column]
    args: Sequence[Expr] = ()
    typed: bool = False  # build also takes the arguments' types, after `over`
    level: float | None = None  # of a continuous quantile of one argument

    def column(self, ctx: Context) -> Column:
        if id(self) in ctx.held:
            return ctx.held[id(self)]
        if ctx.kind == "row":
            raise ValueError(f"{self.label} is an aggregate; use it in summarize, mutate or transmute")
        over = (lambda c: c) if ctx.kind == "summarize" else (lambda c: c.over(ctx.window()))
        inner = Context(ctx.df, "row", None, ctx.scopes)
        columns = [a.column(inner) for a in self.args]
        return self.build(over, [inner.type(c) for c in columns], *columns) if self.typed else self.build(over, *columns)


@dataclass(eq=False)
class Win(Expr):
    """A window function. frame: 'none' drops the user's frame, 'user' keeps it, 'running' is from the start to here."""

    label: str
    build: Callable[..., Column]
    args: Sequence[Expr] = ()
    frame: str = "none"
    cast: str | None = None
    typed: bool = False  # build takes the arguments' types first

    def column(self, ctx: Context) -> Column:
        if ctx.kind != "window":
            raise ValueError(f"{self.label} is a window function; use it in mutate or transmute")
        inner = Context(ctx.df, "row", None, ctx.scopes)
        columns = [a.column(inner) for a in self.args]
        made = self.build([inner.type(c) for c in columns], *columns) if self.typed else self.build(*columns)
        out = made.over(ctx.window(frame=self.frame, ordered=True))
        return out.cast(self.cast) if self.cast else out


@dataclass(eq=False)
class Forced(Expr):
    """agg(x): x is an aggregate known to Spark, windowed in mutate."""

    inner: Expr

    def column(self, ctx: Context) -> Column:
        if ctx.kind == "summarize":
            raise ValueError("agg() is for mutate; summarize aggregates as it is")
        if ctx.kind != "window":
            raise ValueError("agg() is for mutate and transmute")
        if isinstance(self.inner, Agg):
            return self.inner.column(ctx)
        return self.inner.column(Context(ctx.df, "row", None, ctx.scopes)).over(ctx.window())


@dataclass(eq=False)
class Sub(Expr):
    """A table of one row and column, as a value."""

    table: object

    def column(self, ctx: Context) -> Column:
        return self.table.df_now().scalar()


@dataclass(eq=False)
class Desc(Expr):
    inner: Expr

    def column(self, ctx: Context) -> Column:
        return self.inner.column(ctx)


def lift(x) -> Expr:
    """A value in an expression: expressions and columns stay, tables are scalar sub-queries, the rest is literal."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, Column):
        return Raw(x)
    if hasattr(x, "df_now"):
        return Sub(x)
    return Lit(x)


def named(x) -> Expr:
    """An argument of a function: text names a column."""
    return Col(x) if isinstance(x, str) else lift(x)


def stated(x) -> Expr:
    """An argument of a verb: text is SQL."""
    return Raw(x) if isinstance(x, str) else lift(x)


def parts(e) -> list:
    """The nodes of an expression tree."""
    below = [*vars(e).get("args", ())]
    if isinstance(e, (Forced, Desc)):
        below += e.inner if isinstance(e.inner, (list, tuple)) else [e.inner]
    return [e, *(x for b in below for x in parts(b))]


def mentions(e: Expr, names) -> bool:
    """Whether the expression may refer to one of the names; of SQL text each word counts."""
    for x in parts(e):
        if isinstance(x, Col) and (x.path in names or x.path.split(".")[0] in names):
            return True
        if isinstance(x, Raw) and any(n in str(x.value) for n in names):
            return True
    return False


def aggregates(e: Expr, df: DataFrame) -> bool:
    """Whether the expression holds an aggregate; SQL text and Spark Columns are asked of Spark's analysis."""
    for x in parts(e):
        if isinstance(x, (Agg, Forced)):
            return True
        if isinstance(x, Raw):
            try:
                plan = df.select(x.column(Context(df)))._jdf.queryExecution().analyzed()
            except AnalysisException:  # an aggregate beside a bare column, or no valid expression, which is told later
                return True
            if plan.getClass().getSimpleName() == "Aggregate":
                return True
    return False


def keys(items, ctx: Context) -> list[Column]:
    """Sort keys, nulls last in both directions. An integer is the place of a column, from 1."""
    out = []
    for x in items:
        if isinstance(x, int):
            x = Col(ctx.df.columns[x - 1])
        e = named(x)
        if isinstance(e, Desc):
            inner = e.inner if isinstance(e.inner, (list, tuple)) else [e.inner]
            out += [named(i).column(ctx).desc_nulls_last() for i in inner]
        else:
            out.append(e.column(ctx).asc_nulls_last())
    return out
