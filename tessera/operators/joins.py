"""Joins: key forms, the output contract, and as-of joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Col, Expr, Op, quoted

KEY = re.compile(r"^\s*([\w.]+)\s*(==|=|<=|>=|<|>|!=)\s*([\w.]+)\s*$")
#: Pieces into which an as-of join cuts the range of its key where one group of equal keys may hold most rows, and the
#: estimated bytes of both sides up to which one task could hold such a group.
PIECES = 64
ONE_TASK = 256 << 20
HOW = {"left": "left", "right": "right", "inner": "inner", "full": "full", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class Key:
    left: str
    op: str
    right: str
    closest: bool = False


def key(x) -> Key:
    """'id', 'id == id2', 'a >= b', 'closest(a >= b)', ('id', 'id2'), or col('a') >= col('b')."""
    if isinstance(x, Key):
        return x
    if isinstance(x, tuple):
        return Key(x[0], "==", x[1])
    if isinstance(x, Op) and all(isinstance(a, Col) for a in x.args):
        return Key(x.args[0].path, x.symbol, x.args[1].path)
    if isinstance(x, Col):
        return Key(x.path, "==", x.path)
    if isinstance(x, Expr):
        raise ValueError("a join key compares a column of each table")
    if m := re.match(r"^\s*closest\((.*)\)\s*$", x):
        return closest(m[1])
    if m := KEY.match(x):
        return Key(m[1], "==" if m[2] == "=" else m[2], m[3])
    return Key(x, "==", x)


def closest(x) -> Key:
    """The one inequality of an as-of join: the nearest right row on that side."""
    k = key(x)
    if k.op not in ("<", "<=", ">", ">="):
        raise ValueError("closest() takes <, <=, > or >=")
    return Key(k.left, k.op, k.right, True)


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def unique(name: str, taken: set[str]) -> str:
    k = 1
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def joined(left: DataFrame, right: DataFrame, how: str, keys: list[Key], hint: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The join, and what each right column is called in it.

    Equality keys come first, coalesced, under their left names; then the other left columns; then the right columns
    but for equality keys, renamed name_1, name_2, … where the left has the name. Semi and anti joins keep the left
    columns as they are. Null keys match nothing. hint: 'broadcast', 'merge', 'shuffle_hash'; for an as-of join 'skew'
    or 'even'. It deals a hot key over several tasks if there are no equal keys, 'skew' says so, or the sides are
    estimated at more than ONE_TASK bytes and 'even' is not said."""
    mapped = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    r = right.toDF(*mapped.values())
    if hint and hint not in ("skew", "even"):
        r = r.hint(hint)
    near = [k for k in keys if k.closest]
    if len(near) > 1:
        raise ValueError("one closest() only")
    equal = [k for k in keys if k.op == "==" and not k.closest]
    theta = [k for k in keys if k.op != "==" and not k.closest]
    if near:
        if theta:
            raise ValueError("an as-of join has one inequality, in closest()")
        b = mapped[near[0].right]
        dealt = hint == "skew" or not equal or hint != "even" and _bytes(left) + _bytes(r) > ONE_TASK
        ordered = isinstance(r.schema[b].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        out = asof(left, r, [(k.left, mapped[k.right]) for k in equal], near[0].left, near[0].op, b, how, PIECES if dealt and ordered else 1)
    elif keys:
        on = None
        for k in keys:
            c = _compare(F.col(quoted(k.left)), k.op, F.col(mapped[k.right]))
            on = c if on is None else on & c
        out = left.join(r, on, HOW[how])
    else:
        raise ValueError("a join needs keys")
    if how in ("semi", "anti"):
        return out.select(*map(_q, left.columns)), {}
    first = {k.left: k.right for k in equal}
    names = [*first, *(c for c in left.columns if c not in first)]
    cols = [F.coalesce(_q(a), F.col(mapped[b])).alias(a) for a, b in first.items()] + [_q(c) for c in names[len(first) :]]
    taken, called = set(names), {b: a for a, b in first.items()}
    for c in right.columns:
        if c not in first.values():
            called[c] = unique(c, taken | set(right.columns)) if c in taken else c
            taken.add(called[c])
            cols.append(F.col(mapped[c]).alias(called[c]))
    return out.select(*cols), called


def _q(name: str) -> Column:
    return F.col(quoted(name))


def _bytes(df: DataFrame) -> int:
    """Spark's estimate of the table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _bounds(right: DataFrame, b: str, pieces: int) -> Column:
    """Keys that deal the right rows into pieces of about one size: a scalar sub-query, so nothing runs before a sink."""
    shares = [i / pieces for i in range(1, pieces)]
    got = right.agg(F.array_distinct(F.percentile_approx(_number(F.col(b), right.schema[b].dataType), shares, 10_000)).alias("b"))
    return F.coalesce(got.scalar(), F.array().cast("array<double>"))


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        c = c.cast("timestamp")
    return F.unix_micros(c.cast("timestamp")).cast("double") if isinstance(kind, (T.DatetimeType, T.TimestampNTZType)) else c.cast("double")


def asof(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], a: str, op: str, b: str, how: str, pieces: int = 1) -> DataFrame:
    """Each left row with the right row of the nearest key on the side that `op` allows, among equal other keys.

    Both sides are laid in one table, ordered by the key, and every left row takes the last right row before it: one
    shuffle by the other keys and one pass, without a join. A right row is taken if a left row follows it, so right
    and full joins need no second look at the right side. With pieces > 1 the key's range is cut too, so that rows of
    one hot key are dealt over so many tasks: each piece's last right row is carried over to the later ones. Rows that
    lack a key match nothing and are dealt by the task that read them, so a common null does not fill a task either.
    Right keys should be unique: among ties the pick is arbitrary."""
    names, right_names = left.columns, right.columns
    down = op in ("<", "<=")
    kept = how in ("right", "full")
    groups = [f"__g{i}" for i in range(len(equal))]
    kind = left.select(_q(a)).union(right.select(F.col(b)).limit(0)).schema[0].dataType
    own = left.select(F.struct(*map(_q, names)).alias("__l"), F.lit(None).cast(right.select(F.struct(*right_names)).schema[0].dataType).alias("__r"), *[_q(l).alias(g) for g, (l, _) in zip(groups, equal)], _q(a).cast(kind).alias("__k"), F.lit(0).alias("__side"))
    side = 1 if op in ("<", ">") else -1  # a tie counts unless the comparison is strict
    other = right.select(F.lit(None).cast(own.schema["__l"].dataType).alias("__l"), F.struct(*right_names).alias("__r"), *[F.col(r).alias(g) for g, (_, r) in zip(groups, equal)], F.col(b).cast(kind).alias("__k"), F.lit(side).alias("__side"))
    whole = F.col("__k").isNotNull()
    for g in groups:
        whole = whole & F.col(g).isNotNull()
    both, piece = own.unionByName(other).withColumn("__whole", whole), F.lit(0)
    if pieces > 1:
        both = both.withColumn("__b", _bounds(right.select(F.col(b).cast(kind).alias(b)), b, pieces))
        piece = F.size(F.filter("__b", lambda x: x <= _number(F.col("__k"), kind)))
    both = both.withColumn("__p", F.when(F.col("__whole"), piece).otherwise(-1 - F.spark_partition_id() % 64)).drop("__b")
    # where a piece's last right row is carried and must not stand alone too, ties need one order everywhere
    both = both.withColumn("__t", F.shiftright(F.xxhash64(F.to_json("__r")), 1) if kept and pieces > 1 else F.lit(0))
    w = Window.partitionBy(*groups, "__p").orderBy(F.col("__k").desc() if down else F.col("__k").asc(), "__side", "__t")
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if kept:
        found = found.withColumn("__next", F.lead("__side").over(w))
    else:
        found = found.filter("__side = 0")
    match, follows = F.col("__m"), F.col("__next")
    if pieces > 1:
        edge = F.when(F.col("__r").isNotNull(), F.struct("__k", -F.col("__t") if down else F.col("__t")))
        last = (F.min_by if down else F.max_by)("__r", edge)
        first = (F.max_by if down else F.min_by)("__side", F.struct("__k", -F.col("__side") if down else F.col("__side")))
        ends = both.filter("__whole").groupBy(*groups, "__p").agg(last.alias("__last"), first.alias("__first"))
        step = Window.partitionBy(*groups).orderBy(F.col("__p").desc() if down else F.col("__p").asc())
        carried = ends.withColumn("__carry", F.last("__last", ignorenulls=True).over(step.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__after", F.lead("__first").over(step))
        carried = carried.select(*[F.col(c).alias(f"{c}c") for c in [*groups, "__p"]], "__carry", "__after")
        on = F.col("__p") == F.col("__pc")
        for g in groups:
            on = on & (F.col(g) == F.col(f"{g}c"))
        found = found.join(carried, on, "left")
        match, follows = F.coalesce("__m", "__carry"), F.coalesce("__next", "__after")
    found = found.withColumn("__m", F.when(F.col("__whole") & (F.col("__side") == 0), match))
    if how == "semi":
        return found.filter(F.col("__m").isNotNull()).select("__l.*")
    if how == "anti":
        return found.filter(F.col("__m").isNull()).select("__l.*")
    if how == "inner":
        found = found.filter(F.col("__m").isNotNull())
    if kept:
        mine = F.col("__side") == 0
        alone = ~mine & ~(F.col("__whole") & F.coalesce(follows == 0, F.lit(False)))
        found = found.filter((mine & F.col("__m").isNotNull() if how == "right" else mine) | alone)
        found = found.withColumn("__m", F.when(mine, F.col("__m")).otherwise(F.col("__r")))
    return found.select(*[F.col("__l").getField(c).alias(c) for c in names], *[F.col("__m").getField(c).alias(c) for c in right_names])
