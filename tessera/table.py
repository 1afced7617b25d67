"""Tidy verbs as methods of an immutable table over a DataFrame."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import options
from .functions import helpers
from .functions.expr import Agg, Col, Context, Expr, aggregates, keys, mentions, parts, quoted, stated
from .operators import joins, quantiles, reshape, windows
from .operators.selectors import Across, resolve


#: Aggregates whose states are large, or grow with the values that they have seen.
LARGE = {"approx_distinct", "median", "quantile", "approx_quantile", "mode", "collect_list", "string_agg"}


def _q(name: str) -> Column:
    return F.col(quoted(name))


@dataclass(frozen=True)
class Tbl:
    """A lazy table. Each verb gives a new one; nothing runs before a sink.

    Grouping, window order and frame hold until the verb that consumes them; order and limit are applied at the end,
    wherever in the chain they were asked for."""

    df: DataFrame
    groups: tuple[str, ...] = ()
    worder: tuple = ()
    wframe: tuple | None = None
    order: tuple = ()
    limit_: int | None = None
    scopes: dict = field(default_factory=dict)
    trace: tuple[str, ...] = ()
    grouped_only: bool = False

    # plumbing

    def _name(self, n: str) -> str:
        return self._ctx().name(n)

    def _ctx(self, kind: str = "row", groups=None, order=None, frame=None, df: DataFrame | None = None) -> Context:
        df = self.df if df is None else df
        base = Context(df, "row", None, self.scopes)
        window = None
        if kind == "window":
            by = [_q(g) for g in (groups or ())]

            def window(frame_kind: str = "user", ordered: bool = False, **kw):
                return windows.spec(by, keys(order or (), base), frame, kw.get("frame", frame_kind), ordered)

        return Context(df, kind, window, self.scopes)

    def _next(self, verb: str, df: DataFrame | None = None, **changes) -> Tbl:
        return replace(self, df=self.df if df is None else df, trace=(*self.trace, verb), **({"grouped_only": False} | changes))

    def _pick(self, items) -> list[str]:
        return resolve(items, self.df.columns, self._name)

    def _by(self, by) -> tuple[str, ...]:
        if by is None:
            return self.groups
        return tuple(self._pick(by if isinstance(by, (list, tuple)) else [by]))

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def df_now(self) -> DataFrame:
        """The DataFrame with the pending distinct groups, order and limit applied."""
        df = self.df.select(*map(_q, self.groups)).distinct() if self.groups and self.grouped_only else self.df
        if self.order:
            df = df.orderBy(*keys(self.order, Context(df, "row", None, self.scopes)))
        return df if self.limit_ is None else df.limit(self.limit_)

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    def tap(self, f: Callable[[Tbl], object]) -> Tbl:
        """Calls f with the table, in the middle of a chain, and goes on."""
        f(self)
        return self

    # projection

    def select(self, *selection) -> Tbl:
        return self._next("select", self.df.select(*map(_q, self._pick(selection))))

    def distinct(self, *selection) -> Tbl:
        """Distinct rows of the given columns, which are all that stay."""
        df = self.df.select(*map(_q, self._pick(selection))) if selection else self.df
        return self._next("distinct", df.distinct())

    def rename(self, **names: str) -> Tbl:
        """rename(new='old')."""
        old = {self._name(o): n for n, o in names.items()}
        if missing := [o for o in old if o not in self.df.columns]:
            raise KeyError(f"no column {missing}")
        scopes = {t: {c: old.get(now, now) for c, now in m.items()} for t, m in self.scopes.items()}
        return self._next("rename", self.df.withColumnsRenamed(old), scopes=scopes, groups=tuple(old.get(g, g) for g in self.groups))

    def relocate(self, *selection, before: str | None = None, after: str | None = None) -> Tbl:
        moved = self._pick(selection)
        rest = [c for c in self.df.columns if c not in moved]
        anchor = before or after
        if anchor is None:
            out = moved + rest
        else:
            anchor = self._name(anchor)
            if anchor in moved:
                raise ValueError("the anchor is among the moved columns")
            at = rest.index(anchor) + (after is not None)
            out = rest[:at] + moved + rest[at:]
        return self._next("relocate", self.df.select(*map(_q, out)))

    def _exprs(self, args, named: dict) -> dict[str, Expr | helpers.Unnest]:
        out: dict = {}
        for a in args:
            if isinstance(a, Across):
                out |= a.expand([c for c in self.df.columns if c not in self.groups], self._name)
            elif isinstance(a, dict):
                out |= a
            elif isinstance(a, helpers.Unnest):
                out[a.name] = a
            else:
                raise TypeError(f"give {a!r} a name")
        return out | named

    def _windowed(self, args, named, by, order, frame, keep: bool, verb: str) -> Tbl:
        exprs = self._exprs(args, named)
        groups = self._by(by)
        if options.warn and (self.groups or self.worder or self.wframe):
            warnings.warn(f"{verb} consumes the groups, window order and frame set before", stacklevel=3)
        order = self.worder if order is None else order if isinstance(order, (list, tuple)) else (order,)
        frame = self.wframe if frame is None else windows.frame_of(frame)
        names, df = self.df.columns, self.df
        made: dict[str, str] = {}  # the column that holds each result until the end
        pending: dict[str, Column] = {}
        for i, (k, e) in enumerate(exprs.items()):
            e = stated(e)
            if mentions(e, pending):  # a new column of this call: it is made first, whatever uses it
                df, pending = df.select("*", *pending.values()), {}
            made[k] = f"__m{i}" if k in names else k  # an old column keeps its value for the rest of the call
            pending[made[k]] = e.column(self._ctx("window", groups, order, frame, df)).alias(made[k])
        df = df.select("*", *pending.values())
        cols = [_q(made.get(c, c)).alias(c) for c in names] if keep else [_q(g) for g in groups if g not in made]
        cols += [_q(m).alias(k) for k, m in made.items() if not keep or k not in names]
        return self._next(verb, df.select(*cols), groups=(), worder=(), wframe=None)

    def mutate(self, *args, _by=None, _order=None, _frame=None, **named) -> Tbl:
        """New columns, or old ones replaced in place; aggregates are windows over _by, _order and _frame. A new column
        may be used by a later one of the same call, unless the table has a column of that name."""
        return self._windowed(args, named, _by, _order, _frame, True, "mutate")

    def transmute(self, *args, _by=None, _order=None, _frame=None, **named) -> Tbl:
        """As mutate, but only the groups and the new columns stay."""
        exprs = self._exprs(args, named)
        nested = [e for e in exprs.values() if isinstance(e, helpers.Unnest)]
        if nested:
            if len(exprs) > 1:
                raise ValueError("unnest() stands alone")
            return self._next("transmute", self.df.select(F.inline(_q(self._name(nested[0].name)))), groups=(), worder=(), wframe=None)
        return self._windowed((), exprs, _by, _order, _frame, False, "transmute")

    # rows

    def filter(self, *conditions) -> Tbl:
        df, ctx = self.df, self._ctx()
        for c in conditions:
            df = df.filter(stated(c).column(ctx))
        return self._next("filter", df, grouped_only=self.grouped_only)

    def drop_missing(self, *selection) -> Tbl:
        df = self.df
        for c in self._pick(selection) if selection else df.columns:
            df = df.filter(_q(c).isNotNull())
        return self._next("drop_missing", df)

    def arrange(self, *order) -> Tbl:
        """Order of the result, nulls last; text names a column, an integer is a place."""
        return self._next("arrange", order=order, grouped_only=self.grouped_only)

    def head(self, n: int = 6) -> Tbl:
        return self._next("head", limit_=n, grouped_only=self.grouped_only)

    def _slice(self, column, n: int, descending: bool, by) -> Tbl:
        key = helpers.desc(column) if descending else column
        w = windows.spec([_q(g) for g in self._by(by)], keys((key,), self._ctx()), None)
        df = self.df.withColumn("rank_col", F.rank().over(w)).filter(F.col("rank_col") <= n).withColumn("rank_col", F.col("rank_col").cast("long"))
        return self._next("slice", df, groups=())

    def slice_min(self, column, n: int = 1, _by=None) -> Tbl:
        """Rows of the n least values, by group, ties kept; rank_col stays."""
        return self._slice(column, n, False, _by)

    def slice_max(self, column, n: int = 1, _by=None) -> Tbl:
        return self._slice(column, n, True, _by)

    def slice_sample(self, n: int = 1, _by=None, seed: int | None = None) -> Tbl:
        """n rows at random, by group; row_num stays. Without groups the rows are ordered and cut, in no one task."""
        groups = [_q(g) for g in self._by(_by)]
        if not groups:
            df = self.df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")
            return self._next("slice_sample", df.withColumn("row_num", F.row_number().over(windows.spec([], [F.lit(1).asc()], None)).cast("long")), groups=())
        # the random number is a column first: ranking over it alone lets each task keep n rows a group before the shuffle
        w = windows.spec(groups, [F.col("__r").asc()], None)
        df = self.df.withColumn("__r", F.rand(seed)).withColumn("row_num", F.row_number().over(w)).filter(F.col("row_num") <= n)
        return self._next("slice_sample", df.drop("__r").withColumn("row_num", F.col("row_num").cast("long")), groups=())

    # groups

    def group_by(self, *selection, **named) -> Tbl:
        """Groups for the next summarize, mutate or slice; new ones by expression. Collected as it is, the distinct groups.
        'all' groups the next summarize by every expression without an aggregate."""
        df = self.df
        if selection == ("all",) and "all" not in df.columns:
            return self._next("group_by", groups=("all",))
        if named:
            ctx = self._ctx()
            df = df.withColumns({k: stated(e).column(ctx) for k, e in named.items()})
        picked = tuple(self._pick(selection)) if selection else ()
        return self._next("group_by", df, groups=(*picked, *named), grouped_only=True)

    def ungroup(self) -> Tbl:
        return self._next("ungroup", groups=())

    def summarize(self, *args, _by=None, **named) -> Tbl:
        """One row for each group; no grouping is left. _by='all' groups by every expression without an aggregate."""
        exprs = self._exprs(args, named)
        ctx = self._ctx("summarize")
        if _by == "all" or self.groups == ("all",):
            group = [k for k, e in exprs.items() if not aggregates(stated(e), self.df)]
            by = [stated(exprs[k]).column(self._ctx()).alias(k) for k in group]
            made = [stated(e).column(ctx).alias(k) for k, e in exprs.items() if k not in group]
            df = self.df.groupBy(*by).agg(*made) if made else self.df.select(*by).distinct()
            return self._next("summarize", df.select(*map(_q, exprs)), groups=())
        groups = self._by(_by)
        if exprs:
            df = self._aggregated({k: stated(e) for k, e in exprs.items()}, groups)
        else:
            df = self.df.select(*map(_q, groups)).distinct()
        return self._next("summarize", df, groups=(), worder=(), wframe=None)

    summarise = summarize

    def _aggregated(self, exprs: dict[str, Expr], groups: tuple[str, ...]) -> DataFrame:
        """The groups' aggregates. Quantiles stand apart, as their states hold all values of a group; so do counts of
        distinct values beside large states, which would be kept, and shuffled, once for each distinct value. They are
        joined to the other aggregates by the group."""
        ctx = self._ctx("summarize")
        whole = {k: e.column(ctx) for k, e in exprs.items()}
        nodes = {k: [x for x in parts(e) if isinstance(x, Agg)] for k, e in exprs.items()}
        labels = {x.label for own in nodes.values() for x in own}
        apart = "n_distinct" in labels and bool(labels & LARGE)
        row = self._ctx()
        values = {id(x): x.args[0].column(row) for own in nodes.values() for x in own if x.level is not None}
        values = {i: c for i, c in values.items() if isinstance(row.type(c), T.NumericType)}
        lone = {k for k, own in nodes.items() if any(id(x) in values or (apart and x.label == "n_distinct") for x in own)}
        if not lone:
            return self.df.groupBy(*map(_q, groups)).agg(*[c.alias(k) for k, c in whole.items()])
        by, left = [_q(g) for g in groups], [F.col(f"__a{i}") for i in range(len(groups))]
        held: dict[int, Column] = {}
        rest, counts, levels = [F.count(F.lit(1)).alias("__n")], [], {}
        for k in exprs:
            own = {id(x): x for x in nodes[k]}
            if k in lone and self._parts_stand_apart(exprs[k], own, groups):
                for i, x in own.items():
                    if i in held:
                        continue
                    name = f"__x{len(held)}"
                    held[i] = F.col(name)
                    if i in values:
                        key = x.args[0].path if isinstance(x.args[0], Col) else i
                        levels.setdefault(key, (values[i], {}))[1][name] = x.level
                    else:
                        (counts if apart and x.label == "n_distinct" else rest).append(x.column(ctx).alias(name))
            else:
                name = f"__w{len(rest)}_{len(counts)}"
                (counts if k in lone and apart and any(x.label == "n_distinct" for x in nodes[k]) else rest).append(whole[k].alias(name))
                held[id(exprs[k])] = F.col(name)
        df = self.df.groupBy(*[c.alias(f"__a{i}") for i, c in enumerate(by)]).agg(*rest)
        others = [self.df.groupBy(*[c.alias(f"__g{i}") for i, c in enumerate(by)]).agg(*counts)] if counts else []
        others += [quantiles.quantiles(self.df, by, c, names) for c, names in levels.values()]
        for other in others:
            on = [c.eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(left)]
            df = df.join(other, on or F.lit(True), "left").drop(*[f"__g{i}" for i in range(len(by))])
        df = df.select(*[c.alias(g) for c, g in zip(left, groups)], *[c for c in df.columns if not c.startswith("__a")])
        last = Context(df, "summarize", None, self.scopes, held)
        return df.select(*map(_q, groups), *[(held[id(e)] if id(e) in held else e.column(last)).alias(k) for k, e in exprs.items()])

    def _parts_stand_apart(self, e: Expr, own: dict[int, Agg], groups: tuple[str, ...]) -> bool:
        """Whether the expression can be made of the columns that its aggregates become; one with aggregates in SQL text
        or by a function's name cannot."""
        ctx = self._ctx("summarize")
        kinds = self.df.agg(*[x.column(ctx).alias(f"__x{n}") for n, x in enumerate(own.values())]).schema
        shell = self.df.select(*map(_q, groups), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
        held = {i: F.col(f"__x{n}") for n, i in enumerate(own)}
        try:
            plan = shell.select(e.column(Context(shell, "summarize", None, self.scopes, held)).alias("__e"))._jdf.queryExecution().analyzed()
        except AnalysisException:
            return False
        return plan.getClass().getSimpleName() != "Aggregate"

    def grouping_sets(self, sets, **named) -> Tbl:
        """Aggregates for each of several lists of columns, in one table; columns that a set lacks are null in its rows."""
        ctx, picked = self._ctx("summarize"), [self._pick(x) if x else [] for x in sets]
        names = list(dict.fromkeys(c for x in picked for c in x))
        df = self.df.groupingSets([list(map(_q, x)) for x in picked], *map(_q, names)).agg(*[stated(e).column(ctx).alias(k) for k, e in named.items()])
        return self._next("grouping_sets", df, groups=())

    def rollup(self, *columns: str, **named) -> Tbl:
        return self._grouping("rollup", columns, named)

    def cube(self, *columns: str, **named) -> Tbl:
        return self._grouping("cube", columns, named)

    def _grouping(self, kind: str, columns, named) -> Tbl:
        ctx = self._ctx("summarize")
        df = getattr(self.df, kind)(*map(_q, self._pick(columns))).agg(*[stated(e).column(ctx).alias(k) for k, e in named.items()])
        return self._next(kind, df, groups=())

    def count(self, *selection, sort: bool = True) -> Tbl:
        """Rows for each combination, most frequent first; without columns one row n."""
        columns = self._pick(selection) if selection else list(self.groups)
        df = self.df.groupBy(*map(_q, columns)).agg(F.count(F.lit(1)).alias("n"))
        return self._next("count", df, groups=(), order=(helpers.desc("n"),) if columns and sort else ())

    def summary(self) -> Tbl:
        """A row for each column: type, min, max, approximate distinct values, mean, spread, quartiles, rows, nulls."""
        rows = []
        stats: list[Column] = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(self.df.schema):
            c = _q(f.name)
            number = isinstance(f.dataType, T.NumericType)
            plain = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
            none = F.lit(None)
            stats.append(
                F.struct(
                    (F.min(c).cast("string") if plain else none.cast("string")).alias("min"),
                    (F.max(c).cast("string") if plain else none.cast("string")).alias("max"),
                    (F.approx_count_distinct(c) if plain else none.cast("long")).alias("approx_unique"),
                    (F.avg(c).cast("double") if number else none.cast("double")).alias("avg"),
                    (F.stddev_samp(c) if number else none.cast("double")).alias("std"),
                    (F.percentile_approx(c, [0.25, 0.5, 0.75]).cast("array<string>") if number else none.cast("array<string>")).alias("q"),
                    F.count(c).alias("present"),
                ).alias(f"s{i}")
            )
        one = self.df.agg(*stats)
        for i, f in enumerate(self.df.schema):
            s = F.col(f"s{i}")
            q = s.getField("q")
            rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), s["min"].alias("min"), s["max"].alias("max"), s["approx_unique"].alias("approx_unique"), s["avg"].alias("avg"), s["std"].alias("std"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.col("n").alias("count"), (100 * (1 - F.try_divide(s["present"], F.col("n")))).alias("null_percentage")))
        return self._next("summary", one.select(F.inline(F.array(*rows))), groups=(), order=(), limit_=None)

    # windows

    def window_order(self, *order) -> Tbl:
        return self._next("window_order", worder=order, grouped_only=self.grouped_only)

    def window_frame(self, from_: int | None = None, to: int | None = None) -> Tbl:
        """Rows for the next mutate: 0 is the current one; a missing side is unbounded."""
        return self._next("window_frame", wframe=(from_, to), grouped_only=self.grouped_only)

    # joins

    def _join(self, how: str, other, on, hint) -> Tbl:
        right = self._table(other)
        theirs = right.df_now()
        ks = []
        for k in map(joins.key, on):
            l, r = self._name(k.left), right._ctx().name(k.right)
            strip = lambda n, cols: n if n in cols else n.rpartition(".")[2]
            ks.append(joins.Key(strip(l, self.df.columns), k.op, strip(r, theirs.columns), k.closest))
        df, called = joins.joined(self.df, theirs, how, ks, hint)
        scopes = {t: dict(m) for t, m in self.scopes.items()}
        for t, m in right.scopes.items():
            scopes.setdefault(t, {}).update({c: called[now] for c, now in m.items() if now in called})
        return self._next(f"{how}_join", df, scopes=scopes)

    def _table(self, other) -> Tbl:
        if isinstance(other, Tbl):
            return other
        if isinstance(other, DataFrame):
            return Tbl(other)
        from .sources.io import dt

        return dt(self.df.sparkSession, other)

    def left_join(self, other, *on, hint: str | None = None) -> Tbl:
        return self._join("left", other, on, hint)

    def right_join(self, other, *on, hint: str | None = None) -> Tbl:
        return self._join("right", other, on, hint)

    def inner_join(self, other, *on, hint: str | None = None) -> Tbl:
        return self._join("inner", other, on, hint)

    def full_join(self, other, *on, hint: str | None = None) -> Tbl:
        return self._join("full", other, on, hint)

    def semi_join(self, other, *on, hint: str | None = None) -> Tbl:
        return self._join("semi", other, on, hint)

    def anti_join(self, other, *on, hint: str | None = None) -> Tbl:
        return self._join("anti", other, on, hint)

    # sets, by position

    def _set(self, verb: str, other, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Tbl:
        return self._next(verb, f(self.df, self._table(other).df_now()))

    def union(self, other, all: bool = False) -> Tbl:
        return self._set("union", other, lambda a, b: a.union(b) if all else a.union(b).distinct())

    def union_all(self, other) -> Tbl:
        return self.union(other, all=True)

    def intersect(self, other, all: bool = False) -> Tbl:
        return self._set("intersect", other, lambda a, b: a.intersectAll(b) if all else a.intersect(b))

    def setdiff(self, other, all: bool = False) -> Tbl:
        return self._set("setdiff", other, lambda a, b: a.exceptAll(b) if all else a.subtract(b))

    # shape

    def pivot_wider(self, names_from, values_from) -> Tbl:
        """names_from: a column, or (column, levels)."""
        names, levels = names_from if isinstance(names_from, tuple) else (names_from, None)
        values = self._pick(values_from if isinstance(values_from, (list, tuple)) else [values_from])
        return self._next("pivot_wider", reshape.pivot_wider(self.df, self._name(names), values, levels), groups=())

    def pivot_longer(self, *selection, names_to: str = "variable", values_to: str = "value") -> Tbl:
        return self._next("pivot_longer", reshape.pivot_longer(self.df, self._pick(selection), names_to, values_to))

    def separate(self, column: str, into, sep: str) -> Tbl:
        return self._next("separate", reshape.separate(self.df, self._name(column), list(into), sep))

    def unite(self, name: str, selection, sep: str) -> Tbl:
        return self._next("unite", reshape.unite(self.df, name, self._pick(selection if isinstance(selection, (list, tuple)) else [selection]), sep))

    def unnest_wider(self, *selection, names_sep: str | None = None) -> Tbl:
        return self._next("unnest_wider", reshape.unnest_wider(self.df, self._pick(selection), names_sep))

    def unnest_longer(self, *selection) -> Tbl:
        return self._next("unnest_longer", reshape.unnest_longer(self.df, self._pick(selection)))

    # results and sinks

    def collect(self, stream: bool = False):
        """A pandas DataFrame; with stream=True an iterator of rows, a partition at a time."""
        return self.df_now().toLocalIterator(prefetchPartitions=True) if stream else self.df_now().toPandas()

    def to_arrow(self):
        return self.df_now().toArrow()

    def scalar(self) -> Expr:
        """The table's one value, for use in an expression."""
        from .functions.expr import Sub

        return Sub(self)

    def show_query(self) -> Tbl:
        """Prints the verbs so far and Spark's plan."""
        print(" -> ".join(self.trace))
        self.df_now().explain("formatted")
        return self

    def create_view(self, name: str, replace: bool = False) -> Tbl:
        df = self.df_now()
        df.createOrReplaceTempView(name) if replace else df.createTempView(name)
        return self

    def create_table(self, name: str, replace: bool = False, temp: bool = False) -> Tbl:
        """A saved table; a temporary one is a persisted view of the session."""
        df = self.df_now()
        if temp:
            df = df.persist()
            df.createOrReplaceTempView(name) if replace else df.createTempView(name)
        else:
            df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)
        return self

    def write_file(self, path: str, **options) -> Tbl:
        """A folder of files in the format of the path's suffix."""
        from .sources.io import write

        write(self.df_now(), path, **options)
        return self


__all__ = ["Col", "Tbl"]
