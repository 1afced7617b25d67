"""Functions of the expression language. Text arguments name columns, unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Agg, Call, Col, Context, Desc, Expr, Forced, Lit, Raw, Win, lift, named

#: Aggregates that stand for windows in mutate by themselves; see register_window_fn.
WINDOWED: set[str] = set()


def col(name: str) -> Expr:
    return Col(name)


def lit(value) -> Expr:
    return Lit(value)


def sql(text: str) -> Expr:
    return Raw(text)


def desc(*columns) -> Expr:
    """Descending order; of several columns each one descends."""
    flat = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]
    return Desc(flat if len(flat) > 1 else named(flat[0]))


def row(build, *args) -> Expr:
    return Call(lambda ctx, *c: build(*c), tuple(map(named, args)))


# aggregates


def _agg(label: str, plain):
    def make(x) -> Expr:
        return Agg(label, lambda over, c: over(plain(c)), (named(x),))

    make.__name__ = label
    make.__doc__ = f"{label} as an aggregate, or over the window in mutate."
    return make


def n() -> Expr:
    """Number of rows."""
    return Agg("n", lambda over: over(F.count(F.lit(1))))


#: Bits of each part in which 64-bit integers are added up; so many rows' parts cannot overflow 64 bits: 2**41.
PART = 22


def _total(over, kinds: list[T.DataType], c: Column) -> Column:
    """A sum; of 64-bit integers it has 128 bits, as decimal(38, 0). They are added as long integers in three parts,
    which is much faster than adding decimals."""
    if not isinstance(kinds[0], T.LongType):
        return over(F.sum(c))
    mask = F.lit((1 << PART) - 1)
    parts = c.bitwiseAND(mask), F.shiftright(c, PART).bitwiseAND(mask), F.shiftright(c, 2 * PART)
    low, middle, high = (over(F.sum(x)).cast("decimal(20,0)") for x in parts)
    scale = lambda k: F.lit(1 << k * PART).cast(f"decimal({len(str(1 << k * PART))},0)")
    return (high * scale(2) + middle * scale(1) + low).cast("decimal(38,0)")


def sum(x) -> Expr:  # noqa: A001
    """Sum as an aggregate, or over the window in mutate; of 64-bit integers one of 128 bits, which does not overflow."""
    return Agg("sum", _total, (named(x),), typed=True)


def wide(x) -> Expr:
    """A 64-bit integer as a decimal of 20 digits: what it is multiplied with, added up or not, has up to 128 bits."""
    return row(lambda c: c.cast("decimal(20,0)"), x)


mean = _agg("mean", F.avg)
minimum = min = _agg("minimum", F.min)  # noqa: A001
maximum = max = _agg("maximum", F.max)  # noqa: A001
std = _agg("std", F.stddev_samp)
count = _agg("count", F.count)
var_samp = _agg("var_samp", F.var_samp)
var_pop = _agg("var_pop", F.var_pop)
stddev_pop = _agg("stddev_pop", F.stddev_pop)
any_value = _agg("any_value", lambda c: F.any_value(c, F.lit(True)))
approx_distinct = _agg("approx_distinct", F.approx_count_distinct)
collect_list = _agg("collect_list", F.collect_list)
bool_and = _agg("bool_and", F.bool_and)
bool_or = _agg("bool_or", F.bool_or)
bit_and = _agg("bit_and", F.bit_and)
bit_or = _agg("bit_or", F.bit_or)
bit_xor = _agg("bit_xor", F.bit_xor)
count_if = _agg("count_if", F.count_if)
mode = _agg("mode", F.mode)
first = _agg("first", F.first)
last = _agg("last", F.last)


def _two(label: str, plain):
    def make(y, x) -> Expr:
        return Agg(label, lambda over, a, b: over(plain(a, b)), (named(y), named(x)))

    make.__name__ = label
    return make


covar_samp, covar_pop, corr = _two("covar_samp", F.covar_samp), _two("covar_pop", F.covar_pop), _two("corr", F.corr)
regr_slope, regr_intercept, regr_r2 = _two("regr_slope", F.regr_slope), _two("regr_intercept", F.regr_intercept), _two("regr_r2", F.regr_r2)
regr_count, regr_avgx, regr_avgy = _two("regr_count", F.regr_count), _two("regr_avgx", F.regr_avgx), _two("regr_avgy", F.regr_avgy)
max_by, min_by = _two("max_by", F.max_by), _two("min_by", F.min_by)


def median(x) -> Expr:
    return Agg("median", lambda over, c: over(F.median(c)), (named(x),), level=0.5)


def quantile(x, q: float) -> Expr:
    """Continuous quantile."""
    return Agg("quantile", lambda over, c: over(F.percentile(c, F.lit(q))), (named(x),), level=q)


def approx_quantile(x, q: float, accuracy: int = 10_000) -> Expr:
    return Agg("approx_quantile", lambda over, c: over(F.percentile_approx(c, q, accuracy)), (named(x),))


def string_agg(x, sep: str = ",") -> Expr:
    return Agg("string_agg", lambda over, c: over(F.listagg(c, F.lit(sep))), (named(x),))


def n_distinct(x) -> Expr:
    """Number of distinct values; over a window the size of their set."""

    def build(over, c):
        probe = F.lit(1)
        return F.count_distinct(c) if over(probe) is probe else F.size(over(F.collect_set(c))).cast("long")

    return Agg("n_distinct", build, (named(x),))


def kurtosis(x) -> Expr:
    """Sample excess kurtosis with bias correction; null below four values."""

    def build(over, c):
        k, m = over(F.kurtosis(c)), over(F.count(c)).cast("double")
        return F.when(m > 3, (m - 1) / F.nullif((m - 2) * (m - 3), F.lit(0.0)) * ((m + 1) * k + 6))

    return Agg("kurtosis", build, (named(x),))


def skewness(x) -> Expr:
    """Sample skewness with bias correction; null below three values."""

    def build(over, c):
        s, m = over(F.skewness(c)), over(F.count(c)).cast("double")
        return F.when(m > 2, F.sqrt(m * (m - 1)) / F.nullif(m - 2, F.lit(0.0)) * s)

    return Agg("skewness", build, (named(x),))


def agg(x) -> Expr:
    """Puts the window around an aggregate that is given by name or as a Spark Column."""
    return Forced(lift(x))


def register_window_fn(name: str) -> None:
    """From now on fn(name, …) is an aggregate that mutate windows by itself."""
    WINDOWED.add(name)


def fn(name: str, *args) -> Expr:
    """Any Spark or registered function by name."""
    values = tuple(map(named, args))
    if name in WINDOWED:
        return Agg(name, lambda over, *c: over(F.call_function(name, *c)), values)
    return Call(lambda ctx, *c: F.call_function(name, *c), values)


# windows


def cumsum(x) -> Expr:
    """Running sum; of 64-bit integers one of 128 bits."""
    return Win("cumsum", lambda kinds, c: F.sum(c.cast("decimal(38,0)") if isinstance(kinds[0], T.LongType) else c), (named(x),), "running", typed=True)


def row_number() -> Expr:
    return Win("row_number", F.row_number, cast="long")


def rank() -> Expr:
    return Win("rank", F.rank, cast="long")


def dense_rank() -> Expr:
    return Win("dense_rank", F.dense_rank, cast="long")


rank_dense = dense_rank


def ntile(k: int) -> Expr:
    return Win("ntile", lambda: F.ntile(k), cast="long")


def cume_dist() -> Expr:
    return Win("cume_dist", lambda: F.cume_dist())


def percent_rank() -> Expr:
    return Win("percent_rank", lambda: F.percent_rank())


def lag(x, k: int = 1, default=None) -> Expr:
    return Win("lag", lambda c: F.lag(c, k, default), (named(x),))


def lead(x, k: int = 1, default=None) -> Expr:
    return Win("lead", lambda c: F.lead(c, k, default), (named(x),))


def first_value(x) -> Expr:
    return Win("first_value", F.first, (named(x),), "user")


def last_value(x) -> Expr:
    return Win("last_value", F.last, (named(x),), "user")


def nth_value(x, k: int) -> Expr:
    return Win("nth_value", lambda c: F.nth_value(c, k), (named(x),), "user")


# conditions and missing values


def if_else(condition, yes, no, missing=None) -> Expr:
    """yes where the condition holds, else no. `missing` stands in for a missing result."""
    out = Call(lambda ctx, c, a, b: F.when(c, a).otherwise(b), (lift(condition), lift(yes), lift(no)))
    return out if missing is None else replace_missing(out, missing)


def case_when(*parts) -> Expr:
    """Pairs (condition, value), flat or as tuples; an odd last value is the default."""
    flat = [x for p in parts for x in (p if isinstance(p, tuple) else (p,))]
    default = flat.pop() if len(flat) % 2 else None

    def build(ctx, *c):
        out = F
        for k in range(0, len(flat), 2):
            out = out.when(c[k], c[k + 1])
        return out.otherwise(c[-1])

    return Call(build, tuple(map(lift, [*flat, default])))


def is_missing(x) -> Expr:
    return row(lambda c: c.isNull(), x)


def replace_missing(x, value) -> Expr:
    return Call(lambda ctx, a, b: F.coalesce(a, b), (named(x), lift(value)))


def missing_if(x, value) -> Expr:
    return Call(lambda ctx, a, b: F.nullif(a, b), (named(x), lift(value)))


# numbers


def round(x, digits: int = 0) -> Expr:  # noqa: A001
    return row(lambda c: F.round(c, digits), x)


def as_float(x) -> Expr:
    """Decimal of three places; null where the value is no number."""
    return row(lambda c: c.try_cast(T.DecimalType(18, 3)), x)


def as_integer(x) -> Expr:
    """Integer, rounded: doubles half to even, text and decimals half away from zero; null where it is no number."""

    def build(ctx: Context, c: Column) -> Column:
        kind = ctx.type(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.bround(c).try_cast("int")
        if isinstance(kind, T.StringType):
            return F.round(c.try_cast("double")).try_cast("int")
        return F.round(c).try_cast("int") if isinstance(kind, T.DecimalType) else c.try_cast("int")

    return Call(build, (named(x),))


def as_string(x) -> Expr:
    """Text of any value. Floating-point numbers are the shortest that read back, as 10000000000.0, 1e-05, 1e+16, inf;
    of about one in 20,000 random bit patterns, and some powers of two, the cast's 16th or 17th digit stays that of Java
    17, which reads back too."""

    def build(ctx: Context, c: Column) -> Column:
        if not isinstance(ctx.type(c), (T.DoubleType, T.FloatType)):
            return c.cast("string")
        # each step's result is bound by a list of one, so that none is computed for each place that it is used in
        bound = lambda value, f: F.transform(F.array(value), f)[0]

        def told(s: Column) -> Column:
            """The cast may give more digits than tell the number. Two texts of up to 15 digits are never one number but
            below 2.3e-308, so that fewer than 15 need no trial above it."""
            x, size = c.cast("double"), F.length(F.regexp_replace(s, "E.*|[^0-9]", ""))
            start = F.when(F.abs(x) < 2.2250738585072014e-308, 1).otherwise(15)
            tried = F.transform(F.sequence(start, F.lit(17)), lambda k: F.call_function("format_string", F.concat(F.lit("%."), k - 1, F.lit("e")), x))
            short = F.get(F.filter(tried, lambda t: t.try_cast("double") == x), F.lit(0))
            return F.when((x != 0) & ((size > 15) | (start == 1)), F.coalesce(short, s)).otherwise(s)

        def shown(s: Column) -> Column:
            whole, fraction, power = (F.regexp_extract(s, r"^-?(\d+)(?:\.(\d+?)0*)?(?:[eE]([+-]?\d+))?$", i) for i in (1, 2, 3))
            parts = F.struct(F.when(s.startswith("-"), "-").otherwise("").alias("sign"), whole.alias("w"), F.when(fraction == "0", "").otherwise(fraction).alias("f"), power.try_cast("int").alias("e"))
            return F.when(s.rlike("[eE]"), bound(parts, spelled)).otherwise(s)

        def spelled(p: Column) -> Column:
            whole, fraction, e = p["w"], p["f"], p["e"]
            digits, size, tall = F.concat(whole, fraction), F.length(fraction), F.abs(e).cast("string")
            large = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, "0"), F.lit("."), F.when(size > e, F.substring(digits, e + 2, size)).otherwise("0"))
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
            power = F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(tall, F.greatest(F.lit(2), F.length(tall)), F.lit("0")))
            return F.concat(p["sign"], F.when((e >= 16) | (e < -4), power).when(e < 0, small).otherwise(large))

        finite = bound(bound(c.cast("string"), told), shown)
        return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(finite)

    return Call(build, (named(x),))


def absolute(x) -> Expr:
    return row(F.abs, x)


# text


def str_detect(x, pattern) -> Expr:
    """Text is matched as LIKE '%text%', where % and _ stay wildcards; a compiled pattern as a regular expression."""
    if isinstance(pattern, re.Pattern):
        return row(lambda c: c.rlike(pattern.pattern), x)
    like = "%" + pattern.replace("\\", "\\\\") + "%"
    return row(lambda c: c.like(like), x)


def starts_with(x, s: str) -> Expr:
    return row(lambda c: c.startswith(s), x)


def ends_with(x, s: str) -> Expr:
    return row(lambda c: c.endswith(s), x)


def contains(x, s: str) -> Expr:
    return row(lambda c: c.contains(s), x)


def _replacement(rep: str, shift: int) -> str:
    """A replacement with \\k as group k, in Java's form, groups moved up."""
    out = []
    for part in re.split(r"(\\\d|\\\\)", rep):
        if re.fullmatch(r"\\\d", part):
            out.append(f"${int(part[1]) + shift}")
        else:
            out.append(re.sub(r"[\\$]", lambda m: "\\" + m[0], "\\" if part == "\\\\" else part))
    return "".join(out)


def str_replace(x, pattern: str, rep: str) -> Expr:
    """The first match only: the rest of the text is matched along and put back."""
    groups = re.compile(pattern).groups
    if groups > 9:
        raise ValueError("at most nine groups")
    whole = rf"\A(?<zbefore>(?s:.*?))({pattern})(?<zafter>(?s:.*))\z"
    new = "${zbefore}" + _replacement(rep, 2) + "${zafter}"
    return row(lambda c: F.regexp_replace(c, whole, new), x)


def str_replace_all(x, pattern: str, rep: str) -> Expr:
    return row(lambda c: F.regexp_replace(c, pattern, _replacement(rep, 0)), x)


def str_remove(x, pattern: str) -> Expr:
    return str_replace(x, pattern, "")


def str_remove_all(x, pattern: str) -> Expr:
    return str_replace_all(x, pattern, "")


def lower(x) -> Expr:
    return row(F.lower, x)


def upper(x) -> Expr:
    return row(F.upper, x)


def length(x) -> Expr:
    return row(lambda c: F.length(c).cast("long"), x)


def concat(*parts) -> Expr:
    """Skips missing parts. Text arguments are literal here."""
    return Call(lambda ctx, *c: F.concat_ws("", *(p.cast("string") for p in c)), tuple(map(lift, parts)))


def substring(x, start: int, size: int) -> Expr:
    return row(lambda c: F.substring(c, start, size), x)


def trim(x) -> Expr:
    return row(F.trim, x)


# dates


def _part(name: str):
    def make(x) -> Expr:
        return row(lambda c: F.extract(F.lit(name), c).cast("long"), x)

    make.__name__ = name
    return make


year, month, day, hour, minute = map(_part, ("year", "month", "day", "hour", "minute"))
quarter, week = _part("quarter"), _part("week")


def second(x) -> Expr:
    return row(lambda c: F.second(c).cast("long"), x)


def dayofweek(x) -> Expr:
    """Sunday is 0."""
    return row(lambda c: (F.dayofweek(c) - 1).cast("long"), x)


def ymd(x) -> Expr:
    return _parsed(x, "y-M-d")


def mdy(x) -> Expr:
    return _parsed(x, "M-d-y")


def dmy(x) -> Expr:
    return _parsed(x, "d-M-y")


def _parsed(x, pattern: str) -> Expr:
    """Of a column (an expression) or of literal text."""
    return Call(lambda ctx, c: F.to_timestamp_ntz(c, F.lit(pattern)), (lift(x),))


def floor_date(x, unit: str) -> Expr:
    return row(lambda c: F.date_trunc(unit, c).cast("timestamp_ntz"), x)


def interval(amount, unit: str | None = None) -> Expr:
    """interval(1, 'year') or interval('1 year')."""
    text = f"{amount} {unit}" if unit else str(amount)
    return Raw(f"INTERVAL {text}")


def years(k):
    return interval(k, "YEAR")


def months(k):
    return interval(k, "MONTH")


def days(k):
    return interval(k, "DAY")


def hours(k):
    return interval(k, "HOUR")


def minutes(k):
    return interval(k, "MINUTE")


def seconds(k):
    return interval(k, "SECOND")


def difftime(end, start, unit: str) -> Expr:
    """Boundaries of the unit between start and end; weeks are whole days by seven."""
    unit = unit.lower().removesuffix("s")

    def build(ctx: Context, e: Column, s: Column) -> Column:
        cut = lambda c, u: F.date_trunc(u, c).cast("timestamp_ntz")
        if unit == "week":
            return (F.timestamp_diff("DAY", cut(s, "day"), cut(e, "day")) / 7).cast("bigint")
        return F.timestamp_diff(unit.upper(), cut(s, unit), cut(e, unit))

    return Call(build, (named(end), named(start)))


# nested values


def element(x, key) -> Expr:
    """A map's value, or an array's item from 1; null if it is absent."""

    def build(ctx: Context, a: Column, k: Column) -> Column:
        return F.try_element_at(a, k)

    return Call(build, (named(x), lift(key)))


def make_map(names, values) -> Expr:
    k, v = list(map(lift, names)), list(map(named, values))
    return Call(lambda ctx, *c: F.map_from_arrays(F.array(*c[: len(k)]), F.array(*c[len(k) :])), tuple(k + v))


def make_array(*values) -> Expr:
    return Call(lambda ctx, *c: F.array(*c), tuple(map(named, values)))


def json_value(x, path: str, kind: str = "string") -> Expr:
    return row(lambda c: F.get_json_object(c, path).try_cast(kind), x)


class Unnest:
    """unnest(col) in transmute: a list of structs becomes rows of their fields."""

    def __init__(self, name: str):
        self.name = name


def unnest(name: str) -> Unnest:
    return Unnest(name)


def udf(f, returns, vectorized: bool = True):
    """A Python function as a function of expressions; vectorized functions take and give pandas Series."""
    made = (F.pandas_udf if vectorized else F.udf)(f, returns)
    return lambda *args: Call(lambda ctx, *c: made(*c), tuple(map(named, args)))
