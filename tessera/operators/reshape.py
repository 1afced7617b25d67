"""Pivots, splitting and uniting of columns, and unnesting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quoted


#: Levels that may be read from a table for columns; Spark's own limit of pivots.
MOST_LEVELS = 10_000


def _q(name: str) -> Column:
    return F.col(quoted(name))


def pivot_wider(df: DataFrame, names: str, values: list[str], levels: list | None) -> DataFrame:
    """A column for each level of `names`; cells hold the first value that is not null. Levels that are not given are
    read from the table and sorted; more than MOST_LEVELS are an error. Of several value columns each makes its own,
    level_value."""
    if levels is None:
        found = df.select(_q(names)).filter(_q(names).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{names} has more than {MOST_LEVELS} levels; give those that are wanted")
        levels = sorted((r[0] for r in found), key=lambda v: (str(type(v)), v))
    ids = [c for c in df.columns if c != names and c not in values]
    one = len(values) == 1
    cells = [F.any_value(F.when(_q(names) == F.lit(v), _q(c)), F.lit(True)).alias(str(v) if one else f"{v}_{c}") for c in values for v in levels]
    return df.groupBy(*map(_q, ids)).agg(*cells) if cells else df.select(*map(_q, ids)).distinct()


def pivot_longer(df: DataFrame, columns: list[str], names_to: str, values_to: str) -> DataFrame:
    """A row for each of the columns. Values of types without a common one become text."""
    ids = [c for c in df.columns if c not in columns]
    kinds = {df.schema[c].dataType for c in columns}
    if len(kinds) > 1 and not all(isinstance(k, T.NumericType) for k in kinds):
        df = df.withColumns({c: _q(c).cast("string") for c in columns})
    return df.unpivot([_q(c) for c in ids], [_q(c) for c in columns], names_to, values_to)


def separate(df: DataFrame, column: str, into: list[str], sep: str) -> DataFrame:
    """The column replaced by its parts; the last one keeps the rest. Empty and missing parts are null."""
    parts = F.split(_q(column), re.escape(sep) if sep else "", len(into))
    new = [F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(into)]
    return df.select(*[x for c in df.columns for x in (new if c == column else [_q(c)])])


def unite(df: DataFrame, name: str, columns: list[str], sep: str) -> DataFrame:
    """The columns, which go, joined as text without nulls into a new last one."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*map(_q, rest), F.concat_ws(sep, *[_q(c).cast("string") for c in columns]).alias(name))


def unnest_wider(df: DataFrame, columns: list[str], names_sep: str | None) -> DataFrame:
    """Structs replaced by their fields, named alone or column + names_sep + field."""
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(_q(c))
            continue
        kind = df.schema[c].dataType
        if not isinstance(kind, T.StructType):
            raise TypeError(f"{c} is {kind.simpleString()}, not a struct")
        out += [_q(c).getField(f).alias(f if names_sep is None else f"{c}{names_sep}{f}") for f in kind.names]
    return df.select(*out)


def unnest_longer(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each place of the lists, which go in step; short ones are padded with null, and a row whose lists are
    all empty or null goes."""
    zipped = F.arrays_zip(*[F.coalesce(_q(c), F.array().cast(df.schema[c].dataType)).alias(f"__{i}") for i, c in enumerate(columns)])
    item = df.withColumn("__item", F.explode(zipped))
    fields = item.schema["__item"].dataType.names
    at = {c: F.col("__item").getField(f) for c, f in zip(columns, fields)}
    return item.select(*[at[c].alias(c) if c in at else _q(c) for c in df.columns])
