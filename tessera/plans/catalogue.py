"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers as f
from ..functions.helpers import col, desc, lit, sql
from ..operators.joins import closest
from ..operators.selectors import across, contains, cols, ends_with, exclude, span, starts_with
from ..sources.io import copy_to, drop_view, dt, read
from ..table import Tbl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """tables(name) is a lazy table of the driver's."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def kept(self, suffix: str) -> str:
        """A new path in the warehouse."""
        return f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-{uuid4().hex}.{suffix}"

    def __call__(self, name: str | list[str]) -> Tbl:
        return dt(self.spark, self.path(name) if isinstance(name, str) else list(map(self.path, name)))


def query(text: str | None = None):
    """Registers a function of (tables, spark)."""

    def wrap(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(Tables(spark, sf_dir), spark)
            return out.df_now() if isinstance(out, Tbl) else out

        run.__name__ = make.__name__
        QUERIES[make.__name__] = run
        if text:
            SQL[make.__name__] = text
        return run

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def money(x) -> object:
    """A sum of values with two decimals that does not depend on the order of its terms: of whole hundredths."""
    return f.row(lambda c: c.cast("double") / 100, f.sum(f.row(lambda c: F.rint(c * 100).cast("long"), x)))


# projection


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def select_range(t, s):
    return t("orders").select("o_orderkey:o_orderstatus")


@query("SELECT c_name, c_nationkey, c_custkey, c_mktsegment FROM customer")
def select_helpers(t, s):
    return t("customer").select(starts_with("c_na"), ends_with("custkey"), contains("mkt"))


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders")
def select_exclude(t, s):
    return t("orders").select(~span("o_custkey", "o_totalprice"))


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM orders")
def select_list(t, s):
    return t("orders").select("o_orderpriority", cols("o_orderkey", "o_custkey"))


@query("SELECT c_custkey, c_nationkey, c_name, c_acctbal, c_mktsegment FROM customer")
def relocate_after(t, s):
    return t("customer").relocate("c_name", after="c_nationkey")


@query("SELECT o_orderdate, o_orderkey, o_orderstatus, o_totalprice, o_custkey, o_orderpriority FROM orders")
def relocate_many(t, s):
    return t("orders").relocate("o_custkey", after="o_totalprice").relocate("o_orderdate")


@query("SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
def rename_cols(t, s):
    return t("nation").rename(id="n_nationkey", nation="n_name")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_cols(t, s):
    return t("lineitem").distinct("l_returnflag", "l_linestatus")


@query("SELECT DISTINCT * FROM region")
def distinct_all(t, s):
    return t("region").union_all(t("region")).distinct()


# filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_and(t, s):
    return t("orders").filter(col("o_orderstatus") == "F", col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR NOT (p_size <= 45)")
def filter_or(t, s):
    return t("part").filter((col("p_size") < 5) | ~(col("p_size") <= 45)).select("p_partkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)")
def filter_in(t, s):
    return t("customer").filter(col("c_mktsegment").isin("BUILDING", "MACHINERY"), ~col("c_nationkey").isin([1, 2])).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A_%' OR p_type LIKE '%B%'")
def filter_not_like(t, s):
    return t("part").filter(~f.str_detect("p_type", "A_") | f.str_detect("p_type", "B")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '[1-3]$')")
def filter_regex(t, s):
    return t("part").filter(f.str_detect("p_brand", re.compile("[1-3]$"))).select("p_partkey", "p_brand")


@query("SELECT n_name FROM nation WHERE starts_with(n_name, 'N') OR ends_with(n_name, '1') OR contains(n_name, '_2')")
def filter_text_helpers(t, s):
    return t("nation").filter(f.starts_with("n_name", "N") | f.ends_with("n_name", "1") | f.contains("n_name", "_2")).select("n_name")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def filter_having(t, s):
    return t("orders").group_by("o_custkey").summarize(n_orders=f.n()).filter(col("n_orders") > 12)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def filter_scalar_subquery(t, s):
    mean = t("orders").summarize(m=f.mean("o_totalprice"))
    return t("orders").filter(col("o_totalprice") > mean.scalar() * 1.5).select("o_orderkey")


@query("SELECT o_orderkey, v FROM (SELECT o_orderkey, o_totalprice * 2 AS v, o_orderstatus FROM orders) WHERE v > 200000 AND o_orderstatus <> 'O'")
def filter_twice_after_mutate(t, s):
    return t("orders").mutate(v=col("o_totalprice") * 2).filter(col("v") > 200000).filter(col("o_orderstatus") != "O").select("o_orderkey", "v")


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def drop_missing(t, s):
    return t("documents").left_join(t("labels"), "doc_id").drop_missing("toxic").select("doc_id", "toxic")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def replace_missing(t, s):
    return t("documents").left_join(t("labels"), "doc_id").mutate(quality=f.replace_missing("quality", -1)).select("doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag FROM lineitem WHERE nullif(l_returnflag, 'N') IS NULL")
def missing_if(t, s):
    return t("lineitem").mutate(flag=f.missing_if("l_returnflag", "N")).filter(f.is_missing("flag")).select("l_orderkey", "l_linenumber", "flag")


# mutate


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, pow(l_quantity, 2) + l_tax AS q2, l_extendedprice / l_quantity AS unit, l_orderkey % 7 AS m FROM lineitem")
def mutate_arith(t, s):
    return t("lineitem").transmute(l_orderkey="l_orderkey", l_linenumber="l_linenumber", net=col("l_extendedprice") * (1 - col("l_discount")), q2=col("l_quantity") ** 2 + col("l_tax"), unit=col("l_extendedprice") / col("l_quantity"), m=col("l_orderkey") % 7)


@query("SELECT p_partkey, p_retailprice * 2 AS p_retailprice, p_size FROM part")
def mutate_replace_in_place(t, s):
    return t("part").select("p_partkey", "p_retailprice", "p_size").mutate(p_retailprice=col("p_retailprice") * 2)


@query("SELECT s_suppkey, s_acctbal * 2 AS twice, s_acctbal * 2 + 1 AS more FROM supplier")
def mutate_reuses_alias(t, s):
    return t("supplier").select("s_suppkey", "s_acctbal").mutate(twice=col("s_acctbal") * 2, more=col("twice") + 1).select("s_suppkey", "twice", "more")


@query("SELECT p_partkey, p_size * 2 AS twice, max(p_size * 2) OVER (PARTITION BY p_brand) AS top, max(p_size * 2) OVER (PARTITION BY p_brand) - p_size * 2 AS below, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, p_size * 3 AS p_size FROM part")
def mutate_windows_over_aliases(t, s):
    new = t("part").mutate(twice=col("p_size") * 2, p_size=col("p_size") * 3, top=f.maximum("twice"), below=col("top") - col("twice"), r=f.rank(), _by="p_brand", _order="p_size", _frame=(None, None))
    return new.select("p_partkey", "twice", "top", "below", "r", "p_size")


@query("SELECT s_suppkey, CAST(CAST(s_suppkey AS DOUBLE) * 10000000 AS VARCHAR) AS a, CAST(CAST(s_suppkey AS DOUBLE) * 1e17 AS VARCHAR) AS b, CAST(CAST(s_suppkey AS DOUBLE) / 1048576 / 1024 AS VARCHAR) AS c, CAST(-s_acctbal AS VARCHAR) AS d, CAST(CAST(s_suppkey AS FLOAT) / 4 AS VARCHAR) AS e FROM supplier")
def mutate_text_of_numbers(t, s):
    x = sql("double(s_suppkey)")
    return t("supplier").transmute(s_suppkey="s_suppkey", a=f.as_string(x * 10000000), b=f.as_string(x * 1e17), c=f.as_string(x / 1048576 / 1024), d=f.as_string(-col("s_acctbal")), e=f.as_string(sql("float(s_suppkey) / float(4)")))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS class, CASE WHEN p_size > 40 THEN 1 END AS flag FROM part")
def mutate_case_when(t, s):
    return t("part").transmute(p_partkey="p_partkey", **{"class": f.case_when((col("p_size") > 40, "large"), (col("p_size") > 20, "medium"), "small")}, flag=f.case_when(col("p_size") > 40, 1))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 10 ELSE toxic END, 43) AS v FROM documents LEFT JOIN labels USING (doc_id)")
def mutate_if_else_missing(t, s):
    return t("documents").left_join(t("labels"), "doc_id").transmute(doc_id="doc_id", v=f.if_else(col("quality") == 1, 10, col("toxic"), 43))


@query("SELECT l_orderkey, l_linenumber, TRY_CAST(l_extendedprice / 3 AS INT) AS i, CAST(TRY_CAST(l_discount * 10 AS DECIMAL(18,3)) AS DOUBLE) AS d, TRY_CAST(l_linenumber AS VARCHAR) AS t, TRY_CAST(l_returnflag AS INT) AS bad, TRY_CAST(concat(l_linenumber, '.5') AS INT) AS r FROM lineitem")
def mutate_casts(t, s):
    return t("lineitem").transmute(l_orderkey="l_orderkey", l_linenumber="l_linenumber", i=f.as_integer(col("l_extendedprice") / 3), d=f.row(lambda c: c.cast("double"), f.as_float(col("l_discount") * 10)), t=f.as_string("l_linenumber"), bad=f.as_integer("l_returnflag"), r=f.as_integer(f.concat(col("l_linenumber"), ".5")))


@query("SELECT p_brand, min(p_size) OVER (PARTITION BY p_brand) AS p_size_minimum, max(p_size) OVER (PARTITION BY p_brand) AS p_size_maximum, p_partkey FROM part")
def mutate_across(t, s):
    return t("part").mutate(across("p_size", (f.minimum, f.maximum)), _by="p_brand").select("p_brand", "p_size_minimum", "p_size_maximum", "p_partkey")


@query("SELECT o_custkey, o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders")
def transmute_grouped(t, s):
    return t("orders").group_by("o_custkey").transmute(share=col("o_totalprice") / f.maximum("o_totalprice"))


@query("SELECT p_partkey, p_retailprice / (p_size - 10) AS q FROM part WHERE p_size <> 10 UNION ALL SELECT p_partkey, 'inf'::DOUBLE FROM part WHERE p_size = 10")
def mutate_division_by_zero(t, s):
    return t("part").transmute(p_partkey="p_partkey", q=col("p_retailprice") / (col("p_size") - 10))


@query("SELECT l_orderkey, l_linenumber, round(l_tax * 100) AS r0, round(l_quantity / 8, 2) AS r2 FROM lineitem")
def mutate_round(t, s):
    return t("lineitem").transmute(l_orderkey="l_orderkey", l_linenumber="l_linenumber", r0=f.round(col("l_tax") * 100), r2=f.round(col("l_quantity") / 8, 2))


# aggregates


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 10""")
def summarize_basic(t, s):
    return (
        t("lineitem")
        .filter("l_shipdate <= timestamp_ntz '1998-09-02'")
        .group_by("l_returnflag", "l_linestatus")
        .summarize(sum_qty=money("l_quantity"), sum_price=money("l_extendedprice"), avg_qty=f.round(f.mean("l_quantity"), 4), n=f.n())
        .filter(col("n") > 10)
        .arrange("l_returnflag", "l_linestatus")
    )


@query("SELECT l_shipdate, CAST(min(l_quantity) AS DOUBLE) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_shipdate")
def summarize_by(t, s):
    return t("lineitem").summarize(lo=f.minimum("l_quantity"), hi=f.maximum("l_quantity"), _by="l_shipdate")


@query("SELECT p_brand, round(avg(p_size), 6) AS p_size_mean, min(p_size) AS p_size_minimum, max(p_size) AS p_size_maximum, round(stddev_samp(p_size), 6) AS p_size_std FROM part GROUP BY p_brand")
def summarize_across(t, s):
    out = t("part").group_by("p_brand").summarize(across(starts_with("p_size"), (f.mean, f.minimum, f.maximum, f.std)))
    return out.mutate(p_size_mean=f.round("p_size_mean", 6), p_size_std=f.round("p_size_std", 6))


@query("SELECT CAST(max(n) AS BIGINT) AS busiest, CAST(count(*) AS BIGINT) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def summarize_twice(t, s):
    return t("orders").group_by("o_custkey").summarize(n=f.n()).summarize(busiest=f.maximum("n"), customers=f.n())


@query("SELECT p_size > 25 AS large, p_brand, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def group_by_expr(t, s):
    return t("part").group_by("p_brand", large=col("p_size") > 25).summarize(n=f.n())


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_by_alone(t, s):
    return t("orders").group_by("o_orderstatus", "o_orderpriority")


@query("SELECT year(o_orderdate) AS y, o_orderstatus AS st, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def group_by_all(t, s):
    return t("orders").summarize(y=f.year("o_orderdate"), st=col("o_orderstatus"), n=f.n(), _by="all")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC")
def count_sorted(t, s):
    return t("events").count("event_type")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def count_all(t, s):
    return t("lineitem").count()


@query("""SELECT l_returnflag, median(l_quantity) AS med, round(var_samp(l_quantity), 5) AS var, round(kurtosis(l_extendedprice), 6) AS kurt, round(skewness(l_extendedprice), 6) AS skew,
quantile_cont(l_quantity, 0.9) AS q90, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, round(var_pop(l_quantity), 5) AS varp FROM lineitem GROUP BY l_returnflag""")
def agg_stats(t, s):
    r = f.round
    return t("lineitem").summarize(med=f.median("l_quantity"), var=r(f.var_samp("l_quantity"), 5), kurt=r(f.kurtosis("l_extendedprice"), 6), skew=r(f.skewness("l_extendedprice"), 6), q90=f.quantile("l_quantity", 0.9), parts=f.n_distinct("l_partkey"), varp=r(f.var_pop("l_quantity"), 5), _by="l_returnflag")


@query("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_samp(l_extendedprice, l_quantity), 2) AS cov FROM lineitem GROUP BY l_linestatus")
def agg_regr(t, s):
    y, x = "l_extendedprice", "l_quantity"
    return t("lineitem").summarize(slope=f.round(f.regr_slope(y, x), 4), r2=f.round(f.regr_r2(y, x), 6), c=f.round(f.corr(y, x), 6), cov=f.round(f.covar_samp(y, x), 2), _by="l_linestatus")


@query("SELECT user_id, arg_max(event_type, event_id) AS latest, arg_min(event_type, event_id) AS earliest, bool_or(value > 100) AS any_high, CAST(count_if(value > 50) AS BIGINT) AS high FROM events GROUP BY user_id")
def agg_by_other(t, s):
    return t("events").summarize(latest=f.max_by("event_type", "event_id"), earliest=f.min_by("event_type", "event_id"), any_high=f.bool_or(col("value") > 100), high=f.count_if(col("value") > 50), _by="user_id")


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, CAST(len(list(n_name)) AS BIGINT) AS k FROM nation GROUP BY n_regionkey")
def agg_string(t, s):
    names = f.row(lambda c: F.array_join(F.array_sort(F.split(c, "[|]")), "|"), f.string_agg("n_name", "|"))
    return t("nation").summarize(names=names, k=f.row(lambda c: F.size(c).cast("long"), f.collect_list("n_name")), _by="n_regionkey")


@query("SELECT l_returnflag, CAST(sum(l_orderkey * 20000000000000) AS VARCHAR) AS total, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def agg_wide_sum(t, s):
    return t("lineitem").summarize(total=f.as_string(f.sum(f.wide("l_orderkey") * 20000000000000)), lines=f.sum("l_linenumber"), _by="l_returnflag")


@query("SELECT o_orderkey, CAST(sum(o_orderkey * 400000000000000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS running FROM orders")
def win_wide_cumsum(t, s):
    return t("orders").mutate(running=f.as_string(f.cumsum(f.wide("o_orderkey") * 400000000000000)), _by="o_custkey", _order="o_orderkey").select("o_orderkey", "running")


@query("SELECT l_returnflag, first(l_returnflag) AS a, last(l_returnflag) AS b, any_value(nullif(l_returnflag, 'N')) AS v, mode(l_linestatus) AS m, CAST(count(nullif(l_linenumber, 1)) AS BIGINT) AS k FROM lineitem GROUP BY l_returnflag")
def agg_first_last_mode(t, s):
    return t("lineitem").summarize(a=f.first("l_returnflag"), b=f.last("l_returnflag"), v=f.any_value(f.missing_if("l_returnflag", "N")), m=f.mode("l_linestatus"), k=f.count(f.missing_if("l_linenumber", 1)), _by="l_returnflag")


@query("SELECT DISTINCT l_returnflag, TRUE AS near, TRUE AS some FROM lineitem")
def agg_approximate(t, s):
    """Approximations are held to a bound: both sides must hold it."""
    share = f.approx_distinct("l_partkey") / f.n_distinct("l_partkey")
    near = f.row(lambda a, b: F.abs(a - b) < 3, f.approx_quantile("l_quantity", 0.3), f.quantile("l_quantity", 0.3))
    return t("lineitem").summarize(near=near, some=(share > 0.85) & (share < 1.15), _by="l_returnflag")


@query("""SELECT o_orderstatus, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x, bool_and(o_totalprice > 0) AS pos, CAST(regr_count(o_totalprice, o_custkey) AS BIGINT) AS n,
round(regr_avgx(o_totalprice, o_custkey), 4) AS ax, round(regr_avgy(o_totalprice, o_custkey), 4) AS ay, round(covar_pop(o_totalprice, o_custkey) / 1000, 3) AS cov, round(stddev_pop(o_totalprice), 4) AS sd, round(regr_intercept(o_totalprice, o_custkey), 3) AS ic FROM orders GROUP BY o_orderstatus""")
def agg_more(t, s):
    y, x, r = "o_totalprice", "o_custkey", f.round
    return t("orders").summarize(a=f.bit_and("o_orderkey"), o=f.bit_or("o_orderkey"), x=f.bit_xor("o_orderkey"), pos=f.bool_and(col(y) > 0), n=f.regr_count(y, x), ax=r(f.regr_avgx(y, x), 4), ay=r(f.regr_avgy(y, x), 4), cov=r(f.covar_pop(y, x) / 1000, 3), sd=r(f.stddev_pop(y), 4), ic=r(f.regr_intercept(y, x), 3), _by="o_orderstatus")


@query("SELECT o_orderstatus AS st, year(o_orderdate) AS y, max(o_totalprice) AS top, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def group_by_all_with_sql(t, s):
    return t("orders").group_by("all").summarize(st=col("o_orderstatus"), y=sql("bigint(year(o_orderdate))"), top=sql("max(o_totalprice)"), n=f.row(lambda c: c, sql("count(1)")))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
def agg_grouping_sets(t, s):
    return t("orders").grouping_sets([["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], []], n=f.n())


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(t, s):
    return t("orders").rollup("o_orderstatus", "o_orderpriority", n=f.n())


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(t, s):
    return t("orders").cube("o_orderstatus", "o_orderpriority", n=f.n())


# windows


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def win_cumsum(t, s):
    running = f.row(lambda c: c.cast("double"), f.cumsum(sql("cast(o_totalprice as decimal(18,2))")))
    return t("orders").mutate(running=running, _by="o_custkey", _order="o_orderkey").select("o_orderkey", "running")


def _framed(t, **how):
    return t("orders").mutate(v=money("o_totalprice"), k=f.n(), _by="o_custkey", _order="o_orderkey", **how).select("o_orderkey", "v", "k")


def _framed_sql(frame: str) -> str:
    w = f"OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN {frame})"
    return f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) {w} AS DOUBLE) AS v, CAST(count(*) {w} AS BIGINT) AS k FROM orders"


@query(_framed_sql("1 PRECEDING AND 1 FOLLOWING"))
def win_frame_both(t, s):
    return _framed(t, _frame=(-1, 1))


@query(_framed_sql("2 PRECEDING AND UNBOUNDED FOLLOWING"))
def win_frame_from(t, s):
    return _framed(t, _frame=-2)


@query(_framed_sql("UNBOUNDED PRECEDING AND 1 FOLLOWING"))
def win_frame_to(t, s):
    return t("orders").group_by("o_custkey").window_order("o_orderkey").window_frame(to=1).mutate(v=money("o_totalprice"), k=f.n()).select("o_orderkey", "v", "k")


@query("""SELECT p_partkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(cume_dist() OVER v, 8) AS cd FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)""")
def win_rank_family(t, s):
    a = t("part").mutate(rn=f.row_number(), nt=f.ntile(4), _by="p_brand", _order=[desc("p_size"), "p_partkey"])
    return a.mutate(rk=f.rank(), dr=f.dense_rank(), cd=f.round(f.cume_dist(), 8), _by="p_brand", _order="p_size").select("p_partkey", "rn", "rk", "dr", "nt", "cd")


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def win_lag_lead(t, s):
    return t("orders").mutate(before=f.lag("o_orderkey"), after=f.lead("o_orderkey", 2), _by="o_custkey", _order="o_orderkey", _frame=(-1, 1)).select("o_orderkey", "before", "after")


@query("SELECT l_returnflag, l_linestatus, n / sum(n) OVER () AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
def win_share_of_total(t, s):
    return t("lineitem").group_by("l_returnflag", "l_linestatus").summarize(n=f.n()).mutate(share=col("n") / f.sum("n")).select("l_returnflag", "l_linestatus", "share")


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS fst, last_value(o_orderkey) OVER w AS lst, nth_value(o_orderkey, 2) OVER w AS snd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def win_nth_first_last(t, s):
    return t("orders").mutate(fst=f.first_value("o_orderkey"), lst=f.last_value("o_orderkey"), snd=f.nth_value("o_orderkey", 2), _by="o_custkey", _order="o_orderkey", _frame=(-1, 2)).select("o_orderkey", "fst", "lst", "snd")


@query("SELECT p_partkey, median(p_size) OVER (PARTITION BY p_brand) AS med, CAST(len(list_distinct(list(p_type) OVER (PARTITION BY p_brand))) AS BIGINT) AS kinds FROM part")
def win_forced_agg(t, s):
    return t("part").mutate(med=f.agg(sql("median(p_size)")), kinds=f.n_distinct("p_type"), _by="p_brand").select("p_partkey", "med", "kinds")


@query("SELECT p_partkey, bool_or(p_size > 49) OVER (PARTITION BY p_brand) AS big FROM part")
def win_registered(t, s):
    f.register_window_fn("bool_or")
    return t("part").mutate(big=f.fn("bool_or", col("p_size") > 49), _by="p_brand").select("p_partkey", "big")


# joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t, s):
    return t("orders").inner_join(t("customer"), "o_custkey == c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def join_left(t, s):
    return t("customer").left_join(t("orders").filter(col("o_totalprice") > 300000), ("c_custkey", "o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(t, s):
    return t("orders").filter(col("o_totalprice") > 300000).right_join(t("customer"), col("o_custkey") == col("c_custkey")).select("o_custkey", "o_orderkey", "c_name")


@query("SELECT coalesce(s_nationkey, n_nationkey) AS s_nationkey, s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 9) FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 4) ON s_nationkey = n_nationkey")
def join_full(t, s):
    return t("supplier").filter(col("s_nationkey") < 9).full_join(t("nation").filter(col("n_nationkey") > 4), "s_nationkey == n_nationkey").select("s_nationkey", "s_suppkey", "n_name")


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(t, s):
    return t("customer").semi_join(t("orders").filter(col("o_totalprice") > 250000), "c_custkey == o_custkey")


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(t, s):
    return t("customer").anti_join(t("orders").filter(col("o_totalprice") > 250000), "c_custkey == o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_after_filter(t, s):
    return t("customer").filter(col("c_acctbal") > 0).semi_join(t("orders"), "c_custkey == o_custkey").select("c_custkey", "c_name")


@query("SELECT l.l_orderkey, l.l_linenumber, r.l_quantity AS l_quantity_1, l.l_quantity FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber")
def join_multi_key_self(t, s):
    return t("lineitem").inner_join(t("lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity_1", "l_quantity")


@query("SELECT a.n_nationkey, b.n_nationkey AS n_nationkey_1, a.n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t, s):
    return t("nation").inner_join(t("nation"), "n_regionkey", "n_nationkey < n_nationkey").select("n_nationkey", "n_nationkey_1", "n_regionkey")


@query("SELECT s_suppkey, n_nationkey FROM supplier LEFT JOIN nation ON s_nationkey > n_nationkey AND s_suppkey >= n_nationkey")
def join_theta_left(t, s):
    return t("supplier").left_join(t("nation"), "s_nationkey > n_nationkey", "s_suppkey >= n_nationkey").select("s_suppkey", "n_nationkey")


def _clicks(t, kind):
    """One row for each user and time, so that a nearest one is unique."""
    return t("events").filter(col("event_type") == kind).group_by("user_id", "ts").summarize(event_id=f.minimum("event_id"))


def _clicks_sql(kind: str) -> str:
    return f"(SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = '{kind}' GROUP BY user_id, ts)"


@query(f"SELECT l.user_id, l.event_id, l.ts, r.event_id AS event_id_1, r.ts AS ts_1 FROM {_clicks_sql('purchase')} l ASOF LEFT JOIN {_clicks_sql('click')} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def join_asof(t, s):
    return _clicks(t, "purchase").left_join(_clicks(t, "click"), "user_id", closest("ts >= ts")).select("user_id", "event_id", "ts", "event_id_1", "ts_1")


@query(f"SELECT l.user_id, l.event_id, r.event_id AS event_id_1 FROM {_clicks_sql('purchase')} l ASOF JOIN {_clicks_sql('click')} r ON l.user_id = r.user_id AND l.ts < r.ts")
def join_asof_next(t, s):
    return _clicks(t, "purchase").inner_join(_clicks(t, "click"), "user_id", "closest(ts < ts)").select("user_id", "event_id", "event_id_1")


@query(f"SELECT coalesce(l.user_id, r.user_id) AS user_id, l.event_id, r.event_id AS event_id_1, r.ts AS ts_1 FROM {_clicks_sql('purchase')} l ASOF RIGHT JOIN {_clicks_sql('click')} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def join_asof_right(t, s):
    return _clicks(t, "purchase").right_join(_clicks(t, "click"), "user_id", closest("ts >= ts")).select("user_id", "event_id", "event_id_1", "ts_1")


@query(f"SELECT coalesce(l.user_id, r.user_id) AS user_id, l.event_id, r.event_id AS event_id_1 FROM {_clicks_sql('purchase')} l ASOF FULL JOIN {_clicks_sql('click')} r ON l.user_id = r.user_id AND l.ts > r.ts")
def join_asof_full(t, s):
    return _clicks(t, "purchase").full_join(_clicks(t, "click"), "user_id", closest("ts > ts"), hint="skew").select("user_id", "event_id", "event_id_1")


@query(f"SELECT l.user_id, l.ts, l.event_id FROM {_clicks_sql('purchase')} l WHERE EXISTS (SELECT 1 FROM {_clicks_sql('click')} r WHERE l.user_id = r.user_id AND l.ts <= r.ts)")
def join_asof_semi(t, s):
    return _clicks(t, "purchase").semi_join(_clicks(t, "click"), "user_id", closest("ts <= ts")).select("user_id", "ts", "event_id")


@query(f"SELECT l.user_id, l.ts, l.event_id FROM {_clicks_sql('purchase')} l WHERE NOT EXISTS (SELECT 1 FROM {_clicks_sql('click')} r WHERE l.user_id = r.user_id AND l.ts <= r.ts)")
def join_asof_anti(t, s):
    return _clicks(t, "purchase").anti_join(_clicks(t, "click"), "user_id", closest("ts <= ts"), hint="skew").select("user_id", "ts", "event_id")


@query(f"SELECT l.ts, l.event_id, r.event_id AS event_id_1 FROM (SELECT ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ts) l ASOF LEFT JOIN (SELECT ts, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ts) r ON l.ts >= r.ts")
def join_asof_one_key(t, s):
    side = lambda kind: t("events").filter(col("event_type") == kind).summarize(event_id=f.minimum("event_id"), _by="ts")
    return side("purchase").left_join(side("click"), closest("ts >= ts")).select("ts", "event_id", "event_id_1")


@query("SELECT c_nationkey, customers, suppliers FROM (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def join_of_aggregates(t, s):
    left = t("customer").summarize(customers=f.n(), _by="c_nationkey")
    return left.inner_join(t("supplier").summarize(suppliers=f.n(), _by="s_nationkey"), "c_nationkey == s_nationkey")


@query("""SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_chain(t, s):
    return (
        t("lineitem").inner_join(t("orders"), "l_orderkey == o_orderkey").inner_join(t("customer"), "o_custkey == c_custkey")
        .inner_join(t("nation"), "c_nationkey == n_nationkey").inner_join(t("region"), "n_regionkey == r_regionkey")
        .summarize(revenue=money("l_extendedprice"), n=f.n(), _by="r_name")
    )


# sets


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t, s):
    return t("customer").transmute(k=col("c_nationkey")).union(t("supplier").select("s_nationkey"))


@query("SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(t, s):
    return t("nation").select("n_name").union_all(t("region").select("r_name")).union(t("region").select("r_name"), all=True)


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t, s):
    return t("customer").select("c_nationkey").intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t, s):
    return t("customer").select("c_nationkey").intersect(t("supplier").select("s_nationkey"), all=True)


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def setdiff(t, s):
    return t("nation").select("n_nationkey").setdiff(t("supplier").filter(col("s_acctbal") > 5000).select("s_nationkey"))


@query("SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def setdiff_all(t, s):
    return t("customer").select("c_nationkey").setdiff(t("supplier").select("s_nationkey"), all=True)


# order, limits, slices


@query("SELECT p_partkey, p_size, CAST(rank_col AS BIGINT) AS rank_col FROM (SELECT *, rank() OVER (ORDER BY p_size) AS rank_col FROM part) WHERE rank_col <= 2")
def slice_min_ties(t, s):
    return t("part").slice_min("p_size", n=2).select("p_partkey", "p_size", "rank_col")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS k FROM orders) WHERE k <= 3")
def slice_max_grouped(t, s):
    return t("orders").group_by("o_orderpriority").slice_max("o_totalprice", n=3).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def arrange_head(t, s):
    return t("orders").select("o_orderkey", "o_totalprice").arrange(desc("o_totalprice"), "o_orderkey").head(10)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 5")
def head_is_deferred(t, s):
    return t("orders").select("o_orderkey", "o_orderstatus").arrange(1).head(5).filter(col("o_orderstatus") == "F")


@query("SELECT o_orderpriority, CAST(least(count(*), 2) AS BIGINT) AS n, CAST(least(count(*), 2) AS BIGINT) AS orders, CAST(least(count(*), 2) AS BIGINT) AS last FROM orders GROUP BY o_orderpriority")
def slice_sample(t, s):
    """The sample differs with the seed; that it is so many different rows of each group's own does not."""
    some = t("orders").slice_sample(n=2, _by="o_orderpriority", seed=1).semi_join(t("orders"), "o_orderkey", "o_orderpriority", "o_totalprice")
    return some.summarize(n=f.n(), orders=f.n_distinct("o_orderkey"), last=f.maximum("row_num"), _by="o_orderpriority")


# shape


@query("SELECT o_orderpriority, CAST(any_value(n) FILTER (o_orderstatus = 'F') AS BIGINT) AS \"F\", CAST(any_value(n) FILTER (o_orderstatus = 'O') AS BIGINT) AS \"O\", CAST(any_value(n) FILTER (o_orderstatus = 'P') AS BIGINT) AS \"P\" FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def pivot_wider(t, s):
    return t("orders").summarize(n=f.n(), _by=["o_orderpriority", "o_orderstatus"]).pivot_wider("o_orderstatus", "n")


@query("""SELECT l_linestatus, CAST(any_value(n) FILTER (l_returnflag = 'A') AS BIGINT) AS A_n, CAST(any_value(n) FILTER (l_returnflag = 'R') AS BIGINT) AS R_n, any_value(q) FILTER (l_returnflag = 'A') AS A_q, any_value(q) FILTER (l_returnflag = 'R') AS R_q
FROM (SELECT l_linestatus, l_returnflag, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_linestatus""")
def pivot_wider_multi(t, s):
    long = t("lineitem").summarize(n=f.n(), q=f.maximum("l_quantity"), _by=["l_linestatus", "l_returnflag"])
    return long.pivot_wider(("l_returnflag", ["A", "R"]), ["n", "q"])


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def pivot_longer(t, s):
    return t("part").select("p_partkey", "p_size", "p_retailprice").pivot_longer("p_size:p_retailprice")


@query("SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS a, nullif(array_to_string((string_split(p_name, ' '))[2:], ' '), '') AS b FROM part")
def separate_cols(t, s):
    return t("part").select("p_partkey", "p_name").separate("p_name", ["a", "b"], " ")


@query("SELECT c_custkey, concat_ws('-', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS tag FROM customer")
def unite_cols(t, s):
    return t("customer").select("c_custkey", "c_mktsegment", "c_nationkey").unite("tag", ["c_mktsegment", "c_nationkey"], "-")


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def unnest_longer(t, s):
    return t("embeddings").select("vec_id", "embedding").unnest_longer("embedding")


@query("SELECT o_orderkey, struct_extract(x, 'a') AS x_a, struct_extract(x, 'b') AS x_b FROM (SELECT o_orderkey, {'a': o_custkey, 'b': o_orderstatus} AS x FROM orders)")
def unnest_wider(t, s):
    return t("orders").transmute(o_orderkey=col("o_orderkey"), x=sql("named_struct('a', o_custkey, 'b', o_orderstatus)")).unnest_wider("x", names_sep="_")


@query("SELECT o_custkey AS a, o_orderstatus AS b FROM orders UNION ALL SELECT o_orderkey, 'x' FROM orders")
def transmute_unnest(t, s):
    return t("orders").mutate(items=sql("array(named_struct('a', o_custkey, 'b', o_orderstatus), named_struct('a', o_orderkey, 'b', 'x'))")).transmute(f.unnest("items"))


# text and dates


@query("SELECT doc_id, regexp_replace(lang, '(e)|n', '<\\0>') AS a, regexp_replace(source, 'r|c', '_') AS b FROM documents")
def str_replace_first(t, s):
    return t("documents").transmute(doc_id="doc_id", a=f.str_replace("lang", "(e)|n", r"<\0>"), b=f.str_replace("source", "r|c", "_"))


@query("SELECT p_partkey, regexp_replace(p_type, '([AEIOU])([A-Z])', '\\2\\1', 'g') AS a FROM part")
def str_replace_all(t, s):
    return t("part").transmute(p_partkey="p_partkey", a=f.str_replace_all("p_type", "([AEIOU])([A-Z])", r"\2\1"))


@query("SELECT p_partkey, regexp_replace(p_type, '[AE]', '', 'g') AS a, regexp_replace(p_type, '[AE]', '') AS b FROM part")
def str_remove_all(t, s):
    return t("part").transmute(p_partkey="p_partkey", a=f.str_remove_all("p_type", "[AE]"), b=f.str_remove("p_type", "[AE]"))


@query("SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS n, concat(p_brand, NULL, '/', p_type) AS c FROM part")
def str_plain(t, s):
    return t("part").transmute(p_partkey="p_partkey", lo=col("p_name").lower(), up=f.upper("p_name"), n=f.length("p_name"), c=f.concat(col("p_brand"), lit(None), "/", col("p_type")))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, dayofweek(o_orderdate) AS w FROM orders")
def date_parts(t, s):
    d = "o_orderdate"
    return t("orders").transmute(o_orderkey="o_orderkey", y=f.year(d), m=f.month(d), d=f.day(d), h=f.hour(d), mi=f.minute(d), s=f.second(d), w=f.dayofweek(d))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('year', o_orderdate) AS y FROM orders")
def date_floor(t, s):
    return t("orders").transmute(o_orderkey="o_orderkey", m=f.floor_date("o_orderdate", "month"), y=f.floor_date("o_orderdate", "year"))


@query("""SELECT event_id, date_diff('month', TIMESTAMP '2023-12-31', ts) AS mo, date_diff('hour', TIMESTAMP '2023-12-31', ts) AS h, date_diff('day', TIMESTAMP '2023-12-31', ts) AS d,
date_diff('year', TIMESTAMP '2023-12-31', ts) AS y, date_diff('minute', TIMESTAMP '2023-12-31', ts) AS mi FROM events""")
def date_difftime(t, s):
    start = sql("timestamp_ntz '2023-12-31 00:00:00'")
    return t("events").transmute(event_id="event_id", **{k: f.difftime("ts", start, u) for k, u in (("mo", "months"), ("h", "hours"), ("d", "day"), ("y", "year"), ("mi", "minutes"))})


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR - INTERVAL 2 MONTH + INTERVAL 3 DAY - INTERVAL 4 HOUR + INTERVAL 5 MINUTE + INTERVAL 6 SECOND AS v FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' - INTERVAL 1 YEAR")
def date_interval(t, s):
    late = col("o_orderdate") > f.ymd("1997-01-01") - f.interval("1 year")
    return t("orders").filter(late).transmute(o_orderkey="o_orderkey", v=col("o_orderdate") + f.years(1) - f.months(2) + f.days(3) - f.hours(4) + f.minutes(5) + f.seconds(6))


@query("SELECT n_nationkey, TIMESTAMP '2023-06-15' AS a, TIMESTAMP '2023-06-12' AS b, TIMESTAMP '2023-12-06' AS c FROM nation")
def date_parse(t, s):
    return t("nation").transmute(n_nationkey="n_nationkey", a=f.ymd("2023-06-15"), b=f.mdy("06-12-2023"), c=f.dmy("06-12-2023"))


# nested values


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS v FROM part")
def map_lookup(t, s):
    m = f.make_map(["size", "price"], [sql("double(p_size)"), col("p_retailprice")])
    return t("part").mutate(m=m).transmute(p_partkey="p_partkey", v=f.if_else(col("p_size") > 25, col("m")["size"], col("m")["price"]))


@query("SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders WHERE o_custkey % 2 = 0")
def struct_fields(t, s):
    made = t("orders").transmute(o_orderkey="o_orderkey", x=sql("named_struct('a', o_custkey, 'b', o_orderstatus)"))
    return made.filter(col("x.a") % 2 == 0).transmute(o_orderkey="o_orderkey", a=col("x.a"), b=col("x").field("b"))


@query("SELECT p_partkey, p_partkey AS a, CAST(p_size AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c FROM part")
def array_elements(t, s):
    made = t("part").mutate(xs=f.make_array("p_partkey", sql("bigint(p_size)")))
    return made.transmute(p_partkey="p_partkey", a=col("xs")[1], b=col("xs")[2], c=col("xs")[3])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t, s):
    return t("events").transmute(event_id="event_id", k=f.json_value("props", "$.k", "bigint"))


@query("SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def udf_vectorized(t, s):
    def twice(x):
        return x * 2 + 1

    twice.__annotations__ = {"x": "pd.Series", "return": "pd.Series"}
    import pandas as pd

    twice.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return t("part").transmute(p_partkey="p_partkey", v=f.udf(twice, "int")("p_size"))


# catalog and files


def _summary_sql(table: str, numbers: list[str], texts: list[str]) -> str:
    one = "SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, {avg} AS avg, {std} AS std, CAST(count(*) AS BIGINT) AS count, CAST(0 AS DOUBLE) AS null_percentage FROM {t}"
    parts = [one.format(c=c, t=table, avg=f"round(avg({c}), 6)", std=f"round(stddev_samp({c}), 6)") for c in numbers]
    return " UNION ALL ".join(parts + [one.format(c=c, t=table, avg="CAST(NULL AS DOUBLE)", std="CAST(NULL AS DOUBLE)") for c in texts])


@query(_summary_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def summary_stats(t, s):
    exact = t("part").summary().select("column_name", "min", "max", "avg", "std", "count", "null_percentage")
    return exact.mutate(avg=f.round("avg", 6), std=f.round("std", 6))


@query("SELECT column_name, near FROM (VALUES ('l_orderkey', TRUE), ('l_quantity', TRUE), ('l_tax', TRUE)) v(column_name, near)")
def summary_estimates(t, s):
    """Quartiles and counts of distinct values are estimates: they are held to the exact ones."""
    few = t("lineitem").select("l_orderkey", "l_quantity", "l_tax")
    exact = few.pivot_longer("l_orderkey:l_tax").summarize(median=f.median("value"), spread=f.std("value"), kinds=f.n_distinct("value"), _by="variable")
    both = few.summary().inner_join(exact, "column_name == variable")
    near = (f.row(lambda a, b, c: F.abs(a.cast("double") - b) <= c / 10, "q50", "median", "spread")) & f.row(lambda a, b: F.abs(a / b - 1) < 0.15, "approx_unique", "kinds")
    return both.transmute(column_name="column_name", near=near)


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def view_roundtrip(t, s):
    t("region").create_view("tessera_region", replace=True)
    return dt(s, "tessera_region").filter(col("r_regionkey") > 1)


@query("SELECT n_nationkey, n_name FROM nation")
def table_roundtrip(t, s):
    name = f"tessera_nation_{uuid4().hex}"
    t("nation").select("n_nationkey", "n_name").create_table(name)
    return dt(s, name)


def _roundtrip(t, suffix: str) -> Tbl:
    path = t.kept(suffix)
    t("supplier").select("s_suppkey", "s_name", "s_acctbal").write_file(path)
    return dt(t.spark, path).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_read_roundtrip(t, s):
    return _roundtrip(t, "csv")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_read_json(t, s):
    return _roundtrip(t, "json")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_read_tsv(t, s):
    return _roundtrip(t, "tsv")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_read_parquet(t, s):
    return _roundtrip(t, "parquet")


@query("SELECT r_regionkey, r_name FROM region")
def read_glob(t, s):
    return t("regi*")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def read_several_paths(t, s):
    return t(["nation", "nation"]).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def read_explicitly(t, s):
    return read(s, "parquet", t.path("nation"), mergeSchema="true").filter(col("data.n_regionkey") == 1).select("n_nationkey", "n_name")


@query("SELECT id, name, n_regionkey FROM (VALUES (CAST(0 AS BIGINT), 'a'), (CAST(1 AS BIGINT), 'b'), (CAST(9 AS BIGINT), 'c')) v(id, name) LEFT JOIN (SELECT DISTINCT n_regionkey FROM nation) ON id = n_regionkey")
def frame_in_memory(t, s):
    import pandas as pd

    own = dt(s, pd.DataFrame({"id": [0, 1, 9], "name": ["a", "b", "c"]}), "tessera_own", alias="own")
    return own.left_join(t("nation").distinct("n_regionkey").mutate(k=col("n_regionkey")), "own.id == k").select("id", "name", "n_regionkey")


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
def collected(t, s):
    """Results on the driver, as a frame and as a stream of rows."""
    counts = t("nation").summarize(n=f.n(), _by="n_regionkey")
    frame, streamed = counts.collect(), [(r.n_regionkey, r.n) for r in counts.collect(stream=True)]
    if sorted(zip(frame.n_regionkey, frame.n)) != sorted(streamed):
        raise AssertionError("the stream's rows are not the frame's")
    return s.createDataFrame(streamed, "n_regionkey int, n long")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000")
def copied_table(t, s):
    rich = t("supplier").filter(col("s_acctbal") > 1000).select("s_suppkey", "s_acctbal")
    return copy_to(s, rich.df_now(), f"tessera_rich_{uuid4().hex}")


@query("SELECT r_regionkey, r_name FROM region")
def view_dropped(t, s):
    name = f"tessera_gone_{uuid4().hex}"
    t("region").create_view(name)
    if not drop_view(s, name) or s.catalog.tableExists(name):
        raise AssertionError("the view is still there")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        shown = t("region").select("r_regionkey", "r_name").show_query()
    if "select" not in out.getvalue():
        raise AssertionError("the verbs are not shown")
    return shown
