"""Verbs on small tables: literal results, semantic traps, and laws that hold for any table."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera import Tbl, across, closest, col, copy_to, desc, drop_view, dt, exclude, show_tables, span
from tessera.functions import helpers as f
from tessera.operators.selectors import contains, ends_with, starts_with
from tessera.streaming.windows import tumbling


def letters(i):
    return chr(65 + i // 26) + chr(65 + i % 26)


def rows(t):
    return [tuple(r) for r in t.df_now().collect()]


def srows(t):
    return sorted(rows(t), key=repr)


@pytest.fixture(scope="module")
def doc(spark):
    """Ten rows: id, groups, value, percent."""
    return dt(spark, pd.DataFrame({"id": [letters(i) for i in range(10)], "groups": ["aa" if i % 2 == 0 else "bb" for i in range(1, 11)], "value": [1, 2, 3, 4, 5] * 2, "percent": [i / 10 for i in range(1, 11)]}), "doc")


@pytest.fixture(scope="module")
def test(spark):
    return dt(spark, pd.DataFrame({"id": [letters(i) for i in range(100)], "groups": ["aa" if i % 2 == 0 else "bb" for i in range(1, 101)], "value": list(range(1, 21)) * 5, "percent": [i / 200 for i in range(1, 101)]}), "test_df")


@pytest.fixture(scope="module")
def score(spark):
    return dt(spark, pd.DataFrame({"id2": [letters(i) for i in range(0, 14, 2)], "category": list("XYXYXYX"), "score": [88, 92, 77, 83, 95, 68, 74]}), "score")


def make(spark, data, schema):
    return Tbl(spark.createDataFrame(data, schema))


# selection


def test_selection_language(test):
    assert test.select(contains("e")).columns == ["value", "percent"]
    assert test.select("id:value").columns == ["id", "groups", "value"]
    assert test.select("!(groups:value)").columns == test.select(~span("groups", "value")).columns == ["id", "percent"]
    assert test.select(~starts_with("v")).columns == ["id", "groups", "percent"]
    assert test.select("!test_df.value").columns == test.select(exclude("value")).columns == ["id", "groups", "percent"]
    assert test.select(["id", "value"], "groups", "id").columns == ["id", "value", "groups"]
    assert test.relocate(["groups", "value"], ends_with("d"), after="percent").columns == ["percent", "groups", "value", "id"]
    assert test.relocate("value").columns == ["value", "id", "groups", "percent"]
    assert test.relocate("id", after="value").columns == ["groups", "value", "id", "percent"]
    assert test.relocate("percent", before="groups").columns == ["id", "percent", "groups", "value"]
    assert test.rename(key="id").columns == ["key", "groups", "value", "percent"]
    for bad in ("nothing", "value:id"):
        with pytest.raises((KeyError, ValueError)):
            test.select(bad)


def test_tables_are_immutable(doc):
    doc.filter(col("value") > 3).mutate(x=1).arrange("id").head(1)
    assert doc.columns == ["id", "groups", "value", "percent"] and doc.df_now().count() == 10


# filters and order


def test_filters(test):
    n = lambda *c: test.filter(*c).df_now().count()
    assert n(col("groups") == "aa", col("value") > 3) == n((col("groups") == "aa") & (col("value") > 3)) == n("groups = 'aa' and value > 3")
    assert n(~f.str_detect("id", "F") & (col("value") > 3)) + n(f.str_detect("id", "F") & (col("value") > 3)) == n(col("value") > 3)
    assert n(f.str_detect("id", re.compile("C$"))) == 4 and n(f.str_detect("id", re.compile("^a"))) == 0
    assert n(f.str_detect("id", "_C")) == 4  # _ is a wildcard
    assert n((col("value") > 3) & (col("value") < 5)) == 5 and n(col("id").isin("AA", "AI", "AC")) == 3
    assert n(f.str_detect("id", re.compile("[BC]$"))) == 8  # brackets stay brackets


def test_two_filters_both_hold_after_mutate_join_and_slice(doc, score):
    t = doc.mutate(v=col("value") * 2).filter(col("v") > 4).filter(col("groups") == "aa")
    assert [r[0] for r in srows(t)] == ["AD", "AH", "AJ"]
    j = doc.left_join(score, "id == id2").filter(col("score") > 80).filter(col("category") == "X")
    assert [r[0] for r in srows(j)] == ["AA", "AI"]
    assert doc.slice_sample(n=2, _by="groups").filter(col("value") > 0).df_now().count() == 4
    g = doc.mutate(v=col("value")).filter(col("v") > 2).group_by("groups").summarize(n=f.n()).filter(col("n") > 0)
    assert sum(r[1] for r in rows(g)) == 6


def test_order_and_limit_are_deferred_and_nulls_come_last(spark, doc):
    assert doc.head(3).filter(col("value") == 5).df_now().count() == 2
    assert [r[0] for r in rows(doc.arrange(desc("value"), "id").head(3).filter(col("groups") == "bb"))] == ["AE", "AI", "AC"]
    t = make(spark, [(1,), (None,), (3,)], "a int")
    assert rows(t.arrange("a")) == [(1,), (3,), (None,)] and rows(t.arrange(desc("a"))) == [(3,), (1,), (None,)]
    assert rows(t.arrange(desc(1 and "a")).arrange(1)) == [(1,), (3,), (None,)]  # the last one holds
    w = t.mutate(k=f.row_number(), _order="a")
    assert sorted(rows(w), key=lambda r: r[1])[-1] == (None, 3)


# mutate


def test_mutate_places_and_precedence(doc):
    t = doc.mutate(value=col("value") * 2, four=4, both=col("four") + 1, old=col("value"))
    assert t.columns == ["id", "groups", "value", "percent", "four", "both", "old"]
    assert rows(t.arrange("id"))[1] == ("AB", "aa", 4, 0.2, 4, 5, 2)


def test_division_by_zero(spark):
    t = make(spark, [(1.0, 0), (-1.0, 0), (0.0, 0), (None, 0), (6.0, 4), (1.0, None)], "a double, b int").transmute(q=col("a") / col("b"))
    got = [r[0] for r in rows(t)]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, 1.5, None]


def test_casts(spark):
    t = make(spark, [(3.7, "3.7"), (2.5, "2.5"), (-2.5, "-2.5"), (3.5, "x"), (None, None)], "d double, s string")
    got = rows(t.transmute(d=f.as_integer("d"), s=f.as_integer("s"), f=f.as_float("s"), t=f.as_string("d")))
    assert [r[:2] for r in got] == [(4, 4), (2, 3), (-2, -3), (4, None), (None, None)]
    assert [r[2] if r[2] is None else float(r[2]) for r in got] == [3.7, 2.5, -2.5, None, None] and got[0][3] == "3.7"


@pytest.mark.parametrize(("pattern", "rep"), [("a|b", "X"), ("x*", "-"), ("(a)(b)?", r"[\2\1]"), ("^a", "$"), ("b$", "\\\\"), ("a", "9"), (r"\d+", r"<\0>"), ("(?i)A", "q")])
def test_first_match_only(spark, pattern, rep):
    import duckdb

    texts = ["", "a", "b", "ab", "ba", "xxaxx", "12ab34", "a\nb", "c", None]
    got = [r[0] for r in rows(make(spark, [(t,) for t in texts], "s string").transmute(s=f.str_replace("s", pattern, rep)))]
    c = duckdb.connect()
    assert got == [c.execute("SELECT regexp_replace(?::VARCHAR, ?, ?)", [t, pattern, rep]).fetchone()[0] for t in texts]


def test_conditions_and_missing_values(spark):
    t = make(spark, [(1,), (5,), (None,)], "a int")
    got = rows(t.transmute(x=f.if_else(col("a") > 3, "hi", "lo"), y=f.if_else(col("a") > 3, f.lit(None), col("a"), 43), z=f.case_when(col("a") > 3, "high", f.is_missing("a"), "none"), m=f.missing_if("a", 5), r=f.replace_missing("a", 0)))
    assert got == [("lo", 1, None, 1, 1), ("hi", 43, "high", None, 5), ("lo", 43, "none", None, 0)]


def test_dates(spark):
    t = make(spark, [(1,)], "a int").transmute(s=f.ymd("2024-01-31"), e=f.ymd("2024-02-01"), h=f.sql("timestamp_ntz '2024-01-01 00:59:00'"), g=f.sql("timestamp_ntz '2024-01-01 01:00:00'"))
    got = rows(t.transmute(m=f.difftime("e", "s", "months"), h=f.difftime("g", "h", "hour"), back=f.difftime("s", "e", "month"), w=f.difftime(f.ymd("2024-03-01"), f.ymd("2024-01-01"), "weeks"), wd=f.dayofweek(f.ymd("2024-03-03"))))
    assert got == [(1, 1, -1, 8, 0)]
    kind = dict(t.transmute(x=f.floor_date("s", "month"), y=f.year("s")).df.dtypes)
    assert kind == {"x": "timestamp_ntz", "y": "bigint"}


def test_window_order_frame_and_keywords_agree(test):
    a = test.window_order("percent").window_frame(-1, 1).group_by("groups").mutate(value=f.sum("value")).window_order(desc("percent")).window_frame(2).mutate(v2=f.sum("value"))
    b = test.mutate(value=f.sum("value"), _order="percent", _frame=(-1, 1), _by="groups").mutate(v2=f.sum("value"), _order=desc("percent"), _frame=2)
    assert srows(a) == srows(b)
    assert a.groups == () and a.worder == () and a.wframe is None


def test_windows_without_order_and_ranks_with_frames(doc):
    assert {r[-1] for r in rows(doc.mutate(k=f.row_number()))} == set(range(1, 11))
    assert {r[-1] for r in rows(doc.mutate(k=f.lag("value"), _frame=(-1, 1)))}
    assert {r[-1] for r in rows(doc.mutate(k=f.sum("value")))} == {30}
    share = rows(doc.count("groups").mutate(p=col("n") / f.sum("n")))
    assert [r[2] for r in share] == [0.5, 0.5]
    d = rows(doc.mutate(k=f.n_distinct("value"), _by="groups"))
    assert {r[-1] for r in d} == {5}
    with pytest.raises(ValueError):
        doc.summarize(x=f.cumsum("value"))
    with pytest.raises(ValueError):
        doc.summarize(x=f.agg(f.median("value")))
    assert {r[-1] for r in rows(doc.mutate(k=f.agg(F.median("value")), _by="groups"))} == {3.0}


def test_registered_window_functions(doc):
    f.register_window_fn("percentile_approx")
    assert {r[-1] for r in rows(doc.mutate(m=f.fn("percentile_approx", "value", f.lit(0.5)), _by="groups"))} == {3}


# aggregates


def test_summarize(doc):
    t = doc.group_by("groups").summarize(across(starts_with("v"), (f.mean, f.minimum)), n=f.n())
    assert t.columns == ["groups", "value_mean", "value_minimum", "n"] and srows(t) == [("aa", 3.0, 1, 5), ("bb", 3.0, 1, 5)]
    assert srows(doc.summarize(s=f.sum("value"), _by="groups")) == srows(doc.group_by("groups").summarize(s=f.sum("value")))
    assert rows(doc.group_by("groups").summarize(n=f.n()).summarize(n=f.sum("n"))) == [(10,)]
    assert srows(doc.group_by("groups")) == [("aa",), ("bb",)]
    assert srows(doc.count("groups", "value", sort=False).filter(col("n") > 1)) == []
    assert rows(doc.count()) == [(10,)]
    assert srows(doc.distinct("groups")) == [("aa",), ("bb",)]
    with pytest.raises(ValueError):
        doc.filter(f.sum("value") > 1)


def test_group_by_all_and_warnings(doc):
    import tessera

    t = doc.group_by("all").summarize(g=col("groups"), big=col("value") > 3, n=f.n())
    assert t.columns == ["g", "big", "n"] and srows(t) == [("aa", False, 3), ("aa", True, 2), ("bb", False, 3), ("bb", True, 2)]
    assert srows(t) == srows(doc.summarize(g=col("groups"), big=col("value") > 3, n=f.n(), _by="all"))
    tessera.warnings(True)
    try:
        with pytest.warns(UserWarning, match="consumes"):
            doc.group_by("groups").mutate(n=f.n())
    finally:
        tessera.warnings(False)


def test_bias_corrected_moments(spark):
    x = [1.0, 2.0, 2.5, 7.0, 11.0]
    k, s, few = rows(make(spark, [(v,) for v in x], "x double").summarize(k=f.kurtosis("x"), s=f.skewness("x"), few=f.n()))[0]
    assert (k, s) == pytest.approx((pd.Series(x).kurt(), pd.Series(x).skew())) and few == 5
    assert rows(make(spark, [(1.0,), (2.0,)], "x double").summarize(k=f.kurtosis("x"), s=f.skewness("x"))) == [(None, None)]


# joins


def test_join_contract(doc, score):
    left = doc.left_join(score, "id == id2")
    assert left.columns == ["id", "groups", "value", "percent", "category", "score"]
    assert sum(r[-1] is not None for r in rows(left)) == 5
    assert left.df_now().count() == 10 and doc.right_join(score, "id = id2").df_now().count() == 7
    assert doc.full_join(score, ("id", "id2")).df_now().count() == 12
    assert {r[0] for r in rows(doc.full_join(score, ("id", "id2")))} >= {"AK", "AM"}
    semi, anti = doc.semi_join(score, "id == id2"), doc.anti_join(score, "id == id2")
    assert semi.columns == doc.columns and srows(semi.union_all(anti)) == srows(doc)
    assert doc.inner_join(score, "id == id2", "value <= score").columns == ["id", "groups", "value", "percent", "category", "score"]
    with pytest.raises(ValueError):
        doc.inner_join(score)


def test_duplicate_names_self_joins_and_qualified_columns(spark, doc):
    t = doc.inner_join(doc, "id")
    assert t.columns == ["id", "groups", "value", "percent", "groups_1", "value_1", "percent_1"]
    again = doc.inner_join(t.filter(col("value") > 2), "id").inner_join(doc, "id")
    assert len(set(again.columns)) == len(again.columns) and again.df_now().count() == 6
    a = dt(spark, spark.createDataFrame([(1, 2)], "k int, v int"), "a")
    b = dt(spark, spark.createDataFrame([(1, 3)], "k int, v int"), "b")
    assert rows(a.inner_join(b, "k").transmute(x=col("a.v"), y=col("b.v"))) == [(2, 3)]
    none = make(spark, [(None, 1)], "k int, v int")
    assert none.inner_join(none, "k").df_now().count() == 0


@pytest.mark.parametrize("hint", ["even", "skew"])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("how", ["left", "inner", "right", "full", "semi", "anti"])
def test_asof_matches_brute_force(spark, op, how, hint):
    r = random.Random(7)
    left = [(i, r.choice([1, 2, None]), r.choice([*range(0, 40, 3), None])) for i in range(40)]
    right = [(100 + i, g, k) for i, (g, k) in enumerate({(r.choice([1, 2, None]), r.choice([*range(0, 40, 2), None])) for _ in range(30)})]
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    want, used = [], set()
    for i, g, k in left:
        ok = [x for x in right if None not in (g, k, x[1], x[2]) and x[1] == g and test(k, x[2])]
        m = (min if "<" in op else max)(ok, key=lambda x: x[2]) if ok else None
        used.add(m[0] if m else None)
        if how in ("semi", "anti"):
            want += [(i, g, k)] if (m is not None) == (how == "semi") else []
        elif m or how in ("left", "full"):
            want.append((g, i, k, m[0] if m else None, m[2] if m else None))
    if how in ("right", "full"):
        want += [(g, None, None, j, k) for j, g, k in right if j not in used]
    a, b = make(spark, left, "i int, g int, k int"), make(spark, right, "j int, g int, q int")
    got = getattr(a, f"{how}_join")(b, "g", f"closest(k {op} q)", hint=hint)
    assert srows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["left", "full"])
def test_asof_deals_a_hot_key_and_a_common_null(spark, how):
    """One user has most rows and a third have none: no task of the ordered pass gets them all."""
    a = make(spark, [(i, [1, 1, None, 2 + i % 5][i % 4], i) for i in range(4000)], "i int, g int, k int")
    b = make(spark, [(i, 1 if i % 3 else None, i * 3) for i in range(1000)], "j int, g int, q int")
    got = {r.i: r.j for r in getattr(a, f"{how}_join")(b, "g", closest("k >= q"), hint="skew").df_now().filter("i is not null").collect()}
    for i, g, k in [(i, [1, 1, None, 2 + i % 5][i % 4], i) for i in range(4000)]:
        last = min(999, k // 3)
        assert got[i] == ((last if last % 3 else last - 1) if g == 1 and last else None)
    plan = a.left_join(b, "g", closest("k >= q"), hint="skew").df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "__p" in plan and "scalar-subquery" in plan


def test_asof_is_lazy_and_cut_by_size(spark, monkeypatch, tmp_path):
    from tessera.operators import joins

    make(spark, [(i, 1, i) for i in range(50)], "i int, g int, k int").df.write.parquet(f"{tmp_path}/a")
    a = dt(spark, spark.read.parquet(f"{tmp_path}/a"))
    b = a.rename(j="i", q="k")
    small = a.left_join(b, "g", closest("k > q")).df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(joins, "ONE_TASK", 10)
    large = a.left_join(b, "g", closest("k > q")).df._jdf.queryExecution().optimizedPlan().toString()
    even = a.left_join(b, "g", closest("k > q"), hint="even").df._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in small + even and "scalar-subquery" in large


def test_asof_without_equal_keys(spark):
    a = make(spark, [(i, i * 3 % 50) for i in range(40)], "i int, k int")
    b = make(spark, [(i, i * 7) for i in range(1, 6)], "j int, q int").mutate(q=f.sql("timestamp_ntz '2024-01-01' + make_dt_interval(q)"))
    got = a.mutate(k=f.sql("timestamp_ntz '2024-01-01' + make_dt_interval(k)")).left_join(b, closest("k >= q"))
    assert dict(rows(got.select("i", "j"))) == {i: min(5, i * 3 % 50 // 7) or None for i in range(40)}


def test_asof_needs_one_inequality(doc, score):
    with pytest.raises(ValueError):
        closest("value != score")
    with pytest.raises(ValueError):
        doc.inner_join(score, closest("value > score"), closest("value < score"))


# sets, slices, shape


def test_sets(spark):
    a = make(spark, [(1, "x"), (1, "x"), (2, "y"), (3, "z"), (1, "x")], "id int, name string")
    b = make(spark, [(1, "x"), (1, "x"), (3, "z"), (4, "w")], "id int, name string")
    assert srows(a.union(b)) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")] and a.union_all(b).df_now().count() == 9
    assert srows(a.intersect(b)) == [(1, "x"), (3, "z")] and srows(a.intersect(b, all=True)) == [(1, "x"), (1, "x"), (3, "z")]
    assert srows(a.setdiff(b)) == [(2, "y")] and srows(a.setdiff(b, all=True)) == [(1, "x"), (2, "y")]


def test_slices(doc):
    assert srows(doc.slice_min("value").select("id", "rank_col")) == [("AA", 1), ("AF", 1)]
    assert srows(doc.group_by("groups").slice_max("value").select("groups", "value", "rank_col")) == [("aa", 5, 1), ("bb", 5, 1)]
    assert srows(doc.slice_sample(n=3, _by="groups").select("groups", "row_num")) == [(g, k) for g in ("aa", "bb") for k in (1, 2, 3)]
    assert sorted(r[-1] for r in rows(doc.slice_sample(n=4))) == [1, 2, 3, 4]


def test_pivots(spark):
    long = make(spark, [(1, "A", 1), (1, "B", 2), (2, "A", 3), (2, "B", 4)], "id int, variable string, value int")
    wide = long.pivot_wider("variable", "value")
    assert wide.columns == ["id", "A", "B"] and srows(wide) == [(1, 1, 2), (2, 3, 4)]
    assert srows(long.pivot_wider(("variable", ["A", "B"]), "value")) == srows(wide)
    assert srows(wide.pivot_longer("A:B")) == srows(long)
    assert wide.pivot_longer("A:B", names_to="letter", values_to="number").columns == ["id", "letter", "number"]
    years = make(spark, [("2023", 1), ("2024", 2), ("2024", None)], "y string, v int").pivot_wider("y", "v")
    assert years.columns == ["2023", "2024"] and rows(years) == [(1, 2)]
    mixed = make(spark, [(1, "a", 2)], "id int, s string, n int").pivot_longer("s", "n")
    assert srows(mixed) == [(1, "n", "2"), (1, "s", "a")]


def test_separate_unite_drop_missing(spark):
    t = make(spark, [("1-1",), ("2-2",), ("3-3-3",), ("4",), ("-5",)], "a string")
    assert rows(t.separate("a", ["b", "c"], "-")) == [("1", "1"), ("2", "2"), ("3", "3-3"), ("4", None), (None, "5")]
    u = make(spark, [("1", "1", None, 1), ("3", "3", "3", 3)], "b string, c string, d string, cc int")
    assert u.unite("new", ["b", "c", "d"], "-").columns == ["cc", "new"] and rows(u.unite("new", ["b", "c", "d"], "-")) == [(1, "1-1"), (3, "3-3-3")]
    m = make(spark, [(1, 1.0), (2, None), (None, 3.0), (4, float("nan"))], "a int, b double")
    assert m.drop_missing().df_now().count() == 2 and m.drop_missing("a").df_now().count() == 3


def test_unnest(spark):
    t = make(spark, [(1, (10.1, 30.3)), (3, (10.3, None))], "id int, pos struct<lat:double,lon:double>")
    assert t.unnest_wider("pos").columns == ["id", "lat", "lon"] and t.unnest_wider("pos", names_sep="_").columns == ["id", "pos_lat", "pos_lon"]
    lists = make(spark, [(1, [1, 2], [3, 4]), (2, [5, 6], [7, 8, 9]), (3, [], None), (4, None, [1])], "id int, a array<int>, b array<int>")
    assert rows(lists.unnest_longer("a:b")) == [(1, 1, 3), (1, 2, 4), (2, 5, 7), (2, 6, 8), (2, None, 9), (4, None, 1)]
    items = make(spark, [(1, [(1, "x"), (2, "y")])], "id int, items array<struct<a:int,b:string>>")
    assert rows(items.transmute(f.unnest("items"))) == [(1, "x"), (2, "y")]
    maps = make(spark, [(1.5, 2)], "p double, v int").mutate(m=f.make_map(["v", "p"], [f.sql("double(v)"), col("p")]))
    assert rows(maps.transmute(a=col("m")["v"], b=col("m")["none"], c=f.make_array("v", "v")[1])) == [(2.0, None, 2)]


# sources and sinks


def test_files_views_and_tables(spark, doc, tmp_path):
    for kind in ("csv", "tsv", "parquet", "json", "orc"):
        path = f"{tmp_path}/my-file.{kind}"
        doc.write_file(path)
        back = dt(spark, path)
        assert srows(back.select("id", "groups", "value", "percent")) == srows(doc), kind
        assert "my_file" in back.scopes
    many = dt(spark, [f"{tmp_path}/my-file.csv", f"{tmp_path}/my-file.csv"])
    assert many.df_now().count() == 20 and dt(spark, f"{tmp_path}/my-*.csv").scopes.keys() == {"data"}
    with pytest.raises(ValueError):
        dt(spark, [f"{tmp_path}/a.xlsx"])
    doc.create_view("v1", replace=True)
    assert dt(spark, "v1").df_now().count() == 10 and any(t.name == "v1" for t in show_tables(spark)) and drop_view(spark, "v1")
    doc.create_table("t1", replace=True)
    with pytest.raises(Exception):
        doc.create_table("t1")
    assert srows(copy_to(spark, f"{tmp_path}/my-file.parquet", "t2", overwrite=True)) == srows(dt(spark, "t1"))
    doc.head(2).create_table("t3", replace=True, temp=True)
    assert dt(spark, "t3").df_now().count() == 2
    import pyarrow as pa
    from pyarrow import feather

    for name, values in (("x", [1, 2]), ("y", [3])):
        feather.write_feather(pa.table({"a": values, "b": ["t"] * len(values)}), f"{tmp_path}/{name}.arrow")
    assert rows(dt(spark, f"{tmp_path}/x.arrow")) == [(1, "t"), (2, "t")]
    assert srows(dt(spark, f"{tmp_path}/*.arrow").select("a")) == [(1,), (2,), (3,)]
    spark.sql("drop table t1")
    spark.sql("drop table t2")


def test_results(doc, capsys):
    assert len(doc.collect()) == 10 and doc.to_arrow().num_rows == 10
    assert sum(1 for _ in doc.collect(stream=True)) == 10
    doc.filter(col("value") > 1).tap(lambda t: None).pipe(lambda t: t.head(1)).show_query()
    assert "filter -> head" in capsys.readouterr().out
    s = {r.column_name: r for r in doc.summary().df_now().collect()}
    assert s["value"].min == "1" and s["value"].q50 == "3" and s["id"].approx_unique == 10 and s["value"].null_percentage == 0.0


def test_scalar_subquery_and_udf(doc):
    top = doc.summarize(m=f.maximum("value"))
    assert srows(doc.filter(col("value") == top.scalar()).select("id")) == [("AE",), ("AJ",)]
    plus = f.udf(lambda a, b: a + b, "long", vectorized=False)
    assert rows(doc.transmute(x=plus("value", "value")).head(1))[0][0] in (2, 4, 6, 8, 10)


def test_stream_windows(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 00:01:00", 1), ("2024-01-01 00:04:00", 2), ("2024-01-01 00:20:00", 5)], "s string, v int").select(F.to_timestamp("s").alias("ts"), "v")
    src.write.parquet(f"{tmp_path}/in")
    stream = Tbl(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"))
    out = tumbling(stream.filter(col("v") > 0), "ts", "5 minutes", late="10 minutes", total=f.sum("v"))
    q = out.df.writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.total for r in spark.table("win").collect()) == [3, 5]


# plans


def test_plans_push_down_and_stay_in_the_jvm(spark, sf):
    t = dt(spark, f"{sf}/lineitem.parquet").filter(col("l_quantity") > 10).summarize(s=f.sum("l_tax"), _by="l_returnflag")
    plan = t.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan.replace("l_quantity), GreaterThan", "l_quantity), GreaterThan")
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in plan and "Python" not in plan
    top = dt(spark, f"{sf}/orders.parquet").group_by("o_orderpriority").slice_max("o_totalprice", n=3)
    assert "WindowGroupLimit" in top.df._jdf.queryExecution().executedPlan().toString()
    head = dt(spark, f"{sf}/orders.parquet").arrange("o_totalprice").head(3)
    assert "TakeOrderedAndProject" in head.df_now()._jdf.queryExecution().executedPlan().toString()


# what the reference's dialect does beside Spark's


def test_windows_over_new_columns(doc):
    t = doc.mutate(double=col("value") * 2, top=f.maximum("double"), share=col("double") / col("top"), value=col("value") + 100, old=col("value"), _by="groups")
    got = t.df_now().collect()
    assert t.columns == ["id", "groups", "value", "percent", "double", "top", "share", "old"]
    for r in got:  # an old column keeps its value for the rest of the call
        assert r.value == r.old + 100 and r.double == 2 * r.old and r.top == 10 and r.share == r.double / 10
    assert rows(doc.transmute(a="value * 2", b=f.sum("a"), c="b + a").head(1))[0][1:] == (60, 62)
    assert srows(doc.mutate(n=f.n(), m=f.sql("n * 2"), _by="groups").distinct("n", "m")) == [(5, 10)]


def test_sums_have_128_bits(spark):
    t = make(spark, [(1 << 62, 7)] * 3, "x long, y int")
    assert rows(t.summarize(s=f.sum("x"), t=f.as_string(f.sum("x")), y=f.sum("y"))) == [(3 << 62, str(3 << 62), 21)]
    assert [int(r[0]) for r in rows(t.transmute(s=f.cumsum("x")))] == [1 << 62, 2 << 62, 3 << 62]
    assert t.summarize(y=f.sum("y")).schema[0].dataType.simpleString() == "bigint"
    r = random.Random(3)
    values = [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(200)] + [-(1 << 63), (1 << 63) - 1, -1, 0, None]
    t = make(spark, [(i % 7, x) for i, x in enumerate(values)], "g int, x long")
    want = {g: sum(x or 0 for x in values[g::7]) for g in range(7)}
    assert {g: int(x) for g, x in rows(t.summarize(x=f.sum("x"), _by="g"))} == want
    assert {(g, int(x)) for g, x in rows(t.transmute(x=f.sum("x"), _by="g"))} == set(want.items())
    assert rows(t.filter(col("g") > 9).summarize(x=f.sum("x"))) == [(None,)]


@pytest.fixture
def high_keys(spark, tmp_path):
    """A folder of orders and lineitem whose keys, times the factors of the queries of wide sums, pass 64 bits."""
    keys = [(k, 1, 1, "A") for k in (3, 461169, 900000, 9000000)]
    spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(keys, "o_orderkey long, n int, o_custkey long, s string").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_wide_sum_of_products_beyond_64_bits(spark, high_keys):
    from tessera.plans import catalogue

    got = catalogue.queries()["agg_wide_sum"](spark, high_keys).collect()
    assert [tuple(r) for r in got] == [("A", str((3 + 461169 + 900000 + 9000000) * 20000000000000), 4)]


def test_running_sum_of_products_beyond_64_bits(spark, high_keys):
    from tessera.plans import catalogue

    got = dict(map(tuple, catalogue.queries()["win_wide_cumsum"](spark, high_keys).collect()))
    assert got == {k: str(s * 400000000000000) for k, s in ((3, 3), (461169, 461172), (900000, 1361172), (9000000, 10361172))}


def test_text_of_numbers(spark):
    values = [0.0, -0.0, 1.0, 0.1, 1e10, 1e-5, 1e-4, 9.5e-5, 1e15, 1e16, 1e22, -2.5e-7, 123456789.125, 5.960464477539063e-08, float("inf"), float("-inf"), 1.7976931348623157e308, 1234567.5, 12345678.0]
    t = make(spark, [(i, x) for i, x in enumerate([*values, float("nan"), None])], "i int, x double")
    got = dict(rows(t.transmute(i="i", s=f.as_string("x"))))
    assert [got[i] for i in range(len(got))] == [*map(repr, values), "nan", None]
    assert rows(make(spark, [(True, 5)], "b boolean, n int").transmute(b=f.as_string("b"), n=f.as_string("n"))) == [("true", "5")]


def test_text_of_numbers_that_the_cast_makes_too_long(spark):
    values = [47228 * 1e17, 47236 * 1e17, 58536224 * 1e14, 9.92274043e18, -47228 * 1e17, 5e-324, 8e-323, 2e23, 1234567.0]
    t = make(spark, list(enumerate(values)), "i int, x double")
    assert [s for _, s in sorted(rows(t.transmute(i="i", s=f.as_string("x"))))] == list(map(repr, values))


def test_group_by_all_asks_for_aggregates(spark, doc):
    want = [("aa", 15), ("bb", 15)]
    for total in (f.sum("value"), f.sql("sum(value)"), f.sql("15 + sum(value) - 15"), F.sum("value")):
        got = doc.mutate(id="upper(id)").summarize(g=col("groups"), s=total, _by="all")
        assert srows(got) == want
    assert srows(doc.group_by("all").summarize(g="upper(groups)")) == [("AA",), ("BB",)]


def test_distinct_counts_stand_apart_from_large_states(spark):
    t = make(spark, [(None, 1, 1.0), (None, 1, 2.0), (1, 2, 5.0), (1, 3, 7.0), (1, 3, 9.0)], "g int, k int, x double")
    assert srows(t.summarize(m=f.median("x"), k=f.n_distinct("k"), n=f.n(), _by="g")) == [(1, 7.0, 2, 3), (None, 1.5, 1, 2)]
    assert rows(t.summarize(k=f.n_distinct("k"), m=f.median("x"))) == [(3, 5.0)]
    assert "Expand" not in t.summarize(m=f.median("x"), k=f.n_distinct("k"), _by="g").df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_those_of_percentile(spark):
    r = random.Random(5)
    data = [(None, float("nan"), 1)] + [(r.choice([None, 0, 1, 2]), r.choice([None, r.random(), r.randint(-3, 3) * 1.0]), r.randint(-(1 << 60), 1 << 60)) for _ in range(3000)]
    t = make(spark, [*data, (7, None, 3), (8, 2.5, 4)], "g int, x double, k long")
    own = t.summarize(a=f.median("x"), b=f.quantile("x", 0.9), c=f.quantile("k", 0.013), d=f.quantile(col("k") / 3, 1), e=f.median("x") - f.mean("x") + f.n(), n=f.n_distinct("x"), _by="g")
    want = t.df.groupBy("g").agg(F.median("x"), F.percentile("x", F.lit(0.9)), F.percentile("k", F.lit(0.013)), F.percentile(F.col("k") / 3, F.lit(1.0)), F.median("x") - F.avg("x") + F.count(F.lit(1)), F.count_distinct("x"))
    near = lambda got: sorted([tuple("nan" if x != x else f"{x:.12g}" if isinstance(x, float) else x for x in r) for r in got], key=repr)
    assert near(rows(own)) == near(map(tuple, want.collect()))
    assert near(rows(t.summarize(m=f.median("k"), q=f.quantile("x", 0.25)))) == near(map(tuple, t.df.agg(F.median("k"), F.percentile("x", F.lit(0.25))).collect()))
    assert rows(t.filter("g > 9").summarize(m=f.median("k"), n=f.n())) == [(None, 0)] and rows(t.filter("g > 9").summarize(m=f.median("k"), _by="g")) == []
    assert srows(t.filter("g > 2").summarize(m=f.sql("median(x)") + f.median("x") + f.fn("max", "k"), _by="g")) == [(7, None), (8, 9.0)]


def test_no_aggregate_holds_all_values_of_a_group(spark):
    t = make(spark, [(1, 2.0)], "g int, x double")
    for made in (t.summarize(m=f.median("x"), _by="g"), t.summarize(m=f.quantile("x", 0.2) + f.n_distinct("x")), t.summarize(m=f.median("x"), k=f.n_distinct("x"), s=f.std("x"))):
        plan = made.df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"percentile\(|median\(", plan)


def test_sketches_stand_apart_from_distinct_counts(spark):
    t = make(spark, [(g, k % 50) for g in (1, 2) for k in range(100)], "g int, k int")
    for by in ("g", None):
        made = t.summarize(share=f.approx_distinct("k") / f.n_distinct("k"), n=f.n(), _by=by)
        assert all(0.8 < r.share < 1.2 and r.n in (100, 200) for r in made.df.collect())
        plan = made.df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "approx_count_distinct(" in x and "distinct k" in x] and "distinct k" in plan


def test_grouping_sets(spark):
    t = make(spark, [("a", 1), ("a", 2), ("b", 1)], "x string, y int")
    assert srows(t.grouping_sets([["x"], ["y"], []], n=f.n())) == sorted([("a", None, 2), ("b", None, 1), (None, 1, 2), (None, 2, 1), (None, None, 3)], key=repr)


# more sources


def test_json_of_each_form(spark, tmp_path):
    for name, text, n in (("lines", '\n{"a": 1}\n{"a": 2}\n', 2), ("array", '[\n {"a": 1},\n {"a": 2}, {"a": 3}]', 3), ("one", '{\n "a": 1\n}', 1), ("flat", '{"a": 1}', 1)):
        (tmp_path / f"{name}.json").write_text(text)
        assert dt(spark, f"{tmp_path}/{name}.json").df_now().count() == n, name
    assert dt(spark, [f"{tmp_path}/lines.json", f"{tmp_path}/flat.json"]).df_now().count() == 3


def test_web_addresses(spark, tmp_path, monkeypatch):
    import functools
    import http.server
    import threading

    from tessera.sources import io

    (tmp_path / "a.csv").write_text("x,y\n1,p\n2,q\n")
    (tmp_path / "b.csv").write_text("x,y\n3,r\n")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        one = dt(spark, f"{base}/a.csv?raw=1")
        assert srows(one) == [(1, "p"), (2, "q")] and one.scopes.keys() == {"a"}
        assert srows(dt(spark, [f"{base}/a.csv", f"{base}/b.csv"]).select("x")) == [(1,), (2,), (3,)]
        monkeypatch.setattr(io, "sheet_url", lambda url: f"{base}/b.csv")
        assert rows(dt(spark, "https://docs.google.com/spreadsheets/d/KEY/edit#gid=7")) == [(3, "r")]
    finally:
        server.shutdown()
    monkeypatch.undo()
    assert io.sheet_url("https://docs.google.com/spreadsheets/d/KEY/edit?usp=sharing#gid=7") == "https://docs.google.com/spreadsheets/d/KEY/export?format=csv&gid=7"


def test_database_files(spark, tmp_path):
    import duckdb
    from tessera import attach

    with duckdb.connect(f"{tmp_path}/x.duckdb") as c:
        c.execute("CREATE TABLE first AS SELECT range AS i, 'r' || range AS s FROM range(5)")
        c.execute("CREATE TABLE second AS SELECT 1 AS k")
    got = attach(spark, f"{tmp_path}/x.duckdb")
    assert got.keys() == {"first", "second"} and got["first"].filter(col("i") > 2).df_now().count() == 2
    assert rows(dt(spark, "second")) == [(1,)] and attach(spark, f"{tmp_path}/x.duckdb", "first").keys() == {"first"}


@pytest.fixture
def connectors(spark):
    """Stand-ins for connectors, which tell the options that they are given."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    def source(kind):
        class Told(DataSource):
            @classmethod
            def name(cls):
                return kind

            def schema(self):
                return "option string, value string"

            def reader(self, schema):
                options = dict(self.options)

                class Reader(DataSourceReader):
                    def read(self, partition):
                        yield from sorted(options.items())

                return Reader()

        return Told

    for kind in ("bigquery", "snowflake", "iceberg", "delta"):
        spark.dataSource.register(source(kind))


def test_connectors_are_asked_for_the_table(spark, connectors):
    from tessera import warehouse

    assert ("table", "p.d.t") in rows(warehouse(spark, "bigquery", "p.d.t", credentials="k"))
    got = warehouse(spark, "snowflake", "s.t", sfurl="u")
    assert {("dbtable", "s.t"), ("sfurl", "u")} <= set(rows(got)) and got.scopes.keys() == {"t"}
    for kind in ("iceberg", "delta"):
        got = dt(spark, "/lake/my-table", **{kind: True, "branch": "b"})
        assert {("path", "/lake/my-table"), ("branch", "b")} <= set(rows(got)) and got.scopes.keys() == {"my_table"}
    with pytest.raises(Exception, match="(?i)driver|class"):
        warehouse(spark, "athena", "t", url="jdbc:athena://x")
    with pytest.raises(KeyError):
        warehouse(spark, "unknown", "t")


def test_switches(spark):
    from tessera import connect, set_sql_mode, update_con, warnings

    set_sql_mode("spark")
    with pytest.raises(ValueError):
        set_sql_mode("mysql")
    warnings(True)
    try:
        with pytest.warns(UserWarning, match="select"):
            dt(spark, pd.DataFrame({"select": [1], "b": [2]}))
    finally:
        warnings(False)
    connect(spark, "s3", access_key="a")
    update_con(spark, "s3", access_key="b")
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.access.key") == "b"


def test_pivots_of_too_many_levels_are_refused(spark, monkeypatch):
    from tessera.operators import reshape

    t = make(spark, [(i, i, 1) for i in range(12)] + [(0, None, 2)], "g int, k int, v int")
    assert len(t.pivot_wider("k", "v").columns) == 13
    monkeypatch.setattr(reshape, "MOST_LEVELS", 11)
    with pytest.raises(ValueError, match="levels"):
        t.pivot_wider("k", "v")
    assert t.pivot_wider(("k", [1, 2]), "v").columns == ["g", "1", "2"]
