import numpy as np
import pytest
from tessera.llm import curve_ann, queries


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = curve_ann.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for q in asked:
        s = v @ v[list(ids).index(q)]
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s.round(12))) if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, scale):
    sf = f"/root/testdata/{scale}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = {}
    for r in queries.op8_curve_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        assert sorted(r.rank for r in found) == [1, 2, 3, 4, 5]
        score = {i: s for i, s in want[q]}
        for r in found:
            hit += r.vec_id in score
            assert abs(r.score - score.get(r.vec_id, r.score)) < 1e-12
    assert hit / (5 * len(want)) >= 0.9


def scattered(n, seed=1):
    """Vectors as the given ones are, near enough: no direction of 64 stands out by much."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64)) * np.linspace(1.25, 0.9, 64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [50_000])
def test_recall_and_work_where_windows_are_small(n):
    """The search's windows in plain numpy: recall of the five nearest, and cosines a query."""
    v, asked = scattered(n), np.arange(0, n, n // 200)
    exact = v[asked] @ v.T
    exact[np.arange(len(asked)), asked] = -2
    want = np.argpartition(-exact, 5, axis=1)[:, :5]
    half, block = curve_ann.window(n)
    hit, work, seen = np.zeros(want.shape, bool), 0, np.zeros((len(asked), n), bool)
    for c in range(curve_ann.CURVES):
        order = np.argsort(curve_ann.Curve(c, 64).keys(v), kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        at = place[asked]
        low, high = np.maximum(at - half, 0) // block * block, (np.minimum(at + half, n) - 1) // block * block + block
        hit |= (place[want] >= low[:, None]) & (place[want] < high[:, None])
        work += np.minimum(high, n) - low
        for i, (a, b) in enumerate(zip(low, high)):
            seen[i, order[a:b]] = True
    print(f"n={n}: recall {hit.mean():.3f}, cosines a query {work.mean() / n:.2f} n, rows seen {seen.mean():.2f}")
    assert hit.mean() >= 0.9 and work.mean() < 0.7 * n and seen.mean() < 0.6


def test_search_in_spark_where_windows_are_small(spark):
    n = 12_000
    v = scattered(n, 2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in curve_ann.search(df, df.filter("vec_id % 200 = 0"), share=0.02, least=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = v[::200] @ v.T
    hits = sum(len(got[200 * i] & set(np.argsort(-np.where(np.arange(n) == 200 * i, -2, s))[:5].tolist())) for i, s in enumerate(exact))
    assert hits >= 0.88 * 5 * len(exact)


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0, 0.0]) for i in range(0, 40)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [nan, 0.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, []), (50, [1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (106, [0.0, 1e200, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in [*same, *same[:3], *odd]], "vec_id long, embedding array<double>, rank int, score double")
    rows = {}
    for r in curve_ann.search(df, df.filter("vec_id % 10 = 0"), k=5).collect():
        rows.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(rows[0]) == [(n, n, 1.0) for n in range(1, 6)]
    assert [x[1] for x in sorted(rows[30])] == [0, 1, 2, 3, 4]
    assert rows.keys() == {0, 10, 20, 30}  # 50 has no vector of its length to be compared with
    assert curve_ann.search(df.limit(0), df.limit(0)).collect() == []
