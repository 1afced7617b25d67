"""Approximate nearest neighbours by shifted space-filling curves.

Vectors of unit length are projected on a few random directions, squeezed towards a uniform spread, shifted and
ordered along a Hilbert curve; several such curves differ in directions and shifts. Each curve is range-partitioned
in Spark. A query looks at the window of a given share of all vectors around its own key on every curve, blocks of
neighbouring keys at a time; the windows' best are merged and ranked by the exact measure on the original vectors.

Where vectors fill all their dimensions evenly, a window of a fixed number of rows would lose recall as the table
grows. The window is a fixed number and a share of the table instead, so work grows with queries x rows, though below
one cosine for each; recall and cosines are measured in the tests where windows are far smaller than the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CURVES = 28
DIRECTIONS = 12
BITS = 4
#: A query's window on one curve: so many vectors and such a share of the table.
LEAST = 200
SHARE = 0.012
#: Candidates in a block, at most and at least; between, a quarter of a window, to which windows are rounded out.
BLOCK = (64, 1024)
#: Queries that meet a block at a time, and queries in one matrix product.
CHUNK = 20_000
STEP = 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row's cell (integers below 2**bits) along the Hilbert curve through all cells."""
    x = cells.astype(np.int64)
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        top, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            set_ = (x[:, d] & top) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)  # Gray code across the dimensions
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> level) & 1
    return key


class Curve:
    """One of the orderings, made from its number and the vectors' dimension alone."""

    def __init__(self, number: int, dims: int, directions: int = DIRECTIONS, bits: int = BITS):
        rng = np.random.default_rng([number, dims])
        directions = min(directions, dims)
        self.axes = np.linalg.qr(rng.normal(size=(dims, directions)))[0] * np.sqrt(dims)
        self.shift = rng.random(directions)
        self.bits = bits

    def keys(self, unit: np.ndarray) -> np.ndarray:
        spread = 1 / (1 + np.exp(-1.7 * (unit @ self.axes)))  # near uniform for projections of unit variance
        cells = ((spread + self.shift) / 2 * (1 << self.bits)).astype(np.int64)
        return hilbert(np.minimum(cells, (1 << self.bits) - 1), self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled so that no square overflows."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.abs(v).max(axis=1, keepdims=True)


def _by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, _matrix(column.take(pa.array(at)))


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(v.isNotNull() & fine & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull())


def _places(rows: DataFrame, curves: int, kind: str) -> DataFrame:
    """id, asks (0 or 1), curve, at: the place of each row on each curve, counted over all curves in turn and over
    the rows that do not ask; a row that asks has the place of the next other one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[Curve]] = {}
        for batch in batches:
            for at, v in _by_length(batch.column(1)) if batch.num_rows else ():
                if v.shape[1] not in made:
                    made[v.shape[1]] = [Curve(c, v.shape[1]) for c in range(curves)]
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                part = batch.take(pa.array(at))
                for c, curve in enumerate(made[v.shape[1]]):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.full(len(at), c, np.int32)), pa.array(curve.keys(unit))], ["id", "asks", "curve", "key"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = 1 - batch.column(1).to_numpy()
            before = seen + np.cumsum(own) - own
            seen += int(own.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(before.astype(np.int64))], ["id", "asks", "curve", "part", "before"])

    keyed = rows.mapInArrow(keys, f"id {kind}, asks int, curve int, key long")
    dealt = keyed.repartitionByRange("curve", "key", "id", "asks").sortWithinPartitions("curve", "key", "id", "asks")
    local = written(dealt.mapInArrow(numbered, f"id {kind}, asks int, curve int, part int, before long"))
    sizes = sorted((r[0], r[1]) for r in local.groupBy("part").agg(F.sum(1 - F.col("asks"))).collect())  # a row a partition
    starts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    offsets = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return local.join(F.broadcast(offsets), "part").select("id", "asks", "curve", (F.col("before") + F.col("start")).alias("at"))


def _nearest(k: int):
    """For a block's candidates and the queries whose windows meet it: each query's k best there."""

    def run(key: tuple, found: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if found.num_rows and asked.num_rows:
            ids, queries = found.column("id").to_numpy(), asked.column("id").to_numpy()
            by_length = {v.shape[1]: (at, v / np.linalg.norm(v, axis=1, keepdims=True)) for at, v in _by_length(found.column("vector"))}
            for at, q in _by_length(asked.column("vector")):
                if q.shape[1] not in by_length:
                    continue
                rows, v = by_length[q.shape[1]]
                q = q / np.linalg.norm(q, axis=1, keepdims=True)
                for i in range(0, len(q), STEP):
                    near = q[i : i + STEP] @ v.T
                    more = min(2 * k + 8, near.shape[1])
                    top = np.argpartition(-near, more - 1, axis=1)[:, :more]
                    a = np.repeat(np.arange(len(near)), more)
                    score = np.einsum("ij,ij->i", q[i : i + STEP][a], v[top.ravel()])
                    who = ids[rows[top.ravel()]]
                    order = np.lexsort((who, -score, a)).reshape(len(near), more)[:, :k].ravel()
                    out.append((queries[at[i + a[order]]], who[order], score[order]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"rep": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return run


def window(n: int, share: float = SHARE, least: int = LEAST) -> tuple[int, int]:
    """Half a window's vectors, and the candidates in a block, in a table of n vectors."""
    whole = least + int(n * share)
    return whole // 2, min(BLOCK[1], max(BLOCK[0], whole // 4))


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine in double precision) of each query's k nearest found.

    df: the candidates; queries: rows that ask, each against every candidate but the one of its own id. Ids are
    integers. Ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows without an id; vectors of different lengths are not compared. Fewer candidates than k
    give fewer rows; repeated rows ask and answer once; empty tables give an empty result; further columns are not read.

    Equal vectors stand on one place of every curve, so only the k + 1 least ids of each are entered, which is all
    that can be among k nearest, and equal queries look up their windows once."""
    alike = Window.partitionBy("vector").orderBy("id")
    own = valid(df, id_col, vector_col).dropDuplicates(["id", "vector"])
    entered = written(own.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k + 1).drop("_n"))
    asked = written(valid(queries, id_col, vector_col).dropDuplicates(["id", "vector"]))
    reps = written(asked.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"))
    n, n_asked = entered.count(), reps.count()
    kind = "long"
    both = entered.select(F.col("id").cast("long"), "vector", F.lit(0).alias("asks")).union(reps.select(F.col("id").cast("long"), "vector", F.lit(1)))
    placed = _places(both, curves, kind)
    half, block = window(n, share, least)
    chunks = max(1, -(-int(n_asked * 2 * (2 * half + block) / max(n, 1)) // CHUNK))
    begin = F.col("curve") * F.lit(n)
    first = F.greatest(F.col("at") - half, begin)
    last = F.least(F.col("at") + half, begin + n) - 1
    windows = placed.filter("asks = 1").select("id", F.explode(F.sequence(F.floor(first / block), F.floor(F.greatest(first, last) / block))).alias("block")).distinct()
    windows = windows.join(reps, "id").select(F.col("block").alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.col("id").alias("id"), F.col("vector").alias("vector"))
    members = placed.filter("asks = 0").select("id", F.floor(F.col("at") / block).alias("block")).distinct().join(entered, "id")
    members = members.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")).alias("chunk"), "id", "vector")
    found = members.groupBy("block", "chunk").cogroup(windows.groupBy("block", "chunk")).applyInArrow(_nearest(k + 1), "rep long, vec_id long, score double")
    best = found.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    # written, as both sides of the join above it are: a vector that many rows ask for is split by Spark
    best = written(best.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= k + 1).drop("_n"))
    of = written(asked.select("id", "vector").join(reps.select(F.col("id").alias("rep"), "vector"), "vector").select("id", "rep"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = of.join(best, "rep").filter("id <> vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
