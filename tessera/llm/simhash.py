"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most four bits, cut into three segments, have a segment that differs in
at most one bit. So each distinct fingerprint is indexed under 64 keys: for every bit, its segment with that bit
left out. Fingerprints that share a key are the candidates, and the whole fingerprints are compared.

Components are found without listing the pairs of a crowded key. First every fingerprint is compared with the
least one under its key, which joins dense groups with as many rows as members. Then only keys that still hold
fingerprints of several components are looked at again: the largest component under a key is compared with the
others, and those among themselves, so the square of a dense group is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words' shingles; 0 if there is no word."""
    words = text.encode().lower().split() if text else []  # splits at the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter((b" ".join(words),))
        n = 1
    else:
        n = len(words) - shingle + 1
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    ones = bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed 64 bits) and text_key (XXH64 of the text, null for null) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), part.column(2)], ["id", "fp", "text_key"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key")).mapInArrow(run, f"id {kind}, fp long, text_key long")


def text_key(text_col: str) -> Column:
    return F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col)))


def _keyed(df: DataFrame) -> DataFrame:
    """Each row of df (fp and more) once for each of its 64 keys, with `half`: the value of the bit left out, or null
    where that bit is its segment's first. Two fingerprints are compared under the bit in which the segment differs,
    so with unlike halves, or under its first bit if the segment is equal; elsewhere they need not be.

    The rows are dealt anew first: there are few bytes of them, but 64 times as many follow."""
    # by a hash of fp: dealt by fp itself, a shuffle by fp just before would be taken for it, and made into few tasks
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keys = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for at in range(width):
            key = segment.bitwiseAND(F.lit(~(1 << at) & ((1 << width) - 1))).bitwiseOR(F.lit((first + at) << 24))
            half = F.shiftrightunsigned("fp", first + at).bitwiseAND(F.lit(1)).cast("int") if at else F.lit(None).cast("int")
            keys.append(F.struct(key.alias("key"), half.alias("half")))
    return df.select("*", F.explode(F.array(*keys)).alias("_k")).select(*df.columns, "_k.key", "_k.half")


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _shuffled(df: DataFrame) -> DataFrame:
    """df, marked so that a join with it broadcasts neither side, whatever Spark takes their sizes to be.

    Spark counts exploded rows as if they were not exploded, so it would send 64 rows a fingerprint through the driver,
    and a written table as large as its files, in which a label that many rows share takes no room."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of the edges (a, b).

    Large-star and small-star rounds; each round's edges are written to the shared folder."""

    def fingerprint_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = fingerprint_of(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        # a hub may hold most edges: the side with one row a node is written, so that Spark can split the other one
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.filter("b > a").join(_shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(_shuffled(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small)
        after = fingerprint_of(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints (column fp, distinct) within the distance.

    All edges are real links; inside a dense group not every link is listed."""
    keyed = _keyed(nodes.select("fp"))
    # the least fingerprint under a key, or of those whose bit is 0
    hubs = keyed.groupBy("key").agg(F.min(F.when(F.coalesce("half", F.lit(0)) == 0, F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and hub is not null").select("key", "hub")
    hubs = written(hubs)  # at most 64 x 2**21 rows; Spark then splits a key that holds many fingerprints
    stars = keyed.join(_shuffled(hubs), (keyed.key == hubs.key) & (F.coalesce("half", F.lit(1)) == 1) & (F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"), distance))
    edges = written(stars.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
    labels = components(edges)
    placed = written(nodes.select("fp").join(_shuffled(labels), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label")))
    keyed = _keyed(placed)
    # keys of two fingerprints are settled, and so are those of one component or one half
    mixed = keyed.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n"), F.min("half").alias("_a"), F.max("half").alias("_b"))
    mixed = mixed.filter("_low < _high and _n > 2 and (_a is null or _a < _b)").select("key")
    rest = written(keyed.join(_shuffled(mixed), "key", "left_semi"))  # read four times below
    # a component with most of a key's fingerprints is compared with the others there, but not with itself
    most = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max(F.struct("_n", "label")).alias("_m"))
    rest = rest.join(_shuffled(written(most.select(F.col("key"), F.col("_m.label").alias("most")))), "key")
    side = lambda n, which: rest.filter(which).select("key", F.col("half").alias(f"h{n}"), F.col("fp").alias(n), F.col("label").alias(f"l{n}"))
    large, few = F.col("label") == F.col("most"), F.col("label") != F.col("most")
    near = _near(F.col("a"), F.col("b"), distance)
    unlike = F.col("ha").isNull() | (F.col("ha") != F.col("hb"))
    a, b, c = side("a", large), side("b", few), side("a", few)
    across = a.join(_shuffled(b), (a.key == b.key) & unlike & near).select("a", "b")
    apart = F.when(F.col("ha").isNull(), F.col("la") < F.col("lb")).otherwise((F.col("ha") < F.col("hb")) & (F.col("la") != F.col("lb")))
    return edges.union(across).union(c.join(_shuffled(b), (c.key == b.key) & apart & near).select("a", "b"))


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fingerprint (16 lowercase hexadecimal digits), component_id and text_key.

    component_id is the least id among all rows reachable over links of at most `distance` bits, itself included.
    Null, empty and blank texts have fingerprint zero, which links like any other; null ids take part but are never
    a component's least id unless it has no other (then null). Repeated rows and rows that share an id on unlike texts
    are each a row of the result, so ties need no rule. A text is read whole whatever its length, with its shingles'
    hashes in memory at once. Other columns are not read; an empty table gives an empty result."""
    return _grouped(df, id_col, text_col, distance).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def _grouped(df: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """id, fp, text_key, component_id and label (the component's least fingerprint) of every row."""
    rows = written(fingerprints(df, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    labels = written(components(links(nodes, distance)))
    # both sides of each join are written: a component or a text with a third of all rows is split by Spark
    labelled = written(nodes.join(_shuffled(labels), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    ids = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    of = written(labelled.join(_shuffled(ids), "label").select("fp", "label", "component_id"))
    return rows.join(_shuffled(of), "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of df, with all its columns, that stand for their component: exactly one row of each.

    It is the row of least id (a null id only if there is no other); of several rows with that id, the one of the
    least hash of its text, a null text first; of rows equal in both, any. So two unlike texts that share an id both
    stay, and so do rows without an id that are alone in their component. An empty table gives an empty one; columns
    of df may have any names."""
    grouped = _grouped(df, id_col, text_col, distance)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"))).alias("r")
    stay = written(grouped.groupBy("label").agg(first).select(F.col("r.id").alias("__tessera_id"), F.col("r.text_key").alias("__tessera_text")))
    own = df.withColumn("__tessera_own", text_key(text_col))
    near = own.join(_shuffled(stay), F.col(id_col).eqNullSafe(F.col("__tessera_id")) & F.col("__tessera_own").eqNullSafe(F.col("__tessera_text")))
    order = Window.partitionBy("__tessera_id", "__tessera_text").orderBy(F.lit(1))
    return near.withColumn("__tessera_n", F.row_number().over(order)).filter("__tessera_n = 1").select(*df.columns)
