"""Packing documents' tokens into few sequences of a fixed capacity.

The lengths' histogram, which has at most `capacity` entries however large the corpus is, goes to the driver.
There a reduction by dominance fixes small sets of lengths for which some best packing must exist, the rest is
packed best-fit in decreasing order, and both are stated as runs: so many pieces of a length go to so many
consecutive sequences at an offset. The pieces are numbered within their length in Spark and look up their run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import SPECIAL, SPECIAL_ID, packed, rows, rust
from .shared import resident, written

CAPACITY = 2048
END_ID = 0
#: Pieces that are numbered together in one group; longer classes are dealt over several groups.
GROUP = 500
#: Characters that are encoded in one call; a call for each word costs twice the time, even if frequent ones are kept.
SPAN = 65_536
#: A space after a character that is not white space.
BOUNDARY = re.compile(r"\S ")


class Ids:
    """Ids of whole texts as packed 32-bit integers; the special token's string gives its id, as by default."""

    def __init__(self, path: str):
        self._encode = rust(path).encode_ordinary

    def of(self, text: str) -> bytes:
        return packed([SPECIAL_ID]).join(b"".join(packed(self._encode(s)) for s in spans(p)) for p in text.split(SPECIAL))


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """The text in parts of at least `size` characters but the last, cut before spaces that follow no white space: no
    match of the pattern crosses such a place or looks beyond it, so the parts' ids are those of the whole."""
    start = 0
    while at := BOUNDARY.search(text, start + size):
        yield text[start : at.end() - 1]
        start = at.end() - 1
    if start < len(text):
        yield text[start:]


def ids_of(path: str) -> Ids:
    """One for each worker process."""
    return resident(("ids", path), lambda: Ids(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity, if n exceeds it."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A null text counts as empty: its piece is the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(public_tokenizers.path(vocab))
        end = packed([END_ID])
        for batch in batches:
            for part in rows(batch):
                at, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    data = memoryview(ids.of(text or "") + end)
                    for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                        at.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class Plan:
    """Runs over the histogram. A run (length, first, count, sequence, each, offset) sends pieces first … first+count-1
    of that length to consecutive sequences, `each` to a sequence, side by side from `offset`."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.taken = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.fixed = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._reduce()
        self._best_fit()

    def _run(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, int(self.taken[length]), count, sequence, each, offset))
        self.taken[length] += count
        self.left[length] -= count

    def _fix(self, lengths: tuple[int, ...], times: int) -> None:
        """The set, so many times, as sequences of its own. Equal lengths stand side by side."""
        if not times:
            return
        offset, sets = 0, sorted(lengths, reverse=True)
        for length in dict.fromkeys(sets):
            each = sets.count(length)
            self._run(length, times * each, self.sequences, each, offset)
            offset += each * length
        self.sequences += times
        self.fixed += times

    def _reduce(self) -> None:
        c = self.capacity
        self._fix((c,), int(self.left[c]))
        # {a, c - a} fills its sequence, so it dominates every set with a: the others in it fit in place of c - a
        for a in range(c - 1, c // 2 - 1, -1):
            self._fix((a, c - a), int(self.left[a] // 2 if 2 * a == c else min(self.left[a], self.left[c - a])))
        for j in range(c - 1, 0, -1):
            while self.left[j]:
                best = self._dominating(j)
                if best is None:
                    break
                need = {x: best.count(x) for x in best}
                self._fix(best, int(min(self.left[x] // k for x, k in need.items())))

    def _dominating(self, j: int) -> tuple[int, ...] | None:
        """A set with j that dominates all feasible sets with j, if one of at most three members is known to."""
        room = self.capacity - j
        self.left[j] -= 1
        have = np.flatnonzero(self.left)
        small: list[int] = []
        for x in have[:3]:
            small += [int(x)] * min(3, int(self.left[x]))
        single = have[have <= room]
        try:
            if not small or small[0] > room:
                return (j,)
            largest = int(single[-1])
            if len(small) < 2 or small[0] + small[1] > room:
                return (j, largest)
            if len(small) > 2 and sum(small[:3]) <= room:
                return None
            # at most two fit beside j: compare with pairs x <= y
            lower = single[2 * single <= room]
            lower = [int(x) for x in lower if self.left[x] > 1 or np.any((single > x) & (single <= room - x))]
            if not lower:
                return (j, largest)
            partner = single[single <= room - single[0]]
            b = int(partner[-1]) if self.left[single[0]] > 1 or partner[-1] != single[0] else int(single[0])
            others = single[single <= room - b]
            a = next((int(x) for x in others[::-1] if x != b or self.left[x] > 1), None)
            sums = max(int(x) + int(single[single <= room - x][-1]) for x in lower)
            if largest >= sums:
                return (j, largest)
            if a is not None and lower[-1] <= min(a, b) and largest <= b:
                return (j, a, b)
            return None
        finally:
            self.left[j] += 1

    def _best_fit(self) -> None:
        """Longest first, each piece into the fullest sequence that has room; equal pieces go together."""
        c = self.capacity
        open_: list[list[tuple[int, int]]] = [[] for _ in range(c + 1)]  # by room: (first sequence, how many)
        for length in range(c, 0, -1):
            room = length
            while (n := int(self.left[length])) > 0:
                while room <= c and not open_[room]:
                    room += 1
                if room > c:
                    per = c // length
                    first, many, at = self.sequences, -(-n // per), c
                    self.sequences += many
                else:
                    first, many = open_[room].pop()
                    per, at = room // length, room
                full, rest = divmod(min(n, many * per), per)
                if full:
                    self._run(length, full * per, first, per, c - at)
                    open_[at - per * length].append((first, full))
                if rest:
                    self._run(length, rest, first + full, rest, c - at)
                    open_[at - rest * length].append((first + full, 1))
                used = full + bool(rest)
                if used < many:
                    open_[at].append((first + used, many - used))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs in order of (length, first), and that order's keys for a binary search."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        return runs, (runs[:, 0] << 46) + runs[:, 1]


def place(table: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces.

    The pieces are written once; pieces of one length (ties) are numbered in groups of about GROUP, dealt by their
    place in the written files, so neither a frequent length nor an id that many rows share fills a task. Within a
    group the order is that of id (null first), piece, start and checksum. Which of the pieces of one length goes
    where may differ from run to run; the number of sequences does not. An empty table gives an empty result."""
    table = written(table)
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(histogram, capacity)
    runs, keys = plan.arrays()
    spark = table.sparkSession
    groups = F.broadcast(spark.createDataFrame([(n, -(-k // GROUP)) for n, k in histogram.items()], "length long, _groups long"))
    at = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    salted = table.withColumn("_at", at).join(groups, "length").withColumn("_group", F.pmod("_at", "_groups")).drop("_groups", "_at")
    counts = salted.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_group").orderBy(id_col, "piece", "start", "ids_crc32")
    numbered = salted.withColumn("_k", F.row_number().over(order) - 1).join(before, ["length", "_group"])
    numbered = numbered.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_k")).alias("_k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, k = (batch.column(i).to_numpy() for i in (3, 5))
            of = runs[np.searchsorted(keys, (length << 46) + k, side="right") - 1]
            step = k - of[:, 1]
            sequence, offset = of[:, 3] + step // of[:, 4], of[:, 5] + step % of[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = table.schema[id_col].dataType.simpleString()
    return numbered.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of every whole text with their place: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only a document longer than the capacity is cut. A null text counts as
    empty; repeated rows are packed each; columns other than id and text are not read; an empty table gives an empty
    result. Texts are tokenized whole and once, one text's ids in memory at a time."""
    return place(pieces(df, id_col, text_col, capacity, vocab), capacity, id_col)
