"""Byte-level BPE encoding and decoding.

A word is a byte array whose adjacent pairs are folded by ascending rank; decoding joins the tokens' binary pieces.
`encode_words` states that fold in Spark's higher-order functions with the rank map as a literal, and
`round_trip_native` uses it for whole texts: once for each of the table's frequent distinct words, whose ids become a
literal map, and in place for the others. `encode_texts` and `round_trip` run the same fold on Arrow batches, once for
each distinct word that a worker meets, with a heap for long words, in a fraction of the time.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import Chunks, Memo, merge, ranks, rows, words
from .shared import resident, written


#: Buckets of the literal rank map; a look-up in Spark's map type scans it, so each bucket is a small map of its own.
SLOTS = 1 << 16
NONE = 1 << 30
#: Words of a table that are folded once and looked up, at most, and their characters: some 20 MB in a plan.
KNOWN = 200_000
SHORT = 40
#: Characters of a run in which a word may be too long for a fold in Spark.
LONG = 200
#: The pattern in Java's spelling, with the same white space as in WORDS.
JAVA_WORDS = public_tokenizers.PATTERN.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def _json(value: list, kind: str) -> str:
    """SQL of a literal."""
    return "from_json('" + json.dumps(value, separators=(",", ":")).replace("\\", "\\\\").replace("'", "\\'") + f"', '{kind}')"


def rank_map(rank: dict[bytes, int]) -> str:
    """SQL of the literal rank map: an array of maps from a token's hexadecimal bytes to its rank, by CRC-32."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, r in rank.items():
        key = token.hex().upper()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = r
    return _json(slots, "array<map<string,int>>")


def _fold(word: str) -> str:
    """SQL of a word's ids, where `tab` is the rank map.

    The word's bytes are a list of parts. The fold takes as many steps as there could be merges: each finds the pair of
    least rank (the leftmost of equals), joins it, and looks up the two pairs beside it again."""
    look = lambda k: f"coalesce(try_element_at(get(tab, cast(crc32(encode({k}, 'UTF-8')) % {SLOTS} as int)), {k}), {NONE})"
    pair = lambda a, b: f"if({a} is null or {b} is null, {NONE}, {look(f'concat({a}, {b})')})"
    kind = "struct<p:array<string>,r:array<int>>"
    begin = f"cast(named_struct('p', parts, 'r', transform(slice(parts, 1, greatest(size(parts) - 1, 0)), (x, i) -> {pair('x', 'get(parts, i + 1)')})) as {kind})"
    # i: place of the pair from 1; the ranks beside it are those of (i - 1, new) and (new, i + 2)
    new = "concat(get(s.p, i - 1), get(s.p, i))"
    ranks_ = f"concat(slice(s.r, 1, greatest(i - 2, 0)), if(i > 1, array({pair('get(s.p, i - 2)', 'new')}), array()), if(i < size(s.r), array({pair('new', 'get(s.p, i + 1)')}), array()), slice(s.r, i + 2, greatest(size(s.r) - i - 1, 0)))"
    parts_ = "concat(slice(s.p, 1, i - 1), array(new), slice(s.p, i + 2, greatest(size(s.p) - i - 1, 0)))"
    joined = f"transform(array({new}), new -> cast(named_struct('p', {parts_}, 'r', {ranks_}) as {kind}))[0]"
    step = f"if(coalesce(array_min(s.r), {NONE}) = {NONE}, s, transform(array(cast(array_position(s.r, array_min(s.r)) as int)), i -> {joined})[0])"
    fold = f"aggregate(slice(parts, 1, greatest(size(parts) - 1, 0)), {begin}, (s, x) -> {step}, s -> transform(s.p, t -> {look('t')}))"
    return f"transform(array(regexp_extract_all(hex(encode({word}, 'UTF-8')), '..', 0)), parts -> {fold})[0]"


def _bound(name: str, literal: str, body: str) -> str:
    """SQL of the body, in which the name stands for the literal."""
    return f"transform(array({literal}), {name} -> {body})[0]"


def encode_words(df: DataFrame, word_col: str = "word", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Adds `ids` (array<int>) of each row's word, one match of the splitting pattern, by Spark's functions alone.

    A null word gives null ids, an empty one none. A word's fold takes time with the square of its length."""
    ids = _bound("tab", rank_map(ranks(public_tokenizers.path(vocab))), _fold(f"`{word_col}`"))
    return df.withColumn("ids", F.expr(f"if(`{word_col}` is null, null, {ids})"))


def frequent_words(texts: DataFrame, vocab: str, most: int = KNOWN) -> dict[str, list[int]]:
    """Ids of the table's most frequent words, each folded once; at most `most` words of at most SHORT characters,
    counted over all texts. Words as frequent as the first one left out are left out too, so the choice is settled."""
    counts = written(texts.select(F.explode(_words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    often, enough = 0, None
    for r in counts.filter(F.length("word") <= SHORT).groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        often += r.k
        if often > most:
            break
        enough = r.n
    if enough is None:
        return {}
    # rank by rank the words' number is known by now to be at most `most`
    some = counts.filter((F.col("n") >= enough) & (F.length("word") <= SHORT)).select("word")
    return {r.word: r.ids for r in encode_words(some, "word", vocab).collect()}


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(text_col, F.lit(JAVA_WORDS), F.lit(0))


def round_trip_native(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken", most: int = KNOWN) -> DataFrame:
    """As `round_trip`, by Spark's functions.

    The table's frequent words are folded once and looked up in a literal map; the others are folded where they stand,
    so nothing but counts of words is shuffled. Texts with a run of LONG characters with or without white space, whose
    fold would take the square of that, are encoded by `round_trip`, which keeps a long word's pairs in a heap.

    A null text counts as empty; repeated rows give equal rows; ties cannot arise; other columns are not read; an empty
    table gives an empty result. Texts are encoded whole, however long."""
    rank = ranks(public_tokenizers.path(vocab))
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.col("text").rlike(rf"\S{{{LONG}}}|\s{{{LONG}}}")
    known: list[dict] = [{} for _ in range(SLOTS)]
    for word, ids in frequent_words(texts.filter(~long), vocab, most).items():
        known[xxhash.xxh64_intdigest(word, 42) % SLOTS][word] = ids
    look = f"try_element_at(get(known, cast(xxhash64(w) & {SLOTS - 1} as int)), w)"
    ids = _bound("known", _json(known, "array<map<string,array<int>>>"), f"flatten(transform(words, w -> coalesce({look}, {_fold('w')})))")
    ids = _bound("tab", rank_map(rank), ids)
    pieces = _json([t.hex().upper() for t, _ in sorted(rank.items(), key=lambda x: x[1])], "array<string>")
    short = texts.filter(~long).select("id", _words("text").alias("words")).select("id", F.expr(ids).alias("ids"))
    decoded = F.expr(_bound("pieces", pieces, "unhex(array_join(transform(ids, i -> get(pieces, i)), ''))"))
    told = short.select("id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
    return told.union(round_trip(texts.filter(long), "id", "text", vocab)).withColumnRenamed("id", id_col)


class Codec:
    """Encoding and decoding under one vocabulary; words already met are remembered within bounds."""

    def __init__(self, path: str, memo: int = 240_000):
        self.rank = ranks(path)
        self.piece = {i: t for t, i in self.rank.items()}
        self._name = {t: str(i) for t, i in self.rank.items()}
        self._named = {n: t for t, n in self._name.items()}
        self._word = Memo(self._folded, memo // 4)
        self._chunks = Chunks(self._encoded, memo)

    def _folded(self, word: str) -> tuple[str, bytes]:
        """A word's ids in decimal, joined by spaces, and the bytes that they decode to."""
        names = list(map(self._name.__getitem__, merge(word.encode(), self.rank)))
        return " ".join(names), b"".join(map(self._named.__getitem__, names))

    def _encoded(self, chunk: str) -> tuple[str, bytes]:
        """As `_folded`, of a chunk. What the chunks' memo keeps anyway is not kept by the words' too."""
        found = words(chunk)
        if len(found) == 1:
            return self._folded(chunk) if chunk[0] == " " else self._word[chunk]
        tail = self._chunks.tail
        ids, raw = zip(*[tail[w[1:]] if w[0] == " " and w[1:].isalpha() else self._word[w] for w in found])
        return " ".join(ids), b"".join(raw)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self._chunks.values(text) for i in ids.split()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        ids, decoded = zip(*self._chunks.values(text))
        joined = " ".join(ids)
        return joined.count(" ") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def codec(path: str) -> Codec:
    """One for each worker process, so that its memos last from task to task."""
    return resident(("codec", path), lambda: Codec(path))


def _mapped(df: DataFrame, id_col: str, text_col: str, step: int, make, names: list[str], types: str, vocab: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(public_tokenizers.path(vocab))
        for batch in batches:
            for part in rows(batch, step):
                yield pa.RecordBatch.from_arrays([part.column(0), *make(c, part.column(1).to_pylist())], ["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("value")).mapInArrow(run, f"id {kind}, {types}")
    return out.withColumnRenamed("id", id_col)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id and `ids` (array<int>) of every whole text, without special tokens; their strings are ordinary text.

    A null text counts as empty (no ids); repeated rows stay repeated; other columns are not read; an empty table
    gives an empty result. Texts are encoded whole; a long word's pairs stand in a heap, so that it takes little more
    time than its length."""
    return _mapped(df, id_col, text_col, 64, lambda c, texts: [pa.array([c.encode(t) if t else [] for t in texts], pa.list_(pa.int32()))], ["ids"], "ids array<int>", vocab)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id and `bytes` (binary), the concatenated pieces of the ids. Null ids give null; no ids give empty bytes."""
    return _mapped(df, id_col, ids_col, 64, lambda c, lists: [pa.array([None if x is None else c.decode(x) for x in lists], pa.binary())], ["bytes"], "bytes binary", vocab)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded in one narrow pass of Arrow
    batches: a worker folds each distinct word that it meets once.

    The digests are lowercase hexadecimal SHA-256 of the decimal ids joined by one space, and of the decoded bytes.
    A null text counts as empty; repeated rows give equal rows; ties cannot arise; other columns are not read; an empty
    table gives an empty result. Texts are encoded whole, however long."""

    def make(c: Codec, texts: list) -> list:
        n, a, b = zip(*[c.digests(t or "") for t in texts])
        return [pa.array(n, pa.int64()), pa.array(a), pa.array(b)]

    return _mapped(df, id_col, text_col, 256, make, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string", vocab)
