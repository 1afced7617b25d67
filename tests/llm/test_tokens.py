import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tessera.llm import bpe_codec, packing, queries, token_counts
from tessera.llm.bytebpe import merge, packed, ranks
from tokenizers import Tokenizer

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["a", "the", " ", "  ", "   ", "\n", "\t", "'", "re", "'s", "'ll", "é", "ß", "日", "😀", "1", "23", "!", "?!", ",", "<|endoftext|>", "<|end", "\x1c", "\x85", "\xa0", " ", "Tion", "x" * 70]


def made(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*made(1, 60), "", None, None, "same", "same", "x" * 50_000, "\n" * 3000, " word" * 4000]
    return spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, length string")


def test_counts_at_every_prefix_match_encoding_each_prefix(hf):
    c = token_counts.PrefixCounts(RANKS)
    for s in made(2, 150):
        every = [len(hf(s[:i])) for i in range(len(s) + 1)]
        assert c.at_every_prefix(s) == every and c.total(s) == every[-1]
        for limit in (0, 1, 5):
            assert c.cut(s, limit) == max(i for i, n in enumerate(every) if n <= limit)


def test_merge_matches_library_on_long_words(tik):
    r = random.Random(4)
    for n in (1, 63, 65, 400):
        w = "".join(r.choice("abeinort") for _ in range(n))
        assert [ranks(RANKS)[t] for t in merge(w.encode(), ranks(RANKS))] == tik.encode_ordinary(w)


def test_op1_counts(odd, hf):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in token_counts.count_tokens(odd).collect():
        n = len(hf(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    assert token_counts.count_tokens(odd.limit(0)).collect() == []


def test_stored_prefixes_answer_budgets(spark, hf):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.fit_to_budget(token_counts.prefix_counts(df), 3).collect()}
    s = "the cat sat on the mat"
    assert got[1].fit_chars == max(i for i in range(len(s) + 1) if len(hf(s[:i])) <= 3)
    assert got[2].counts == [0] and got[3].fit_chars == 0


def test_op4_round_trip(odd, tik):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = bpe_codec.round_trip(odd).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe_codec.decode_ids(bpe_codec.encode_texts(odd))
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == texts


def test_codec_folds_and_keeps_each_word_once(tik, monkeypatch):
    folded = []
    monkeypatch.setattr(bpe_codec, "merge", lambda w, rank: folded.append(w) or merge(w, rank))
    c = bpe_codec.Codec(RANKS)
    texts = [" zorbling quaffed, zorbling. quaffed's end", "first zorbling, 7x " + "\u00e9t\u00e9" * 9, " ", "a  b \n c", *made(11, 60)]
    for s in (*texts, *texts):
        ids = tik.encode_ordinary(s)
        assert c.digests(s) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(s.encode()).hexdigest()) and c.encode(s) == ids
    assert folded.count(b" zorbling") == folded.count(b" quaffed") == 1
    assert " zorbling" not in c._word and "zorbling" in c._chunks.tail  # with the chunks only, not again with the words


def test_op6_pieces_are_whole_and_gapless(odd, hf):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    by_doc, by_sequence = {}, {}
    for r in packing.pack(odd).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, rows in by_doc.items():
        ids, rows = hf(texts[i]) + [0], sorted(rows, key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids)
        assert len(rows) == 1 or all(r.length == 2048 for r in rows[1:])
        for r in rows:
            assert zlib.crc32(packed(ids[r.start : r.start + r.length])) == r.ids_crc32
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(odd.limit(0)).collect() == []


def test_texts_are_encoded_in_long_spans(monkeypatch, tik, hf):
    """A call for each new word cost op6 twice the time. Where a long text is cut, the ids stay those of the whole."""
    calls = []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return tik.encode_ordinary(text)

    monkeypatch.setattr(packing, "rust", lambda path: Counted())
    ids = packing.Ids(RANKS)
    text = " ".join(f"w{i}" for i in range(5000)) + ".\n"
    assert ids.of(text) == packed(hf(text)) and calls == [text]
    long = text * 20
    calls.clear()
    assert ids.of(long) == packed(tik.encode_ordinary(long)) and 2 < len(calls) <= len(long) // 60_000 and "".join(calls) == long
    assert ids.of("") == b"" and ids.of("a<|endoftext|><|endoftext|>") == packed(hf("a<|endoftext|><|endoftext|>"))


@pytest.mark.parametrize("size", [0, 1, 4])
def test_spans_are_cut_where_no_match_crosses(tik, size):
    for text in made(10, 3000):
        parts = list(packing.spans(text, size))
        assert "".join(parts) == text and [i for p in parts for i in tik.encode_ordinary(p)] == tik.encode_ordinary(text)


def _best(items: list[int], c: int) -> int:
    best = [len(items)]

    def go(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= c and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(6)
    for _ in range(200):
        c = r.choice([10, 13, 20, 31])
        items = sorted((r.randint(1, c) for _ in range(r.randint(1, 9))), reverse=True)
        plan = packing.Plan({x: items.count(x) for x in items}, c)
        assert plan.sequences <= _best(items, c) + (plan.fixed < plan.sequences)


def test_many_pieces_of_one_length_are_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    for same in (df, df.withColumn("doc_id", F.lit(None).cast("long"))):  # an id that all rows share is dealt alike
        rows = packing.place(same).collect()
        assert len({(r.sequence_id, r.offset) for r in rows}) == 100 and max(r.sequence_id for r in rows) == 49


def test_queries_on_the_smallest_tables(spark, sf):
    assert queries.op1_token_counts(spark, sf).count() == queries.op4_byte_bpe(spark, sf).count() == 200
    assert queries.op6_best_fit_packing(spark, sf).select("doc_id").distinct().count() == 200


@pytest.mark.parametrize("most", [0, 40, 200_000])
def test_native_round_trip_matches_library(spark, odd, tik, most):
    """With no, some and all words looked up; texts with long runs go the other way."""
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = bpe_codec.round_trip_native(odd, most=most).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, raw = tik.encode_ordinary(texts[r.doc_id]), texts[r.doc_id].encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_frequent_words_are_settled_and_bounded(spark):
    df = spark.createDataFrame([("a a a b b c c d " + "x" * 50,), ("a b " * 3,), (None,)], "text string").na.fill("")
    got = {n: sorted(bpe_codec.frequent_words(df, "byte_bpe_50k.tiktoken", n)) for n in (0, 1, 2, 3, 100)}
    assert got[0] == [] and got[1] == [" b"] and got[100] == sorted({" a", " b", " c", " d", "a", " "}) and len(got[3]) <= 3
    plan = bpe_codec.round_trip_native(df.selectExpr("1L as doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan  # that of texts with long runs


def test_native_fold_over_distinct_words(spark, tik):
    r = random.Random(8)
    words = sorted({w for s in made(9, 80) for w in token_counts.WORDS.findall(s)} | {"".join(r.choice("eintors") for _ in range(n)) for n in (1, 2, 9, 30)})
    df = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    got = {x.word: x.ids for x in bpe_codec.encode_words(df).collect()}
    assert got.pop(None) is None and got.pop("") == []
    assert got == {w: tik.encode_ordinary(w) for w in words}
