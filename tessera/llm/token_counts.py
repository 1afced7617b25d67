"""Exact token counts at every prefix of a text, by prefix dynamic programming over byte-level BPE.

For a word (one match of the splitting pattern) the last token of each prefix is determined by the last tokens
of shorter prefixes: it is the one vocabulary entry t ending there for which the prefix without t ends in a
token u such that u and t, joined, are encoded as (u, t). So a table of one pass holds the token count of every
prefix, and questions of budget or truncation read it instead of encoding again. Time is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import SPECIAL, WORDS, Chunks, Memo, merge, ranks, rows, words
from .shared import resident

#: The contractions of the splitting pattern that have two letters.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Unicode's White_Space.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class PrefixCounts:
    """Token counts of all prefixes of words and texts under one vocabulary."""

    def __init__(self, path: str, memo: int = 250_000):
        self.rank = ranks(path)
        self.token = {i: t for t, i in self.rank.items()}
        self.ending = ahocorasick.Automaton()  # all tokens that end at each place of a word, longest first
        for token, i in self.rank.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), i))
        self.ending.make_automaton()
        self._joined = Memo(self._keeps, 400_000)
        self._total = Memo(lambda word: self.of_word(word.encode())[-1], memo)
        self._chunks = Chunks(lambda chunk: sum(map(self._total.__getitem__, words(chunk))), memo)

    def _keeps(self, pair: int) -> bool:
        """Whether the tokens pair >> 16 and pair & 0xFFFF, joined, are encoded as those two."""
        left, right = self.token[pair >> 16], self.token[pair & 0xFFFF]
        return merge(left + right, self.rank) == [left, right]

    def of_word(self, word: bytes) -> list[int]:
        """Counts of word[:0], word[:1], …, word[:len(word)], where the word is one match of the pattern."""
        joined, n = self._joined, len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for at, (length, token) in self.ending.iter(word.decode("latin-1")):
            end = at + 1
            if last[end] < 0:
                start = end - length
                if not start or joined[last[start] << 16 | token]:
                    last[end], count[end] = token, count[start] + 1
        return count

    def total(self, text: str) -> int:
        """Tokens of the text; the special token's string counts as one, as the tokenizer takes it by default."""
        if SPECIAL in text:
            parts = text.split(SPECIAL)
            return len(parts) - 1 + sum(sum(self._chunks.values(p)) for p in parts if p)
        return sum(self._chunks.values(text))

    def at_every_prefix(self, text: str) -> list[int]:
        """Counts of text[:0], text[:1], …, text[:len(text)], each as if that prefix were encoded by itself."""
        out, base, parts = [0], 0, text.split(SPECIAL)
        for i, part in enumerate(parts):
            marked = i + 1 < len(parts)
            counts = self._plain(part + SPECIAL if marked else part)
            out += [base + n for n in counts[1 : len(part) + len(SPECIAL) if marked else None]]
            if marked:
                base += counts[len(part)] + 1
                out.append(base)
        return out

    def _plain(self, text: str) -> list[int]:
        out, base = [0], 0  # base: tokens of the matches before this one
        blank, blank_base = None, 0  # where the run of white space began that reaches this match, and base there
        for m in WORDS.finditer(text):
            word, start = m[0], m.start()
            counts, at = self.of_word(word.encode()), 0
            if word in CONTRACTIONS:  # its first two characters alone are two matches
                out += [base + counts[1], base + counts[1] + self.of_word(word[1].encode())[-1], base + counts[-1]]
            else:
                lead = len(word) - len(word.lstrip(BLANKS)) if blank is not None else 0
                if lead:  # a prefix that ends here ends in a longer run, which is one match
                    run = self.of_word(text[blank : start + lead].encode())
                    before = len(text[blank:start].encode())
                for i, c in enumerate(word):
                    at += len(c.encode())
                    out.append(blank_base + run[before + at] if i < lead else base + counts[at])
            if word[-1] not in BLANKS:
                blank = None
            elif blank is None:
                blank, blank_base = start, base
            base += counts[-1]
        return out

    def cut(self, text: str, limit: int) -> int:
        """Characters of the longest prefix that has at most `limit` tokens."""
        if len(text.encode()) <= limit or self.total(text) <= limit:
            return len(text)
        counts = self.at_every_prefix(text)
        return max(i for i, n in enumerate(counts) if n <= limit)


def counter(path: str) -> PrefixCounts:
    """One for each worker process, so that its memos last from task to task."""
    return resident(("counter", path), lambda: PrefixCounts(path))


def count_tokens(df: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows stay repeated; an empty
    table gives an empty result; other columns are not read, whatever their names. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(vocab))
        for batch in batches:
            for part in rows(batch):
                n = pa.array([count.total(t) if t else 0 for t in part.column(1).to_pylist()], pa.int64())
                size = pc.fill_null(pc.binary_length(part.column(1)).cast(pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id and `counts`, where counts[i] is the token count of the text's first i characters (i from 0).

    Truncation to k characters costs counts[k] tokens; a budget of b tokens allows the last i with counts[i] <= b.
    A null text counts as empty: counts is [0]. Repeated rows stay repeated; an empty table gives an empty result; a
    text's counts take four bytes a character, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(public_tokenizers.path(vocab))
        for batch in batches:
            for part in rows(batch, 16):
                made = pa.array([count.at_every_prefix(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["id", "counts"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, counts array<int>").withColumnRenamed("id", id_col)


def fit_to_budget(df: DataFrame, budget: int, counts_col: str = "counts") -> DataFrame:
    """Adds `fit_chars`, the longest prefix in characters that has at most `budget` tokens, from stored counts alone;
    null for null counts. Of prefixes with equal counts the longest is taken."""
    c = F.col(counts_col)
    longest = F.array_max(F.transform(c, lambda n, i: F.when(n <= budget, i)))
    return df.withColumn("fit_chars", longest)
