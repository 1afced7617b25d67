"""Byte-level BPE pieces shared by the token operators: the vocabulary, exact splitting and bounded memos.

A text is cut at single spaces before the pattern is applied. That cut agrees with the pattern wherever a
space has a character other than white space before or after it, because only a run of white space can cross
such a place; a text with another kind of space (``STRADDLE``) is matched as a whole instead.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, pairwise

import public_tokenizers
import pyarrow as pa
import regex

#: The pattern's own classes, spelled so that every engine means the same set by white space.
WORDS = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: A space between two characters of white space, or after one at the end.
STRADDLE = re.compile(r"\s (?:\s|\Z)")
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Rank (which is also the id) of each token of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def rust(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def words(chunk: str) -> Sequence[str]:
    """The pattern's matches in the chunk; the two usual kinds of chunk are told without the pattern."""
    if chunk[:1] == " ":
        if chunk[1:].isalpha():
            return (chunk,)
        if chunk[-1] in ",." and chunk[1:-1].isalpha():
            return (chunk[:-1], chunk[-1])
    return WORDS.findall(chunk)


class Memo(dict):
    """make(key) for each key asked for. Holds two generations of `size` keys at most; keys in use survive."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Chunks:
    """Values of a text's chunks; make(chunk) gives one chunk's value and is remembered for usual chunks."""

    def __init__(self, make: Callable[[str], object], size: int):
        self.make = make
        self.tail = Memo(lambda p: make(" " + p), size)

    def values(self, text: str) -> Iterator:
        """In order; the chunks' concatenation is the text, and no match of the pattern crosses two of them."""
        if STRADDLE.search(text):
            return iter((self.make(text),))
        first, *rest = text.split(" ")
        tail = map(self.tail.__getitem__, rest)
        return chain((self.make(first),), tail) if first else tail


def merge(word: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """A word's tokens: the adjacent pair of lowest rank (leftmost first) is joined until no pair has a rank.

    A heap-free scan is used for usual words; long ones keep candidate pairs in a heap over a linked list.
    """
    if word in rank:
        return [word]
    if len(word) > 64:
        return _merge_long(word, rank)
    cuts, none, get = list(range(len(word) + 1)), len(rank) + 1, rank.get
    # of the pair that begins at each cut but the last two
    scores = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while scores:
        best = min(scores)
        if best == none:
            break
        i = scores.index(best)
        del cuts[i + 1], scores[i]
        if i:
            scores[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
        if i < len(scores):
            scores[i] = get(word[cuts[i] : cuts[i + 2]], none)
    return [word[a:b] for a, b in pairwise(cuts)]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[bytes]:
    from heapq import heapify, heappop, heappush

    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

    def pair(i: int):
        j = end[i]
        if j < n and (r := rank.get(word[i : end[j]])) is not None:
            return (r, i, j, end[j])
        return None

    heap = [x for i in range(n - 1) if (x := pair(i))]
    heapify(heap)
    while heap:
        _, i, j, k = heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
            continue
        alive[j], end[i] = 0, k
        if k < n:
            before[k] = i
        for at in (before[i], i):
            if at >= 0 and (x := pair(at)):
                heappush(heap, x)
    return [word[i : end[i]] for i in range(n) if alive[i]]


def rows(batch: pa.RecordBatch, step: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that few texts are Python strings at a time."""
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()
