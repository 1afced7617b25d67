"""License scans by a positional index of rare words.

The corpus gives every word of the licence texts its inverse document frequency. Each template is posted under its
rarest words with their positions. A file's licence words, rarest first, look up these postings; occurrences that
agree on where the template would begin (file position minus template position) make a candidate, and a
candidate counts if the template's key phrase stands, word by word, at that place.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in UTF-8 after lower-casing A-Z: ASCII letters and digits and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The phrases whose places are all reported, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, text, key phrase of that text). The key phrase must stand in full.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Index:
    """Templates and base phrases, posted under their rarest words.

    idf: inverse document frequency by word; a word that it lacks is taken as the rarest. rare: how many of its
    words, besides the key phrase's rarest one, a template is posted under."""

    def __init__(self, idf: dict[bytes, float], templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE, rare: int = 4):
        self.top = max(idf.values(), default=1.0)
        self.idf = idf
        self.base = [(label, _words(phrase)) for phrase, label in base.items()]
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # by word: base phrase, position in it
        for b, (_, phrase) in enumerate(self.base):
            at = max(range(len(phrase)), key=lambda i: (self.weight(phrase[i]), -i))
            self.anchors[phrase[at]].append((b, at))
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # by word: template, position in it
        for t, (label, text, key) in enumerate(templates):
            words, phrase = _words(text), _words(key)
            begin = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            order = sorted(range(len(words)), key=lambda i: (-self.weight(words[i]), i))
            must = next(i for i in order if begin <= i < begin + len(phrase))
            for i in {must, *order[:rare]}:
                self.postings[words[i]].append((t, i))
            self.templates.append((label, words, begin, phrase, sum(map(self.weight, words))))
        self.asked = self.anchors.keys() | self.postings.keys()

    def weight(self, word: bytes) -> float:
        return self.idf.get(word, self.top)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], dict[str, float]]:
        """Number of words; (word position, label) of each base place in order; score of each label found."""
        words = _words(text)
        n, asked = len(words), self.asked
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in asked:
                places[w].append(i)
        hits, votes = [], Counter()
        for w in sorted(places, key=lambda w: (-self.weight(w), w)):
            for b, at in self.anchors.get(w, ()):
                label, phrase = self.base[b]
                hits += [(i - at, label) for i in places[w] if i >= at and words[i - at : i - at + len(phrase)] == phrase]
            for t, at in self.postings.get(w, ()):
                votes.update((t, i - at) for i in places[w])
        scores: dict[str, float] = {}
        for t, begin in votes:
            label, template, key, phrase, whole = self.templates[t]
            if begin + key >= 0 and words[begin + key : begin + key + len(phrase)] == phrase:
                found = sum(self.weight(x) for k, x in enumerate(template) if 0 <= begin + k < n and words[begin + k] == x)
                scores[label] = max(scores.get(label, 0.0), min(1.0, found / whole) if whole else 1.0)
        for _, label in hits:
            scores.setdefault(label, 0.0)
        return n, sorted(hits), scores


def word_frequencies(df: DataFrame, text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> dict[bytes, float]:
    """Inverse document frequency of each word of the licence texts over all rows. What reaches the driver is one
    row for each such word, however large the corpus is."""
    asked = frozenset(w for text in [*base, *(t for _, t, _ in templates)] for w in _words(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for text in batch.slice(i, 256).column(0).to_pylist():
                    n += 1
                    if text:
                        seen.update(asked.intersection(_words(text)))
        keys = [b"", *seen]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    counted = df.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {bytes(r.word): r.n for r in counted.collect()}
    total = n.pop(b"", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) + 1e-6 for w in asked}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of all base phrases; first_word and last_word are their least and greatest starting
    word (null if none); labels are distinct, sorted and joined by commas; score is the best template's share of
    weight that stands in place; of templates of one label the best counts, so ties need no rule. A null text counts
    as empty (no words, empty labels, score 0). Repeated rows stay repeated; other columns are not read, whatever their
    names; an empty table gives an empty result. Texts are read whole, one text's words in memory at a time. Two narrow
    passes: frequencies, then the scan."""
    idf = word_frequencies(df, text_col, templates, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, templates, base)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n, count, first, last, own, labels, score = [], [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    words, hits, scores = index.scan(text or "")
                    n.append(words)
                    count.append(len(hits))
                    first.append(hits[0][0] if hits else None)
                    last.append(hits[-1][0] if hits else None)
                    own.append(",".join(sorted({x for _, x in hits})))
                    labels.append(",".join(sorted(scores)))
                    score.append(max(scores.values(), default=0.0))
                ints = [pa.array(x, pa.int64()) for x in (n, count, first, last)]
                yield pa.RecordBatch.from_arrays([part.column(0), *ints, pa.array(own, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)
