import math
import random
import re

from tessera.llm import license_scan, queries

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_base_matches_brute_force_and_labels_add(spark):
    r = random.Random(1)
    al = ["MIT", "mit", "license", "License", "apache", "general", "public", "gnu", "Kelvin K", "é", "日本", "x_y", "2.0", "under the", "İ", "cc", "by-nc", "lesser"]
    texts = [" ".join(r.choice(al) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "Released under the MIT License.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "mit. License", "mitlicense", "MIT license " * 9000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string")
    rows = {x.doc_id: x for x in license_scan.scan(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(t)
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    assert rows[302].labels == "mit" and rows[302].score > 0.99 and rows[304].labels == "cc-by-nc" and rows[304].n_base == 0
    assert license_scan.scan(df.limit(0)).collect() == []


def test_query_covers_the_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_license_scan(spark, sf).collect()
    assert {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in rows} == {i: brute(t) for i, t in docs.items()}


def test_labels_and_scores_match_brute_force(spark):
    """Every place of every template's key phrase is looked at, without an index."""
    r = random.Random(4)
    own = [words for _, text, _ in license_scan.TEMPLATES for words in [text.split()]]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(r.randint(0, 4)):
            words = list(r.choice(own))
            for _ in range(r.choice([0, 0, 1, 3])):  # a word changed, lost or put in
                i = r.randrange(len(words))
                words[i : i + r.choice([0, 1])] = r.choice([[], ["river"], ["the"]])
                words = words or ["x"]
            parts += words[r.choice([0, 0, 2]) :] + ["stone"] * r.randint(0, 3)
        texts.append(" ".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = {w.decode(): x for w, x in license_scan.word_frequencies(df).items()}
    n = {w: sum(w in t.split() for t in texts) for w in idf}
    for w, x in idf.items():
        assert abs(x - math.log((len(texts) + 1) / (n[w] + 1)) - 1e-6) < 1e-9
    rows = {x.doc_id: x for x in license_scan.scan(df).collect()}
    for i, text in enumerate(texts):
        words, scores = text.split(), {label: 0.0 for p, label in PHRASES.items() if re.search(rf"(?<!\S){p}(?!\S)", text)}
        for label, template, key in license_scan.TEMPLATES:
            template, key = template.split(), key.split()
            at = next(k for k in range(len(template)) if template[k : k + len(key)] == key)
            for place in range(len(words)):
                if words[place : place + len(key)] == key:
                    stands = [x for k, x in enumerate(template) if 0 <= place - at + k < len(words) and words[place - at + k] == x]
                    scores[label] = max(scores.get(label, 0.0), min(1.0, sum(idf[x] for x in stands) / sum(idf[x] for x in template)))
        assert rows[i].labels == ",".join(sorted(scores)) and abs(rows[i].score - max(scores.values(), default=0.0)) < 1e-9
