import zlib

import numpy as np
import pytest
from tessera.llm import queries, toxicity


def test_gradients_match_differences():
    net = toxicity.Net.fresh({"a": 0, "b": 1}, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, rows, y = rng.normal(size=(5, 24)), rng.integers(1, 5, (6, 3)), np.array([1.0, 0, 1])
    mask = np.ones((6, 3))
    mask[4:, 1] = 0
    _, g, dx = net.gradients(x, rows, mask, y)
    for name, v in [*((k, net.p[k]) for k in net.p if k not in ("word", "char")), ("x", x)]:
        for i in [tuple(0 for _ in v.shape), tuple(n - 1 for n in v.shape)]:
            own = v[i]
            v[i] = own + 1e-4
            up = net.gradients(x, rows, mask, y)[0]
            v[i] = own - 1e-4
            down = net.gradients(x, rows, mask, y)[0]
            v[i] = own
            assert abs((up - down) / 2e-4 - (dx if name == "x" else g[name])[i]) < 1e-4


def test_all_windows_are_scored():
    for n in (0, 1, 63, 64, 65, 112, 113, 5000):
        seen = {k for s in toxicity.starts(n) for k in range(s, s + toxicity.WINDOW)}
        assert seen >= set(range(n)) and toxicity.starts(n)[-1] < max(n, 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.97  # some two in a hundred labels of this table are wrong
    assert sum(b for a, b in held if a) >= 0.8 * sum(a for a, _ in held)


@pytest.fixture(scope="module")
def net():
    good = [f"the quiet river number {i} runs over stones and sand" for i in range(60)]
    bad = [f"you are a grumblefool number {i} and a grumbler over sand" for i in range(60)]
    return toxicity.train(good + bad, [0] * 60 + [1] * 60)


def test_odd_rows(spark, net):
    long = "the quiet river runs over stones " * 20_000
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, long, 1), (3, long, 1), (4, long + " grumblefoolish grumblefool", 1), (None, "sand", 2)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in toxicity.score(df, net).collect()}
    assert rows[1].score == rows[2].score and rows[None].held_out is None
    assert rows[3].predicted == 0 and rows[4].predicted == 1
    kept = toxicity.clean(df, net)
    assert kept.columns == df.columns and 4 not in [r.doc_id for r in kept.collect()] and kept.count() >= 2
    assert toxicity.score(df.limit(0), net).collect() == []


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    one = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1}


def test_long_runs_are_read_to_their_end(net):
    run = "abcdefghij" * 30
    for n in (1, 59, 60, 61, 117, 118, 300):
        pieces = toxicity.words_of(run[:n])
        assert all(len(w) <= 60 for w in pieces) and (n > 60 or pieces == [run[:n]]) and pieces[0] + "".join(w[3:] for w in pieces[1:]) == run[:n]
    clean = "the_quiet_river_runs_over_stones_and_sand_" * 20
    toxic = clean + "you_are_a_grumblefool_and_a_grumbler_grumblefool_" * 3
    scores = toxicity.Scorer(net).scores([clean, toxic])
    assert scores[0] < 0.5 <= scores[1]


def test_scores_match_brute_force(net):
    """Each window by itself, word by word and step by step."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def inputs(word):
        data = f"<{word}>".encode()
        grams = [data[i : i + n] for n in (3, 4) for i in range(max(1, len(data) - n + 1))]
        char = sum(p["char"][zlib.crc32(g) % toxicity.BUCKETS] for g in grams) / len(grams)
        return np.concatenate([p["word"][net.vocabulary.get(word, len(net.vocabulary))], char])

    def states(xs, side):
        out, last = [], np.zeros(h)
        for x in xs if side == "f" else xs[::-1]:
            a, r = x @ p[f"W{side}"] + p[f"c{side}"], last @ p[f"U{side}"]
            z, q = sigmoid(a[:h] + r[:h]), sigmoid(a[h : 2 * h] + r[h : 2 * h])
            n = np.tanh(a[2 * h :] + q * r[2 * h :])
            last = z * last + (1 - z) * n
            out.append(last)
        return out if side == "f" else out[::-1]

    def score(text):
        words, best = text.lower().split(), -np.inf
        for begin in range(0, max(1, len(words) - 16), 48):
            xs = [inputs(w) for w in words[begin : begin + 64]]
            s = np.hstack([np.array(states(xs, "f")), np.array(states(xs, "b"))])
            e = np.tanh(s @ p["A"] + p["a"]) @ p["v"]
            w = np.exp(e - e.max())
            best = max(best, float((w / w.sum()) @ s @ p["o"] + p["k"][0]))
        return sigmoid(net.slope * best + net.offset)

    rng = np.random.default_rng(3)
    known = [*net.vocabulary, "unheard", "of", "grumblefool"]
    texts = [" ".join(rng.choice(known, n)) for n in (1, 2, 10, 63, 64, 65, 112, 113, 200)]
    assert toxicity.Scorer(net).scores(texts) == pytest.approx([score(t) for t in texts], abs=1e-4)


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNABLE", 40)
    taken = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.update(rows=list(zip(texts, labels))))
    rows = [(i, f"text {i}") for i in range(400)] + [(1, "a text"), (1, "text 1")] * 50 + [(2, None), (3, "x" * 41), (3, "y" * 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(4, 7), (5, None)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    want = {i: (f"text {i}", i % 2) for i in ids} | ({1: ("a text", 1)} if 1 in ids else {}) | ({2: ("", 0)} if 2 in ids else {}) | ({4: ("text 4", 1)} if 4 in ids else {})
    assert taken["rows"] == [want[i] for i in ids]
    toxicity.fit(docs, labels, sample=20)
    assert 10 < len(taken["rows"]) < 80
