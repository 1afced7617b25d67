"""Toxicity by a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word enters as a learned vector of its own, if it is frequent in the training rows, joined with the mean of
learned vectors of its character n-grams, hashed. Two gated recurrent units read a window of words from both
sides, attention pools their states, and a linear unit gives the window's logit. All overlapping windows of a text
are scored; the text's score is a calibrated function of its greatest logit. Training is plain numpy on the driver,
over a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import resident, sampled

WINDOW = 64
STRIDE = 48
HIDDEN = 8
WORD_DIM = 8
CHAR_DIM = 16
BUCKETS = 1 << 14
VOCABULARY = 4000
#: Labelled rows of each class that are learned from, at most about so many.
SAMPLE = 1200
#: Texts of more characters are not learned from (they are scored whole), so that the driver holds at most about
#: 2 x SAMPLE x LEARNABLE characters.
LEARNABLE = 60_000
#: A training text whose label the net contradicts by so many logits is left out, until it does so no more.
DOUBT = 1.0
#: Longest word; a longer run is several, each about as long as usual words, whose n-grams' means they resemble.
LONGEST = 60
PIECE = 10
#: Rows of the table of word inputs that a worker keeps.
KEPT = 60_000

WORD = re.compile(r"\w+")


def grams(word: str) -> list[int]:
    """Buckets of the word's character n-grams of 3 and 4, with marks at both ends."""
    data = f"<{word}>".encode()
    return [zlib.crc32(data[i : i + n]) % BUCKETS for n in (3, 4) for i in range(max(1, len(data) - n + 1))]


def words_of(text: str) -> list[str]:
    """The runs of word characters, lower-cased. A run of over LONGEST characters, as in scripts without spaces, gives
    successive words of PIECE that overlap by 3, so that no n-gram of it is lost."""
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        return [x for w in found for x in ([w[i : i + PIECE] for i in range(0, len(w) - 3, PIECE - 3)] if len(w) > LONGEST else [w])]
    return found


def starts(n: int) -> range:
    """Where the overlapping windows of n words begin."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


@dataclass
class Net:
    """Parameters by name; `forward` and `gradients` work on windows of row numbers into a table of inputs."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": draw(BUCKETS, CHAR_DIM, scale=0.1)}
        for side in "fb":
            p |= {f"W{side}": draw(d, 3 * h, scale=d**-0.5), f"U{side}": draw(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        p |= {"A": draw(2 * h, h, scale=(2 * h) ** -0.5), "a": np.zeros(h, np.float32), "v": draw(h, scale=h**-0.5), "o": draw(2 * h, scale=(2 * h) ** -0.5), "k": np.zeros(1, np.float32)}
        return cls(p, vocabulary)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Word vectors and means of n-gram vectors."""
        out = np.empty((len(words), WORD_DIM + CHAR_DIM), np.float32)
        unknown, char = len(self.vocabulary), self.p["char"]
        out[:, :WORD_DIM] = self.p["word"][[self.vocabulary.get(w, unknown) for w in words]]
        ids = [grams(w) for w in words]
        sizes = np.array([len(x) for x in ids])
        if len(words):
            flat = char[np.concatenate([np.array(x) for x in ids])]
            out[:, WORD_DIM:] = np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return out

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the inputs add to both units' gates; the same for a word wherever it stands."""
        return np.hstack([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]])

    def _unit(self, g: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States of one unit over time-major gate inputs g (T, B, 3H); mask (T, B, 1) is 0 where the text has ended."""
        u, h = self.p[f"U{side}"], HIDDEN
        steps, batch, _ = g.shape
        states = np.zeros((steps, batch, h), np.float32)
        saved = []
        last = np.zeros((batch, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            r = last @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * (g[t, :, : 2 * h] + r[:, : 2 * h]))
            z, q = gates[:, :h], gates[:, h:]
            n = np.tanh(g[t, :, 2 * h :] + q * r[:, 2 * h :])
            new = last + mask[t] * (1 - z) * (n - last)
            if keep:
                saved.append((t, last, z, q, n, r[:, 2 * h :]))
            states[t] = last = new
        return states, saved

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; g (T, B, 6H), mask (T, B)."""
        m = mask[:, :, None]
        f, sf = self._unit(g[:, :, : 3 * HIDDEN], m, "f", keep)
        b, sb = self._unit(g[:, :, 3 * HIDDEN :], m, "b", keep)
        states = np.concatenate([f, b], axis=2)
        tanh = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, tanh @ self.p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        logit = pooled @ self.p["o"] + self.p["k"]
        return (logit, (states, tanh, w, pooled, sf, sb)) if keep else logit

    def gradients(self, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Logistic loss, its gradients and those of the input table x, over windows of row numbers (T, B)."""
        p, h = self.p, HIDDEN
        logit, (states, tanh, w, pooled, sf, sb) = self.forward(self.projected(x)[rows], mask, keep=True)
        prob = 0.5 + 0.5 * np.tanh(0.5 * logit)
        loss = float(np.mean(np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d, "k": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        dw = np.einsum("bh,tbh->tb", dp, states)
        ds = w[:, :, None] * dp
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, tanh)
        dt = de[:, :, None] * p["v"] * (1 - tanh * tanh)
        g["A"] = np.einsum("tbi,tbj->ij", states, dt)
        g["a"] = dt.sum(axis=(0, 1))
        ds = ds + dt @ p["A"].T
        dx = np.zeros_like(x)
        taken = x[rows]
        for side, saved, own in (("f", sf, ds[:, :, :h]), ("b", sb, ds[:, :, h:])):
            u, dg = p[f"U{side}"], np.zeros((*rows.shape, 3 * h), np.float32)
            du, back = np.zeros_like(u), np.zeros((rows.shape[1], h), np.float32)
            for t, last, z, q, n, r in reversed(saved):
                m = mask[t][:, None]
                dh = own[t] + back
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (last - n) * z * (1 - z)
                dq = dn * r * q * (1 - q)
                dg[t] = np.hstack([dz, dq, dn])
                dr = np.hstack([dz, dq, dn * q])
                du += last.T @ dr
                back = dh * (1 - m * (1 - z)) + dr @ u.T
            g[f"U{side}"] = du
            g[f"W{side}"] = np.einsum("tbi,tbj->ij", taken, dg)
            g[f"c{side}"] = dg.sum(axis=(0, 1))
            dx += summed(rows.ravel(), (dg @ p[f"W{side}"].T).reshape(rows.size, -1), len(x))
        return loss, g, dx


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by their place below n."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out[own[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Scorer:
    """Scores texts with a net; keeps a bounded table of the gate inputs of words already met."""

    def __init__(self, net: Net):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Each text's greatest logit over all its windows; that of an empty window for a text without words."""
        if len(self.row) > KEPT:
            self._clear()
        lists = [words_of(t) for t in texts]
        new = list({w for ws in lists for w in ws} - self.row.keys())
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            parts = [self.net.projected(self.net.inputs(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *parts])
        windows, counts = [], []
        for ws in lists:
            at = starts(len(ws))
            rows = np.zeros((at[-1] if len(at) else 0) + WINDOW, np.int32)
            rows[: len(ws)] = [self.row[w] for w in ws]
            windows.append(np.lib.stride_tricks.sliding_window_view(rows, WINDOW)[::STRIDE])
            counts.append(len(at))
        rows = np.concatenate(windows)
        out = np.empty(len(rows), np.float32)
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512].T
            out[i : i + 512] = self.net.forward(self.table[part], _mask(part))
        counts = np.array(counts)
        return np.maximum.reduceat(out, np.cumsum(counts) - counts)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i in range(0, len(texts), 64):
            x = self.net.slope * self.logits(texts[i : i + 64]).astype(np.float64) + self.net.offset
            out[i : i + 64] = 0.5 + 0.5 * np.tanh(0.5 * x)
        return out


class Rows:
    """Training texts as arrays: words numbered from 1, their n-grams laid end to end."""

    def __init__(self, texts: list[str]):
        self.lists = [words_of(t) for t in texts]
        names = sorted({w for ws in self.lists for w in ws})
        number = {w: i + 1 for i, w in enumerate(names)}
        self.rows = [np.array([number[w] for w in ws], np.int32) for ws in self.lists]
        frequent = np.zeros(len(names) + 1, int)
        for r in self.rows:
            frequent[np.unique(r)] += 1
        order = sorted(range(len(names)), key=lambda i: (-frequent[i + 1], i))[:VOCABULARY]
        self.vocabulary = {names[i]: k for k, i in enumerate(order) if frequent[i + 1] >= 5}
        self.known = np.array([0, *(self.vocabulary.get(w, len(self.vocabulary)) for w in names)])
        ids = [[0], *map(grams, names)]
        self.sizes = np.array([len(x) for x in ids])
        self.flat = np.array([g for x in ids for g in x])
        self.begin = np.cumsum(self.sizes) - self.sizes
        windows = [np.pad(r, (0, starts(len(r))[-1] + WINDOW - len(r))) for r in self.rows]
        self.windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, WINDOW)[::STRIDE] for w in windows])
        self.counts = np.array([len(starts(len(r))) for r in self.rows])
        self.first = np.cumsum(self.counts) - self.counts  # each text's first window

    def grams_of(self, words: np.ndarray) -> np.ndarray:
        """The words' n-grams, end to end."""
        own = self.sizes[words]
        return self.flat[np.arange(own.sum()) + np.repeat(self.begin[words] - np.cumsum(own) + own, own)]

    def inputs(self, net: Net, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, own = self.grams_of(words), self.sizes[words]
        means = np.add.reduceat(net.p["char"][at], np.cumsum(own) - own, axis=0) / own[:, None]
        return np.hstack([net.p["word"][self.known[words]], means]).astype(np.float32), at

    def telling(self, y: np.ndarray) -> np.ndarray:
        """Each window's sum of its words' mean log odds of n-grams, by the texts that hold them, where positive."""
        seen = np.zeros((2, BUCKETS))
        for r, label in zip(self.rows, y):
            if len(r):
                seen[int(label), np.unique(self.grams_of(np.unique(r)))] += 1
        n = np.bincount(y.astype(int), minlength=2)
        odds = np.where(seen[1] >= 3, np.log((seen[1] + 0.5) / n[1]) - np.log((seen[0] + 0.5) / n[0]), 0)
        words = np.add.reduceat(odds[self.flat], self.begin) / self.sizes
        words[0] = 0
        return np.maximum(words, 0)[self.windows].sum(axis=1)

    def logits(self, net: Net) -> np.ndarray:
        """Of all windows."""
        table = np.concatenate([net.projected(self.inputs(net, np.arange(i, min(i + 20_000, len(self.known))))[0]) for i in range(0, len(self.known), 20_000)])
        out = np.empty(len(self.windows), np.float32)
        for i in range(0, len(out), 1024):
            part = self.windows[i : i + 1024].T
            out[i : i + 1024] = net.forward(table[part], _mask(part))
        return out

    def best(self, value: np.ndarray) -> np.ndarray:
        """Each text's window of greatest value."""
        return np.array([f + int(np.argmax(value[f : f + n])) for f, n in zip(self.first, self.counts)])


def _mask(rows: np.ndarray) -> np.ndarray:
    mask = (rows > 0).astype(np.float32)
    mask[0] = 1
    return mask


def train(texts: list[str], labels: list[int], seed: int = 0, epochs: int = 6, steps: int = 200) -> Net:
    """A net for whole texts labelled 0 or 1. Windows of a toxic text are chosen where its most telling n-grams
    stand, then, from the third epoch on, where the net itself is surest; of clean texts also one at random. There
    are at least so many epochs and steps of 128 windows."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net = Net.fresh({}, seed)
        net.slope, net.offset = 0.0, 8.0 if labels and labels[0] else -8.0
        return net
    data = Rows(texts)
    net = Net.fresh(data.vocabulary, seed)
    rng = np.random.default_rng(seed)
    best = data.best(data.telling(y))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, clean_, trusted = 0, np.flatnonzero(y == 0), np.ones(len(y), bool)
    batches = -(-(len(y) + len(clean_)) // 128)
    for epoch in range(max(epochs, -(-steps // batches))):
        if epoch >= 2 and epoch % max(1, steps // batches // 8) == 0:
            logits = data.logits(net)
            best = data.best(logits)
            if epoch >= 3:  # a label that the net contradicts by far may be wrong
                trusted = logits[best] * (2 * y - 1) > -DOUBT
        other = data.first[clean_] + (rng.random(len(clean_)) * data.counts[clean_]).astype(int)
        chosen = np.concatenate([best[trusted], other])
        target = np.concatenate([y[trusted], np.zeros(len(other), np.float32)])
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), 128):
            window = data.windows[chosen[order[k : k + 128]]].T
            need, local = np.unique(window, return_inverse=True)
            x, at = data.inputs(net, need)
            _, g, dx = net.gradients(x, local.reshape(window.shape), _mask(window), target[order[k : k + 128]])
            own = data.sizes[need]
            g["word"] = summed(data.known[need], dx[:, :WORD_DIM], len(net.p["word"]))
            g["char"] = summed(at, np.repeat(dx[:, WORD_DIM:] / own[:, None], own, axis=0), BUCKETS)
            step += 1
            for name, v in net.p.items():  # Adam
                m, s = moment[name]
                m += 0.1 * (g[name] - m)
                s += 0.001 * (g[name] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.slope, net.offset = _calibrated(np.maximum.reduceat(data.logits(net), data.first).astype(np.float64)[trusted], y[trusted])
    return net


def _calibrated(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope 1 and the offset that puts the best threshold between clean and toxic training texts at one half."""
    order = np.argsort(logits)
    x, t = logits[order], y[order]
    wrong = np.concatenate([[np.sum(t == 0)], np.sum(t == 0) - np.cumsum(t == 0) + np.cumsum(t == 1)])
    good = np.flatnonzero(wrong == wrong.min())
    cuts = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    gaps = np.concatenate([[0], x[1:] - x[:-1], [0]])
    return 1.0, -float(cuts[good[np.argmax(gaps[good])]])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net:
    """A net learned from labelled rows whose crc32(id as text) mod 5 is not 0: about `sample` rows of each class,
    chosen by a hash of the id, with texts of at most LEARNABLE characters. Rows without id or label are not learned
    from; of repeated ids the greatest label and the least text hold, a null text counts as empty. Without labels of
    both classes the net tells the one that it has, or clean, of every text."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    own = own.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("label") == label) & sampled(F.col("id"), F.lit(min(1.0, sample / n))))
    picked = F.broadcast(own.filter(keep))  # about 2 x `sample` rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= LEARNABLE)
    rows = rows.join(picked, "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.id)
    return train([r.text for r in rows], [r.label for r in rows])


def _scorer(key: int, net: Net) -> Scorer:
    """One for each worker process."""
    return resident(("scorer", key), lambda: Scorer(net))


def _key(net: Net) -> int:
    return zlib.crc32(net.p["o"].tobytes() + np.float64(net.offset).tobytes())


def score(df: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. A null text counts as empty and is scored like any
    other; a null id gives a null held_out; repeated rows stay repeated; a score of exactly 0.5 is predicted 1; other
    columns are not read; an empty table gives an empty result. Texts are scored whole, in time and memory that grow
    with their words (64 texts at a time)."""
    key = _key(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, net)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                s = scorer.scores([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    held = (F.crc32(F.col(id_col).cast("string")) % 5 == 0).alias("held_out")
    out = df.select(F.col(id_col).alias("id"), held, F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def clean(df: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """The rows of df that the net does not take for toxic, with all their columns, whatever their names; a narrow pass.
    A null text counts as empty; repeated rows stay or go alike; an empty table gives an empty one."""
    key, at = _key(net), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, net)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(scorer.scores([t or "" for t in part.column(at).to_pylist()]) < 0.5))

    return df.mapInArrow(run, df.schema)
