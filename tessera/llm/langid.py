"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from hashed character trigrams of its words, counted by grouped
aggregation over a bounded sample of rows with a declared language. To its log are added those of the declared
markup language and of the address (top-level domain, language segment of the path), each under a fixed rate of
error, and of the host's prior. Host priors are counts of what pages look like, smoothed from the whole corpus to
the registered domain to the host, and are joined to small evidence rows, not to texts.

Beside the learned languages stands a class of other text, under which every bucket is equally likely. That is what
a language's smoothed counts say before any text is seen, so what resembles none of the languages falls to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import sampled, written

BUCKETS = 1 << 14
#: Trigrams that are hashed at a time.
PIECE = 1 << 16
#: Rows of each declared language that the trigram counts are learned from, at most about so many.
SAMPLE = 750
#: Texts with letters that must declare a language for it to be learned.
LEAST = 3
#: Count that a trigram bucket has before any text is seen. Small, so that a language of few texts does not spread
#: its likelihood over all buckets, which other text does.
UNSEEN = 0.1
#: Weight of a text's log likelihood: neighbouring trigrams tell much the same.
TEMPER = 0.3
#: Rates at which a declaration, a path segment and a top-level domain name another language than the text's.
WRONG = {"declared": 0.08, "segment": 0.12, "domain": 0.35}
#: Pseudo-counts with which a wider level enters a narrower one.
SMOOTH = 10.0
#: Hosts whose priors are broadcast: a host and one number a language each, a few MB in all.
HOSTS = 20_000
#: Least posterior of an accepted row.
ACCEPT = 0.5
#: Name of the class of other text; no language tag is empty.
OTHER = ""

#: Languages of top-level domains.
DOMAINS = {"de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "se": "sv", "dk": "da", "fi": "fi", "no": "no", "cz": "cs", "tr": "tr", "gr": "el", "kr": "ko", "hu": "hu", "ro": "ro"}

WORD = re.compile(r"[^\W\d_]+")
#: What is not closed goes to the end of the page, so that no piece of a page is read twice.
MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[a-z/!?][^>]*(?:>|\Z)", re.S | re.I)
CODE = r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$"


def tag(declared: Column) -> Column:
    """The primary subtag, lower-cased; null for what is no language tag."""
    got = F.lower(F.regexp_extract(declared, CODE, 1))
    return F.when(got != "", got)


def host_of(url: Column) -> Column:
    got = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(got != "", got)


def trigrams(text: str) -> np.ndarray | None:
    """How often each bucket's trigrams stand in the text's words (lower-cased runs of letters with a space at both
    ends); None for a text without letters."""
    words = WORD.findall(text.lower())
    if not words:
        return None
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(codes) - 2, PIECE):
        c = codes[i : i + PIECE + 2]
        h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(18)  # the upper bits, as many as BUCKETS has
        out += np.bincount(h[c[1:-1] != 32], minlength=BUCKETS)  # none crosses from word to word
    return out


@dataclass
class Model:
    """Languages, and the log probability of each trigram bucket in each."""

    languages: list[str]
    log: np.ndarray  # BUCKETS x languages

    def __post_init__(self):
        self._log = np.hstack([self.log, np.full((BUCKETS, 1), -np.log(BUCKETS))])

    def __reduce__(self):
        return Model, (self.languages, self.log)

    def text(self, text: str) -> np.ndarray:
        """Tempered log likelihoods of the words in each language, all zero for a text without letters."""
        return self.classes(text)[:-1]

    def classes(self, text: str) -> np.ndarray:
        """The same, and that of other text at the end."""
        counts = trigrams(text)
        if counts is None:
            return np.zeros(len(self.languages) + 1)
        at = np.flatnonzero(counts)
        return TEMPER * (counts[at] @ self._log[at])


def fit(df: DataFrame, text: str, declared: str, markup: bool = False, sample: int = SAMPLE) -> Model:
    """A model from about `sample` rows of each declared language, chosen by a hash of the text; all rows of a
    language that has no more. At least LEAST texts with letters must declare a language for it to be learned. What
    reaches the driver is bounded by languages x BUCKETS counts."""
    rows = df.select(F.col(text).alias("text"), tag(F.col(declared)).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect() if r[1] >= LEAST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts: Counter = Counter()
        for batch in batches:
            for t, lang in zip(*(c.to_pylist() for c in batch.columns)):
                own, found = counts.setdefault(lang, np.zeros(BUCKETS, np.int64)), trigrams(MARKUP.sub(" ", t) if markup else t)
                if found is not None:
                    texts[lang] += 1
                    own += found
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(own[at], texts[lang]), pa.int64())], ["lang", "bucket", "n"])

    def counted(parts: dict[str, float]) -> dict[str, dict[int, int]]:
        """Counts by bucket of such shares of each language's rows; under -1 the number of texts with letters."""
        picked = F.broadcast(df.sparkSession.createDataFrame(list(parts.items()), "lang string, part double"))
        some = rows.join(picked, "lang").filter(sampled(F.col("text"), F.col("part"))).select("text", "lang")
        out: dict[str, dict[int, int]] = {}
        for r in some.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            out.setdefault(r.lang, {})[r.bucket] = r.n
        return out

    parts = {x: min(1.0, sample / n) for x, n in sizes.items()}
    got = counted(parts) if parts else {}
    # the hash may pass over a language that is mostly copies of few texts
    missed = {x: 1.0 for x, part in parts.items() if part < 1 and got.get(x, {}).get(-1, 0) < LEAST}
    got |= counted(missed) if missed else {}
    languages = sorted(x for x, own in got.items() if own[-1] >= LEAST)
    counts = np.full((BUCKETS, len(languages)), UNSEEN)
    for i, x in enumerate(languages):
        for bucket, n in got[x].items():
            if bucket >= 0:
                counts[bucket, i] += n
    return Model(languages, np.log(counts / counts.sum(axis=0)))


def evidence(df: DataFrame, model: Model, text: str, declared: Column, url: Column, host: Column, keep: list[str], markup: bool = False) -> DataFrame:
    """The columns of `keep`, host, domain, `logs` (one log likelihood for each language and for other text), `likely`
    (the class of the greatest, null without any evidence), `letters` (whether the text has any) and `unlearned` (the
    declared language, if it is not one of the model's; it speaks for other text). A narrow pass."""
    languages = model.languages
    classes = [*languages, OTHER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(classes)}
        step = {k: np.log((1 - e) / (e / max(1, len(languages) - 1))) for k, e in WRONG.items()}
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                logs, likely, letters, unlearned = [], [], [], []
                for t, d, s, top in zip(*(part.column(k).to_pylist() for k in range(4))):
                    own = model.classes(MARKUP.sub(" ", t) if markup else t) if t else np.zeros(len(classes))
                    letters.append(bool(np.any(own)))
                    unlearned.append(d if d not in index else None)
                    d = d if d is None or d in index else OTHER
                    for value, kind in ((d, "declared"), (s, "segment"), (DOMAINS.get(top), "domain")):
                        if value in index:
                            own[index[value]] += step[kind]
                    logs.append(own)
                    likely.append(classes[int(np.argmax(own))] if np.any(own) else None)
                yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(logs, pa.list_(pa.float64())), pa.array(likely, pa.string()), pa.array(letters, pa.bool_()), pa.array(unlearned, pa.string())], [*part.schema.names[4:], "logs", "likely", "letters", "unlearned"])

    segment = F.lower(F.regexp_extract(url, r"^[^?#]*?//[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    domain = F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)
    rows = df.select(F.col(text).alias("_text"), tag(declared).alias("_declared"), segment.alias("_segment"), top.alias("_top"), *[F.col(c).alias(c) for c in keep], host.alias("host"), domain.alias("domain"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[4:])
    return rows.mapInArrow(run, f"{schema}, logs array<double>, likely string, letters boolean, unlearned string")


def priors(rows: DataFrame, languages: list[str], smooth: float = SMOOTH) -> tuple[DataFrame, list[float]]:
    """host and `prior` (log probabilities of the languages): counts of `likely` by host, smoothed towards the
    domain's, those towards the whole table's, those towards even odds. Also the whole table's log probabilities."""
    wanted = [F.sum((F.col("likely") == x).cast("long")).alias(f"n{i}") for i, x in enumerate(languages)]
    hosts = rows.filter("likely is not null and host is not null").groupBy("host", "domain").agg(*wanted)
    names = [f"n{i}" for i in range(len(languages))]
    domains = hosts.groupBy("domain").agg(*[F.sum(c).alias(f"d{c}") for c in names])
    whole = rows.filter("likely is not null").agg(*[F.coalesce(w, F.lit(0)).alias(f"g{i}") for i, w in enumerate(wanted)]).first()  # one row
    total, even = sum(whole), 1 / len(languages)
    broad = [(n + smooth * even) / (total + smooth) for n in whole]
    size = lambda cs: sum((F.col(c) for c in cs), F.lit(0))
    d = [(F.col(f"d{c}") + smooth * F.lit(b)) / (size([f"d{c}" for c in names]) + smooth) for c, b in zip(names, broad)]
    joined = hosts.join(domains, "domain")
    h = [F.log((F.col(c) + smooth * p) / (size(names) + smooth)) for c, p in zip(names, d)]
    return joined.select("host", F.array(*h).alias("prior")), [float(np.log(b)) for b in broad]


def fused(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang, posterior and accepted to evidence rows; drops logs. lang is null, posterior 0 and accepted false
    where the text has no letters or is likelier other text than any language. Other text that declares a language
    which could not be learned is taken at its word: lang is that language, and the posterior of other text is
    lessened by a declaration's rate of error. Whether the priors are broadcast (up to HOSTS rows, a few MB) or joined
    by a shuffle is a choice of plan, by a count of their rows; the result is the same. In the shuffle both sides are
    written tables, so Spark splits a host that holds a large part of the rows."""
    by_host, broad = priors(rows, [*languages, OTHER])
    by_host = written(by_host)
    small = by_host.count() <= HOSTS
    out = rows.join(F.broadcast(by_host) if small else by_host, "host", "left")
    total = F.zip_with("logs", F.coalesce("prior", F.array(*map(F.lit, broad))), lambda a, b: a + b)
    out = out.withColumn("_sum", total).withColumn("_top", F.array_max("_sum"))
    mass = F.aggregate(F.transform("_sum", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*[F.lit(x or None) for x in [*languages, OTHER]]), F.array_position("_sum", F.col("_top")).cast("int"))
    out = out.withColumn("_best", F.when(F.col("letters"), best))
    taken = F.col("letters") & F.col("_best").isNull()
    out = out.withColumn("lang", F.when(taken, F.col("unlearned")).otherwise(F.col("_best")))
    sure = F.when(taken, 1 - WRONG["declared"]).otherwise(F.lit(1.0)) / mass
    out = out.withColumn("posterior", F.when(F.col("lang").isNotNull(), sure).otherwise(F.lit(0.0))).withColumn("accepted", F.col("posterior") >= ACCEPT)
    return out.drop("_sum", "_top", "_best", "prior", "logs", "unlearned")


def identify_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, lang, posterior, accepted.

    A null or wordless page, and one that neither resembles a learned language nor declares one that could not be
    learned, is rejected with a null lang and posterior 0;
    a null address has no address evidence and the whole table's prior; repeated rows
    stay repeated; of languages with equal posteriors the first by name is taken; other columns are not read. Pages
    are read whole, in time that grows with their length. A table in which no page declares a language is rejected as
    a whole; where too few declare each, pages are taken at their word; an empty one gives an empty result."""
    page = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # of the first html tag, found in one step and read in another, so that neither reads a place twice
    page = page.withColumn("declared", F.regexp_extract(F.regexp_extract("html", r"(?i)<html\b([^>]*)", 1), r"(?i)\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))
    model = fit(page, "html", "declared", markup=True)
    rows = written(evidence(page, model, "html", F.col("declared"), F.col("url"), host_of(F.col("url")), ["id", "url"], markup=True))
    out = fused(rows, model.languages).select("id", "url", "lang", "posterior", "accepted")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def known(df: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of df, with all its columns, whose language is told with a posterior of at least ACCEPT.

    The declared language is a column and the source stands for the host; there is no address. Rows without letters
    and those that neither resemble a learned language nor declare one that could not be learned go; a null source has
    the whole table's prior; repeated rows stay or go alike; an empty table gives an empty one; columns may have any
    names. The rows are written once with their evidence, so each text is scored once; then only the small table of
    priors is joined to them."""
    names = df.columns
    own = df.toDF(*[f"_k{i}" for i in range(len(names))])
    text, declared, host = (f"_k{names.index(c)}" for c in (text_col, declared_col, host_col))
    model = fit(own, text, declared)
    rows = written(evidence(own, model, text, F.col(declared), F.lit(None).cast("string"), F.col(host).cast("string"), own.columns))
    return fused(rows, model.languages).filter("accepted").select(*own.columns).toDF(*names)
