import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F
from tessera.llm import queries, simhash


def brute_fp(text):
    words = (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Of a list of (id, fp)."""
    parent = {f: f for _, f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    all_ = list(parent)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in fps:
        least[root(f)].append(i)
    return {(i, f): min(least[root(f)]) for i, f in fps}


def test_fingerprint_matches_the_definition():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 50, 300, 1200]:
        t = "".join(r.choice(["Ab", "c", "É", "日", " ", "\t", "\n ", "\xa0"]) for _ in range(n))
        assert simhash.fingerprint(t) == brute_fp(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_components_match_brute_force(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(40)]
    for base in fps[:12]:  # chains, dense balls and pairs on the limit
        f = base
        for _ in range(12):
            for _ in range(r.choice([1, 2, 3, 4, 4, 5])):
                f ^= 1 << r.randrange(64)
            fps.append(f)
        fps += [base ^ (1 << a) ^ (1 << b) for a in range(0, 20, 5) for b in range(21, 40, 6)]
    for base in fps[12:24]:  # a dense group, and others that only one of its members is near, under keys that it fills
        group = [base ^ (1 << a) ^ (1 << b) for a, b in (r.sample(range(22, 43), 2) for _ in range(25))]
        fps += group
        for member in r.sample(group, 6):
            lone = member
            for at in [*r.sample(range(22), r.choice([1, 2])), *r.sample(range(43, 64), 2)]:
                lone ^= 1 << at
            fps += [lone, lone ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {x.node: x.label for x in simhash.components(simhash.links(nodes)).collect()}
    want = brute_components(list(zip(signed, fps)))
    of = defaultdict(set)
    for s, f in zip(signed, fps):
        of[want[s, f]].add(s)
    for members in of.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(m, m) for m in signed}) == len(of)


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(docs)
    rows = queries.op5_simhash_near_dedup(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.component_id == want[r.doc_id, int(r.fingerprint, 16)] and len(r.fingerprint) == 16


def test_odd_rows_and_keeping_one(spark):
    long = " ".join(f"w{i}" for i in range(400))
    data = [(5, long), (3, long), (3, long), (9, None), (8, ""), (7, " \t"), (1, "alone in the world here"), (2, long + " x"), (None, "other words stand in this row")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in data], "doc_id long, text string, _id string, _n int")
    rows = simhash.cluster(df).collect()
    assert len(rows) == len(data)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {7}
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 5)} == {2}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 7]
    assert simhash.cluster(df.limit(0)).collect() == [] and simhash.keep_one(df.limit(0)).collect() == []
    big = df.union(df.select((F.col("doc_id") + 100), *df.columns[1:]))
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(big).collect()) == [0, 1, 2, 7]


def test_no_join_broadcasts_a_side(spark):
    """Spark takes exploded rows for as few as before, and written tables for as small as their files."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    words = "river stone valley bird green quiet winter road lamp house".split()
    r = random.Random(7)
    texts = [" ".join(r.choices(words, k=30)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t + end for t in texts for end in ("", " end", " and"))], "doc_id long, text string")
    try:
        assert len(simhash.cluster(df).collect()) == 120 and len(simhash.keep_one(df).collect()) <= 120
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        runs = store.executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Join" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)


def test_one_row_of_each_component_whatever_its_id(spark):
    """Against brute force, where ids repeat on unlike texts, are null, or whole rows repeat."""
    r = random.Random(5)
    bases = [" ".join(r.choice("river stone valley bird green quiet winter road lamp house tree cloud".split()) + str(r.randrange(50)) for _ in range(60)) for _ in range(12)]
    texts = [*bases, *(b + " end" for b in bases[:6]), None, "", "  "]
    rows = [(r.choice([None, 5, 5, 6, 7, r.randrange(100)]), r.choice(texts)) for _ in range(90)] + [(5, bases[0]), (5, bases[1]), (5, bases[0])]
    want = set()
    groups = defaultdict(list)
    root = brute_components([(brute_fp(t), brute_fp(t)) for _, t in rows])
    for i, t in rows:
        groups[root[brute_fp(t), brute_fp(t)]].append((i, t))
    least = {g: min((i for i, _ in of if i is not None), default=None) for g, of in groups.items()}
    kept = [(x.doc_id, x.text) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == len(groups)
    for i, t in kept:
        g = root[brute_fp(t), brute_fp(t)]
        want.add(g)
        assert i == least[g] and (i, t) in groups[g]
    assert want == groups.keys()
