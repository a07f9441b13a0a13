"""SimHash against brute force."""

import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from cellweave.llm import simhash
from cellweave.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def check(df):
    rows = [(x["doc_id"], brute_fingerprint(x["text"])) for x in df.collect()]
    of = brute_classes({f for _, f in rows})
    first = {}
    for doc, f in rows:
        if doc is not None:
            first[of[f]] = min(first.get(of[f], doc), doc)
    want = sorted((str(d), f"{f:016x}", str(first.get(of[f]))) for d, f in rows)
    assert sorted((str(x["doc_id"]), x["fingerprint"], str(x["component_id"])) for x in simhash.link(df).collect()) == want


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_documents(odd, none):
    check(odd)
    assert simhash.link(none).collect() == []
    assert simhash.drop_copies(none).collect() == []


def test_long_text_in_steps(monkeypatch):
    text = " ".join(f"w{i % 313}" for i in range(4000))
    monkeypatch.setattr(simhash, "STEP", 100)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def planted(seed, n=150):
    """Fingerprints with clusters that share blocks, and chains of near ones."""
    r = random.Random(seed)
    out = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(n // 6):
            x = base
            for b in r.sample(range(64), r.randrange(6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_links_both_ways(spark):
    """Pairs by blocks and crowded buckets by one-bit neighbours give the same classes as brute force."""
    for seed in (1, 2):
        fps = planted(seed)
        want = brute_classes(fps)
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
        for bucket in (1, 3, 32):
            got = {x["node"] % (1 << 64): x["root"] % (1 << 64) for x in components(simhash.links(df, bucket)).collect()}
            classes = {}
            for f in fps:
                classes.setdefault(got.get(f, f), set()).add(f)
            expected = {}
            for f in fps:
                expected.setdefault(want[f], set()).add(f)
            assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {k: got.get(k, k) for k in root} == {k: find(k) for k in root}


def test_one_of_each_class_stays(spark, sf, odd):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        linked = simhash.link(df).collect()
        classes = brute_classes({int(x["fingerprint"], 16) for x in linked})
        kept = simhash.drop_copies(df)
        assert kept.columns == df.columns
        rows = kept.collect()
        assert len(rows) == len(set(classes.values()))
        assert len({classes[brute_fingerprint(x["text"])] for x in rows}) == len(rows)
        smallest = {x["component_id"] for x in linked}
        assert {x["doc_id"] for x in rows if x["doc_id"] is not None} <= smallest


def test_copies_are_caught(spark):
    text = " ".join(f"token{i}" for i in range(400))
    near = text.replace("token399", "changed")
    rows = [(i, text) for i in range(30)] + [(100, near), (200, " ".join(f"other{i}" for i in range(400)))]
    got = {x["doc_id"]: x["component_id"] for x in simhash.link(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("x", F.lit(1))).collect()}
    assert all(got[i] == 0 for i in range(30))
    assert got[200] == 200
