"""Aggregates, graph, vectors, text, writes, tables and feed against plain Python."""

import math
import random
import struct
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.functions import hashing
from cellweave.functions import sketches as S
from cellweave.functions.words import auto_edits, damerau, found_clauses, phrase_count, sloppy_frequency, sloppy_places, snippet, words
from cellweave.operators import aggregates, graph, select, text, vector, write
from cellweave.operators.ivf import Ivf
from cellweave.operators.select import Read
from cellweave.plans.tables import Database
from cellweave.schema import CELLS, Family
from cellweave.sources import jsonl
from cellweave.streaming import feed


def inputs(spark, values, kind, column="value_f64"):
    rows = [(b"r", "f", b"q%d" % (i % 2), 0, i + 1, 0, 2, "f64" if column == "value_f64" else "i64", None, v if column == "value_i64" else None, v if column == "value_f64" else None, None) for i, v in enumerate(values)]
    return aggregates.inputs(spark.createDataFrame(rows, CELLS), [Family("f", kind)])


HARD = [1e300, 1.0, -1e300, 5e-324, 0.1, 0.2, 0.3, -0.0, 1e16, 1.0, -1e16, 2.0**-1060, 3.5, 1e-300]


def test_exact_sums(spark):
    got = {bytes(x["qualifier"]): x["sum"] for x in aggregates.sum_f64(inputs(spark, HARD + [math.inf], "sum_f64")).collect()}
    for k in (0, 1):
        assert got[b"q%d" % k] == math.fsum(HARD[k::2])


def test_exact_moments(spark):
    values = [x for x in HARD if abs(x) < 1e200] + [7.25] * 3
    got = {bytes(x["qualifier"]): x for x in aggregates.mean_var(inputs(spark, values, "mean_var")).collect()}
    for k in (0, 1):
        own = [Fraction(x) for x in values[k::2]]
        n, mean = len(own), sum(own) / len(own)
        spread = sum((x - mean) ** 2 for x in own)
        x = got[b"q%d" % k]
        assert (x["n"], x["mean"], x["var_pop"], x["var_samp"]) == (n, float(mean), float(spread / n), float(spread / (n - 1)))


def test_extrema_order_zeros(spark):
    x = aggregates.extrema_f64(inputs(spark, [0.0, 1.0, -0.0, 1.0, math.nan, 1.0], "min_f64")).where(F.col("qualifier") == F.lit(b"q0")).first()
    assert math.copysign(1, x["least"]) == -1 and math.copysign(1, x["most"]) == 1


def test_histogram(spark):
    values = [-math.inf, 0.0, 9.99, 10.0, math.inf, 1e9, math.nan, -0.0]
    got = aggregates.histogram(inputs(spark, values, "histogram"), [0.0, 10.0]).collect()
    assert sum(sum(x["counts"]) for x in got) == 7
    assert [sum(c) for c in zip(*(x["counts"] for x in got), strict=True)] == [1, 3, 3]
    with pytest.raises(ValueError):
        aggregates.histogram(inputs(spark, [], "histogram"), [1.0, 1.0])


def test_quantiles_and_collapse(spark):
    r = random.Random(1)
    values = [r.choice([-1, 1]) * math.exp(r.uniform(-5, 5)) for _ in range(400)] + [0.0] * 9
    asked = [0, 0.01, 0.25, 0.5, 0.9, 1]
    for most in (2048, 40):
        got = {bytes(x["qualifier"]): x for x in aggregates.quantiles(inputs(spark, values, "quantiles"), asked, max_buckets=most).collect()}
        for k in (0, 1):
            own = values[k::2]
            neg, pos = Counter(), Counter()
            for v in own:
                if v:
                    (pos if v > 0 else neg)[struct.unpack("<Q", struct.pack("<d", abs(v)))[0] >> 45] += 1
            neg, pos = S.collapsed(dict(neg), most), S.collapsed(dict(pos), most)
            assert got[b"q%d" % k]["values"] == [S.quantile_of(neg, own.count(0.0), pos, q) for q in asked]
            if most == 2048:
                for q, v in zip(asked, got[b"q%d" % k]["values"], strict=True):
                    real = sorted(own)[math.floor(q * (len(own) - 1))]
                    assert abs(v - real) <= abs(real) / 128


def test_hll_and_bloom(spark):
    n = 30_000
    values = [i // 3 for i in range(n)]
    rows = inputs(spark, values, "hll", "value_i64")
    for x in aggregates.hll(rows).collect():
        real = len(set(values[int(bytes(x["qualifier"])[1:]) :: 2]))
        assert abs(x["estimate"] - real) / real < 0.05
    assert S.hll_estimate({}) == 0
    assert S.hll_estimate(dict(Counter(S.register(hashing.element_hash(i))[1] for i in range(3)))) == 3
    small = inputs(spark, list(range(60)), "bloom", "value_i64")
    own = aggregates.bloom(small).withColumns({f"has_{i}": aggregates.bloom_contains(i) for i in range(0, 60, 7)}).collect()
    by = {bytes(x["qualifier"]): x for x in own}
    assert all(by[b"q%d" % (i % 2)][f"has_{i}"] for i in range(0, 60, 7))
    want = sorted({p for i in range(0, 60, 2) for p in S.bloom_positions(hashing.element_hash(i), 10, 4)})
    assert by[b"q0"]["bits"] == want


def test_bytes_and_integers_hash_apart():
    assert hashing.element_hash(5) != hashing.element_hash((5).to_bytes(8, "little"))
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_sets_in_commit_order(spark):
    schema = "row binary, family string, qualifier binary, ts bigint, element bigint, added boolean, seqno bigint, op int"
    rows = [(b"r", "f", b"q", 0, e, a, s, 0) for s, (e, a) in enumerate([(1, True), (2, True), (1, False), (3, True), (3, False), (3, True), (4, False)])]
    df = spark.createDataFrame(rows, schema)
    assert aggregates.set_ops(df).first()["members"] == [2, 3]
    base = spark.createDataFrame([(b"r", "f", b"q", 0, e, 3) for e in (7, 8)], "row binary, family string, qualifier binary, ts bigint, element bigint, seqno bigint")
    assert aggregates.set_ops(df, base).first()["members"] == [3, 7, 8]


def test_merge_operator(spark):
    own = aggregates.MergeOperators()
    with pytest.raises(KeyError):
        own.fold(inputs(spark, [], "x"), "nope")


# graph


def brute_walk(edges, seeds, hops, per_node=None, hop_limit=None, most=10**9):
    out = defaultdict(list)
    for a, b in sorted(edges):
        if per_node is None or len(out[a]) < per_node:
            out[a].append(b)
    level, seen = sorted(set(seeds)), set(seeds)
    found = [(n, 0, i, None) for i, n in enumerate(level)]
    for hop in range(1, hops + 1):
        best = {}
        for i, a in enumerate(level):
            for b in out[a]:
                if b not in seen:
                    best.setdefault(b, i)
        new = sorted(best.items(), key=lambda x: (x[1], x[0]))[: min(x for x in (hop_limit, most - len(found), 10**9) if x is not None)]
        level = sorted(n for n, _ in new)
        found += [(n, hop, i, dict(new)[n]) for i, n in enumerate(level)]
        seen |= set(level)
        if not level:
            break
    return sorted(found)


@pytest.mark.parametrize("options", [{}, {"per_node": 2}, {"hop_limit": 3}, {"most": 9}, {"per_node": 3, "hop_limit": 4}])
@pytest.mark.parametrize("few", [0, 100_000])
def test_traverse(spark, options, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(4)
    edges = {(b"n%02d" % r.randrange(40), b"n%02d" % min(39, int(r.expovariate(0.1)))) for _ in range(150)} | {(b"n00", b"n%02d" % i) for i in range(20)}
    seeds = [b"n00", b"n07", b"none"]
    names = {"per_node": "per_node_limit", "hop_limit": "hop_limit", "most": "max_nodes"}
    got = graph.traverse(spark.createDataFrame(sorted(edges), "src binary, dst binary").repartition(3), spark.createDataFrame([(s,) for s in seeds], "node binary"), 3, parents=True, **{names[k]: v for k, v in options.items()})
    rows = sorted((bytes(x["node"]), x["hop"], x["index"], x["parent"]) for x in got.nodes.collect())
    assert rows == brute_walk(edges, seeds, 3, **options)


def test_traverse_resolves_the_frontier_alone(spark):
    """Edges come from a log, deletes applied; only rows of the frontier reach the windows and shuffles that resolve them."""
    log = write.WriteBatch({"out": Family("out")})
    for a, b in ((b"a", b"b"), (b"a", b"c"), (b"b", b"d"), (b"c", b"d"), (b"x", b"y")):
        log.put(a, "out", b, b"")
    cells = log.frame(spark, 1, 100).unionByName(write.WriteBatch(log.families).delete_column(b"a", "out", b"c").delete_row(b"x").frame(spark, 2, 200))
    seeds = spark.createDataFrame([(b"a",), (b"x",)], "node binary")
    edges = graph.edges_from(cells, list(log.families.values()))
    for options in ({}, {"per_node_limit": 1}):
        got = graph.traverse(edges, seeds, 3, parents=True, **options)
        want = graph.traverse(graph.edges_of(select.select(cells, list(log.families.values()))), seeds, 3, parents=True, **options)
        assert sorted(map(tuple, got.nodes.collect())) == sorted(map(tuple, want.nodes.collect())) and got.stats == want.stats
    assert sorted(map(tuple, edges(seeds).collect())) == [(b"a", b"b")]
    said = edges(seeds)._jdf.queryExecution().optimizedPlan().toString()
    assert said.rindex("LeftSemi") > said.rindex("Window" if "Window" in said else "Aggregate")
    with pytest.raises(ValueError):
        graph.edges_from(cells, list(log.families.values()), select.Read(limit=1))


def test_traverse_budget(spark):
    edges = spark.createDataFrame([(b"a", b"n%d" % i) for i in range(9)], "src binary, dst binary")
    got = graph.traverse(edges, spark.createDataFrame([(b"a",)], "node binary"), 3, byte_budget=17 + 4 * 18)
    assert sorted(bytes(x["node"]) for x in got.nodes.collect()) == [b"a", b"n0", b"n1", b"n2", b"n3"]
    assert got.stats["cut_by_budget"] and got.stats["edges"] == 9
    with pytest.raises(ValueError):
        graph.traverse(edges, edges, 65)


# vectors


def test_nearest(spark):
    r = np.random.default_rng(2)
    vec = r.normal(size=(60, 6)).round(1)
    vec[3] = 0
    vec[10] = vec[11]
    rows = [(b"%02d" % i, b"", [float(x) for x in v]) for i, v in enumerate(vec)] + [(b"zz", b"", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "row binary, qualifier binary, value_vec array<float>")
    q = [float(x) for x in r.normal(size=6).round(1)]
    f32 = vec.astype(np.float32).astype(float)
    for metric in ("l2", "ip", "cosine"):
        d = vector._distances(np.array([q]), f32, metric)[0]
        want = [b"%02d" % i for i in sorted((i for i in range(60) if not np.isnan(d[i])), key=lambda i: (round(d[i], 12), i))[:8]]
        got = [bytes(x["row"]) for x in vector.nearest(df, q, 8, metric).collect()]
        assert sorted(got) == sorted(want)
    bits = [sum((a > 0) != (b > 0) for a, b in zip(v, q, strict=True)) for v in f32]
    assert [x["distance"] for x in vector.nearest_bits(df, q, 8).collect()] == sorted(bits)[:8]


def test_ivf(spark):
    r = np.random.default_rng(3)
    vec = np.concatenate([r.normal(c, 0.3, size=(100, 4)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)], "id bigint, vec array<float>")
    index = Ivf.build(df, target=30)
    many = vector.nearest_many(df, df.where("id % 20 = 0"), 10).collect()
    exact = defaultdict(set)
    for x in many:
        exact[x["query"]].add(x["id"])
    everything = {x["id"] for x in index.search([float(x) for x in vec[0]], 10, nprobe=99).collect()}
    assert everything == exact[0]
    hits = sum(len(exact[i] & {x["id"] for x in index.search([float(x) for x in vec[i]], 10, nprobe=4).collect()}) for i in range(0, 300, 60))
    assert hits / 50 >= 0.9
    assert index.verify(df) == {"missing": 0, "stale": 0, "twice": 0}
    assert sum(x["n"] for x in index.rebalanced(60).sizes().collect()) == 300
    assert index.search([0.0] * 4, 5, nprobe=1, keep=F.col("id") >= 290).count() == 5


def test_halves():
    x = np.array([1.0, 1 / 3, 65504.0, -2.5e-8], np.float32)
    assert vector.to_half(x).tolist() == x.astype(np.float16).astype(np.float32).tolist()
    assert vector.to_bfloat(np.array([1.0, 3.0e38, 1.00390625], np.float32)).tolist()[0] == 1.0
    assert vector.to_bfloat(np.array([1.00390625], np.float32))[0] == 1.0  # a tie goes to the even one
    with pytest.raises(OverflowError):
        vector.to_half(np.array([70000.0]))


# text


def test_words():
    assert [w[0] for w in words("Don't stop-the 3.14 naïve e.g. U.S.A. 中文 😀!")][:6] == ["don't", "stop", "the", "3.14", "naïve", "e.g"]
    assert [(t, p) for t, p, _, _ in words("The cat and THE hat", stop_words=True)] == [("cat", 1), ("hat", 4)]
    raw = "é ñandú"
    assert [raw.encode()[a:b].decode().lower() for _, _, a, b in words(raw)] == ["é", "ñandú"]
    assert words("é")[0][0] == "é"


@given(st.text(st.sampled_from("abZ9_ .,':;·-\n\r\t!éΣßİªºǀʰɐ中カא٣😀🇩🇪\u0301\u200d\u00ad\u3000\xa0½"), max_size=16), st.booleans())
@settings(max_examples=400, deadline=None)
def test_words_between_blanks_are_those_of_the_whole(said, stop_words):
    from cellweave.functions.words import STOP_WORDS, _segments

    whole = [(said[a:b].lower(), i, len(said[:a].encode()), len(said[:b].encode())) for i, (a, b) in enumerate(_segments(said))]
    assert words(said, stop_words, None) == [x for x in whole if not (stop_words and x[0] in STOP_WORDS)]


def test_tokens_are_handed_on_in_parts(spark, monkeypatch):
    """A long text, many short ones and none: no batch that a worker makes grows with them."""
    import pyarrow as pa

    monkeypatch.setattr(text, "TOKENS", 8, raising=False)
    seen = {}

    class Held:
        schema = spark.createDataFrame([], "id bigint, t string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            seen["run"] = run

    text.tokenize(Held(), "id", "t")
    texts = ["a b c " * 30, None, "", *["x y"] * 40]
    made = list(seen["run"]([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "t"])]))
    assert max(x.num_rows for x in made) <= 16 and len(made) > 10
    got = [tuple(y.values()) for x in made for y in x.to_pylist()]
    assert got == [(i, *x) for i, t in enumerate(texts) for x in words(t or "")]


def test_verify_counts_both_sides_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "c"), (4, None)], "id bigint, text string")
    index = text.Index.build(spark.createDataFrame([(1, "a b"), (3, "d e")], "id bigint, text string"), "id", "text")
    assert index.verify(df, "id", "text") == {"missing": 2, "stale": 3}
    twice = text.Index(index.docs, index.postings.unionByName(index.postings))
    assert twice.verify(df, "id", "text") == {"missing": 2, "stale": 6}


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_damerau(a, b, most):
    assert damerau(a, b, most) == min(osa(a, b), most + 1)


def test_query_syntax():
    assert text.parse('a "b c"~2 d~ e~2 a f\\~x') == [text.Term("a"), text.Phrase("b c", 2), text.Fuzzy("d"), text.Fuzzy("e", 2), text.Term("f~x")]
    for bad in ('"open', "a~3", '"a~b"', '"a b"~x', "a~1b"):
        with pytest.raises(text.QueryError):
            text.parse(bad)
    assert [auto_edits(x) for x in ("ab", "abc", "abcde", "abcdef")] == [0, 1, 1, 2]


@given(st.lists(st.lists(st.integers(0, 15), min_size=1, max_size=5, unique=True).map(sorted), min_size=2, max_size=3))
@settings(max_examples=200, deadline=None)
def test_sloppy_agrees_with_exact(lists):
    terms = [f"t{i}" for i in range(len(lists))]
    offsets = list(range(len(lists)))
    exact = phrase_count(lists, offsets)
    assert sloppy_frequency(terms, lists, offsets, 0) == exact
    assert sloppy_frequency(terms, lists, offsets, 3) >= exact


def test_snippet():
    t = "aé " * 20 + "needle pin " + "b " * 50
    a = len(("aé " * 20).encode())
    s, e = snippet(t, [(0, 1, 0), (a, a + 6, 1), (a + 7, a + 10, 0)], 24)
    assert e - s <= 24 and "needle pin" in t.encode()[s:e].decode()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    vocabulary = [f"w{chr(97 + i)}" for i in range(24)]
    return [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(24)], k=r.randrange(0, 30)))) for i in range(80)] + [(99, None)]


def brute_bm25(docs, terms):
    own = {i: [w[0] for w in words(t or "")] for i, t in docs}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    out = defaultdict(float)
    for t in terms:
        df = sum(t in x for x in own.values())
        for i, x in own.items():
            tf = x.count(t)
            if tf:
                out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark, corpus):
    df = spark.createDataFrame(corpus, "id bigint, text string")
    index = text.Index.build(df, "id", "text")
    got = [(x["id"], round(x["score"], 9)) for x in index.search("wa wd wz wa", 12).collect()]
    assert got == [(i, round(s, 9)) for i, s in brute_bm25(corpus, ["wa", "wd", "wz"])[:12]]
    assert index.verify(df, "id", "text") == {"missing": 0, "stale": 0}
    smaller = index.without(spark.createDataFrame([(got[0][0],)], "id bigint"))
    assert got[0][0] not in [x["id"] for x in smaller.search("wa wd", 99).collect()]
    fuzzy = {t: b for t, _, b in index.expansions(text.Fuzzy("wab", 1))}
    assert fuzzy["wa"] == 0.5 and set(fuzzy) == {"wa", "wb"}
    more = index.with_documents(spark.createDataFrame([(500, "wq wq wq unique")], "id bigint, text string"), "id", "text")
    assert more.search("unique", 5).first()["id"] == 500


def test_edits_of_characters_or_bytes(spark):
    """A letter of two bytes is one edit of characters, and two of bytes (DuckDB's damerau_levenshtein)."""
    df = spark.createDataFrame([(1, "ention mention éention entioné entino èntion")], "id bigint, text string")
    own = text.Index.build(df, "id", "text")
    asked = text.Fuzzy("ention", 1)
    assert {t for t, _, _ in own.expansions(asked)} == {"ention", "mention", "éention", "entioné", "entino", "èntion"}
    by_bytes = text.Index.build(df, "id", "text", unit="bytes")
    assert {t for t, _, _ in by_bytes.expansions(asked)} == {"ention", "mention", "entino"}
    accents = text.Index.build(spark.createDataFrame([(1, "été éte ètè")], "id bigint, text string"), "id", "text", unit="bytes")
    assert {t for t, _, _ in accents.expansions(text.Fuzzy("étè", 1))} == {"été", "ètè"}
    assert {t for t, _, _ in by_bytes.without(spark.createDataFrame([(9,)], "id bigint")).expansions(asked)} == {"ention", "mention", "entino"}


def test_highlights_agree_with_sql_on_accents(spark, tmp_path):
    import duckdb

    from cellweave.plans import registry

    d = str(tmp_path)
    duckdb.sql("create table t as select * from (values (0::BIGINT, 0::BIGINT, 'user', 'thing éention ention'), (0, 1, 'user', 'of the of entioné mention')) v(conv_id, turn, role, text)", connection=(c := duckdb.connect()))
    c.sql(f"copy t to '{d}/conversations.parquet'")
    c.sql("create view conversations as select * from t")
    for name in ("highlight_clauses", "fuzzy_terms"):
        found = registry.QUERIES[name](spark, d)
        want = c.sql(registry.SQL[name])
        at = [want.columns.index(x) for x in found.columns]
        assert sorted(map(tuple, found.collect())) == sorted(tuple(x[i] for i in at) for x in want.fetchall()), name


def test_parts_rank_as_one_index(spark, corpus):
    df = spark.createDataFrame(corpus, "id bigint, text string")
    asked = 'wa wd~1 "wa wd" "wd wz"~4 none'
    whole = text.Index.build(df, "id", "text")
    parts = [text.Index.build(df.where(F.col("id") % 3 == x), "id", "text") for x in range(3)]
    of = text.Statistics.merged([x.statistics(asked) for x in parts])
    assert of == whole.statistics(asked) and of.terms["none"] == 0 and not of.cut
    want = {x["id"]: x["score"] for x in whole.search(asked, 999).collect()}
    got = {x["id"]: x["score"] for p in parts for x in p.search(asked, 999, statistics=of).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    assert all(abs(got[i] - s) < 1e-9 for i, s in want.items())
    with pytest.raises(ValueError):
        text.Statistics.merged([of, whole.statistics("wa")])
    with pytest.raises(ValueError):
        whole.search("wq", 3, statistics=of)
    with pytest.raises(ValueError):
        text.Statistics.merged([])


def test_merged_expansions_are_cut_again():
    def part(first):
        return text.Statistics(9, 9, {}, {"w~1": (1, [(f"w{i:02}", 1, 1 + i % 2) for i in range(first, first + 40)])})

    found = text.Statistics.merged([part(0), part(20)])
    (edits, near), = found.near.values()
    assert edits == 1 and len(near) == text.EXPANSIONS and found.cut == {"w~1"} and found.docs == 18
    assert near[0] == ("w21", 1, 4) and [x[2] for x in near] == sorted((x[2] for x in near), reverse=True)


def test_highlights_of_every_clause(spark):
    said = "Ünder the big  oak, the OAK fell; oaks by the old, old oak."
    index = text.Index.build(spark.createDataFrame([(1, said), (2, None), (3, "")], "id bigint, text string"), "id", "text")
    hits = spark.createDataFrame([(1, said), (2, None), (3, "")], "id bigint, text string")
    rows = {x["id"]: x for x in index.highlight(hits, "text", 'fell "the oak" "old oak"~2 aok~1 "never seen"', 999).collect()}
    raw = said.encode()
    seen = [(raw[m["start"] : m["end"]].decode(), m["clause"], m["occurrence"]) for m in rows[1]["matches"]]
    assert [x for x in seen if x[1] == 0] == [("fell", 0, 0)]
    assert [x for x in seen if x[1] == 1] == [("the OAK", 1, 0)]
    assert [x[0] for x in seen if x[1] == 2 and x[2] == 0] == ["old", "oak"]
    assert [x for x in seen if x[1] == 3] == [("oak", 3, 0), ("OAK", 3, 1), ("oak", 3, 2)]
    assert not [x for x in seen if x[1] == 4]
    assert rows[1]["snippet"] == said and rows[2]["matches"] == rows[3]["matches"] == [] and rows[2]["snippet"] == ""


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), min_size=2, max_size=3), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_highlighted_phrases_are_the_scored_ones(own, terms, slop):
    lists = [[i for i, x in enumerate(own) if x == t] for t in terms]
    found = found_clauses([(t, i, 2 * i, 2 * i + 1) for i, t in enumerate(own)], [(7, terms, list(range(len(terms))), slop)])
    if not all(lists):
        assert not found
        return
    offsets = list(range(len(terms)))
    if slop:
        places = list(sloppy_places(terms, lists, offsets, slop))
        assert sum(1 / (w + 1) for w, _ in places) == sloppy_frequency(terms, lists, offsets, slop)
        for width, at in places:
            shifts = [p - o for p, o in zip(at, offsets, strict=True)]
            assert max(shifts) - min(shifts) == width <= slop and len(set(at)) == len(at) and [own[p] for p in at] == terms
        assert sorted(found) == sorted((2 * p, 2 * p + 1, 7, i) for i, (_, at) in enumerate(places) for p in at)
    else:
        assert [x[:2] for x in found] == [(2 * i, 2 * (i + len(terms)) - 1) for i in range(len(own)) if own[i : i + len(terms)] == terms]


# writes, tables, feed


def test_batch_and_condition(spark):
    families = {"f": Family("f"), "c": Family("c", "sum"), "q": Family("q", "quantiles")}
    b = write.WriteBatch(families)
    b.put(b"r", "f", b"a", b"one").put(b"r", "f", b"a", b"two").incr(b"r", "c", b"n", 2).incr(b"r", "c", b"n", 3)
    log = b.frame(spark, 1, 100)
    assert log.count() == 3
    own = list(families.values())[:2]
    found = {bytes(x["qualifier"]): (x["value"], x["value_i64"], x["ts"]) for x in select.select(log, own).collect()}
    assert found == {b"a": (bytearray(b"two"), None, 100), b"n": (None, 5, 0)}
    later = log.unionByName(write.WriteBatch(families).delete_row(b"r").frame(spark, 2, 200))
    assert select.select(later, own).count() == 0
    assert write.Condition(b"r", "f", b"a", "value", b"two").holds(log, own)
    assert write.Condition(b"r", "f", b"a", "absent").holds(later, own)
    for bad in (lambda: b.incr(b"r", "c", b"n", 1.5), lambda: b.put(b"r", "f", b"a", "text")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        b.aggregate(b"r", "q", b"x", math.nan)


def test_returning(spark):
    log = write.WriteBatch({"c": Family("c", "sum")})
    frames = [write.WriteBatch(log.families).incr(b"r", "c", b"n", v).frame(spark, s, 0) for s, v in ((1, 5), (2, -2), (3, 10))]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert [(x["previous"], x["current"]) for x in write.returning(rows, [Family("c", "sum")]).orderBy("seqno").collect()] == [(None, 5), (5, 3), (3, 13)]


def test_transact():
    tries = []

    def body():
        tries.append(1)
        if len(tries) < 3:
            raise write.Conflict
        return "done"

    assert write.transact(body) == "done" and len(tries) == 3


def test_database_dump_and_feed(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert db.tables() == []
    families = [Family("f", max_versions=3), Family("c", "sum")]
    db.create_table("t", families)
    assert db.log("t").count() == 0
    with pytest.raises(ValueError):
        db.create_table("t", [])
    by = {f.name: f for f in families}
    for s in range(1, 6):
        db.append("t", write.WriteBatch(by).put(b"r%d" % s, "f", b"q\xff", b"\xfe%d" % s).put(b"r%d" % s, "f", b"x", 1.5 * s).incr(b"r", "c", b"n", s).frame(spark, s, s * 10))
    db.add_family("t", Family("g"))
    assert [f.name for f in db.families("t")] == ["f", "c", "g"] and db.families("t")[0] == families[0]
    assert db.check("t").count() == 0 and db.info().count() == 2
    assert [x["event"] for x in db.catalog_events().collect()] == ["TableCreated", "FamilyAdded", "FamilyAdded", "FamilyAdded"]
    db.backup("t", str(tmp_path / "copy"), snapshot=3)
    assert Database(spark, str(tmp_path / "copy")).spark.read.parquet(str(tmp_path / "copy/cells/t")).count() == 9

    selected = select.select(db.log("t"), families, Read(versions=0))
    jsonl.dump(spark, selected, "t", families, str(tmp_path / "dump"))
    tables, cells = jsonl.load(spark, str(tmp_path / "dump"))
    assert tables == {"t": families}
    key = ["row", "family", "qualifier", "ts", "value_type", "value", "value_i64", "value_f64"]
    assert sorted(map(str, cells.select(*key).collect())) == sorted(map(str, selected.select(*key).collect()))
    assert jsonl.arrow_batches(selected).num_rows == 11

    seen = []
    changed = feed.stream(spark, str(tmp_path / "db/cells/t"), after=0)
    feed.follow(changed, str(tmp_path / "token"), lambda b, n: seen.extend(x["seqno"] for x in b.collect())).awaitTermination()
    assert sorted(seen) == [s for s in range(1, 6) for _ in range(3)] or len(seen) == 15
    db.append("t", write.WriteBatch(by).put(b"r9", "f", b"q", b"v").frame(spark, 6, 60))
    seen.clear()
    feed.follow(feed.stream(spark, str(tmp_path / "db/cells/t")), str(tmp_path / "token"), lambda b, n: seen.extend(x["seqno"] for x in b.collect())).awaitTermination()
    assert seen == [6]
    feed.replicate(feed.stream(spark, str(tmp_path / "db/cells/t")), str(tmp_path / "token2"), str(tmp_path / "replica")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "replica")).count() == 16
    assert [len(x["changes"]) for x in feed.commits(feed.changes(db.log("t"), "t")).orderBy("seqno").collect()] == [3] * 5 + [1]
    with pytest.raises(feed.FeedExpired):
        feed.between(db.log("t"), 1, oldest=5)
    db.drop_table("t")
    assert db.tables() == []


def test_pages_and_budgets(spark):
    rows = [(b"r%d" % (i // 12), "f", b"q%02d" % (i % 12), t, i + 1, 0, 1, "bytes", b"x" * (i % 7), None, None, None) for i in range(48) for t in range(1 + i % 3)]
    own = select.select(spark.createDataFrame(rows, CELLS), [Family("f")], Read(versions=0))
    everything = [(bytes(x["row"]), bytes(x["qualifier"]), x["ts"]) for x in select.ordered(own).collect()]
    for most in (1, 2, 5, 100):
        by = defaultdict(list)
        for x in select.ordered(select.row_pages(own, most)).collect():
            by[bytes(x["row"]), x["page"]].append(bytes(x["qualifier"]))
        assert sum(map(len, by.values())) == len(everything)
        for (_, _), cells in by.items():
            assert len(cells) <= most or len(set(cells)) == 1
    sizes = defaultdict(int)
    for row, _, q, _, *_, value, _, _, _ in rows:
        sizes[row, q] += len(q) + len(value) + 16
    for budget in (0, 20, 100, 500, 10**6):
        spent, last, want = 0, None, set()
        for row, q in sorted(sizes):
            spent += sizes[row, q] + (len(row) if row != last else 0)
            last = row
            if spent > budget:
                break
            want.add((row, q))
        got = {(bytes(x["row"]), bytes(x["qualifier"])) for x in select.within(own, budget).collect()}
        assert got == want
    seen, at = [], None
    while True:
        part = select.ordered(own if at is None else select.after(own, *at)).limit(10).collect()
        if not part:
            break
        full = [(bytes(x["row"]), x["fam"], bytes(x["qualifier"])) for x in part]
        at = full[-1]
        seen += [k for k in dict.fromkeys(full)]
    assert set(seen) == {(r, 1, q) for r, q, _ in everything}


def test_long_texts_are_tokenized_whole(spark):
    """12,000 words keep their last one; over 10,000 distinct terms are refused, as in the reference."""
    long = "again and again " * 4000 + "final"
    df = spark.createDataFrame([(1, long), (2, "final word")], "id bigint, text string")
    assert [(x["id"], x["position"]) for x in text.tokenize(df, "id", "text").where("term = 'final'").orderBy("id").collect()] == [(1, 12_000), (2, 0)]
    assert {x["id"]: x["len"] for x in text.Index.build(df, "id", "text").docs.collect()} == {1: 12_001, 2: 2}
    many = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(10_001)))], "id bigint, text string")
    with pytest.raises(Exception, match="10001 distinct terms, above max_terms 10000"):
        text.tokenize(many, "id", "text").collect()
    assert text.tokenize(many.selectExpr("id", "substring(text, 1, length(text) - 7) AS text"), "id", "text").count() == 10_000


def test_nearest_many_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i * i % 37), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(3)
    whole = sorted(map(tuple, vector.nearest_many(df, df, 3).collect()))
    monkeypatch.setattr(vector, "MOST_QUERIES", 15)
    assert sorted(map(tuple, vector.nearest_many(df, df, 3).collect())) == whole and len(whole) == 120


def brute_narrowest(terms, lists, offsets):
    """The least width over all ways to hold distinct positions."""
    best = math.inf
    for at in product(*lists):
        if all(terms[i] != terms[j] or at[i] != at[j] for i in range(len(at)) for j in range(i)):
            shifts = [p - o for p, o in zip(at, offsets, strict=True)]
            best = min(best, max(shifts) - min(shifts))
    return best


@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=5, unique=True).map(sorted), min_size=2, max_size=4), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_sloppy_finds_the_narrowest_place(lists, slop):
    terms, offsets = [f"t{i}" for i in range(len(lists))], list(range(len(lists)))
    narrowest = brute_narrowest(terms, lists, offsets)
    found = sloppy_frequency(terms, lists, offsets, slop)
    assert (found > 0) == (narrowest <= slop)
    if narrowest <= slop:
        assert found >= 1 / (narrowest + 1)
        assert sloppy_frequency(terms, lists, offsets, narrowest) >= 1 / (narrowest + 1)


@given(st.lists(st.integers(0, 12), min_size=1, max_size=6, unique=True).map(sorted), st.lists(st.integers(0, 12), min_size=1, max_size=4, unique=True).map(sorted), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_sloppy_repeats_hold_positions_of_their_own(own, other, slop):
    terms, offsets = ["a", "b", "a"], [0, 1, 2]
    found = sloppy_frequency(terms, [own, other, own], offsets, slop)
    assert found == 0 or brute_narrowest(terms, [own, other, own], offsets) <= slop
    assert len(own) > 1 or found == 0


def test_sloppy_examples():
    assert sloppy_frequency(["a", "b"], [[0, 10], [1, 13]], [0, 1], 2) == 1 + 1 / 3
    assert sloppy_frequency(["a", "b"], [[0, 1, 2], [3]], [0, 1], 5) == 1
    assert sloppy_frequency(["a", "a"], [[4, 5], [4, 5]], [0, 1], 0) == 1
    assert sloppy_frequency(["a", "a"], [[4], [4]], [0, 1], 9) == 0


def test_returning_after_deletes(spark):
    families = {"c": Family("c", "sum")}

    steps = [
        (write.WriteBatch(families).incr(b"r", "c", b"n", 5), 1), (write.WriteBatch(families).delete_column(b"r", "c", b"n", 0), 2), (write.WriteBatch(families).incr(b"r", "c", b"n", 2), 3),
        (write.WriteBatch(families).delete_row(b"r", 9).incr(b"r", "c", b"n", 3), 4), (write.WriteBatch(families).delete_cell(b"r", "c", b"n", 7), 5), (write.WriteBatch(families).incr(b"r", "c", b"n", 1).incr(b"r", "c", b"n", 1, 7), 6),
    ]
    log = spark.createDataFrame([], CELLS)
    for b, s in steps:
        log = log.unionByName(b.frame(spark, s, 0))
    got = [(x["seqno"], x["ts"], x["previous"], x["current"]) for x in write.returning(log, [families["c"]]).orderBy("seqno", "ts").collect()]
    assert got == [(1, 0, None, 5), (3, 0, None, 2), (4, 0, None, 3), (6, 0, 3, 4), (6, 7, None, 1)]
    now = {x["ts"]: x["value_i64"] for x in select.select(log, [families["c"]], Read(versions=0)).collect()}
    assert now == {0: 4, 7: 1}


def test_conflicts_against_all_pairs(spark):
    r = random.Random(9)
    writes = [(b"r%d" % r.randrange(3), "f", None if r.random() < 0.2 else b"q%d" % r.randrange(3), r.randrange(60)) for _ in range(60)]
    reads = [(i, b"r%d" % r.randrange(4), "f", None if r.random() < 0.3 else b"q%d" % r.randrange(3), s := r.randrange(60), s + r.randrange(1, 6)) for i in range(80)]
    log = spark.createDataFrame([(a, b, c, 0, s, 0, 5 if c is None else 1, None, None, None, None, None) for a, b, c, s in writes], CELLS)
    asked = spark.createDataFrame(reads, "txn int, row binary, family string, qualifier binary, start bigint, commit bigint")
    want = {i for i, a, b, c, s, e in reads if any(a == x and b == y and (c is None or z is None or c == z) and s < n < e for x, y, z, n in writes)}
    assert {x["txn"] for x in write.conflicts(log, asked).collect()} == want


@given(st.integers(0, 999), st.sampled_from(["l2", "ip", "cosine"]), st.integers(1, 6), st.floats(0, 1e6))
@settings(max_examples=60, deadline=None)
def test_k_best_are_the_distances_first(seed, metric, k, offset):
    """By one product and few exact distances: the same as all distances sorted, with ties, far origins and NaN."""
    r = np.random.default_rng(seed)
    vec = r.integers(-2, 3, size=(r.integers(1, 40), 3)).astype(float) + offset
    asked = vec[r.integers(0, len(vec), 5)] + r.choice([0, 1e-7], size=(5, 1))
    vec[r.random(len(vec)) < 0.1] = np.nan
    ids = r.permutation(len(vec))
    d = vector._distances(asked, vec, metric)
    want = [(i, int(ids[j]), d[i, j]) for i in range(5) for j in sorted(np.flatnonzero(~np.isnan(d[i])), key=lambda j: (d[i, j], ids[j]))]
    want = [x for n, x in enumerate(want) if n - next(m for m, y in enumerate(want) if y[0] == x[0]) < k]
    got = list(zip(*[x.tolist() for x in vector.k_best(asked, vec, ids, k, metric)], strict=True))
    assert got == want
    bound = np.array([x[2] for x in want if x[0] == 0][-1:] * 5 or [np.inf] * 5)
    held = vector.k_best(asked, vec, ids, k, metric, bound)
    assert [x for x in zip(*[x.tolist() for x in held], strict=True) if x[0] == 0] == [x for x in want if x[0] == 0]


def test_ivf_files_do_not_grow_with_lists(spark, tmp_path):
    import glob

    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(300)], "id bigint, vec array<float>")
    index = Ivf.build(df, target=1, path=str(tmp_path / "ivf"))
    assert len(index.centroids) == 300 and len(glob.glob(f"{tmp_path}/ivf/**/*.parquet", recursive=True)) < 20
    assert [x["id"] for x in index.search([7.2, 0.0], 2, nprobe=2).collect()] == [7, 8]


def test_ivf_many_and_changes(spark):
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(400, 8)))], "id bigint, vec array<float>")
    index, asked = Ivf.build(df, target=25), df.where("id % 20 = 0")
    true = {(x["query"], x["id"]) for x in vector.nearest_many(df, asked, 5).collect()}
    everything = {(x["query"], x["id"]) for x in index.search_many(asked, 5, 99).collect()}
    assert everything == true
    nprobe = index.tuned(df, asked, 5)
    found = {(x["query"], x["id"]) for x in index.search_many(asked, 5, nprobe).collect()}
    assert len(found & true) >= 0.95 * len(true) and nprobe < len(index.centroids)
    new = spark.createDataFrame([(1000, [9.0] * 8), (3, [-9.0] * 8)], "id bigint, vec array<float>")
    more = index.inserted(new)
    assert [x["id"] for x in more.search([9.0] * 8, 1, 99).collect()] == [1000] and [x["id"] for x in more.search([-9.0] * 8, 1, 99).collect()] == [3]
    assert more.verify(df.where("id <> 3").unionByName(new)) == {"missing": 0, "stale": 0, "twice": 0}
    assert more.deleted(new.select("id")).members.count() == 399
