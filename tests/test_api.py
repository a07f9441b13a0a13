"""The table surface, transactions, pages, and memories' lifecycle."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import memory, text
from cellweave.operators.select import Read
from cellweave.operators.write import Condition, Conflict
from cellweave.plans.api import Table, page
from cellweave.plans.tables import Database
from cellweave.schema import Family


@pytest.fixture
def table(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("t", [Family("f"), Family("c", "sum"), Family("out"), Family("emb")])
    return Table(db, "t")


def test_reads_and_writes(table):
    b = table.batch()
    for i in range(5):
        b.put(b"r%d" % i, "f", b"a", b"v%d" % i).put(b"r%d" % i, "f", b"b", float(i)).put(b"r%d" % i, "emb", b"", [float(i), 0.0]).incr(b"r%d" % i, "c", b"n", i)
        b.put(b"r%d" % i, "out", b"r%d" % ((i + 1) % 5), b"")
    first = table.commit(b, now=10)
    second = table.commit(table.batch().put(b"r1", "f", b"a", b"new").delete_column(b"r2", "f", b"b", 50), now=20)
    assert (first, second, table.snapshot()) == (1, 2, 2)
    assert bytes(table.get(b"r1", "f", b"a").first()["value"]) == b"new"
    assert bytes(table.get(b"r1", "f", b"a", snapshot=1).first()["value"]) == b"v1"
    assert table.row(b"r2", Read(families=("f",))).count() == 1
    assert [bytes(x["row"]) for x in table.scan(b"r1", b"r3", Read(families=("c",))).collect()] == [b"r1", b"r2"]
    assert table.scan_prefix(b"r", Read(families=("f",))).count() == 9
    assert sorted((x["index"], bytes(x["row"])) for x in table.keys([b"r4", b"zz", b"r0"], Read(families=("c",))).collect()) == [(0, b"r0"), (1, b"r4")]
    assert [bytes(x["row"]) for x in table.nearest("emb", [2.2, 0.0], 2).collect()] == [b"r2", b"r3"]
    assert table.nearest("emb", [2.2, 0.0], 2, keys=[b"r0"]).count() == 1
    assert sorted(bytes(x["node"]) for x in table.traverse([b"r0"], "out", 2).nodes.collect()) == [b"r0", b"r1", b"r2"]
    assert table.changes(1).count() == 2
    assert len(table.rows_as_maps().where(F.col("row") == F.lit(b"r1")).first()["cells"]) == 5
    assert table.commit_if(table.batch().put(b"x", "f", b"q", b"1"), Condition(b"r1", "f", b"a", "value", b"old")) is None
    assert table.commit_if(table.batch().put(b"x", "f", b"q", b"1"), Condition(b"x", "f", b"q", "absent")) == 3
    got = table.commit_returning(table.batch().incr(b"r3", "c", b"n", 4)).first()
    assert (got["previous"], got["current"]) == (3, 7)


def test_transactions(table):
    table.commit(table.batch().put(b"a", "f", b"x", 1).put(b"b", "f", b"x", 1))
    one, two, three = table.transaction(), table.transaction(), table.transaction()
    one.get(b"a", "f", b"x")
    two.get_row(b"a")
    three.get(b"b", "f", b"x")
    one.batch.put(b"a", "f", b"x", 2)
    two.batch.put(b"b", "f", b"y", 2)
    three.batch.put(b"b", "f", b"z", 2)
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    three.commit()


def test_chained_pages(table):
    b = table.batch()
    for i in range(12):
        b.put(b"r%d" % (i // 4), "f", b"q%d" % (i % 4), b"x" * i)
    table.commit(b)
    selected = table.select(Read(families=("f",)))
    seen, at, budget = [], None, 60
    while True:
        p = page(selected, budget, at)
        seen += [(bytes(x["row"]), bytes(x["qualifier"])) for x in p.cells.collect()]
        if not p.cut_by_budget:
            break
        at, budget = p.resume, max(60, p.next_bytes)
    assert sorted(seen) == sorted((b"r%d" % (i // 4), b"q%d" % (i % 4)) for i in range(12))
    empty = page(selected, 5)
    assert empty.cells.count() == 0 and empty.cut_by_budget and empty.next_bytes == 2 + 2 + 16


def memories(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, text string, embedding array<float>, importance double, created bigint")
    return memory.memories(df, ns=F.lit("a"), id=F.col("id"), text=F.col("text"), embedding=F.col("embedding"), importance=F.col("importance"), created=F.col("created"), session=F.lit("s"))


NONE = "ns string, src bigint, dst bigint, weight double"


def test_remember(spark):
    old = memories(spark, [(1, "the  cat", [1.0, 0.0], 0.2, 1), (2, "a dog", [0.0, 1.0], 0.5, 2)])
    new = memories(spark, [(3, "the cat ", [1.0, 0.1], 0.9, 3), (4, "nearly the cat", [1.0, 0.01], 0.7, 4), (5, "a bird", [-1.0, 0.3], 0.1, 5)])
    links = spark.createDataFrame([], NONE)
    for near, ids, uses in (("link", [1, 2, 4, 5], 1), ("skip", [1, 2, 5], 1), ("merge", [1, 2, 5], 2)):
        rows, found = memory.remember(old, new, links, near)
        by = {x["id"]: x for x in rows.collect()}
        assert sorted(by) == ids
        assert by[1]["importance"] == 0.9 and by[1]["uses"] == uses and by[2]["uses"] == 0 and by[5]["uses"] == 0
        assert [(x["src"], x["dst"]) for x in found.collect()] == ([(4, 1)] if near == "link" else [])


def test_lifecycle(spark):
    hour = 3_600_000_000
    rows = memories(spark, [(i, f"text {i}", [1.0, i / 100], 0.1 * i, i) for i in range(1, 5)] + [(9, "far", [-1.0, 0.0], 0.9, 9)])
    groups = memory.consolidation_groups(rows, "a", 2 * hour)
    assert {x["id"] for x in groups.collect()} == {1, 2, 3, 4}
    made, marked, links = memory.consolidate(rows, groups, " + ".join, "a", 2 * hour)
    assert made.first()["text"] == "text 1 + text 2 + text 3 + text 4" and made.first()["kind"] == "semantic"
    assert marked.where("consolidated").count() == 4 and links.count() == 4
    everyone = marked.unionByName(made)
    due = memory.due(everyone, 2 * hour + memory.WEEK_US * 50, min_retention=0.01, links=links)
    assert not {x["id"] for x in due.collect()} & {1, 2, 3, 4}
    left, rest = memory.forget(everyone, links, spark.createDataFrame([("a", 1)], "ns string, id bigint"))
    assert left.count() == everyone.count() - 1 and rest.count() == 3
    used = memory.mark_used(rows, spark.createDataFrame([("a", 2), ("a", 2)], "ns string, id bigint"), 77)
    assert [(x["uses"], x["last_used"]) for x in used.where("id = 2").collect()] == [(2, 77)]
    assert memory.supersede(rows, spark.createDataFrame([("a", 3)], "ns string, id bigint")).where("superseded").first()["id"] == 3


def test_recall_filters_and_budget(spark):
    rows = memories(spark, [(i, f"alpha beta {i}", [1.0, i / 10], 0.1, i * 1000) for i in range(1, 9)])
    want = memory.Recall(("a",), 10_000, text="alpha", embedding=(1.0, 0.0), k=5)
    got = memory.recall_hits(rows, want).collect()
    assert len(got) == 5 and got[0]["score"] >= got[-1]["score"]
    assert memory.recall_hits(rows, memory.Recall(("a",), 10_000, text="alpha", k=5, byte_budget=1)).count() == 1
    assert memory.recall_hits(rows, memory.Recall(("a",), 10_000, session="other")).count() == 0
    hidden = memory.supersede(rows, spark.createDataFrame([("a", got[0]["id"])], "ns string, id bigint"))
    assert got[0]["id"] not in [x["id"] for x in memory.recall_hits(hidden, want).collect()]


def test_own_tokenizer(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, "b|c")], "id bigint, text string")

    def cut(x):
        return [(t, i, 0, 0) for i, t in enumerate(x.split("|"))]

    index = text.Index.build(df, "id", "text", tokenizer=cut)
    assert {x["term"]: x["df"] for x in index.terms().collect()} == {"a": 1, "b": 2, "c": 1}
    # Queries, checks and later documents go by the same tokenizer.
    assert [x["id"] for x in index.search([text.Phrase("b|c")], 5).collect()] == [2]
    assert index.verify(df, "id", "text") == {"missing": 0, "stale": 0}
    more = index.with_documents(spark.createDataFrame([(2, "d e|f")], "id bigint, text string"), "id", "text")
    assert {x["term"] for x in more.terms().collect()} == {"a", "b", "d e", "f"}


def test_tokens_sets_vectors_and_ranges(spark):
    import math

    from cellweave.functions.hashing import base32_id
    from cellweave.operators import aggregates, select, vector, write
    from cellweave.operators.select import ValueFilter
    from cellweave.plans.api import position_token, token_position

    at = (b"r\x00\xff", 3, b"q")
    assert token_position(position_token(at)) == at
    with pytest.raises(ValueError):
        token_position(b"\0\0")
    assert sorted(base32_id(bytes([i, 255 - i])) for i in range(256)) == [base32_id(bytes([i, 255 - i])) for i in range(256)]
    families = {"s": Family("s", "set"), "v": Family("v", params={"dim": 2, "element": "f16", "metric": "cosine"}), "f": Family("f")}
    b = write.WriteBatch(families).set_add(b"r", "s", b"q", 5).set_add(b"r", "s", b"q", 6).set_remove(b"r", "s", b"q", 5).put(b"r", "v", b"", [1 / 3, 1.0]).put(b"r", "f", b"a", b"abc").put(b"r", "f", b"b", b"xyz")
    log = b.frame(spark, 1, 9)
    assert aggregates.sets(aggregates.inputs(log, [families["s"]])).first()["members"] == [6]
    got = select.select(log, [families["v"]])
    assert got.first()["value_vec"] == [0.333251953125, 1.0]
    assert vector.nearest_within(vector.nearest(got, [1.0, 1.0], 5), 16).count() == 0
    assert vector.nearest_within(vector.nearest(got, [1.0, 1.0], 5), 17).count() == 1
    assert [bytes(x["qualifier"]) for x in select.select(log, [families["f"]], Read(value_filter=ValueFilter("range", (b"ab", b"b")))).collect()] == [b"a"]
    for bad in ([1.0], [math.nan, 1.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            b.put(b"r", "v", b"", bad)
    with pytest.raises(OverflowError):
        b.put(b"r", "v", b"", [1e6, 1.0])
    with pytest.raises(ValueError):
        write.fitted([200.0], {"element": "i8"})
    with pytest.raises(ValueError):
        b.set_add(b"r", "s", b"q", -1)


def test_near_duplicates_of_several_dimensions(spark):
    """Each dimension is compared with itself; superseded memories, zeros and NaN with none."""
    rows = [(i, "x", [1.0, 0.0], 0.1, i) for i in range(1, 7)] + [(10 + i, "x", [0.0, 1.0, 0.0], 0.1, 10 + i) for i in range(6)] + [(20, "x", [0.0, 0.0], 0.1, 20), (21, "x", [float("nan"), 1.0], 0.1, 21), (22, "x", None, 0.1, 22)]
    df = memories(spark, rows)
    got = sorted((x["id"], x["of"]) for x in memory.near_duplicates(df).collect())
    assert got == [(i, 1) for i in range(2, 7)] + [(10 + i, 10) for i in range(1, 6)]
    hidden = memory.supersede(df, spark.createDataFrame([("a", 1)], "ns string, id bigint"))
    assert (3, 2) in [(x["id"], x["of"]) for x in memory.near_duplicates(hidden).collect()]
    assert 1 not in [x["of"] for x in memory.near_duplicates(hidden).collect()]
    assert memory.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("similarity", [0.7, 0.85, 0.95])
def test_recall_of_near_duplicates(spark, similarity):
    import numpy as np

    r = np.random.default_rng(5)
    base = r.normal(size=(150, 16))
    vec = np.concatenate([base, base + r.normal(size=base.shape) * 0.6 * np.tan(np.arccos(similarity))]).astype(np.float32)
    df = memories(spark, [(i, "x", [float(x) for x in v], 0.1, i) for i, v in enumerate(vec)])
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    near = np.tril(unit @ unit.T, -1)
    want = {i for i in range(len(vec)) if (near[i] >= similarity).any()}
    got = {x["id"] for x in memory.near_duplicates(df, similarity).collect()}
    assert len(want) > 30 and got <= want and len(got) >= 0.99 * len(want)


def test_near_duplicates_in_parts_of_buckets(spark, monkeypatch):
    """Buckets hand on one row a memory, not pairs, and a large one's parts find the same; multiples are equally near, so the oldest counts."""
    import numpy as np

    r = np.random.default_rng(8)
    base = np.repeat(r.normal(size=(6, 8)), 20, axis=0) * r.choice([1.0, 2.0, 4.0], size=(120, 1))
    vec = (base + np.where(np.arange(120)[:, None] % 2, r.normal(size=base.shape) * 0.02, 0)).astype(np.float32)
    df = memories(spark, [(i, "x", [float(x) for x in v], 0.1, i) for i, v in enumerate(vec)])
    whole = sorted(map(tuple, memory.near_duplicates(df, 0.9).collect()))
    assert len(whole) == 114
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    near = np.where(np.tril(np.ones((120, 120)), -1) > 0, unit @ unit.T, -1)
    assert all(abs(s - near[i].max()) < 1e-9 and near[i, of] > near[i].max() - 1e-9 for _, i, of, s in whole)
    monkeypatch.setattr(memory, "PART", 7)
    monkeypatch.setattr(memory, "STEP", 4)
    found = memory.near_duplicates(df, 0.9)
    assert sorted(map(tuple, found.collect())) == whole
    # Vectors are dealt once to each bucket and never joined to pairs.
    said = found._jdf.queryExecution().optimizedPlan().toString()
    assert "of_embedding" not in said and "FlatMapGroupsInArrow" in said


def brute_groups(rows, similarity, least, most):
    """rows: session, id, created, unit vector. Greedy groups of each session, newest seed first."""
    out = []
    for session in sorted({x[0] for x in rows}):
        left = sorted((x for x in rows if x[0] == session), key=lambda x: (-x[2], x[1]))
        while left:
            seed = left[0]
            group = [seed] + [x for x in left[1:] if sum(a * b for a, b in zip(x[3], seed[3], strict=True)) >= similarity][: most - 1]
            left = [x for x in left if x not in group]
            if len(group) >= least:
                out.append((seed[2], seed[1], sorted(x[1] for x in group)))
    return [(i, own) for _, i, own in sorted(out, key=lambda x: (-x[0], x[1]))]


def test_consolidation_in_passes(spark):
    import math
    import random

    r = random.Random(3)
    rows = []
    for i in range(120):
        a = r.uniform(0, 2 * math.pi)
        rows.append((f"s{r.randrange(4)}", i, r.randrange(50), (math.cos(a), math.sin(a))))
    df = spark.createDataFrame([(s, i, c, list(v)) for s, i, c, v in rows], "session string, id bigint, created bigint, embedding array<float>")
    df = memory.memories(df, ns=F.lit("a"), id=F.col("id"), text=F.lit("x"), embedding=F.col("embedding"), created=F.col("created"), session=F.col("session"))
    want = brute_groups(rows, 0.9, 2, 5)

    def listed(found):
        by = {}
        for x in found.collect():
            by.setdefault(x["grp"], []).append(x["id"])
        return {k: sorted(v) for k, v in by.items()}

    options = {"min_age": 0, "similarity": 0.9, "least": 2, "most": 5}
    assert listed(memory.consolidation_groups(df, "a", 100, **options)) == dict(want)
    first, resume = memory.consolidation_pass(df, "a", 100, groups=20, **options)
    assert listed(first) == dict(want[:20]) and resume == (next(x[2] for x in rows if x[1] == want[19][0]), want[19][0])
    # Passes over few memories: chained, they reach every one, and no group is larger than asked.
    seen, at, n = [], None, 0
    while True:
        found, at = memory.consolidation_pass(df, "a", 100, after=at, groups=2, **options)
        groups = listed(found)
        assert len(groups) <= 2 and all(2 <= len(x) <= 5 for x in groups.values())
        seen += [i for x in groups.values() for i in x]
        n += 1
        if at is None:
            break
        assert n < 60
    assert len(set(seen)) > 60
    side = [i for x in listed(memory.consolidation_groups(df, "a", 100, groups=2, **options)).values() for i in x]
    assert len(side) == len(set(side)) > 60


def test_two_writers_race(spark, tmp_path):
    """Of two writers that saw the same state one commits first; the other's conflict is found, or its number is the next."""
    path = str(tmp_path / "db")
    Database(spark, path).create_table("t", [Family("f")])
    one, two = Table(Database(spark, path), "t"), Table(Database(spark, path), "t")
    one.commit(one.batch().put(b"a", "f", b"x", 1))
    a, b = one.transaction(), two.transaction()
    a.get(b"a", "f", b"x")
    b.get(b"a", "f", b"x")
    a.batch.put(b"a", "f", b"x", 2)
    b.batch.put(b"a", "f", b"x", 3)
    raced, publish = [], two.db.publish

    def late(after, **record):
        if not raced:
            raced.append(a.commit())  # lands between the other's check and its record
        return publish(after, **record)

    two.db.publish = late
    with pytest.raises(Conflict):
        b.commit()
    assert raced == [2] and two.get(b"a", "f", b"x").first()["value_i64"] == 2
    two.db.publish = publish
    raced.clear()
    two.db.publish = lambda after, **record: (raced or raced.append(one.commit(one.batch().put(b"b", "f", b"x", 1)))) and publish(after, **record) or publish(after, **record)
    assert two.commit(two.batch().put(b"c", "f", b"x", 1)) == 4 and raced == [3]
    assert sorted(x["seqno"] for x in one.log.select("seqno").collect()) == [1, 2, 3, 4]


def test_unpublished_entries_are_not_read(table):
    table.commit(table.batch().put(b"a", "f", b"x", 1))
    table.db.write("t", table.batch().put(b"b", "f", b"x", 1).frame(table.db.spark, 2, 0))
    assert table.log.count() == 1 and table.snapshot() == 1


def test_commit_over_tables_and_feed(spark, tmp_path):
    from cellweave.plans.api import commit_all
    from cellweave.streaming import feed

    db = Database(spark, str(tmp_path / "db"))
    for name in ("t", "u"):
        db.create_table(name, [Family("f"), Family("g")])
    t, u = Table(db, "t"), Table(db, "u")
    for i in range(3):
        commit_all(db, {"t": t.batch().put(b"r%d" % i, "f", b"x", i).put(b"r%d" % i, "g", b"y", i), "u": u.batch().put(b"s%d" % i, "g", b"x", i)}, now=10)
    db.add_family("t", Family("h"))
    got = []

    def sink(batch, events, n):
        got.append((n, [(x["n"], x["seqno"], x["table"], x["family"], bytes(x["row"])) for x in batch.collect()], events))

    feed.follow_commits(db, str(tmp_path / "at"), sink, most=1).awaitTermination()
    assert [n for n, _, _ in got] == [1, 2, 3, 4, 5, 6]
    assert [len(x) for _, x, _ in got] == [0, 0, 3, 3, 3, 0] and got[5][2] == [(6, "FamilyAdded", "t")]
    assert sorted(x[2:] for x in got[3][1]) == [("t", "f", b"r1"), ("t", "g", b"r1"), ("u", "g", b"s1")]
    t = Table(db, "t")
    t.commit(t.batch().put(b"q", "h", b"z", 5), now=20)
    got.clear()
    feed.follow_commits(db, str(tmp_path / "at"), sink).awaitTermination()
    assert [(n, len(x)) for n, x, _ in got] == [(7, 1)]
    changed, events, token = feed.after_token(db, 4)
    assert changed.count() == 4 and token == 7 and events == [(6, "FamilyAdded", "t")]
    assert feed.after_token(db, token)[0].count() == 0


def test_feed_order_when_clocks_differ(spark, tmp_path):
    """Records' files have rising times, whatever the clock says, so a feed of single commits gets them in order."""
    import os

    from cellweave.streaming import feed

    db = Database(spark, str(tmp_path / "db"))
    db.create_table("t", [Family("f")])
    first = tmp_path / "db/commits" / f"{1:020d}.json"
    ahead = first.stat().st_mtime_ns + 60 * 10**9
    os.utime(first, ns=(ahead, ahead))
    for name in "ghi":
        db.add_family("t", Family(name))
    times = [x.stat().st_mtime_ns // 10**6 for x in sorted((tmp_path / "db/commits").glob("0*.json"))]
    assert len(times) == 4 and times == sorted(set(times))
    got = []
    feed.follow_commits(db, str(tmp_path / "at"), lambda _, events, n: got.append(n), most=1).awaitTermination()
    assert got == [1, 2, 3, 4]


def test_held_snapshots_and_compaction(table):
    from cellweave.streaming import feed

    for i in range(4):
        table.commit(table.batch().put(b"a", "f", b"x", i, ts=5).incr(b"a", "c", b"n", 1), now=5)
        if i == 1:
            assert table.db.hold("keep") == 2
    before = table.log.count()
    assert table.db.compact("t") == 2 and table.log.count() < before
    assert table.get(b"a", "f", b"x", snapshot=2).first()["value_i64"] == 1 and table.get(b"a", "f", b"x").first()["value_i64"] == 3
    assert table.changes(2).count() == 4
    with pytest.raises(feed.FeedExpired):
        table.changes(1)
    table.db.release("keep")
    assert table.db.compact("t") == 4 and table.db.held() == {}
    assert table.get(b"a", "f", b"x").first()["value_i64"] == 3 and table.get(b"a", "c", b"n").first()["value_i64"] == 4
    assert len(table.db.folders("t")) == 1
