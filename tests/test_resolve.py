"""The engine's resolution against the model, on random logs of every entry kind."""

import random

import pytest
from model import aggregate, standard

from cellweave.operators.resolve import resolve
from cellweave.operators.select import Bounds, Read, ValueFilter, ordered, select
from cellweave.plans.compact import compact
from cellweave.schema import CELLS, Family


def log(seed, n, kinds, seqnos):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(kinds)
        out.append((f"r{r.randrange(6)}".encode(), None if kind == 5 else f"q{r.randrange(4)}".encode(), r.randrange(12), seqnos(r, i), i, kind, r.randrange(-50, 50) if kind < 3 else None))
    return out


def frame(spark, entries):
    rows = [(row, "f", q, ts, s, op, kind, "i64" if v is not None else None, None, v, None, None) for row, q, ts, s, op, kind, v in entries]
    return spark.createDataFrame(rows, CELLS)


def found(df):
    return {(bytes(x["row"]), bytes(x["qualifier"]), x["ts"]): x["value_i64"] for x in df.collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("adds", [False, True])
def test_standard_family(spark, seed, adds):
    kinds = [1, 1, 1, 1, 3, 4, 5] + [2, 2] * adds
    entries = log(seed, 400, kinds, lambda r, i: r.randrange(1, 200))
    f = Family("f", ttl_us=4, merge_operator="i64_add" if adds else "")
    got = found(resolve(frame(spark, entries), [f], snapshot=120, now=7))
    assert got == standard(entries, 120, 7, 4, adds)


@pytest.mark.parametrize("kind, fold", [("sum", sum), ("min", min), ("max", max)])
def test_aggregate_family(spark, kind, fold):
    entries = log(7, 500, [2, 2, 2, 2, 2, 1, 3, 4, 5], lambda r, i: i // 3 + 1)
    assert found(resolve(frame(spark, entries), [Family("f", kind)], snapshot=150)) == aggregate(entries, 150, fold)


def test_sums_wrap(spark):
    top = 2**63 - 1
    entries = [(b"r", b"q", 0, 1, 0, 2, top), (b"r", b"q", 0, 2, 0, 2, 1)]
    assert found(resolve(frame(spark, entries), [Family("f", "sum")])) == {(b"r", b"q", 0): -(2**63)}


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_same_at_any_partitioning(spark, parts):
    entries = log(3, 300, [1, 1, 1, 3, 4, 5], lambda r, i: r.randrange(1, 99))
    got = found(resolve(frame(spark, entries).repartition(parts), [Family("f")]))
    assert got == standard(entries)


def test_compaction_changes_no_read(spark):
    entries = log(11, 500, [1, 1, 1, 1, 3, 4, 5], lambda r, i: r.randrange(1, 100))
    cells, f = frame(spark, entries), [Family("f")]
    small = compact(cells, f, oldest=40)
    assert small.count() < cells.count()
    for snapshot in (40, 60, 99, None):
        assert found(resolve(small, f, snapshot)) == found(resolve(cells, f, snapshot))


def test_empty_log(spark):
    cells = spark.createDataFrame([], CELLS)
    for f in (Family("f"), Family("f", "sum"), Family("f", merge_operator="i64_add")):
        assert select(cells, [f], Read(versions=0)).collect() == []


def test_selection_order_of_steps(spark):
    """Time range before version counts; a value predicate looks at the newest version in range."""
    entries = [(b"r", b"q", ts, ts + 1, 0, 1, v) for ts, v in ((1, 10), (2, 20), (3, 30))] + [(b"r", b"z", 1, 9, 0, 1, 5)]
    cells, f = frame(spark, entries), [Family("f")]
    assert found(select(cells, f, Read(time_range=(1, 3)))) == {(b"r", b"q", 2): 20, (b"r", b"z", 1): 5}
    assert found(select(cells, f, Read(versions=0, value_filter=ValueFilter(">=", 30)))) == {(b"r", b"q", 3): 30, (b"r", b"q", 2): 20, (b"r", b"q", 1): 10}
    assert found(select(cells, f, Read(value_filter=ValueFilter("<", 30), column_limit=1))) == {(b"r", b"z", 1): 5}
    assert found(select(cells, f, Read(limit=0))) == {}


def test_bounds(spark):
    cells = frame(spark, [(k, b"q", 1, 1, 0, 1, 1) for k in (b"a", b"ab", b"b\xff", b"b\xff\xff", b"c")])
    f = [Family("f")]

    def rows(b):
        return [bytes(x["row"]) for x in ordered(select(cells, f, Read(rows=b))).collect()]

    assert rows(Bounds.prefix(b"a")) == [b"a", b"ab"]
    assert rows(Bounds.prefix(b"b\xff")) == [b"b\xff", b"b\xff\xff"]
    assert rows(Bounds(b"c", b"a")) == []
    assert rows(Bounds(b"a", b"b\xff", low_open=True, high_open=False)) == [b"ab", b"b\xff"]
    assert len(rows(Bounds.prefix(b""))) == 5


def test_unknown_family(spark):
    with pytest.raises(ValueError):
        select(spark.createDataFrame([], CELLS), [Family("f")], Read(families=("g",)))


def test_folding_compaction_keeps_later_reads(spark):
    """Random logs of integer families: every read from the oldest held number on, and after later writes, is as before."""
    import random

    from cellweave.plans.compact import compact
    from cellweave.schema import INTEGER_KINDS

    r = random.Random(11)
    families = [Family(k, k) for k in INTEGER_KINDS]
    rows = []
    for s in range(1, 161):
        family, kind = r.choice(families).name, r.choices([1, 2, 3, 4, 5], [1, 8, 1, 1, 0.3])[0]
        value = r.randrange(-9, 9) if kind < 3 else None
        rows.append((b"r%d" % r.randrange(2), family, None if kind == 5 else b"q%d" % r.randrange(2), r.randrange(3), s, 0, kind, "i64" if kind < 3 else None, None, value, None, None))
    log = spark.createDataFrame(rows, CELLS)
    for oldest in (60, 110):
        small = compact(log, families, oldest)
        assert small.count() < log.count()
        for snapshot in (oldest, oldest + 25, None):
            want, got = (sorted((bytes(x["row"]), x["family"], bytes(x["qualifier"]), x["ts"], x["seqno"], x["value_i64"]) for x in select(c, families, Read(versions=0, snapshot=snapshot)).collect()) for c in (log, small))
            assert got == want
