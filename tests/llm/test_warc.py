"""WARC: round trip, determinism, rolling, broken archives, and the contract against brute force."""

import base64
import gzip
import hashlib
import io

import pytest
from checks import same_rows, tables

from cellweave.llm import warc
from cellweave.llm.queries import op1_warc

PAGES = "page_id bigint, url string, html string"
ODD = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (5, "http://c/\r\nX: 1", ""), (7, "u", "same"), (7, "u", "same"), (None, "n", "same"), (None, None, None), (9, "é", "ü" * 200_000), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\n")]


def brute(rows):
    out, seen = [], set()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    for page, _, html in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = page is None or (first[html or ""] == page and (page, html or "") not in seen)
        seen.add((page, html or ""))
        out.append((str(page), len(data), digest, "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out, key=str)


def test_odd_pages(spark):
    df = spark.createDataFrame(ODD, PAGES).withColumnRenamed("x", "y").selectExpr("*", "'c' AS payload", "'d' AS digest", "1 AS kind").repartition(3)
    got = [(str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.archive(df).collect()]
    assert sorted(got, key=str) == brute(ODD)
    assert warc.archive(spark.createDataFrame([], PAGES)).collect() == []


def test_against_sql(spark, sf):
    same_rows(op1_warc(spark, sf), warc.SQL, tables(sf))


def test_same_bytes_again_and_rolls(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    names = []
    for i in range(2):
        manifest = warc.write(pages.repartition(3 + i), f"file://{tmp_path}/{i}", roll_bytes=20_000)
        names.append(sorted((x["name"], x["records"], x["bytes"], x["sha256"]) for x in manifest.collect()))
    assert names[0] == names[1]
    assert len(names[0]) > 4
    assert sum(x[1] for x in names[0]) == pages.count()
    for name, _, size, sha in names[0]:
        data = (tmp_path / "0/warc" / name).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert sorted(x.name for x in (tmp_path / "0/warc").iterdir()) == [x[0] for x in names[0]]
    assert not (tmp_path / "0/_temporary").exists()


def test_broken_archives():
    good = gzip.compress(warc.record(1, "http://a/", b"payload", None))
    assert len(list(warc.records(io.BytesIO(good)))) == 1
    raw = gzip.decompress(good)
    for bad in (raw.replace(b"payload", b"pay1oad"), raw[:-10], raw.replace(b"WARC/1.1", b"HARC/1.1")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(bad))))


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], PAGES)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(df, folder, least_bytes=5)
    got = {x["page_id"]: x["refers_to"] for x in warc.read(spark, folder, manifest, manifest.count()).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
