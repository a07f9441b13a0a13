"""WARC archives: a deterministic sharded writer, and a reader.

Writing: a record is a response, or a revisit of the record with the same payload
and the smallest id. Payload digests are grouped without payloads, and only the
revisits found come back as small marker rows; these and the records are
range-partitioned and sorted by id and digest together, so payloads move once, are
no sort keys, and a marker stands just before its record. Each task rolls to a new file when the compressed
size passes a limit, computes every header and digest anew, and writes under a
temporary name of its attempt. The manifest rows of the attempts that Spark
takes (a row per file, on the driver) name the files that count; these are renamed to their final names by
shard and roll, and the final manifest is written last. What other attempts left
is deleted. The same rows over the same shards give the same bytes.

Reading: a task per file inflates record after record, checks block and payload
digests, and returns what the headers and the payload say.

Defined cases: a null payload is empty; a null url is an empty target; records
with null ids are responses that nothing revisits, in the first shard; of rows
with equal id and payload the first is the response, and the rest revisit it; an
empty table gives no files and no rows; other columns are ignored. A task holds a
batch of about eight MB, or one record, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, join_hot, list_files, make_dir, readers, shared_dir, slices, small_batches, spread

#: Compressed bytes after which a task starts its next file.
ROLL_BYTES = 64 << 20
LEVEL = 6
#: A fixed capture time, so that archives don't hang on the clock.
DATE = "2024-01-01T00:00:00Z"
SOFTWARE = "cellweave"
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
MANIFEST = "shard int, roll int, name string, records long, bytes long, sha256 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
#: Files that one task renames, about.
RENAMES = 64
#: Compressed bytes read, and records returned, at once.
READ_BYTES = 1 << 20
READ_ROWS = 256


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest} {nth}')}>"


def _clean(value: str) -> str:
    """A header value: no line ends."""
    return " ".join(value.split())


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, nth: int = 0) -> bytes:
    """One record. A revisit has the response's HTTP headers, and no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest, nth)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one task, under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.top = filesystem(folder)
        self.shard, self.roll_bytes, self.own = shard, roll_bytes, uuid.uuid4().hex
        self.made: list[dict] = []
        self.out = None

    def _open(self) -> None:
        self.name = f"{self.own}-{len(self.made)}.tmp"
        self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(f"{self.top}/{self.name}", compression=None), 0, 0, hashlib.sha256()
        info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, 'warcinfo', (self.shard << 20) + len(self.made))}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self._put(head.encode() + info + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member for each record, without a time
        data = squeeze.compress(data) + squeeze.flush()
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(data)
        self.records += 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.made.append({"shard": self.shard, "roll": len(self.made), "name": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()})
            self.out = None


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes archives below ``folder`` and returns the final manifest."""
    spark = pages.sparkSession
    temporary, final = f"{folder}/_temporary", f"{folder}/warc"
    make_dir(temporary)
    make_dir(final)
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    digests = rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= least_bytes)).select("page_id", "digest")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    markers = join_hot(digests, firsts, "digest", pages.count()).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    marked = markers.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit("").alias("url"), F.lit(b"").alias("payload"))
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "payload").unionByName(marked)
    both = both.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")

    def run(batches):
        from pyspark import TaskContext

        out = _Roller(temporary, TaskContext.get().partitionId(), roll_bytes)
        own, refers_to, nth = None, None, 0
        for batch in slices(batches):
            for x in batch.to_pylist():
                page = x["page_id"]
                if (page, x["digest"]) != own:
                    own, refers_to, nth = (page, x["digest"]), None, 0
                if not x["kind"]:
                    refers_to = x["refers_to"]
                    continue
                again = page if nth and page is not None and len(x["payload"]) >= least_bytes else None
                out.add(record(page, x["url"], x["payload"], again if refers_to is None else refers_to, nth))
                nth += 1
        out.close()
        if out.made:
            yield pa.RecordBatch.from_pylist(out.made, pa.schema([("shard", pa.int32()), ("roll", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    with small_batches(spark):
        made = both.mapInArrow(run, MANIFEST).collect()  # one row per file, of the attempts that Spark takes
    committed = spread(spark.createDataFrame(made, MANIFEST), len(made) // RENAMES)

    def rename(batches):
        fs, top = filesystem(folder)
        for batch in batches:
            done = batch.to_pylist()
            for x in done:
                name = f"shard-{x['shard']:06d}-{x['roll']:05d}.warc.gz"
                # A second attempt finds the file in its place already.
                if fs.get_file_info(f"{top}/warc/{name}").type == pa.fs.FileType.NotFound:
                    fs.move(f"{top}/_temporary/{x['name']}", f"{top}/warc/{name}")
                x["name"] = name
            yield pa.RecordBatch.from_pylist(done, batch.schema)

    committed.mapInArrow(rename, MANIFEST).write.parquet(f"{folder}/manifest")
    fs, top = filesystem(temporary)
    if list_files(temporary):  # of attempts that didn't count
        fs.delete_dir_contents(top)
    fs.delete_dir(top)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Stream:
    """Inflated bytes of a file of gzip members, never held whole."""

    def __init__(self, source):
        self.source, self.inflate, self.raw, self.data = source, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.data += self.inflate.decompress(self.raw)
        self.raw = self.inflate.unused_data if self.inflate.eof else b""
        return True

    def upto(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark))
            if not self._more():
                return None
        out = bytes(self.data[:found])
        del self.data[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self._more():
            pass
        if len(self.data) < n:
            raise ValueError("a record is cut off")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def records(source):
    """Headers (lower-cased names) and block of each record of an open archive; digests are checked."""
    stream = _Stream(source)
    while (head := stream.upto(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record ends wrong")
        if (said := headers.get("warc-block-digest")) and said != f"sha1:{base32_sha1(block)}":
            raise ValueError("a block's digest is wrong")
        yield headers, block


def read(spark: SparkSession, folder: str, manifest: DataFrame, n_files: int) -> DataFrame:
    """Per record of a page page_id, payload_bytes, payload_digest, record_type, refers_to, file."""
    n_bytes = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def run(batches):
        fs, top = filesystem(f"{folder}/warc")
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as source:
                    for h, block in records(source):
                        if h["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        if h["warc-type"] == "response" and (base32_sha1(payload) != digest or len(payload) != length):
                            raise ValueError("a payload's digest is wrong")
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        found.append({"page_id": page and int(page), "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": refers and int(refers), "file": name})
                        if len(found) == READ_ROWS:
                            yield pa.RecordBatch.from_pylist(found, kinds)
                            found = []
                yield pa.RecordBatch.from_pylist(found, kinds)

    return spread(manifest, readers(spark, n_files, n_bytes)).mapInArrow(run, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below the shared folder and reads the archives back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    manifest = write(pages, folder)
    return read(spark, folder, manifest, manifest.count())


#: The op1 query in DuckDB, on the rows of pages.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS s, row_number() OVER (PARTITION BY page_id, html) AS nth FROM p
), f AS (
  SELECT s, min(page_id) AS first FROM h GROUP BY s
), b AS (
  SELECT page_id, payload_bytes, first, nth, list_transform(range(40), lambda i: instr('0123456789abcdef', s[i + 1]) - 1) AS x FROM h JOIN f USING (s)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (((x[5 * i // 4 + 1] * 16 + coalesce(x[5 * i // 4 + 2], 0)) >> (3 - 5 * i % 4)) & 31)]), '') AS payload_digest,
       CASE WHEN page_id IS NULL OR (page_id = first AND nth = 1) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NULL OR (page_id = first AND nth = 1) THEN NULL ELSE first END AS refers_to
FROM b
"""
