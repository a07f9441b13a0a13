"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by id, so file p holds the p-th run
of documents. Each task streams its ids to ``<name>.bin`` (uint16 where the
vocabulary allows, else uint32, little endian) and writes ``<name>.off`` (uint64
offsets inside the file, one more than documents) and ``<name>.doc`` (int64
document ids, nulls first as zeros), batch by batch. A task's files carry a name of
its own attempt; only those that the rows of the attempts that Spark takes name
count, so lost executors and second attempts leave no trace in the result. Partition
bases are prefix sums over these rows (one per file), the manifest, and readers map
the files.

Defined cases: null text is empty (only the end id); null ids sort first and
keep null; repeated ids are kept, ordered by text; an empty table gives an empty
manifest and result; other columns are ignored. A text of any length is one row of a
batch: a task needs some ten times its bytes.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, delete_file, filesystem, list_files, make_dir, readers, shared_dir, slices, small_batches, spread
from .encoders import byte_bpe, model_path

MODEL = "byte_bpe_50k.json"
END_ID = 2
MANIFEST = "pid int, name string, n_docs long, n_null long, n_ids long, width int"
#: Documents encoded at once.
BATCH_ROWS = 1 << 16
#: Rows of a manifest's file.
NAMES = 65_536
#: Documents a reader handles at once.
READ_DOCS = 4096


def write_ids(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """Writes the files below ``folder`` and returns the manifest, with each file's ``base``."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    width = 2 if max(Tokenizer.from_file(model_path(model)).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = f"<u{width}"
    files = f"{folder}/ids"
    make_dir(files)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        pid = context.partitionId()
        name = f"part-{pid:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:12]}"
        fs, top = filesystem(files)
        encoder = byte_bpe(model)
        n_docs = n_ids = nulls = 0
        with contextlib.ExitStack() as files_of:
            out = None
            for batch in slices(batches, BATCH_ROWS, BATCH_BYTES):
                if out is None:
                    out, off, doc = (files_of.enter_context(fs.open_output_stream(f"{top}/{name}{x}")) for x in (".bin", ".off", ".doc"))
                    off.write(bytes(8))
                found = batch.column(0)
                nulls += found.null_count
                ids, ends = encoder.encode_ended(batch.column(1), end_id)
                out.write(ids.astype(kind).tobytes())
                off.write((ends[1:] + n_ids).astype("<u8").tobytes())
                doc.write(found.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_ids = n_docs + batch.num_rows, n_ids + len(ids)
        if not n_docs:
            return
        yield pa.RecordBatch.from_pylist(
            [{"pid": pid, "name": name, "n_docs": n_docs, "n_null": nulls, "n_ids": n_ids, "width": width}],
            pa.schema([("pid", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]),
        )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(spark):
        found = sorted(rows.mapInArrow(run, MANIFEST).collect(), key=lambda x: x["pid"])  # one row per file, of the attempts that Spark takes
    kept = {x["name"] for x in found}
    for path in list_files(files):
        if path.rpartition("/")[2].rpartition(".")[0] not in kept:
            delete_file(path)
    bases = accumulate((x["n_ids"] for x in found), initial=0)
    rows = [(*x, base) for x, base in zip(found, bases, strict=False)]
    spread(spark.createDataFrame(rows, f"{MANIFEST}, base long"), len(rows) // NAMES).write.parquet(f"{folder}/manifest")
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest")


def _mapped(fs, path: str, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    if fs.type_name == "local":
        return np.memmap(path, kind, "r", shape=(n,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, n_files: int) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    files = f"{folder}/ids"
    n_bytes = manifest.agg(F.coalesce(F.sum(F.col("n_ids") * F.col("width")), F.lit(0))).first()[0]

    def run(batches):
        fs, top = filesystem(files)
        for batch in batches:
            for x in batch.to_pylist():
                at = f"{top}/{x['name']}"
                ids = _mapped(fs, f"{at}.bin", f"<u{x['width']}", x["n_ids"])
                offsets = _mapped(fs, f"{at}.off", "<u8", x["n_docs"] + 1).astype(np.int64)
                docs = _mapped(fs, f"{at}.doc", "<i8", x["n_docs"])
                for i in range(0, x["n_docs"], READ_DOCS):
                    j = min(i + READ_DOCS, x["n_docs"])
                    cuts = offsets[i : j + 1]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    null = np.arange(i, j) < x["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[i:j], pa.int64(), mask=null), pa.array(cuts[:-1] + x["base"], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread(manifest, readers(spark, n_files, n_bytes)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """Writes ``df`` (doc_id, text) below the shared folder and reads it back."""
    spark = df.sparkSession
    folder = shared_dir(spark, "ids")
    manifest = write_ids(df, folder, model=model, end_id=end_id)
    return read_ids(spark, folder, manifest, manifest.count())
