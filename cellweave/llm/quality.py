"""Document quality rules with cross-document line frequency.

One narrow pass measures each document and hashes its normalised lines (words
joined by one blank, A-Z lower-cased). A line is frequent on a host when it
stands in more distinct documents there than ``max(line_docs, line_share x the
host's distinct documents)``; documents with equal texts are one, so copies of a
document don't make its own lines frequent. Frequent lines are removed (``judge``
counts their words, ``keep_good`` gives the texts without them), and a document
that loses more than ``1 - left`` of its words is depleted and rejected,
as is one that fails the base rules. Lines travel as hashes; counting combines
before the shuffle, so a line or host that a third of all documents share costs
no more than another.

Defined cases: null text has no words and fails the base rules; a null host is a
host of its own; repeated rows are judged each; null ids are kept as they are;
other columns are ignored by ``judge`` and passed through by ``keep_good``; an
empty table gives an empty result. A text of any length is one row, whose words and
lines one task holds; of its lines hashes alone go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, release, slices, staged, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LINE_DOCS = 10
LINE_SHARE = 0.05
LEFT = 0.5
WINDOW = 3


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that are found twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    keys = ids[:n]
    for k in range(1, window):
        if k > 1:  # numbers stay below the square of the words' count
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(number) + ids[k : k + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= twice
    return int(covered.sum())


def line_hash(own: list[bytes]) -> int:
    """Of a line's words, as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(b" ".join(own).lower())
    return h - ((h >> 63) << 64)


def without_lines(text: str, gone: set[int]) -> str:
    """``text`` without the lines of these hashes; lines without words stay."""
    lines = text.encode().split(b"\n")
    return b"\n".join(x for x in lines if not (own := x.split()) or line_hash(own) not in gone).decode()


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines' hashes and words."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    doubles, lines = 0, {}
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            doubles += line in seen
            seen.add(line)
            h = line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), doubles, repeated_words(words), list(lines), list(lines.values())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id long, host string, a long, b long, " + ", ".join(f"{x} long" for x in MEASURES) + ", hashes array<long>, sizes array<long>"


def _measured(rows: DataFrame) -> DataFrame:
    """``rows``: doc_id, host, a, b, text."""

    def run(batches):
        for batch in slices(batches):
            found = list(zip(*map(measure, texts(batch.column(4))), strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], ["doc_id", "host", "a", "b", *MEASURES, "hashes", "sizes"])

    return rows.mapInArrow(run, MEASURED)


def _judged(df: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int, line_share: float, left: float) -> DataFrame:
    """The staged measures with base_failed, removed_words, gone (the frequent lines' hashes; null: none), kept; a and b hash the text."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"), text.alias("text"))
    rows = staged(_measured(rows).withColumn("row", F.monotonically_increasing_id()), "measured")
    # A row for each distinct document and line of a host.
    lines = rows.select("host", "a", "b", F.explode("hashes").alias("h")).distinct()
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    sizes = rows.select("host", "a", "b").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    same = counts["host"].eqNullSafe(sizes["host"])
    often = counts.join(sizes, same).where(F.col("docs") > line_share * F.col("host_docs")).select(counts["host"].alias("at"), F.col("h").alias("line"))
    each = rows.select("row", "host", F.inline(F.arrays_zip("hashes", "sizes")))
    gone = each.join(often, (F.col("hashes") == F.col("line")) & F.col("host").eqNullSafe(F.col("at")))
    gone = gone.groupBy("row").agg(F.sum("sizes").alias("removed_words"), F.collect_list("hashes").alias("gone"))
    out = rows.join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= left * F.col("n_words")))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left: float = LEFT) -> DataFrame:
    """Per row doc_id, the measures, base_failed, removed_words and kept."""
    out = _judged(df, id_col, text_col, host_col, line_docs, line_share, left)
    return out.select("doc_id", *MEASURES, "base_failed", "removed_words", "kept")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left: float = LEFT) -> DataFrame:
    """``df``'s rows that are kept, with all columns; frequent lines are gone from their texts.

    Rejected documents and those with a frequent line alone are looked up: a
    document's verdict and lines depend on its host and text alone. Only texts that
    lose a line go through Python.
    """
    a, b, host, kept, gone = (f"{OWN}{x}" for x in ("a", "b", "host", "kept", "gone"))
    text = F.col(text_col).cast("string")
    found = _judged(df, id_col, text_col, host_col, line_docs, line_share, left).where(~F.col("kept") | F.col("gone").isNotNull())
    found = found.groupBy(F.col("a").alias(a), F.col("b").alias(b), F.xxhash64(F.lit("h"), "host").alias(host)).agg(F.first("kept").alias(kept), F.first("gone").alias(gone))
    keyed = df.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit("b"), text), host: F.xxhash64(F.lit("h"), F.col(host_col).cast("string"))})

    @F.pandas_udf("string")
    def cut(text: pd.Series, gone: pd.Series) -> pd.Series:
        release()
        return pd.Series([None if x is None else without_lines(x, set(y.tolist())) for x, y in zip(text, gone, strict=True)], dtype=object)

    out = keyed.join(found, [a, b, host], "left").where(F.coalesce(kept, F.lit(True)))
    less = cut(F.when(F.col(gone).isNotNull(), text), F.col(gone))
    return out.withColumn(text_col, F.coalesce(less, text)).drop(a, b, host, kept, gone)


#: The op3 query in DuckDB, on the rows of documents.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), lines AS (
  SELECT r, source, t, i, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE n > 0 GROUP BY r
), freq AS (
  SELECT source, norm, count(DISTINCT t) AS docs FROM lines WHERE n > 0 GROUP BY source, norm
), hosts AS (
  SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source
), often AS (
  SELECT freq.source, norm FROM freq JOIN hosts ON freq.source IS NOT DISTINCT FROM hosts.source
  WHERE docs > {line_docs} AND docs > {line_share}::DOUBLE * host_docs
), gone AS (
  SELECT r, sum(n) AS removed_words FROM lines JOIN often ON lines.source IS NOT DISTINCT FROM often.source AND lines.norm = often.norm GROUP BY r
), win AS (
  SELECT r, p, ws[p] AS x, ws[p + 1] AS y, ws[p + 2] AS z
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS p FROM w)
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND n_words - removed_words >= {left}::DOUBLE * n_words AS kept FROM v
""".format(line_docs=LINE_DOCS, line_share=LINE_SHARE, left=LEFT)
