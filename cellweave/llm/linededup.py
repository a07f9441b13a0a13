"""Line dedup by a log-template tree, in DataFrame functions alone.

A line's tokens are what stands between blanks; tokens with a digit are variable
from the start and read ``<*>``. The tree has fixed depth: token count, then the
first ``LEADING`` tokens; together they name a leaf. Inside a leaf a token stays
constant where ``docs`` documents or more have it at its position, else the field
is generalised to ``<*>``; a line of which fewer than ``SIMILAR`` of the tokens
stay constant is a template of its own, word for word (so rows of mere numbers
aren't all alike). Templates that ``docs`` distinct texts or
more share are recurring and are dropped from every document but the first
(smallest id) that has one.

``passage`` (off in the op4 query, whose SQL has templates alone) drops long lines
too: one of that many tokens or more that stands, blanks aside, word for word in
two distinct texts goes from every document but the first that has it.

Plan: lines are first reduced to hashes (no text). Only lines whose leaf enough
documents share, found through a broadcast of at most BUCKETS leaf buckets, are
read again, once for each distinct line; positions, supports and templates are
hash aggregations with partial sums, so a line that a third of all documents
hold is one row. Texts move only in the last join.

Defined cases: null texts stay null, empty lines stay; equal rows (same id and
text) are one document and all treated alike; documents with equal texts count
once; a null id sorts before all others; extra columns pass through; an empty
table gives no rows. A text of any length is one row until it is cut into lines, and
again in the last join, where each of its lines is looked up among the dropped ones:
its time there grows with its lines times its dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, staged

LEADING = 3
DOCS = 20
SIMILAR = 0.5
#: Tokens of a passage, a line that two texts may not share, in the pipeline.
PASSAGE = 50
FIELD = "<*>"
#: Leaf buckets that are broadcast at most.
BUCKETS = 1 << 16
HELD = ("doc_id", "a", "b", "content", "pos", "template")
#: White space inside a line, beside the blank.
BLANKS = "\t\x0b\f\r"


def _masked(line: Column) -> Column:
    """``line``: trimmed, white space as blanks. Tokens joined by one blank, those with a digit as FIELD.

    Most lines have neither digits nor blanks in a row; they skip the patterns.
    """
    line = F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " {2,}", " ")).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(line)


def _lines(df: DataFrame, id_col: str, text_col: str, passage: int | None = None) -> DataFrame:
    """doc_id, a, b (hashes of id and text), content (of the text), pos, masked, raw (hash), leaf, sig of each line that has tokens; with ``passage`` also same (hash; null: fewer tokens)."""
    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit("b"), text, id_col).alias("b"),
        F.xxhash64(text).alias("content"), F.posexplode(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), "\n")).alias("pos", "line"),
    )
    rows = docs.withColumn("line", F.trim("line")).where("line <> ''").withColumns({"masked": _masked(F.col("line")), "raw": F.xxhash64("line")})
    tokens = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    if passage is not None:
        rows = rows.withColumn("same", F.when(tokens + 1 >= passage, F.xxhash64(F.lit("same"), F.regexp_replace("line", " {2,}", " "))))
    rows = rows.drop("line")
    return rows.withColumns({"leaf": F.xxhash64(tokens, F.substring_index("masked", " ", LEADING)), "sig": F.xxhash64("masked")})


def _templates(lines: DataFrame, often: DataFrame, docs: int) -> DataFrame:
    """``lines``: with their masked text, in buckets of ``often`` leaves. Per leaf and sig its template (a hash; null: the line itself)."""
    held = lines.join(often, "leaf", "left_semi").select("leaf", "sig", "content", "masked")
    one = held.groupBy("leaf", "sig", "content").agg(F.first("masked").alias("masked"))
    one = staged(one.groupBy("leaf", "sig").agg(F.count("*").alias("n"), F.first("masked").alias("masked")), "lines")
    each = one.select("leaf", "sig", "n", F.posexplode(F.split("masked", " ")).alias("p", "token"))
    support = each.groupBy("leaf", "p", "token").agg(F.sum("n").alias("s")).where(F.col("s") >= docs)
    marked = each.join(support, ["leaf", "p", "token"], "left").withColumn("constant", F.col("s").isNotNull())
    fields = F.when(F.col("constant"), F.xxhash64("p", "token")).otherwise(F.xxhash64("p", F.lit(FIELD)))
    # A template's hash is the sum of its fields' hashes, so fields needn't be gathered; the leaf gives their number.
    total = F.sum(fields.cast("decimal(38,0)"))
    made = marked.groupBy("leaf", "sig").agg(total.alias("total"), F.avg((F.col("constant") & (F.col("token") != FIELD)).cast("double")).alias("constant"))
    return made.select("leaf", "sig", F.when(F.col("constant") >= SIMILAR, F.xxhash64("leaf", "total")).alias("template"))


def recurring(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = DOCS, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged lines without texts, and which of them go: a, b, pos of each."""
    lines = _lines(df, id_col, text_col, passage)
    short = staged(lines.drop("masked"), "leaves")
    often = short.select("leaf", "content").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= docs)
    often = staged(often.select("leaf"), "often")
    bucket = F.pmod("leaf", F.lit(BUCKETS)).cast("int")
    buckets = F.broadcast(often.select(bucket.alias("bucket")).distinct())
    near = lines.join(buckets, bucket == F.col("bucket"), "left_semi")
    named = staged(_templates(near, often, docs), "templates")
    held = short.join(named, ["leaf", "sig"]).withColumn("template", F.coalesce("template", F.xxhash64("leaf", "raw")))
    gone = _later(staged(held.select(*HELD), "held"), docs)
    if passage is not None:
        gone = gone.union(_later(staged(short.where("same IS NOT NULL").withColumn("template", F.col("same")).select(*HELD), "passages"), 2))
    return short, gone


def _later(held: DataFrame, docs: int) -> DataFrame:
    """``held``: HELD. a, b, pos of what ``docs`` texts or more share, but in the first document."""
    texts = held.groupBy("template", "content").agg(F.min(F.struct("doc_id", "a", "b")).alias("first"))
    shared = texts.groupBy("template").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= docs)
    return held.join(staged(shared.drop("n"), "shared"), "template").where(~((F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b")))).select("a", "b", "pos")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = DOCS, passage: int | None = None) -> DataFrame:
    """``df`` with recurring lines dropped from ``text_col``, and n_lines, n_dropped (lines with tokens; of them dropped) as ``__cw_`` columns."""
    a, b = f"{OWN}a", f"{OWN}b"
    short, gone = recurring(df, id_col, text_col, docs, passage)
    lost = gone.groupBy("a", "b").agg(F.collect_set("pos").alias(f"{OWN}pos")).withColumnsRenamed({"a": a, "b": b})
    held = short.groupBy("a", "b").agg(F.countDistinct("pos").cast("long").alias(f"{OWN}n_lines")).withColumnsRenamed({"a": a, "b": b})
    text = F.col(text_col).cast("string")
    keyed = df.withColumns({a: F.xxhash64(id_col, text), b: F.xxhash64(F.lit("b"), text, id_col)})
    out = keyed.join(held.join(lost, [a, b], "left"), [a, b], "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(f"{OWN}pos", i)), "\n")
    out = out.withColumns({text_col: F.when(F.col(f"{OWN}pos").isNull(), text).otherwise(left), f"{OWN}n_lines": F.coalesce(f"{OWN}n_lines", F.lit(0).cast("long")), f"{OWN}n_dropped": F.coalesce(F.size(f"{OWN}pos"), F.lit(0)).cast("long")})
    return out.select(*[F.col(f"`{x}`") for x in df.columns], f"{OWN}n_lines", f"{OWN}n_dropped")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = DOCS) -> DataFrame:
    """Per row doc_id, text (without recurring lines), n_lines, n_dropped."""
    out = drop_lines(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), docs=docs)
    return out.withColumnsRenamed({f"{OWN}n_lines": "n_lines", f"{OWN}n_dropped": "n_dropped"})


#: The op4 query in DuckDB, on the rows of documents.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), e AS (
  SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), l AS (
  SELECT *, string_split(masked, ' ') AS tok FROM (
    SELECT *, regexp_replace(regexp_replace(raw, ' +', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked
    FROM (SELECT r, doc_id, text, i, trim(regexp_replace(line, '[\t\x0B\f\r]', ' ', 'g')) AS raw FROM e)
  ) WHERE masked <> ''
), k AS (
  SELECT *, len(tok) AS n, array_to_string(tok[1:{leading}], ' ') AS lead FROM l
), leaf AS (
  SELECT n, lead FROM k GROUP BY n, lead HAVING count(DISTINCT text) >= {docs}
), one AS (
  SELECT n, lead, masked, tok, count(DISTINCT text) AS c FROM k SEMI JOIN leaf USING (n, lead) GROUP BY n, lead, masked, tok
), each AS (
  SELECT n, lead, masked, c, unnest(tok) AS token, generate_subscripts(tok, 1) AS p FROM one
), sup AS (
  SELECT n, lead, p, token FROM each GROUP BY n, lead, p, token HAVING sum(c) >= {docs}
), made AS (
  SELECT n, lead, masked, string_agg(CASE WHEN sup.p IS NULL THEN '<*>' ELSE each.token END, ' ' ORDER BY each.p) AS template, avg((sup.p IS NOT NULL AND each.token <> '<*>')::INT) AS share
  FROM each LEFT JOIN sup USING (n, lead, p, token) GROUP BY n, lead, masked
), named AS (
  SELECT n, lead, masked, CASE WHEN share >= {similar} THEN 't' || template END AS template FROM made
), held AS (
  SELECT r, doc_id, text, i, coalesce(template, 'r' || raw) AS template, n, lead FROM k JOIN named USING (n, lead, masked)
), shared AS (
  SELECT n, lead, template, min(coalesce(doc_id, -9223372036854775808)) AS first FROM held GROUP BY n, lead, template HAVING count(DISTINCT text) >= {docs}
), gone AS (
  SELECT r, i FROM held JOIN shared USING (n, lead, template) WHERE coalesce(doc_id, -9223372036854775808) <> first
), counts AS (
  SELECT r, count(*) AS n_lines FROM k GROUP BY r
), lost AS (
  SELECT r, count(*) AS n_dropped FROM gone GROUP BY r
), kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM e ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN counts USING (r) LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
""".format(leading=LEADING, docs=DOCS, similar=SIMILAR)
