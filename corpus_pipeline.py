"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last return the columns of
documents; where a stage changes a text, ``n_chars`` follows.

1. quality_rules: documents that fail the base rules, or that frequent lines
   deplete, go; the others lose their frequent lines.
2. line_dedup: recurring line templates, and passages (lines of 50 tokens or more)
   that two texts share, go from every document but the first that has one; documents of which nothing is left go.
3. near_dedup: one document of each group of near copies stays.
4. mixing: sources come to their target weights; a document stands once for each
   whole pass, and once more with the words of picked blocks.
5. packing: every document of the mix, as pieces placed in sequences.

Null texts fail the base rules; tables may be empty; columns beside those of
documents pass through the first four stages. Of rows with equal id and text one is
left after near_dedup; of equal texts with several ids the smallest id stays. A text of
any length is one row of every stage; the last cuts it into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import linededup, mixing, packing, quality, simhash
from cellweave.llm.common import documents, staged
from cellweave.plans.ship import ship


#: Words that a worker of the last stage remembers, and bytes of texts it encodes together: its executor still holds what the stages before it took.
PACKING_WORDS, PACKING_BYTES = 100_000, 2 << 20


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` set anew, where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _counted(quality.keep_good(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = linededup.drop_lines(docs, passage=linededup.PASSAGE)
    lines, dropped = F.col(f"{linededup.OWN}n_lines"), F.col(f"{linededup.OWN}n_dropped")
    left = out.where((dropped == 0) | (dropped < lines))
    return _counted(left.select(*[F.col(f"`{x}`") for x in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_copies(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _counted(mixing.draw(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, words=PACKING_WORDS, at_once=PACKING_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_weights),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash needs XXH64, which SQL hasn't; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
