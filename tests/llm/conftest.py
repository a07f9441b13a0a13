import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHES = ("kept", "size", "fp", "row", "part", "a", "b", "fingerprint", "template", "n", "pos", "host", "root", "node", "total", "target", "length", "bin", "u", "v", "word")


def odd_documents():
    same = "One two three four five six seven eight nine ten.\nA second line of this very document stands here."
    rows = [(None, "a text without an id", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, "   \n\t\n ", "en", "s2"), (4, same, "en", "s1"), (5, same, "en", "s2"), (5, same, "en", "s2"), (6, "word", "en", None)]
    rows += [(7, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "s1"), (8, "x" * 300_000, "en", "s3"), (None, None, None, None), (9, "ÀÉ ñandú — ﬁ 中文 🙂 <|endoftext|>  two  blanks ", "es", "s3")]
    return [(*x, None if x[1] is None else len(x[1])) for x in rows]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_documents(), DOCS)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
