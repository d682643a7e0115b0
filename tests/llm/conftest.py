import pytest
from pyspark.sql import functions as F

#: Nulls in every column, repeated rows, a missing id, white space only, and extra columns with the names that operators use inside.
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 3, "x", 1),
    (2, "The quick  brown fox jumps over\tthe lazy dog near the old river bank today", "en", "a", None, None, 2),
    (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "", 0),
    (5, " \n\t ", "en", "b", 4, "y", 0),
    (6, "single", "en", "b", 6, "y", 0),
    (6, "single", "en", "b", 6, "y", 0),
    (None, "no id at all but some text with enough words to be a line", "en", None, 1, "z", 9),
    (7, "x" * 5000 + " " + "y z " * 3000, "de", "c", 1, "z", 9),
]

CLASHING = "row t th key score lines gone _id _th s h h1 at block members fill done a b keys words n_words copies weight passes rest predicted size".split()


@pytest.fixture
def awkward(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long, id string, n int")
    return rows.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
