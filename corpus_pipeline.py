"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import lines, minhash, mixing, packing, queries, toxicity
from netloom.store import Store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Store(spark, "pipeline-toxicity"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line makes superfluous go, and with them documents of which nothing else was left."""
    found = lines.without_repeated_lines(docs, Store(spark, "pipeline-lines"))
    emptied = (F.col("lines.removed") > 0) & ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return found.where(~emptied).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words to a shingle, similarity 0.8."""
    return minhash.deduplicated(docs, Store(spark, "pipeline-minhash"), width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights of nine tenths of the largest entropy; the budget is the least that reads every source whole once."""
    return mixing.mixed(docs, Store(spark, "pipeline-mixing"), target_entropy=0.9, cover=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place in it; a document that mixing repeats is packed as often."""
    pieces = packing.tokenise(docs, queries.vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, Store(spark, "pipeline-packing"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = store.cut(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, shingle hashes and a trained model are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
