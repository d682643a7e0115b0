"""One query for each operator of this subpackage, applied to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Store


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, tokenise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = tokenise(docs, vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, Store(spark, "op1"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "op2"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import without_repeated_strings

    found = without_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "op3"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the text that stays (null text: of the empty one)."""
    from .lines import without_repeated_lines

    found = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "op4"))
    return found.select("row.doc_id", F.col("lines.total").alias("n_lines"), F.col("lines.removed").alias("n_removed"), F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    records = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), Store(spark, "op5"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Store(spark, "op6"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "op7"), width=2, percent=80)


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_words, weight of the source, copies: how often the document is read under the corpus' own budget of words.

    The weights have 0.97 of the largest entropy: flatter than the shares where these are less even, sharper where they are more so.
    """
    from .mixing import plan

    found = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Store(spark, "op8"), target_entropy=0.97, sharpen=True)
    return found.select("row.doc_id", "source", "n_words", F.round("weight", 6).alias("weight"), "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Store(spark, "op9"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), limit=512)


#: Equal texts in DuckDB SQL. regexp_replace works on the same white space as the operator.
OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


#: Records in DuckDB SQL; the archive's name and the members' places, which only the files know, are left out.
OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
     f AS (SELECT page_id, n, h, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h, n) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


#: Mixing in DuckDB SQL: the exponent by bisection, budgets, and the prefix of the permuted blocks and documents that they pay for.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS h
  FROM documents),
src AS (SELECT s, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY s),
p AS (SELECT list(tokens / (SELECT sum(tokens) FROM src)) AS ps FROM src WHERE tokens > 0),
bis AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 64.0::DOUBLE AS high, ps FROM p
  UNION ALL
  SELECT k + 1, CASE WHEN over THEN low ELSE middle END, CASE WHEN over THEN middle ELSE high END, ps
  FROM (SELECT k, low, high, ps, (low + high) / 2 AS middle,
               ln(list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))))
               - (low + high) / 2 * list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) < 0.97 * ln(len(ps)) AS over
        FROM bis WHERE k < 60)),
t AS (SELECT CASE WHEN len(ps) < 2 THEN 1.0 ELSE round(high, 9) END AS t FROM bis WHERE k = 60),
raised AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM src), (SELECT t FROM t)) ELSE 0 END AS r FROM src),
w AS (SELECT s, n_rows, tokens, round(r / (SELECT sum(r) FROM raised), 12) AS weight FROM raised),
want AS (SELECT *, CAST(floor(weight * (SELECT sum(tokens) FROM src) + 0.5) AS BIGINT) AS want, CAST(ceil(n_rows / 1024) AS BIGINT) AS blocks FROM w),
budget AS (SELECT s, weight, blocks, CASE WHEN tokens = 0 THEN 1 ELSE want // tokens END AS passes, CASE WHEN tokens = 0 THEN 0 ELSE want % tokens END AS rest FROM want),
placed AS (SELECT d.*, weight, passes, rest, h % blocks AS block FROM d JOIN budget USING (s)),
b AS (SELECT s, block, rest, sum(n) AS n, CAST('0x' || substr(md5('17:' || s || ':' || block), 1, 13) AS BIGINT) AS o FROM placed GROUP BY s, block, rest),
ends AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY o, block ROWS UNBOUNDED PRECEDING) AS block_end FROM b),
inner_ends AS (
  SELECT placed.*, ends.block_end - ends.n AS before, ends.block_end,
         sum(placed.n) OVER (PARTITION BY placed.s, placed.block ORDER BY h RANGE UNBOUNDED PRECEDING) AS inside
  FROM placed JOIN ends ON placed.s = ends.s AND placed.block = ends.block)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_words, round(weight, 6) AS weight,
       CAST(passes + CASE WHEN before < rest AND (block_end <= rest OR before + inside <= rest) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM inner_ends
"""


def queries() -> dict:
    every = (op1_best_fit_packing, op2_exact_dedup, op3_suffix_array_dedup, op4_line_dedup, op5_warc, op6_embedding_near_dedup, op7_minhash_near_dedup, op8_temperature_mixing, op9_toxicity, op10_token_counts)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_warc": OP5_SQL, "op8_temperature_mixing": OP8_SQL}
