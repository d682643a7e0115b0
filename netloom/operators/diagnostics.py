"""What embeddings say about candidates: ranks, top-k accuracy, gaps, correlations, norms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm


def rank_of_nearest(scored: DataFrame) -> DataFrame:
    """scored(g1_id, g2_id, distance, similarity) to (g1_id, g2_id, rank): the rank by similarity of the spatially nearest candidate."""
    w = Window.partitionBy("g1_id").orderBy(F.desc("similarity"), "g2_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("g1_id").agg(F.min(F.struct("distance", "g2_id", "rank")).alias("m")).select("g1_id", "m.g2_id", "m.rank")


def top_k_accuracy(ranks: DataFrame, up_to: int = 20) -> DataFrame:
    """(k, accuracy): the share of ranks up to k."""
    ks = ranks.groupBy("rank").agg(F.count("*").alias("c"))
    total = ks.agg(F.sum("c").alias("n"))
    each = ks.select("c", F.explode(F.when(F.col("rank") <= up_to, F.sequence(F.col("rank"), F.lit(up_to)))).alias("k")).groupBy("k").agg(F.sum("c").alias("hits"))
    grid = total.select("n", F.explode(F.sequence(F.lit(1), F.lit(up_to))).alias("k"))
    return grid.join(F.broadcast(each), "k", "left").select("k", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("accuracy"))


def discrimination_gap(scored: DataFrame) -> DataFrame:
    """(g1_id, gap): best less second-best similarity, of nodes with two candidates at least."""
    w = Window.partitionBy("g1_id").orderBy(F.desc("similarity"), "g2_id")
    top = scored.select("g1_id", "g2_id", "similarity").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return top.groupBy("g1_id").agg(F.count("*").alias("c"), (F.max("similarity") - F.min("similarity")).alias("gap")).where("c = 2").select("g1_id", "gap")


def best_similarity(scored: DataFrame) -> DataFrame:
    return scored.groupBy("g1_id").agg(F.max("similarity").alias("best"))


def distance_bins(scored: DataFrame, edges: tuple[float, ...] = (0, 2, 5, 10, 15, 20)) -> DataFrame:
    """(bin, lo, hi, similarity): mean similarity of each bin [lo, hi), 0 where it is empty."""
    spark = scored.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    at = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        at = F.when((F.col("distance") >= a) & (F.col("distance") < b), i).otherwise(at)
    means = scored.groupBy(at.alias("bin")).agg(F.avg("similarity").alias("m"))
    return bins.join(F.broadcast(means), "bin", "left").select("bin", "lo", "hi", F.coalesce("m", F.lit(0.0)).alias("similarity"))


def correlations(scored: DataFrame, a: str = "distance", b: str = "similarity") -> DataFrame:
    """Pearson and Spearman correlation; equal values share their mean rank. Ranks come from running counts over value buckets' totals."""
    ranks = scored.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    for c in ("a", "b"):
        per = ranks.groupBy(c).agg(F.count("*").alias("m"))
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = per.select(F.col(c).alias("v"), (F.sum("m").over(w) - (F.col("m") - 1) / 2.0).alias(f"r{c}"))
        ranks = ranks.join(placed, ranks[c] == placed["v"]).drop("v")
    return ranks.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def p_value(r: float, n: int) -> float:
    """Two-sided probability of a correlation at least as far from 0 in n independent pairs: Student's t with n - 2 degrees of freedom."""
    if n < 3 or r is None:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for k in range(1, 10_000):
        for top in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def vector_statistics(embeddings: DataFrame) -> DataFrame:
    """Norms and values: mean, population deviation, bounds."""
    lengths = embeddings.select(norm("vec").alias("n")).agg(F.count("*").alias("vectors"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"))
    values = embeddings.select(F.explode("vec").alias("x")).select(F.col("x").cast("double").alias("x")).agg(F.avg("x").alias("value_mean"), F.stddev_pop("x").alias("value_std"), F.min("x").alias("value_min"), F.max("x").alias("value_max"))
    return lengths.crossJoin(values)


def top_examples(scored: DataFrame, wanted_graph: str, scan: int = 100, top: int = 5) -> DataFrame:
    """scored(word, other, similarity): of the `scan` most similar words those of one graph, `top` at most."""
    w = Window.partitionBy("word").orderBy(F.desc("similarity"), "other")
    near = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= scan).where(F.split("other", "_")[0] == wanted_graph)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("r")
