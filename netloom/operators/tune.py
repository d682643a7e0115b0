"""Experiment plans, spatial folds, cross-fitting and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import precision_recall_f1, variant_name

ORDERS = {"text": lambda p: [p.cast("string")], "length": lambda p: [F.length(p.cast("string")), p.cast("string")], "number": lambda p: [p.cast("double")]}


def spatial_folds(nodes: DataFrame) -> DataFrame:
    """(id, fold): core nodes west of the median x are A, the others B; nodes without a role count as core."""
    core = nodes.where(F.coalesce("role", F.lit("core")) == "core") if "role" in nodes.columns else nodes
    median = core.agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return core.crossJoin(F.broadcast(median)).select("id", F.when(F.col("x") < F.col("m"), "A").otherwise("B").alias("fold"))


def cross_fit(rows: DataFrame, param_order: str = "text") -> DataFrame:
    """rows(variant, method, param, fold, TP, FP, FN, f1) to one row per variant and method.

    On each fold the parameter of largest F1 is chosen, the first in order among equals; it scores the other fold; the two folds' counts are added.
    Rows whose status is not ok, and folds other than A and B, are left out.
    """
    ok = rows.where("fold in ('A', 'B')")
    ok = ok.where("status = 'ok'") if "status" in rows.columns else ok
    w = Window.partitionBy("variant", "method", "fold").orderBy(F.desc("f1"), *ORDERS[param_order](F.col("param")))
    best = ok.withColumn("r", F.row_number().over(w)).where("r = 1").select("variant", "method", F.when(F.col("fold") == "A", "B").otherwise("A").alias("fold"), "param")
    scored = best.join(ok.select("variant", "method", "fold", "param", "TP", "FP", "FN"), ["variant", "method", "fold", "param"])
    out = scored.groupBy("variant", "method").agg(F.max(F.when(F.col("fold") == "B", F.col("param"))).alias("param_A"), F.max(F.when(F.col("fold") == "A", F.col("param"))).alias("param_B"), *[F.sum(c).alias(c) for c in ("TP", "FP", "FN")], F.count("*").alias("folds")).where("folds = 2").drop("folds")
    p, r, f = precision_recall_f1(F.col("TP"), F.col("FP"), F.col("FN"))
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)})


def best_on_all(rows: DataFrame, param_order: str = "number") -> DataFrame:
    """(variant, method, param, f1): the parameter whose counts over both folds have the largest F1, the first in order among equals."""
    summed = rows.where("fold in ('A', 'B')").groupBy("variant", "method", "param").agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN")])
    _, _, f = precision_recall_f1(F.col("TP"), F.col("FP"), F.col("FN"))
    w = Window.partitionBy("variant", "method").orderBy(F.desc("f1"), *ORDERS[param_order](F.col("param")))
    return summed.withColumn("f1", F.round(f, 6)).withColumn("r", F.row_number().over(w)).where("r = 1").select("variant", "method", "param", "f1")


def best_parameter(rows: DataFrame, by: list[str], param_order: str = "text") -> DataFrame:
    """The parameter of the best single row of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("f1"), *ORDERS[param_order](F.col("param")))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, "param", "f1")


def grid(spark: SparkSession, zone: str, families: dict[str, list[float]], seeds: list[int], tune_seed: int, sigmas: list[float], alphas: list[float]) -> DataFrame:
    """The plan: cells (variant, family, level, seed), the tuning seed's first, times (sigma, alpha); alpha 0 once, as SpatialOnly, whatever sigma."""
    cells = spark.createDataFrame([(f, float(v), s) for f, levels in families.items() for v in levels for s in (seeds[:1] if f == "identity" else seeds)], "family string, level double, seed int")
    params = spark.createDataFrame([(float(s), float(a), "SANA") for s in sigmas for a in alphas if a] + ([(float(sigmas[0]), 0.0, "SpatialOnly")] if 0.0 in [float(a) for a in alphas] else []), "sigma double, alpha double, method string")
    name = variant_name(F.lit(zone), "family", F.col("level"), "seed")
    return cells.crossJoin(params).select(name.alias("variant"), "family", "level", "seed", "method", "sigma", "alpha").orderBy(F.col("seed") != tune_seed, "family", "level", "seed", "sigma", "alpha")


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the plan not done yet; rows that failed are tried again."""
    ok = done.where("status = 'ok'") if "status" in done.columns else done
    return plan.join(ok.select(*keys).distinct(), keys, "left_anti")


def reuse(plan: DataFrame, tuned: DataFrame) -> DataFrame:
    """The tuned parameter of (family, level) for each row of the plan."""
    return plan.join(F.broadcast(tuned.select("family", "level", "param")), ["family", "level"], "left")  # one row a level


def rescored(rows: DataFrame) -> DataFrame:
    """Rows read from CSV with counts as numbers and precision, recall and F1 computed anew."""
    counts = {c: F.expr(f"try_cast({c} AS bigint)") for c in ("TP", "FP", "FN")}
    p, r, f = precision_recall_f1(F.col("TP"), F.col("FP"), F.col("FN"))
    return rows.withColumns(counts).where("TP is not null").withColumns({"precision": p, "recall": r, "f1": f})


def pivot_summary(rows: DataFrame) -> DataFrame:
    """F1 of each pair in a row, a column for each method."""
    return rows.groupBy("pair").pivot("method").agg(F.first("f1"))
