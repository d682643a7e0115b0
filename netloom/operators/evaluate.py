"""Ground truth, outcomes and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance, precision_recall_f1

OUTCOMES = ("TP", "FP", "FN", "false_alarm", "correct_rejection")


def provenance_truth(nodes1: DataFrame, provenance: DataFrame) -> DataFrame:
    """(g1_id, truth): the g2 node that came from each g1 node, null where none did."""
    back = provenance.where("origin is not null").select(F.col("origin").alias("g1_id"), F.col("new_id").alias("truth"))
    return nodes1.select(F.col("id").alias("g1_id")).join(back, "g1_id", "left")


def scored_nodes(nodes: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Nodes to score: the core if any node has a role, else all; less those excluded(id)."""
    zoned = nodes.agg(F.max(F.col("role").isNotNull()).alias("z")) if "role" in nodes.columns else None
    out = nodes if zoned is None else nodes.crossJoin(F.broadcast(zoned)).where(~F.coalesce("z", F.lit(False)) | (F.col("role") == "core")).drop("z")
    return out.join(exclude.select("id"), "id", "left_anti") if exclude is not None else out


def outcomes(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """(g1_id, outcome, predicted, truth): TP, FP (a wrong partner), FN (none though there is one), false_alarm, correct_rejection."""
    joined = truth.join(matches.select("g1_id", F.col("g2_id").alias("predicted")), "g1_id", "left")
    p, t = F.col("predicted"), F.col("truth")
    kind = F.when(t.isNull(), F.when(p.isNull(), "correct_rejection").otherwise("false_alarm")).when(p.isNull(), "FN").when(p == t, "TP").otherwise("FP")
    return joined.select("g1_id", kind.alias("outcome"), "predicted", "truth")


def metrics(scored: DataFrame, alarms_are_fp: bool = True) -> DataFrame:
    """Counts, precision, recall and F1, without rows too. A wrong partner is a false positive only, so complete matchings have recall 1."""
    counts = scored.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("n_eval"))
    fp = F.col("FP") + F.col("false_alarm") if alarms_are_fp else F.col("FP")
    p, r, f = precision_recall_f1(F.col("TP"), fp, F.col("FN"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def fold_metrics(scored: DataFrame, folds: DataFrame) -> DataFrame:
    """Metrics of each fold and of all, where false alarms do not count as false positives."""
    joined = scored.join(folds, scored["g1_id"] == folds["id"], "left").where("fold is not null")
    rolled = joined.rollup("fold").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("TP", "FP", "FN")], F.count("*").alias("n_eval"))
    p, r, f = precision_recall_f1(F.col("TP"), F.col("FP"), F.col("FN"))
    return rolled.select(F.coalesce("fold", F.lit("all")).alias("fold"), "TP", "FP", "FN", "n_eval", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def extra_predictions(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of g1 nodes that have no ground truth row or no partner there."""
    return matches.join(truth.where("truth is not null").select("g1_id"), "g1_id", "left_anti")


def error_distances(scored: DataFrame, nodes2: DataFrame) -> DataFrame:
    """How far the predicted node is from the true one, for false positives."""
    at = nodes2.select("id", "x", "y")
    p, t = at.select(F.col("id").alias("predicted"), F.col("x").alias("px"), F.col("y").alias("py")), at.select(F.col("id").alias("truth"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return scored.where("outcome = 'FP'").join(p, "predicted").join(t, "truth").select("g1_id", distance("px", "py", "tx", "ty").alias("error"))


def binned(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Counts of the bins [edge, next edge), the last one open; empty bins are left out."""
    v, label = F.col(column), None
    for lo, hi in zip(edges, [*edges[1:], None], strict=True):
        cond = (v >= lo) if hi is None else (v >= lo) & (v < hi)
        name = f"[{lo:g},{'inf' if hi is None else format(hi, 'g')})"
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return values.select(label.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))


def equal_bins(values: DataFrame, column: str, bins: int) -> DataFrame:
    """A histogram of equal bins from the least to the largest value, which the last bin includes."""
    bounds = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return values.crossJoin(F.broadcast(bounds)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def cycle_lengths(matches: DataFrame, provenance: DataFrame, longest: int = 5) -> DataFrame:
    """(g1_id, cycle): steps after which following match then origin comes back, up to `longest`; null if it does not."""
    origin = provenance.select(F.col("new_id").alias("g2_id"), "origin")
    step = matches.join(origin, "g2_id").where("origin is not null").select(F.col("g1_id").alias("from"), F.col("origin").alias("to"))
    now = step.select(F.col("from").alias("g1_id"), F.col("to").alias("at"), F.when(F.col("from") == F.col("to"), 1).alias("cycle"))
    for k in range(2, longest + 1):
        moved = now.join(step, now["at"] == step["from"], "left")
        now = moved.select("g1_id", F.col("to").alias("at"), F.coalesce("cycle", F.when(F.col("to") == F.col("g1_id"), k)).alias("cycle"))
    return now.select("g1_id", "cycle")


def swap_classes(wrong: DataFrame, nodes1: DataFrame, edges1: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """wrong(g1_id, other): why the two nodes may be confused: co-located, adjacent, equivalent (same degree and neighbours' degrees), same degree, other."""
    from .graph import degrees, symmetric

    deg = degrees(nodes1, edges1)
    near = symmetric(edges1).distinct()
    around = near.join(deg.select(F.col("id").alias("b"), "degree"), "b").groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list("degree")).alias("sig"))
    info = nodes1.select("id", "x", "y").join(deg, "id").join(around, "id", "left").select("id", "x", "y", "degree", F.coalesce("sig", F.array().cast("array<long>")).alias("sig"))
    side = lambda s: info.select(*[F.col(c).alias(f"{s}_{c}") for c in info.columns])
    pairs = near.select(F.col("a").alias("e_a"), F.col("b").alias("e_b"), F.lit(True).alias("adjacent"))
    joined = wrong.join(side("a"), F.col("g1_id") == F.col("a_id"), "left").join(side("b"), F.col("other") == F.col("b_id"), "left").join(pairs, (F.col("g1_id") == F.col("e_a")) & (F.col("other") == F.col("e_b")), "left")
    kind = (
        F.when(F.col("b_id").isNull(), "other")
        .when(distance("a_x", "a_y", "b_x", "b_y") < tolerance, "colocated")
        .when(F.col("adjacent"), "adjacent")
        .when((F.col("a_degree") == F.col("b_degree")) & (F.col("a_sig") == F.col("b_sig")), "equivalent")
        .when(F.col("a_degree") == F.col("b_degree"), "same_degree")
        .otherwise("other")
    )
    return joined.select("g1_id", "other", kind.alias("class"))
