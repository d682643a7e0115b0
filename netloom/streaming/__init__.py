"""Incremental candidates for a stream of edited nodes: an addition, the reference task itself being batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance


def stream_candidates(edits: DataFrame, fixed: DataFrame, radius: float, delay: str = "10 minutes") -> DataFrame:
    """edits(id, x, y, ts) as a stream to (g1_id, g2_id, distance, ts) against a fixed network; edits later than delay are dropped, repeats once seen too."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    static = fixed.select(F.col("id").alias("g2_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("o")).select("g2_id", "x2", "y2", (cell("x2") + F.col("o.i")).alias("cx"), (cell("y2") + F.col("o.j")).alias("cy"))
    live = edits.withWatermark("ts", delay).dropDuplicates(["id", "ts"]).select(F.col("id").alias("g1_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "ts", cell("x").alias("cx"), cell("y").alias("cy"))
    d = distance("x1", "y1", "x2", "y2")
    return live.join(static, ["cx", "cy"]).where(d <= radius).select("g1_id", "g2_id", d.alias("distance"), "ts")


def windowed_counts(candidates: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Candidates found in each time window."""
    return candidates.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("pairs"), F.avg("distance").alias("distance_mean"))
