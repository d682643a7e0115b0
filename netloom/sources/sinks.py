"""Writers. Each takes a DataFrame that its operator made; what is not asked for is not computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_lines(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(value): `src dst` lines; with nodes, isolated ones are lines of their own and self-loops are left out."""
    if nodes is None:
        return edges.select(F.concat_ws(" ", "src", "dst").alias("value"))
    e = edges.where("src <> dst")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
    alone = nodes.select("id").join(ends, "id", "left_anti").select(F.col("id").cast("string").alias("value"))
    return e.select(F.concat_ws(" ", "src", "dst").alias("value")).unionByName(alone)


def walk_lines(walks: DataFrame) -> DataFrame:
    return walks.select(F.concat_ws(" ", "tokens").alias("value"))


def line_wkt(x1: str, y1: str, x2: str, y2: str):
    return F.format_string("LINESTRING (%.3f %.3f, %.3f %.3f)", x1, y1, x2, y2)


def match_lines(records: DataFrame) -> DataFrame:
    """Matches as WKT lines from the one node to the other."""
    return records.select("g1_id", "g2_id", line_wkt("x_g1", "y_g1", "x_g2", "y_g2").alias("wkt"), "distance_m")


def cross_edge_lines(compound: DataFrame, nodes1: DataFrame, nodes2: DataFrame) -> DataFrame:
    a = nodes1.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes2.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return compound.where("edge_type = 'cross_graph'").join(a, "src").join(b, "dst").select("src", "dst", "distance", "weight", line_wkt("x1", "y1", "x2", "y2").alias("wkt"))


def embedding_lines(embeddings: DataFrame) -> DataFrame:
    """word2vec text lines without the header: id and values."""
    return embeddings.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """word2vec text: a header with the number of vectors and their length, in the first part file, then a line a vector."""
    header = embeddings.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).select(F.concat_ws(" ", "n", F.coalesce("dim", F.lit(0))).alias("value"))
    write_text(header.coalesce(1).union(embedding_lines(embeddings)), path)


def latex_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """(value): cells between ampersands, ended by a double backslash."""
    return table.select(F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in columns]), F.lit(r" \\")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """features(properties, geometry) as one GeoJSON collection, a feature a line; the one task that writes it holds a line at a time."""
    line = features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", "geometry")).alias("value")).repartition(1)
    comma = F.when(F.monotonically_increasing_id() == 0, "").otherwise(",")
    head, foot = (features.sparkSession.createDataFrame([(v,)], "value string").coalesce(1) for v in ('{"type":"FeatureCollection","features":[', "]}"))
    write_text(head.union(line.select(F.concat(comma, "value").alias("value"))).union(foot).coalesce(1), path)


def write_coordinates(nodes: DataFrame, path: str) -> None:
    nodes.select(F.col("id").alias("node_id"), "x", "y").write.mode("overwrite").option("header", True).csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_manifest(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)
