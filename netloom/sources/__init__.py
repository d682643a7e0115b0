"""Readers of the file formats that networks, embeddings and results come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lambert93
from .features import Layout, feature_texts, layout

POINT = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
LINE = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])


def geojson(spark: SparkSession, path: str, geometry: T.StructType, found: Layout | None = None) -> DataFrame:
    """(ordinal, properties map, geometry) of the features of a GeoJSON collection, which no task holds as a whole."""
    feature = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", geometry)])
    read = feature_texts(found or layout(spark, path)).select(F.col("ordinal").cast("int").alias("ordinal"), F.from_json("text", feature).alias("f"))
    return read.select("ordinal", "f.properties", "f.geometry")


def detect_format(nodes: DataFrame, pipes: DataFrame) -> str:
    """wastewater if nodes have old_id and edges sourceNode; else road if nodes have nodeID or edges u."""
    has = lambda df, k: bool(df.where(F.map_contains_key("properties", F.lit(k))).limit(1).count())
    if has(nodes, "old_id") and has(pipes, "sourceNode"):
        return "wastewater"
    if has(nodes, "nodeID") or has(pipes, "u"):
        return "road"
    raise ValueError("neither a wastewater nor a road network")


def srid_of(spark: SparkSession, path: str, found: Layout | None = None) -> int:
    """The EPSG number that a GeoJSON file's member crs names; 4326, longitude and latitude, where it names none."""
    name = (found or layout(spark, path)).crs or "EPSG:4326"
    if name.endswith("CRS84"):
        return 4326
    return int(name.rsplit(":", 1)[-1])


def load_network(spark: SparkSession, nodes_path: str, pipes_path: str, data_format: str = "auto", srid: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(id, x, y, attrs) and canonical edges(src, dst, attrs) of a pair of GeoJSON files.

    Road networks are brought to metres in EPSG:2154 from longitude and latitude, unless they are in it already; srid overrides what the files say.

    Wastewater edges bring in ends that the node file lacks, without coordinates; road edges without both ends are dropped. Road edges name their
    ends by u and v, by node_start and node_end, or lie between nodes whose coordinates agree with the line's ends to six decimals.
    """
    layouts = [layout(spark, path) for path in (nodes_path, pipes_path)]
    raw_nodes, raw_pipes = geojson(spark, nodes_path, POINT, layouts[0]), geojson(spark, pipes_path, LINE, layouts[1])
    kind = detect_format(raw_nodes, raw_pipes) if data_format == "auto" else data_format
    srids = [srid or (srid_of(spark, path, at) if kind == "road" else 2154) for path, at in zip((nodes_path, pipes_path), layouts, strict=True)]
    prop = lambda k: F.expr(f"try_cast(properties['{k}'] AS bigint)")
    if kind == "wastewater":
        id_, src, dst = prop("old_id"), prop("sourceNode"), prop("targetNode")
    else:
        id_, src, dst = F.coalesce(prop("nodeID"), prop("osmid"), F.col("ordinal").cast("long")), F.coalesce(prop("u"), prop("node_start")), F.coalesce(prop("v"), prop("node_end"))
    nodes = raw_nodes.select(id_.alias("id"), _metres(F.col("geometry.coordinates"), srids[0]).alias("at"), F.col("properties").alias("attrs")).where("id is not null").dropDuplicates(["id"])
    nodes = nodes.select("id", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"), "attrs")
    ends = raw_pipes.select("ordinal", "properties", src.alias("src"), dst.alias("dst"), _metres(F.get("geometry.coordinates", F.lit(0)), srids[1]).alias("first"), _metres(F.element_at("geometry.coordinates", -1), srids[1]).alias("last"))
    edges = ends.where("src is not null and dst is not null")
    if kind == "road":
        key = lambda c: F.struct(F.round(F.get(c, F.lit(0)), 6).alias("kx"), F.round(F.get(c, F.lit(1)), 6).alias("ky"))
        at = nodes.where("x is not null and y is not null").groupBy(F.struct(F.round("x", 6).alias("kx"), F.round("y", 6).alias("ky")).alias("k")).agg(F.max("id").alias("nid"))
        loose = ends.where("src is null or dst is null").withColumns({"k1": key("first"), "k2": key("last")})
        placed = loose.join(at.select(F.col("k").alias("k1"), F.col("nid").alias("s")), "k1").join(at.select(F.col("k").alias("k2"), F.col("nid").alias("d")), "k2")
        edges = edges.select("ordinal", "properties", "src", "dst").unionByName(placed.select("ordinal", "properties", F.col("s").alias("src"), F.col("d").alias("dst")))
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    else:
        named = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes, "id", "left_anti")
        nodes = nodes.unionByName(named.select("id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("map<string,string>").alias("attrs")))
    from ..operators.graph import canonical

    return nodes, canonical(edges.select("src", "dst", F.col("properties").alias("attrs"), "ordinal"), "ordinal").drop("ordinal")


def _metres(point: Column, srid: int) -> Column:
    if srid == 2154:
        return point
    if srid != 4326:
        raise ValueError(f"coordinates in EPSG:{srid}; 4326 and 2154 are read")
    return F.when(point.isNotNull(), F.array(*lambert93(F.get(point, F.lit(0)), F.get(point, F.lit(1)))))


def edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(src, dst) of a text file with `int int` a line, or a single int for an isolated node."""
    parts = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    typed = parts.select(F.get("p", F.lit(0)).cast("long").alias("src"), F.get("p", F.lit(1)).cast("long").alias("dst"))
    nodes = typed.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return nodes, typed.where("dst is not null")


def from_dict(spark: SparkSession, neighbours: dict[int, list[int]]) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(src, dst) of a mapping from nodes to their neighbours."""
    edges = [(a, b) for a, near in neighbours.items() for b in near]
    ids = sorted({*neighbours, *(b for _, b in edges)})
    return spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")


def checked_adjacency_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same as adjacency_list, but with edges in both directions, once each, and no self-loops."""
    nodes, edges = adjacency_list(spark, path)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes, both.where("src <> dst").distinct()


def adjacency_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id) and edges(src, dst) of a text file with a node and then its neighbours in each line."""
    parts = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")).alias("p"))
    edges = parts.select(F.get("p", F.lit(0)).alias("src"), F.explode(F.slice("p", 2, F.size("p") - 1)).alias("dst"))
    return parts.select(F.explode("p").alias("id")).distinct(), edges


def embedding_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of a word2vec text file; the header, which has two fields, is skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 2)
    return parts.select(F.get("p", F.lit(0)).cast("long").alias("id"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """A result CSV with every column as a string."""
    return spark.read.option("header", True).csv(path)
