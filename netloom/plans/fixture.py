"""A pair of networks derived from the table `events`: a sparse planar grid, and a displaced copy that lacks every 23rd node."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import nearest_join, radius_join

#: The same definition for both engines; Spark wants the literals as doubles.
NODES = """SELECT event_id AS id,
    (event_id % 100) * {d16} + (value - floor(value / {d8}) * {d8}) AS x,
    floor(event_id / {d100}) * {d16} + ((event_id * 7919) % 800) / {d100} AS y,
    CASE WHEN (event_id % 100) BETWEEN 20 AND 79 THEN 'core' ELSE 'halo' END AS role, event_type
  FROM events"""
EDGES = """SELECT a.id AS src, b.id AS dst FROM fx_nodes a JOIN fx_nodes b ON b.id = a.id + 1 WHERE a.id % 100 < 99 AND a.event_type <> 'error'
  UNION ALL SELECT a.id AS src, b.id AS dst FROM fx_nodes a JOIN fx_nodes b ON b.id = a.id + 100 WHERE a.id % 9 = 0"""
NODES2 = """SELECT id + 10000000 AS id, id AS origin, x + ((id * 7919) % 1001 - 500) / {d500} * {d6} AS x, y + ((id * 104729) % 1001 - 500) / {d500} * {d6} AS y
  FROM fx_nodes WHERE id % 23 <> 0"""
EDGES2 = """SELECT src + 10000000 AS src, dst + 10000000 AS dst FROM fx_edges WHERE src % 23 <> 0 AND dst % 23 <> 0 AND (src + dst) % 29 <> 0"""


def _literals(suffix: str) -> dict[str, str]:
    return {f"d{n}": f"{n}.0{suffix}" for n in (6, 8, 16, 100, 500)}


_SPARK, _DUCK = _literals("D"), {k: f"{v}::double" for k, v in _literals("").items()}

#: Common table expressions for SQL over the same tables.
CTE = ",\n".join(f"{name} AS ({sql.format(**_DUCK)})" for name, sql in (("fx_nodes", NODES), ("fx_edges", EDGES), ("fx_nodes2", NODES2), ("fx_edges2", EDGES2)))
CANDIDATES = """cand AS MATERIALIZED (SELECT a.id AS g1_id, b.id AS g2_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
  FROM fx_nodes a JOIN fx_nodes2 b ON b.x BETWEEN a.x - 20 AND a.x + 20 AND b.y BETWEEN a.y - 20 AND a.y + 20
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 20)"""
NEAREST = "nn AS (SELECT g1_id, min(struct_pack(d := distance, i := g2_id)).i AS g2_id, min(distance) AS distance FROM cand WHERE distance < 20 GROUP BY g1_id)"
SYMMETRIC = "sym AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS b FROM fx_edges WHERE src <> dst UNION ALL SELECT dst, src FROM fx_edges WHERE src <> dst))"
DEGREES = "deg AS (SELECT n.id, count(e.id) AS degree FROM fx_nodes n LEFT JOIN (SELECT unnest([src, dst]) AS id FROM fx_edges) e ON e.id = n.id GROUP BY n.id)"


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "event_type")
        self.nodes1 = spark.sql(NODES.format(**_SPARK).replace("FROM events", "FROM {events}"), events=events)
        of = lambda sql, **t: spark.sql(_braced(sql.format(**_SPARK), t), **t)
        self.edges1 = of(EDGES, fx_nodes=self.nodes1)
        self.nodes2 = of(NODES2, fx_nodes=self.nodes1)
        self.edges2 = of(EDGES2, fx_edges=self.edges1)

    @cached_property
    def candidates(self) -> DataFrame:
        return radius_join(self.nodes1, self.nodes2, 20.0)

    @cached_property
    def nearest(self) -> DataFrame:
        return nearest_join(self.nodes1, self.nodes2, 20.0)

    @cached_property
    def provenance(self) -> DataFrame:
        return self.nodes2.select(F.col("id").alias("new_id"), "origin")

    def halves(self) -> tuple[DataFrame, DataFrame]:
        """The table `embeddings` as two graphs: even and odd ids."""
        e = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return e.where("id % 2 = 0"), e.where("id % 2 = 1")

    def split_vectors(self) -> tuple[DataFrame, DataFrame]:
        """The first and the last 32 components of each embedding, as two graphs' vectors of the same node."""
        e = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        return e.select("id", F.slice("vec", 1, 32).alias("vec")), e.select("id", F.slice("vec", 33, 32).alias("vec"))


def _braced(sql: str, tables: dict) -> str:
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return sql
