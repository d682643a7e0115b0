"""Further registered queries: formats read back, sampling, tuning orders, anchors and small operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as fn
from . import sources
from .operators import align, compound, diagnostics, embedding, evaluate, graph, perturb, spatial, struc2vec, structural, tune, zone
from .plans import alignment, experiments
from .plans.fixture import CANDIDATES, DEGREES, NEAREST, SYMMETRIC
from .queries import BACK, COMPOUND, HALO, ONE, SCORED, SCORES, SIMS, SWEEP, WALKS, ZONE, _network, _sims, _sweep, _u, _walks, query, rounded
from .sources import sinks

# ---------------------------------------------------------------- formats, written and read back


def _at(store, name: str) -> str:
    return f"{store.root}/{name}"


@query("SELECT src, dst FROM fx_edges WHERE src <> dst")
def read_edge_list(x, store):
    sinks.write_text(sinks.edge_lines(x.edges1, x.nodes1), _at(store, "edges"))
    return sources.edge_list(x.spark, _at(store, "edges"))[1]


@query("SELECT id FROM fx_nodes")
def read_edge_list_nodes(x, store):
    sinks.write_text(sinks.edge_lines(x.edges1, x.nodes1), _at(store, "edges"))
    return sources.edge_list(x.spark, _at(store, "edges"))[0]


@query("SELECT src, dst FROM fx_edges")
def read_adjacency_list(x, store):
    lines = x.edges1.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")).select(F.concat_ws(" ", F.col("src").cast("string"), F.transform("to", lambda d: d.cast("string"))).alias("value"))
    sinks.write_text(lines, _at(store, "adjacency"))
    return sources.adjacency_list(x.spark, _at(store, "adjacency"))[1]


@query("SELECT vec_id AS id, len(embedding)::int AS dim, round(embedding[1]::double, 5) AS first, round(embedding[-1]::double, 5) AS last FROM embeddings")
def read_embedding_text(x, store):
    e = x.spark.read.parquet(f"{x.sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    sinks.write_embeddings(e, _at(store, "vectors"))
    back = sources.embedding_text(x.spark, _at(store, "vectors"))
    return back.select("id", F.size("vec").alias("dim"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.element_at("vec", -1).cast("double"), 5).alias("last"))


_SWEPT = f"""s AS ({SWEEP.replace("string)", "varchar)")})"""


@query(f""", f AS (SELECT variant, method, fold, param::varchar AS param, "TP" AS tp, "FP" AS fp, "FN" AS fn FROM s) SELECT variant, method, fold, param, tp, fp, fn, {SCORES} FROM f""", (_SWEPT,))
def read_results(x, store):
    sinks.append_csv(_sweep(x), _at(store, "results"))
    found = tune.rescored(sources.results(x.spark, _at(store, "results")))
    return rounded(found.select("variant", "method", "fold", "param", F.col("TP").alias("tp"), F.col("FP").alias("fp"), F.col("FN").alias("fn"), "precision", "recall", "f1"), "precision", "recall", "f1")


@query("SELECT id AS node_id, round(x, 6) AS x, round(y, 6) AS y FROM fx_nodes")
def coordinates_csv(x, store):
    sinks.write_coordinates(x.nodes1, _at(store, "coordinates"))
    return rounded(x.spark.read.schema("node_id long, x double, y double").option("header", True).csv(_at(store, "coordinates")), "x", "y")


@query("SELECT g1_id, g2_id, round(distance, 6) AS distance FROM cand", (CANDIDATES,))
def artifact(x, store):
    store.cut(x.candidates, "kept")
    return rounded(x.spark.read.parquet(_at(store, "kept")), "distance")


@query("SELECT array_to_string(tokens, ' ') AS value FROM walk", WALKS, recursive=True)
def walk_file(x, store):
    sinks.write_text(sinks.walk_lines(_walks(x, store)), _at(store, "walk-file"))
    return x.spark.read.text(_at(store, "walk-file"))


@query("SELECT 'nodes & ' || (SELECT count(*) FROM fx_nodes) || ' & ' || (SELECT count(*) FROM fx_nodes2) || ' ' || chr(92) || chr(92) AS value")
def latex_table(x, store):
    row = x.nodes1.agg(F.count("*").alias("a")).crossJoin(x.nodes2.agg(F.count("*").alias("b"))).withColumn("name", F.lit("nodes"))
    return sinks.latex_rows(row, ["name", "a", "b"])


@query("SELECT c.src, c.dst, round(distance, 6) AS distance, round(weight, 6) AS weight, printf('LINESTRING (%.3f %.3f, %.3f %.3f)', a.x, a.y, b.x, b.y) AS wkt FROM comp c JOIN fx_nodes a ON a.id = c.src JOIN fx_nodes2 b ON b.id = c.dst WHERE edge_type = 'cross_graph'", (CANDIDATES, COMPOUND))
def cross_edge_wkt(x, store):
    made = compound.gaussian(x.edges1, x.edges2, x.candidates, 3.0, 0.001)
    return rounded(sinks.cross_edge_lines(made, x.nodes1, x.nodes2), "distance", "weight")


@query("SELECT (SELECT count(*) FROM fx_nodes) AS nodes, (SELECT count(*) FROM fx_edges) AS edges")
def manifest(x, store):
    sinks.write_manifest(x.nodes1.agg(F.count("*").alias("nodes")).crossJoin(x.edges1.agg(F.count("*").alias("edges"))), _at(store, "manifest"))
    return x.spark.read.json(_at(store, "manifest")).select("nodes", "edges")


def _feature_file(x, store, name: str, rows: DataFrame) -> str:
    """A GeoJSON collection: one document, as the format has it."""
    sinks.write_features(rows, _at(store, name))
    return _at(store, name)


def _point(a: str = "x", b: str = "y"):
    return F.struct(F.lit("Point").alias("type"), F.array(a, b).alias("coordinates"))


def _wastewater(x, store):
    nodes = x.nodes1.where("id % 50 <> 7").select(F.struct(F.col("id").alias("old_id")).alias("properties"), _point().alias("geometry"))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("coordinates"))
    pipes = x.edges1.select(F.struct(F.col("src").alias("sourceNode"), F.col("dst").alias("targetNode")).alias("properties"), line.alias("geometry"))
    return sources.load_network(x.spark, _feature_file(x, store, "nodes", nodes), _feature_file(x, store, "pipes", pipes))


@query("SELECT id, round(CASE WHEN id % 50 <> 7 THEN x END, 6) AS x, round(CASE WHEN id % 50 <> 7 THEN y END, 6) AS y FROM fx_nodes WHERE id % 50 <> 7 OR id IN (SELECT unnest([src, dst]) FROM fx_edges)")
def wastewater_nodes(x, store):
    return rounded(_wastewater(x, store)[0].select("id", "x", "y"), "x", "y")


@query("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM fx_edges")
def wastewater_edges(x, store):
    return _wastewater(x, store)[1].select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def _road(x, store, srid: int | None = None):
    """Every third edge names its ends, the others lie between them; nodes are at six decimals."""
    at = x.nodes1.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")) if srid is None else x.nodes1.select("id", (F.lit(2.0) + F.col("x") / 100000).alias("x"), (F.lit(45.0) + F.col("y") / 100000).alias("y"))
    nodes = at.select(F.struct(F.col("id").alias("nodeID")).alias("properties"), _point().alias("geometry"))
    a, b = (at.select(F.col("id").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}")) for e in ("src", "dst"))
    named = lambda c: F.when(F.col("src") % 3 == 0, F.col(c))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("x_src", "y_src"), F.array("x_dst", "y_dst")).alias("coordinates"))
    pipes = x.edges1.join(a, "src").join(b, "dst").select(F.struct(named("src").alias("u"), named("dst").alias("v")).alias("properties"), line.alias("geometry"))
    return sources.load_network(x.spark, _feature_file(x, store, "nodes", nodes), _feature_file(x, store, "pipes", pipes), srid=srid or 2154)


@query("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM fx_edges")
def road_edges(x, store):
    return _road(x, store)[1].select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


@query(
    """, c AS (SELECT sqrt(2 / 298.257222101 - (1 / 298.257222101) ** 2) AS e, radians(44.0) AS p1, radians(49.0) AS p2, radians(46.5) AS p0),
m AS (SELECT *, cos(p1) / sqrt(1 - (e * sin(p1)) ** 2) AS m1, cos(p2) / sqrt(1 - (e * sin(p2)) ** 2) AS m2,
  tan(pi() / 4 - p1 / 2) / ((1 - e * sin(p1)) / (1 + e * sin(p1))) ** (e / 2) AS t1, tan(pi() / 4 - p2 / 2) / ((1 - e * sin(p2)) / (1 + e * sin(p2))) ** (e / 2) AS t2, tan(pi() / 4 - p0 / 2) / ((1 - e * sin(p0)) / (1 + e * sin(p0))) ** (e / 2) AS t0 FROM c),
k AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM m), kk AS (SELECT *, 6378137.0 * m1 / (n * t1 ** n) AS f FROM k),
g AS (SELECT id, radians(45.0 + y / 100000) AS phi, 2.0 + x / 100000 AS lon FROM fx_nodes),
r AS (SELECT id, n * radians(lon - 3.0) AS turn, f * (tan(pi() / 4 - phi / 2) / ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2)) ** n AS rho, f * t0 ** n AS rho0 FROM g, kk)
SELECT id, round(700000.0 + rho * sin(turn), 3) AS x, round(6600000.0 + rho0 - rho * cos(turn), 3) AS y FROM r"""
)
def road_nodes_projected(x, store):
    return rounded(_road(x, store, srid=4326)[0].select("id", "x", "y"), "x", "y", digits=3)


@query("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM fx_edges WHERE src <> dst")
def canonical_edges(x, store):
    both = x.edges1.unionByName(x.edges1.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.canonical(both.withColumn("o", F.monotonically_increasing_id()), "o").where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


# ---------------------------------------------------------------- anchors, candidates and embeddings

def _anchored(pairs: str) -> str:
    u = _u("'42'", "g1_id", "g2_id")
    return f"SELECT g1_id, g2_id FROM (SELECT greatest(1, round_even(0.1 * count(*), 0))::bigint AS k FROM {pairs}) JOIN (SELECT g1_id, g2_id, row_number() OVER (ORDER BY {u}, g1_id, g2_id) AS r FROM {pairs}) ON r <= k"


@query(", mn AS (SELECT nn.g1_id, nn.g2_id FROM nn JOIN back USING (g1_id, g2_id)) " + _anchored("mn"), (CANDIDATES, NEAREST, BACK))
def anchors_mutual(x, store):
    return align.anchors(x.nodes1, x.nodes2, "mutual_nn")


@query(", two AS (SELECT g1_id, g2_id FROM one WHERE g2_id IN (SELECT g2_id FROM one GROUP BY g2_id HAVING count(*) = 1)) " + _anchored("two"), (CANDIDATES, ONE))
def anchors_colocated(x, store):
    return align.anchors(x.nodes1, x.nodes2, "colocated", tolerance=2.0)


@query(", p AS (SELECT origin AS g1_id, id AS g2_id FROM fx_nodes2) " + _anchored("p"))
def anchors_provenance(x, store):
    return align.anchors(x.nodes1, x.nodes2, "provenance", provenance=x.provenance)


@query("SELECT id FROM fx_nodes WHERE role = 'core' AND id NOT IN (SELECT g1_id FROM nn JOIN back USING (g1_id, g2_id))", (CANDIDATES, NEAREST, BACK))
def scored_without_anchors(x, store):
    return evaluate.scored_nodes(x.nodes1, spatial.mutual_nearest(x.nodes1, x.nodes2, 20.0).select(F.col("g1_id").alias("id"))).select("id")


@query("SELECT g1_id, g2_id FROM cand WHERE g1_id % 3 <> 0 AND g2_id % 5 <> 0", (CANDIDATES,))
def candidates_with_embeddings(x, store):
    one = F.array(F.lit(1.0), F.lit(2.0))
    e1, e2 = (n.where(c).select("id", one.alias("vec")) for n, c in ((x.nodes1, "id % 3 <> 0"), (x.nodes2, "id % 5 <> 0")))
    return align.scored_candidates(x.candidates, e1, e2, least=None).select("g1_id", "g2_id")


@query("SELECT g1_id, g2_id, round(exp(-distance / 4.0), 6) AS similarity FROM cand", (CANDIDATES,))
def exponential_kernel(x, store):
    return rounded(x.candidates.select("g1_id", "g2_id", fn.kernel(F.col("distance"), 4.0, "exponential").alias("similarity")), "similarity")


@query("SELECT vec_id AS id, round(embedding[1]::double / n, 5) AS first, round(embedding[-1]::double / n, 5) AS last FROM (SELECT *, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM embeddings)")
def unit_vectors(x, store):
    e = x.spark.read.parquet(f"{x.sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), fn.unit("embedding").alias("v"))
    return rounded(e.select("id", F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last")), "first", "last", digits=5)


@query("SELECT g1_id, round(max(similarity), 6) AS best FROM sims GROUP BY g1_id", (CANDIDATES, SCORED, SIMS))
def best_similarity(x, store):
    return rounded(diagnostics.best_similarity(_sims(x)), "best")


@query(
    """, near AS (SELECT g1_id AS word, CASE WHEN g2_id % 2 = 0 THEN 'G1_' ELSE 'G2_' END || g2_id AS other, similarity FROM sims),
top AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, other) AS r FROM near)
SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, other)::int AS rank FROM top WHERE r <= 4 AND other LIKE 'G2%' QUALIFY rank <= 2""",
    (CANDIDATES, SCORED, SIMS),
)
def top_examples(x, store):
    graph_of = F.when(F.col("g2_id") % 2 == 0, "G1").otherwise("G2")
    near = _sims(x).select(F.col("g1_id").alias("word"), fn.token(graph_of, "g2_id").alias("other"), "similarity")
    return diagnostics.top_examples(near, "G2", 4, 2).select("word", "other", "rank")


@query("SELECT count(*) AS words, count(*) FILTER (node LIKE 'G1%') AS g1, count(*) FILTER (node LIKE 'G2%') AS g2 FROM (SELECT DISTINCT unnest(tokens) AS node FROM walk)", WALKS, recursive=True)
def vocabulary(x, store):
    return embedding.vocabulary_counts(_walks(x, store).select(F.explode("tokens").alias("word")).distinct())


@query("SELECT round(sqrt((e2 / v2) / (e1 / v1)), 9) AS first, round(1 / sqrt((e2 / v2) / (e1 / v1)), 9) AS second FROM (SELECT (SELECT count(*) FROM fx_nodes) AS v1, (SELECT count(*) FROM fx_edges) AS e1, (SELECT count(*) FROM fx_nodes2) AS v2, (SELECT count(*) FROM fx_edges2) AS e2)")
def rectification(x, store):
    a, b = structural.rectification(x.nodes1, x.edges1, x.nodes2, x.edges2)
    return rounded(x.spark.createDataFrame([(a, b)], "first double, second double"), "first", "second", digits=9)


# ---------------------------------------------------------------- tuning


def _spread(x):
    """The experiment with parameters whose orders as numbers, texts and by length differ."""
    return _sweep(x).withColumn("param", F.element_at(F.array(*map(F.lit, (9, 10, 8, 100))), F.col("param") + 1))


def _crossed(order: str) -> str:
    return f""", p AS (SELECT variant, method, fold, [9, 10, 8, 100][param + 1] AS param, "TP", "FP", "FN" FROM s), r AS (SELECT *, round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 6) AS f1 FROM p),
b AS (SELECT variant, method, CASE WHEN fold = 'A' THEN 'B' ELSE 'A' END AS fold, param FROM r QUALIFY row_number() OVER (PARTITION BY variant, method, fold ORDER BY f1 DESC, {order}) = 1),
t AS (SELECT variant, method, max(param) FILTER (fold = 'B') AS "param_A", max(param) FILTER (fold = 'A') AS "param_B", sum("TP")::bigint AS tp, sum("FP")::bigint AS fp, sum("FN")::bigint AS fn FROM b JOIN r USING (variant, method, fold, param) GROUP BY variant, method HAVING count(*) = 2)
SELECT *, {SCORES} FROM t"""


@query(_crossed("param::varchar"), (_SWEPT,))
def cross_fit_text(x, store):
    return tune.cross_fit(_spread(x), "text").withColumnsRenamed({"TP": "tp", "FP": "fp", "FN": "fn"})


@query(_crossed("len(param::varchar), param::varchar"), (_SWEPT,))
def cross_fit_length(x, store):
    return tune.cross_fit(_spread(x), "length").withColumnsRenamed({"TP": "tp", "FP": "fp", "FN": "fn"})


@query("SELECT variant, method, fold, param FROM s WHERE NOT (\"TP\" % 2 = 0 AND \"FN\" % 3 <> 0)", (_SWEPT,))
def resume_plan(x, store):
    rows = _sweep(x)
    done = rows.where("TP % 2 = 0").withColumn("status", F.when(F.col("FN") % 3 != 0, "ok").otherwise("failed"))
    return tune.remaining(rows.select("variant", "method", "fold", "param"), done, ["variant", "method", "fold", "param"])


@query("SELECT variant, method, fold, CASE WHEN method = 'm0' THEN 5 END AS param FROM s", (_SWEPT,))
def reused_parameter(x, store):
    tuned = x.spark.createDataFrame([("m0", 0.5, 5)], "family string, level double, param int")
    plan = _sweep(x).select("variant", "fold", F.col("method").alias("family"), F.lit(0.5).alias("level"))
    return tune.reuse(plan, tuned).select("variant", F.col("family").alias("method"), "fold", "param")


@query("""SELECT variant AS pair, max(f1) FILTER (method = 'm0') AS m0, max(f1) FILTER (method = 'm1') AS m1 FROM (SELECT *, round(coalesce(2 * "TP" / nullif(2 * "TP" + "FP" + "FN", 0), 0), 6) AS f1 FROM s) WHERE fold = 'A' AND param = 0 GROUP BY variant""", (_SWEPT,))
def summary_pivot(x, store):
    return tune.pivot_summary(_sweep(x).where("fold = 'A' and param = 0").withColumnRenamed("variant", "pair"))


@query("SELECT variant, 'Z1' AS zone, family, replace(level::double::varchar, '.', 'p') AS level FROM (SELECT 'Z1__' || family || '_L' || replace(level::double::varchar, '.', 'p') || '_s0' || seed AS variant, family, level FROM (VALUES ('jitter', 0.25), ('warp', 1.5)) a(family, level), (VALUES (1), (2)) b(seed))")
def variant_parts(x, store):
    named = x.spark.createDataFrame([(f, v, s) for f, v in (("jitter", 0.25), ("warp", 1.5)) for s in (1, 2)], "family string, level double, seed int")
    made = named.select(fn.variant_name(F.lit("Z1"), "family", F.col("level"), "seed").alias("variant"))
    return made.withColumn("p", fn.variant_parts("variant")).select("variant", "p.zone", "p.family", "p.level")


# ---------------------------------------------------------------- whole runs


@query(
    """, kd AS (SELECT h.id, h.depth, (SELECT degree FROM deg WHERE deg.id = h.id) AS full_, count(e.id) AS now
 FROM hall h LEFT JOIN (SELECT unnest([src, dst]) AS id FROM fx_edges WHERE src IN (SELECT id FROM h2) AND dst IN (SELECT id FROM h2)) e ON e.id = h.id GROUP BY h.id, h.depth)
SELECT count(*) FILTER (depth = 0) AS core, count(*) FILTER (depth > 0) AS halo, count(*) FILTER (depth = 0 AND full_ <> now) AS core_changed, count(*) FILTER (depth > 0 AND full_ <> now) AS halo_changed,
 (SELECT count(*) FROM fx_edges WHERE (src IN (SELECT id FROM h2)) <> (dst IN (SELECT id FROM h2))) AS severed FROM kd""",
    (ZONE, SYMMETRIC, HALO, DEGREES),
)
def zone_carve(x, store):
    return zone.carve(x.nodes1, x.edges1, (320.0, 100.0, 960.0, 900.0), 2, store)[2].drop("components", "core_components")


@query("SELECT 'nearest' AS method, 1.0::double AS f1, count(*) AS n_eval, true AS passed FROM fx_nodes WHERE role = 'core'")
def identity_control(x, store):
    return experiments.identity_control(_network(x), {"nearest": alignment.Settings(method="nearest")}, store)


@query("SELECT 'Z1__identity_L0p0_s01' AS variant, 'SpatialOnly' AS method, 'ok' AS status, count(*) AS n_eval, 1.0::double AS f1 FROM fx_nodes WHERE role = 'core'")
def sweep_identity(x, store):
    """The sweep over a plan of one cell that has its answer beforehand."""
    plan = experiments.select(tune.grid(x.spark, "Z1", {"identity": [0.0], "jitter": [0.25]}, [1, 2], 1, [3.0], [0.0]), family=["identity"])
    return experiments.sweep(_network(x), plan, alignment.Settings(), store, 10.0).select("variant", "method", "status", "n_eval", "f1")


@query("SELECT 'a-b' AS pair, 'nearest' AS method, count(*) AS n_eval FROM one WHERE g2_id IN (SELECT g2_id FROM one GROUP BY g2_id HAVING count(*) = 1)", (CANDIDATES, ONE))
def real_pairs(x, store):
    networks = {"a": (x.nodes1, x.edges1), "b": (x.nodes2, x.edges2)}
    rows, _ = experiments.real_pairs(networks, experiments.network_pairs(["a", "b"]), {"nearest": alignment.Settings(method="nearest")}, store, 2.0)
    return rows.select("pair", "method", "n_eval")


# ---------------------------------------------------------------- small operators


@query("SELECT a.n_nationkey::bigint AS v, b.n_nationkey::bigint AS u FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def triangular_pairs(x, store):
    return struc2vec.triangular(x.spark.read.parquet(f"{x.sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")))


@query("SELECT a.n_nationkey::bigint AS src, b.n_nationkey::bigint AS dst FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def clique_edges(x, store):
    return graph.clique(x.spark.read.parquet(f"{x.sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")))


@query(
    "SELECT src, dst, round((greatest(a.degree, b.degree) + 0.5) / (least(a.degree, b.degree) + 0.5) - 1, 6) AS cost, round(((greatest(a.degree, b.degree) + 0.5) / (least(a.degree, b.degree) + 0.5) - 1) * least(src % 3, dst % 5), 6) AS cost_min, round(((greatest(a.degree, b.degree) + 0.5) / (least(a.degree, b.degree) + 0.5) - 1) * greatest(src % 3, dst % 5), 6) AS cost_max FROM fx_edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst",
    (DEGREES,),
)
def degree_costs(x, store):
    deg = graph.degrees(x.nodes1, x.edges1)
    a, b = deg.select(F.col("id").alias("src"), F.col("degree").alias("da")), deg.select(F.col("id").alias("dst"), F.col("degree").alias("db"))
    both = x.edges1.join(a, "src").join(b, "dst").withColumns({"fa": F.col("src") % 3, "fb": F.col("dst") % 5})
    cost = struc2vec.cost_column
    found = both.select("src", "dst", cost("da", "db").alias("cost"), cost("da", "db", "fa", "fb", least=True).alias("cost_min"), cost("da", "db", "fa", "fb").alias("cost_max"))
    return rounded(found, "cost", "cost_min", "cost_max")


@query(", m AS (SELECT sqrt((m.x - n.x) * (m.x - n.x) + (m.y - n.y) * (m.y - n.y)) AS d FROM fx_nodes2 m JOIN fx_nodes n ON n.id = m.origin) SELECT round(count(*) FILTER (d <= 5) / count(*), 6) AS coverage FROM m")
def radius_coverage(x, store):
    made = perturb.Network(x.nodes2.withColumn("role", F.lit("core")), x.edges2)
    return rounded(spatial.coverage(perturb.provenance(made, x.nodes1), 5.0), "coverage")


@query(
    """, t AS (SELECT variant, method, param, sum("TP") AS tp, sum("FP") AS fp, sum("FN") AS fn FROM s GROUP BY ALL), r AS (SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM t)
SELECT variant, method, param, f1 FROM r QUALIFY row_number() OVER (PARTITION BY variant, method ORDER BY f1 DESC, param) = 1""",
    (_SWEPT,),
)
def best_on_all(x, store):
    return tune.best_on_all(_sweep(x))


@query("SELECT count(*) FILTER (abs(p) < 1e-3) AS clear, count(*) AS n FROM (SELECT 0.0 AS p FROM range(0, 2))")
def correlation_p_values(x, store):
    """The p-values of distance against similarity's own shift: of a perfect and of an almost perfect correlation."""
    r = diagnostics.correlations(x.candidates.select("distance", (F.col("distance") * 2).alias("similarity"))).first()
    n = x.candidates.count()
    rows = [(diagnostics.p_value(r["pearson"], n),), (diagnostics.p_value(0.99, n),)]
    return x.spark.createDataFrame(rows, "p double").agg(F.count_if(F.abs("p") < 1e-3).alias("clear"), F.count("*").alias("n"))


@query("SELECT src, dst FROM fx_edges WHERE src <> dst UNION SELECT dst, src FROM fx_edges WHERE src <> dst")
def read_adjacency_list_checked(x, store):
    lines = x.edges1.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")).select(F.concat_ws(" ", F.col("src").cast("string"), F.transform("to", lambda d: d.cast("string"))).alias("value"))
    sinks.write_text(lines, _at(store, "adjacency"))
    return sources.checked_adjacency_list(x.spark, _at(store, "adjacency"))[1]
