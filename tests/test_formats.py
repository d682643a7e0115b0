import json

import pytest
from pyspark.sql import functions as F

from netloom import sources
from netloom.sources import sinks
from netloom.sources.features import layout
from netloom.streaming import stream_candidates, windowed_counts


def collection(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}))
    return str(path)


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


def line(*c):
    return {"type": "LineString", "coordinates": [list(p) for p in c]}


def test_wastewater(spark, tmp_path):
    n = collection(tmp_path / "n.json", [({"old_id": 1, "kind": "a"}, point(0, 0)), ({"old_id": 2}, point(1, 0))])
    p = collection(tmp_path / "p.json", [({"sourceNode": 1, "targetNode": 2, "d": "x"}, line((0, 0), (1, 0))), ({"sourceNode": 2, "targetNode": 1, "d": "y"}, line((1, 0), (0, 0))), ({"sourceNode": 2, "targetNode": 5}, line((1, 0), (9, 9)))])
    nodes, edges = sources.load_network(spark, n, p)
    assert {r["id"]: (r["x"], r["y"]) for r in nodes.collect()} == {1: (0, 0), 2: (1, 0), 5: (None, None)}
    got = {(r["src"], r["dst"]): r["attrs"].get("d") for r in edges.collect()}
    assert got == {(1, 2): "y", (2, 5): None}


def test_roads(spark, tmp_path):
    n = collection(tmp_path / "n.json", [({"nodeID": 10}, point(0, 0)), ({"nodeID": 11}, point(1, 0)), ({"nodeID": 12}, point(2, 0))])
    p = collection(tmp_path / "p.json", [({"u": 10, "v": 11}, line((0, 0), (1, 0))), ({"u": 10, "v": 99}, line((0, 0), (5, 5))), ({}, line((1.0000001, 0), (2, 0)))])
    nodes, edges = sources.load_network(spark, n, p, srid=2154)
    assert nodes.count() == 3 and {(r["src"], r["dst"]) for r in edges.collect()} == {(10, 11), (11, 12)}
    # without a crs a file is in degrees, and ends are matched in metres, where 1e-7 degrees are a centimetre
    nodes, edges = sources.load_network(spark, n, p)
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [(10, 11)] and nodes.agg({"x": "max"}).first()[0] > 100_000
    named = tmp_path / "crs.json"
    named.write_text('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::2154"}}, "features": []}')
    assert sources.srid_of(spark, str(named)) == 2154 and sources.srid_of(spark, n) == 4326


@pytest.mark.parametrize("split", [40, 300, 1 << 20])
@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_collections_are_read_by_splits(spark, tmp_path, split, how):
    odd = ['a"b', "back\\", '\\"', "}{][", "{", 'é "features": [{', "", '"}']
    features = [{"type": "Feature", "geometry": point(i, -i), "properties": {"nodeID": i, "name": odd[i % len(odd)], "more": "x" * (i % 7) * 30}} for i in range(40)]
    doc = {"name": '"features": [{}', "bbox": [[0, {"a": 1}]], "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::2154"}}, "links": [{"properties": {"nodeID": 99}}], "features": features, "after": [{"properties": {}}]}
    (tmp_path / "n.json").write_text(json.dumps(doc, ensure_ascii=False, **how))
    sizes = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        found = layout(spark, str(tmp_path / "n.json"))
        got = sorted((r["ordinal"], r["properties"]["name"], r["properties"]["more"], tuple(r["geometry"]["coordinates"])) for r in sources.geojson(spark, str(tmp_path / "n.json"), sources.POINT, found).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(i, f["properties"]["name"], f["properties"]["more"], (i, -i)) for i, f in enumerate(features)]
    assert found.crs.endswith("2154") and len(found.starts) > 1  # each core gets a split at least


def test_edge_list_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 2)], "src long, dst long")
    sinks.write_text(sinks.edge_lines(edges, nodes), str(tmp_path / "e"))
    n, e = sources.edge_list(spark, str(tmp_path / "e"))
    assert {r["id"] for r in n.collect()} == {1, 2, 3} and [tuple(r) for r in e.collect()] == [(1, 2)]
    (tmp_path / "adj").write_text("1 2 3\n4\n")
    n, e = sources.adjacency_list(spark, str(tmp_path / "adj"))
    assert n.count() == 4 and {tuple(r) for r in e.collect()} == {(1, 2), (1, 3)}


def test_embeddings_results_and_tables(spark, tmp_path):
    v = spark.createDataFrame([(7, [0.5, 0.25])], "id long, vec array<float>")
    sinks.write_text(sinks.embedding_lines(v).union(spark.createDataFrame([("1 2",)], "value string")), str(tmp_path / "v"))
    assert [tuple(r) for r in sources.embedding_text(spark, str(tmp_path / "v")).collect()] == [(7, [0.5, 0.25])]
    sinks.append_csv(v.select("id"), str(tmp_path / "c"))
    sinks.append_csv(v.select("id"), str(tmp_path / "c"))
    assert [r["id"] for r in sources.results(spark, str(tmp_path / "c")).collect()] == ["7", "7"]
    assert sinks.latex_rows(v.select("id", F.lit("a").alias("n")), ["id", "n"]).first()["value"] == "7 & a \\\\"
    sinks.write_manifest(v.select("id"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["id"] == 7


def test_stream(spark, tmp_path):
    edits = spark.createDataFrame([(1, 0.0, 0.0, "2026-01-01 00:00:00"), (1, 0.0, 0.0, "2026-01-01 00:00:00"), (2, 100.0, 0.0, "2026-01-01 00:01:00")], "id long, x double, y double, t string")
    edits.select("id", "x", "y", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    fixed = spark.createDataFrame([(9, 3.0, 4.0)], "id long, x double, y double")
    live = spark.readStream.schema("id long, x double, y double, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_candidates(live, fixed, 20.0).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["g1_id"], r["g2_id"], r["distance"]) for r in spark.table("found").collect()] == [(1, 9, 5.0)]
    batch = stream_candidates(edits.select("id", "x", "y", F.col("t").cast("timestamp").alias("ts")), fixed, 20.0)
    assert windowed_counts(batch).first()["pairs"] == 1
