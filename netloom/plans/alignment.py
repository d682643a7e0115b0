"""End-to-end alignments: the compound-graph method with Gaussian or structural cross edges, the nearest-neighbour baseline, and post-hoc mapping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, compound, embedding, evaluate, struc2vec, structural, walks
from ..operators.graph import rings
from ..operators.spatial import radius_join
from ..store import Store


@dataclass
class Settings:
    """What a run needs; the figures are the usual ones of the method."""

    method: str = "gaussian"  # gaussian, structural, nearest, posthoc, struc2vec
    radius: float = 20.0
    sigma: float = 3.0
    align_sigma: float = 5.0
    alpha: float = 0.5
    depth: int = 3
    top_m: int = 50
    threshold: float = 0.0
    walks_per_node: int = 10
    walk_length: int = 80
    stay: float = 0.5
    dim: int = 128
    window: int = 5
    epochs: int = 5
    seed: int = 42
    objective: str = "sgns"  # or hs
    least: float | None = 0.0
    candidates: str = "embedding_topk"  # of the post-hoc methods; or radius
    mapping: str = "procrustes"  # or direct: both networks' vectors are compared as they are
    until_layer: int = 6
    anchors: dict = field(default_factory=lambda: {"mode": "mutual_nn", "fraction": 0.1})


def cross_graph(s: Settings, n1: DataFrame, e1: DataFrame, n2: DataFrame, e2: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """The compound graph and the candidates with distance."""
    near = store.cut(radius_join(n1, n2, s.radius), "candidates")
    if s.method == "gaussian":
        return compound.gaussian(e1, e2, near, s.sigma, s.threshold), near
    f1, f2 = structural.rectification(n1, e1, n2, e2)
    sides = [structural.vectors(structural.features(structural.ring_bounds(rings(n, e, s.depth, Store(n.sparkSession, "rings")), f), s.depth)) for n, e, f in ((n1, e1, f1), (n2, e2, f2))]
    similar = store.cut(structural.top_pairs_both(*sides, s.alpha, s.top_m), "similar")
    return compound.structural(e1, e2, similar, s.threshold), near


def vectors_of(s: Settings, walked: DataFrame) -> DataFrame:
    if s.objective == "hs":
        return embedding.skip_gram_hs(walked, s.dim, s.window, s.epochs, s.seed)
    return embedding.skip_gram_sgns(walked, s.dim, s.window, s.epochs, seed=s.seed)[0]


def _posthoc(s: Settings, n1: DataFrame, n2: DataFrame, made: list[DataFrame], store: Store) -> DataFrame:
    known = None if s.mapping == "direct" else align.anchors(n1, n2, **s.anchors, seed=s.seed)
    found = align.posthoc_alignment(n1, n2, *made, known, s.dim, store, candidates=s.candidates, radius=s.radius)
    return align.match_records(found.withColumnRenamed("similarity", "embedding_sim"), n1, n2)


def run(s: Settings, n1: DataFrame, e1: DataFrame, n2: DataFrame, e2: DataFrame, store: Store) -> DataFrame:
    """Match records of one run."""
    if s.method == "nearest":
        return align.match_records(align.nearest_neighbour_alignment(radius_join(n1, n2, s.radius), store, n1), n1, n2)
    if s.method == "struc2vec":
        made = [store.cut(struc2vec.vectors(n, e, Store(n.sparkSession, f"s2v-{name}"), s.until_layer, s.walks_per_node, s.walk_length, seed=s.seed, dim=s.dim, window=s.window, epochs=s.epochs), f"vectors-{name}") for name, n, e in (("G1", n1, e1), ("G2", n2, e2))]
        return _posthoc(s, n1, n2, made, store)
    if s.method == "posthoc":
        made = []
        for name, n, e in (("G1", n1, e1), ("G2", n2, e2)):
            names = n.select(F.concat(F.lit(f"{name}_"), "id").alias("node"))
            walked = store.cut(walks.weighted_walks(walks.uniform_adjacency(e, name), names, Store(n.sparkSession, f"walk-{name}"), s.walks_per_node, s.walk_length, s.seed), f"walks-{name}")
            made.append(store.cut(embedding.by_graph(vectors_of(s, walked)).select("id", "vec"), f"vectors-{name}"))
        return _posthoc(s, n1, n2, made, store)
    graph, near = cross_graph(s, n1, e1, n2, e2, store)
    adjacency = compound.adjacency(store.cut(graph, "compound"))
    names = n1.select(F.concat(F.lit("G1_"), "id").alias("node")).unionByName(n2.select(F.concat(F.lit("G2_"), "id").alias("node")))
    walker = Store(n1.sparkSession, "walker")
    if s.method == "gaussian":
        walked = walks.weighted_walks(adjacency, names, walker, s.walks_per_node, s.walk_length, s.seed)
    else:
        walked = walks.biased_walks(adjacency, names, walker, s.walks_per_node, s.walk_length, s.stay, s.seed)
    walked = store.cut(walked, "walks")
    vectors = store.cut(embedding.by_graph(vectors_of(s, walked)), "vectors")
    e_1, e_2 = (vectors.where(F.col("graph") == g).select("id", "vec") for g in ("G1", "G2"))
    scored = align.scored_candidates(near, e_1, e_2, s.alpha, s.align_sigma, least=s.least)
    return align.match_records(align.similarity_alignment(scored, store, n1), n1, n2)


def evaluate_run(matches: DataFrame, nodes1: DataFrame, provenance: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    scored = evaluate.scored_nodes(nodes1, exclude)
    truth = evaluate.provenance_truth(nodes1, provenance).join(scored.select(F.col("id").alias("g1_id")), "g1_id", "left_semi")
    return evaluate.outcomes(truth, matches)
