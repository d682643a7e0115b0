"""Runs as users start them: datasets, the sweep over degraded copies, real pairs, and the identity control."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable, Iterable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, perturb, spatial, tune
from ..sources import load_network
from ..store import Store
from . import alignment

#: The environment variable that names a configuration file.
CONFIG = "NETLOOM_CONFIG"


def settings(path: str | None = None, overrides: Iterable[str] = ()) -> alignment.Settings:
    """Settings from a YAML file, by default the one that $NETLOOM_CONFIG names; overrides are `key=value` or `anchors.key=value`."""
    import yaml

    path = path or os.environ.get(CONFIG)
    found = {}
    if path:
        with open(path) as f:
            found = yaml.safe_load(f) or {}
    for item in overrides:
        key, _, value = item.partition("=")
        at = found
        *heads, last = key.split(".")
        for head in heads:
            at = at.setdefault(head, {})
        at[last] = yaml.safe_load(value)
    known = {f.name for f in dataclasses.fields(alignment.Settings)}
    if unknown := set(found) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return alignment.Settings(**found)


def write_settings(s: alignment.Settings, path: str) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(dataclasses.asdict(s), f, sort_keys=False)


def ordered_distinct(pairs: list[tuple[str, str]]) -> list[str]:
    """The datasets of some pairs, each once, as they come."""
    return list(dict.fromkeys(name for pair in pairs for name in pair))


def network_pairs(names: list[str], fixed: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Every two of the networks, and the fixed pairs."""
    return list(dict.fromkeys([*combinations(names, 2), *fixed]))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def variants(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a glob pattern names, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])


def datasets(spark: SparkSession, files: dict[str, tuple[str, str]], pairs: list[tuple[str, str]], say: Callable[[str], None] = print) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(nodes, edges) of the datasets of some pairs; those whose files are missing or cannot be read are reported and left out."""
    out = {}
    for name in ordered_distinct(pairs):
        paths = files.get(name)
        if paths is None or not all(_exists(spark, p) for p in paths):
            say(f"{name}: no files")
            continue
        try:
            out[name] = load_network(spark, *paths)
        except Exception as e:  # one bad dataset does not end the run
            say(f"{name}: {e}")
    return out


def select(plan: DataFrame, **wanted) -> DataFrame:
    """Rows of a plan whose columns have one of the wanted values, such as family=["jitter"]; None takes all."""
    for column, values in wanted.items():
        if values is not None:
            plan = plan.where(F.col(column).isin(list(values)))
    return plan


def scored_row(matches: DataFrame, nodes1: DataFrame, provenance: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    return evaluate.metrics(alignment.evaluate_run(matches, nodes1, provenance, exclude))


def sweep(net: perturb.Network, plan: DataFrame, base: alignment.Settings, store: Store, spacing: float, done: DataFrame | None = None, steps: list[dict] | None = None) -> DataFrame:
    """A row of metrics for each row of the plan (variant, family, level, seed, method, sigma, alpha) that is not done yet.

    Levels of jitter and warp are multiples of the node spacing. Variants are built once and shared by their methods. SpatialOnly, alpha 0, is the
    baseline by distance; a cell that fails has status failed and no metrics. Cells are run one after another; each is distributed.
    """
    spark, keys = net.nodes.sparkSession, ["variant", "method", "sigma", "alpha"]
    todo = tune.remaining(plan, done, keys) if done is not None else plan
    cells: dict[str, list] = {}
    for r in todo.orderBy("variant", "method", "sigma", "alpha").collect():  # the plan is a few hundred rows
        cells.setdefault(r["variant"], []).append(r)
    rows = []
    for name, cell in cells.items():
        own = Store(spark, f"sweep-{name}")
        first = cell[0]
        level = first["level"] * spacing if first["family"] in ("jitter", "warp") else first["level"]
        how = {"spacing": 500.0} if first["family"] == "warp" else {}
        made, origin = perturb.build_variant(net, first["family"], level, first["seed"], own, steps, **how)
        radius = spatial.coverage_radius(origin.where("displacement is not null"), base.radius).first()["radius"]
        for r in cell:
            s = dataclasses.replace(base, method="nearest" if r["alpha"] == 0 else base.method, align_sigma=r["sigma"], alpha=r["alpha"], radius=radius, seed=r["seed"])
            try:
                matches = alignment.run(s, net.nodes, net.edges, made.nodes, made.edges, own)
                m = scored_row(matches, net.nodes, origin.select("new_id", "origin")).first().asDict()
                rows.append((*[r[k] for k in ("variant", "family", "level", "seed", "method", "sigma", "alpha")], radius, "ok", *[m[k] for k in METRICS]))
            except Exception:
                rows.append((*[r[k] for k in ("variant", "family", "level", "seed", "method", "sigma", "alpha")], radius, "failed", *[None] * len(METRICS)))
        own.close()
    return store.cut(spark.createDataFrame(rows, f"variant string, family string, level double, seed int, method string, sigma double, alpha double, radius double, status string, {_METRIC_TYPES}"), "sweep")


METRICS = ("TP", "FP", "FN", "false_alarm", "correct_rejection", "n_eval", "precision", "recall", "f1")
_METRIC_TYPES = ", ".join(f"{m} {'double' if m in ('precision', 'recall', 'f1') else 'long'}" for m in METRICS)


def real_pairs(networks: dict[str, tuple[DataFrame, DataFrame]], pairs: list[tuple[str, str]], methods: dict[str, alignment.Settings], store: Store, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows, summary): metrics of each method on each pair of networks, and F1 with a row a pair and a column a method.

    The truth of a real pair is bilateral unique co-location within the tolerance; nodes without a partner there are not scored.
    """
    spark, rows = store.spark, []
    for a, b in pairs:
        (n1, e1), (n2, e2) = networks[a], networks[b]
        own = Store(spark, f"pair-{a}-{b}")
        with own.dealt(n1.count()):
            truth = own.cut(spatial.colocated(n1, n2, tolerance, both_sides=True).select("g1_id", F.col("g2_id").alias("truth")), "truth")
        for name, s in methods.items():
            outcome = evaluate.outcomes(truth, alignment.run(s, n1, e1, n2, e2, own).select("g1_id", "g2_id"))
            m = evaluate.metrics(outcome).first().asDict()
            rows.append((f"{a}-{b}", name, *[m[k] for k in METRICS]))
        own.close()
    found = store.cut(spark.createDataFrame(rows, f"pair string, method string, {_METRIC_TYPES}"), "real-pairs")
    return found, tune.pivot_summary(found)


def identity_control(net: perturb.Network, methods: dict[str, alignment.Settings], store: Store) -> DataFrame:
    """(method, f1, n_eval, passed): every method must find a copy of the network under fresh ids again, F1 1 but for co-located nodes."""
    spark = store.spark
    made, origin = perturb.build_variant(net, "identity", 0.0, 0, store)
    rows = []
    for name, s in methods.items():
        own = Store(spark, f"identity-{name}")
        m = scored_row(alignment.run(s, net.nodes, net.edges, made.nodes, made.edges, own), net.nodes, origin.select("new_id", "origin")).first()
        rows.append((name, m["f1"], m["n_eval"], m["f1"] == 1.0))
        own.close()
    return store.cut(spark.createDataFrame(rows, "method string, f1 double, n_eval long, passed boolean"), "identity")

