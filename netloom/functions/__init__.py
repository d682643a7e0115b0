"""Column expressions: vectors, kernels, keyed random numbers, metrics and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 2.0**52


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null if either has length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    a = F.col(a) if isinstance(a, str) else a
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def kernel(distance: Column, sigma: float, mode: str = "gaussian") -> Column:
    """Spatial similarity: exp(-d^2 / 2 sigma^2) or exp(-d / sigma)."""
    if mode == "gaussian":
        return F.exp(-(distance * distance) / (2.0 * sigma * sigma))
    if mode == "exponential":
        return F.exp(-distance / sigma)
    raise ValueError(f"unknown kernel: {mode}")


def combined(embedding: Column, spatial: Column, alpha: float) -> Column:
    return alpha * embedding + (1.0 - alpha) * spatial


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the key alone, the same in every engine with md5: its first 13 hex digits over 2**52."""
    parts = [F.lit(str(k)) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(TWO_52)


def normal(*key: Column | str | int) -> Column:
    """A standard normal number that depends on the key alone (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(*key, 1))) * F.cos(2.0 * F.lit(3.141592653589793) * uniform(*key, 2))


def distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    x1, y1, x2, y2 = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def token(graph: Column | str, id_: Column | str) -> Column:
    """A node as a word of a walk, such as G1_12."""
    return F.concat_ws("_", graph, id_)


def token_graph(word: Column | str) -> Column:
    return F.split(word, "_")[0]


def token_id(word: Column | str) -> Column:
    return F.split(word, "_")[1].cast("long")


def level_label(level: Column) -> Column:
    """A level as it stands in a variant's name: 0.125 as 0p125, a minus as m."""
    return F.regexp_replace(F.regexp_replace(level.cast("string"), r"\.", "p"), "-", "m")


def variant_name(zone: Column | str, family: Column | str, level: Column, seed: Column | str) -> Column:
    return F.concat(zone, F.lit("__"), family, F.lit("_L"), level_label(level), F.lit("_s"), F.format_string("%02d", seed))


def variant_parts(name: Column | str) -> Column:
    """Zone, family and level label of a variant's name."""
    pattern = r"^(.+)__(.+)_L([\dpm]+)_s\d+$"
    return F.struct(*[F.regexp_extract(name, pattern, i).alias(k) for i, k in enumerate(("zone", "family", "level"), 1)])


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres in EPSG:2154 from degrees on GRS80 (Lambert conformal conic with two standard parallels)."""
    import math

    a, e = 6378137.0, math.sqrt(2 / 298.257222101 - (1 / 298.257222101) ** 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = map(math.radians, (46.5, 44.0, 49.0))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = a * m(p1) / (n * t(p1) ** n)
    phi, turn = F.radians(lat), n * F.radians(lon - 3.0)
    tt = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho = f * F.pow(tt, F.lit(n))
    return 700000.0 + rho * F.sin(turn), 6600000.0 + f * t(p0) ** n - rho * F.cos(turn)
