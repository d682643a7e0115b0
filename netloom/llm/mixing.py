"""Mixing sources to target weights by temperature, with DataFrame and SQL functions only.

Source shares p become weights p**t / sum(p**t). The exponent t is searched until the weights have the wanted entropy, or until the most repeated
source is read as often as allowed. Each source then has a budget of tokens: whole passes over it, and for the rest whole blocks of documents in
a permuted order; of the last block documents in a permuted order. Only sums for each source and block are ordered, in two levels; documents stay
where they are. Tokens are words here: a tokenizer's tokens are beyond SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Store

#: Documents of a block, about; larger sources have more blocks.
BLOCK_ROWS = 1024
#: The largest exponent; and exponents that one pass over the sources tries, and passes: the interval is cut to its 17th part 11 times.
SHARPEST, TRIED, PASSES = 64.0, 16, 11
#: Numbers of hashed() in bits, and the bits of them that deal the blocks of a source into ranges of their order.
HASH_BITS, RANGE_BITS = 52, 10


def exponent(sources: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, sharpen: bool = False) -> float:
    """sources(tokens) to t: where the entropy is target_entropy times the largest possible, or the least t that reads no source more than repetition_limit times.

    t lies in [0, 1], which only flattens; with sharpen and a target entropy in [0, SHARPEST]. If no t there is right, the nearest end is taken. With
    fewer than two sources that have tokens t is 1. The driver sees a few sums a pass, however many sources there are.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")
    some = sources.where("tokens > 0")
    number, total = some.agg(F.count("*"), F.sum("tokens")).first()
    if number < 2:
        return 1.0
    shares = some.select((F.col("tokens") / F.lit(total)).alias("p"))
    log = F.log("p")
    goal = target_entropy * float(shares.select(F.log(F.lit(number).cast("double"))).first()[0]) if target_entropy is not None else 0.0

    def too_large(ts: list[float]) -> list[bool]:
        """Whether the right exponent is smaller, or this one, for each of ts."""
        power = [F.exp(F.lit(t) * log) for t in ts]
        if target_entropy is not None:  # ln S - t/S sum(p**t ln p) falls with t
            row = shares.agg(*[(F.log(F.sum(x)) - F.lit(t) * F.sum(x * log) / F.sum(x)).alias(f"v{i}") for i, (t, x) in enumerate(zip(ts, power, strict=True))]).first()
            return [v < goal for v in row]
        row = shares.agg(*[(F.max(F.exp(F.lit(t - 1) * log)) / F.sum(x)).alias(f"v{i}") for i, (t, x) in enumerate(zip(ts, power, strict=True))]).first()
        return [v * (budget if budget is not None else total) / total <= repetition_limit for v in row]

    low, high = 0.0, SHARPEST if sharpen and target_entropy is not None else 1.0
    if not too_large([high])[0]:
        return high
    for _ in range(PASSES):
        ts = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        over = too_large(ts)
        first = over.index(True) if True in over else TRIED
        low, high = ts[first - 1] if first else low, ts[first] if first < TRIED else high
    return round(high, 9)


def hashed(*columns: str | Column) -> Column:
    """A number from 0 to 2**52-1 that depends on these values alone and is the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) if isinstance(c, str) else c for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def weighted(sources: DataFrame, store: Store, block_rows: int, budget: int | None, cover: bool, **how) -> DataFrame:
    """sources(s, rows, tokens) with the weight of each, whole passes over it, the rest of its budget, and its number of blocks."""
    t = exponent(sources, budget=budget, **how)
    some = sources.where("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0] or 1
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(t))).otherwise(0.0)
    mass = sources.agg(F.sum(raised)).first()[0] or 1.0
    named = store.cut(sources.withColumn("weight", F.round(raised / F.lit(mass), 12)), "weights")
    if cover:
        budget = named.where("weight > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
    elif budget is None:
        budget = total
    want = F.floor(F.col("weight") * F.lit(budget) + 0.5).cast("long")
    read = F.expr("want div tokens")
    once = (F.col("tokens") == 0) | (F.lit(cover) & (read == 0))  # the second by rounding only
    out = named.withColumn("want", want).select("s", "weight", F.when(once, 1).otherwise(read).cast("long").alias("passes"), F.when(once, 0).otherwise(F.col("want") % F.col("tokens")).cast("long").alias("rest"), F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks"))
    return store.cut(out, "weighted")


def plan(docs: DataFrame, store: Store, target_entropy: float | None = None, repetition_limit: float | None = None, budget: int | None = None, cover: bool = False, sharpen: bool = False, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs(doc_id, text, source, ...) to (row, source, n_words, weight, copies): how often each row is read.

    Words are [^\\x20\\x09-\\x0D]+; null text has none. The budget in words is that of all rows unless given; with cover it is the least that reads every
    source whole once. Rows without a source are a source of their own. A source without words is read once. Rows that repeat id and source are
    taken or left together, as are rows without an id of one source. An empty table gives an empty result.
    """
    names = docs.columns
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("s"), words.alias("n"), hashed(F.lit(str(seed)), "doc_id").alias("h"))
    sources = store.cut(rows.groupBy("s").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")), "sources")
    targets = weighted(sources, store, block_rows, budget, cover, target_entropy=target_entropy, repetition_limit=repetition_limit, sharpen=sharpen)
    rows = rows.join(targets, "s").withColumn("block", F.pmod(F.col("h"), F.col("blocks")))
    # blocks in permuted order, whole ones as long as the rest of the budget lasts: first by ranges of the order, then within the range where it ends
    sums = rows.where("rest > 0").groupBy("s", "block", "rest").agg(F.sum("n").alias("n")).withColumn("o", hashed(F.lit(str(seed)), "s", "block"))
    sums = store.cut(sums.withColumn("range", F.shiftright("o", HASH_BITS - RANGE_BITS)), "blocks")
    so_far = lambda *order: Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sums.groupBy("s", "range", "rest").agg(F.sum("n").alias("of_range")).withColumn("range_end", F.sum("of_range").over(so_far("range")))
    ranges = ranges.where("range_end - of_range < rest").select("s", "range", (F.col("range_end") - F.col("of_range")).alias("before"), (F.col("range_end") <= F.col("rest")).alias("all"))
    inside = store.cut(sums.join(ranges, ["s", "range"]), "ranges")
    edge = inside.where("not all").withColumn("end", F.col("before") + F.sum("n").over(so_far("o", "block")))
    edge = edge.where("end - n < rest").select("s", "block", (F.col("end") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("end") + F.col("n")).alias("left"))
    blocks = store.cut(inside.where("all").select("s", "block", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("left")).unionByName(edge), "taken-blocks")
    last = blocks.where("not whole").select("s", "block", "left")  # one block of each source at most
    within = Window.partitionBy("s", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.select("s", "block", "h", "n").join(last, ["s", "block"]).withColumn("end", F.sum("n").over(within)).where("end <= left").groupBy("s", "block").agg(F.max("h").alias("last"))
    taken = store.cut(blocks.select("s", "block", "whole").join(last, ["s", "block"], "left"), "taken")
    store.free("blocks", "ranges", "taken-blocks")
    found = rows.join(taken, ["s", "block"], "left")
    extra = F.when(F.col("whole"), 1).when(F.col("h") <= F.col("last"), 1).otherwise(0)
    return found.select("row", F.when(F.col("s") != "null", F.substring("s", 2, 2**31 - 1)).alias("source"), F.col("n").alias("n_words"), "weight", (F.col("passes") + extra).alias("copies"))


def mixed(docs: DataFrame, store: Store, **how) -> DataFrame:
    """docs with each row as often as plan() reads it; the columns stay as they are."""
    planned = plan(docs, store, **how).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
