"""Operator 5: mixing sources to target weights by entropy balancing.

A document's size is its number of words. Every source has a target of words. Rates r (the expected number of copies of a
document) minimise sum(r * log(r) - r) over all documents, the entropy of the mix relative to the corpus, subject to sum(size * r)
= target for each source and r <= MOST_COPIES. The dual is convex and has one variable a source: r = min(MOST_COPIES, exp(dual *
size)), so rates are tilted exponentially by size, and Newton's iterations on the dual meet the constraint. As the rate depends on the
size alone, the sums over all documents are sums over the distinct sizes of a source: the documents are counted by (source, size)
on the cluster, and each source is solved on an executor from those counts, whose number the longest text bounds, whatever the
source's share of the rows.

Rates are rounded to whole copies in order of size within a source: with C the running sum of rates, a document gets
floor(C + 1/2) - floor(C before it + 1/2) copies, so counts are right over every range of sizes. Then at most REPAIRS documents a
source get a copy more or less to bring the source nearer to its target. Nothing is random, so reruns agree, and nothing but the
weights' sums reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import drop_stored, stored, text_column, words

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
NEWTON_STEPS, TOLERANCE = 200, 1e-9
REPAIRS = 12


def _numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df dealt by ranges of that order, with its part and its row, which rise with the order from part to part; the table is stored."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "dealt")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source of sizes (source, source_size).

    The weights 5, 2, 1, repeating by code point (null last), share BUDGET of all words; what exceeds MOST_COPIES times a source's size
    is shared again by weight. A share of level * weight is full at a level that only rises, so the level alone is carried from round to round.
    """
    dealt = _numbered(sizes, F.asc_nulls_last("source"))
    counts = dealt.groupBy("part").agg(F.count("*").alias("count"))
    offset = counts.select(F.col("part").alias("p1"), F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = stored(dealt.join(offset, F.col("part") == F.col("p1")).select("source", "source_size", weight.alias("weight")), "weights")
    drop_stored(dealt)
    budget, level = None, 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= MOST_COPIES * F.col("source_size")
        now = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        budget = BUDGET * (now["all"] or 0)
        raised = max(level, (budget - MOST_COPIES * (now["full"] or 0)) / now["open"]) if now["open"] else level
        if raised == level:
            break
        level = raised
    out = stored(weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), MOST_COPIES * F.col("source_size").cast("double")).alias("target")), "targets")
    drop_stored(weighed)
    return out


def dual_rates(size: np.ndarray, n: np.ndarray, target: float) -> np.ndarray:
    """The rate of the documents of each size, of which there are n: min(MOST_COPIES, exp(dual * size)) with sum(n * size * rate) = target.

    Newton's iterations on the dual, kept between the points where the sum was too low and too high.
    """
    whole = size * n
    if target <= 0 or target >= MOST_COPIES * whole.sum():
        return np.full(len(size), 0.0 if target <= 0 else float(MOST_COPIES))
    x = size * (n.sum() / whole.sum())
    dual, low, high, top = 0.0, -np.inf, np.inf, np.log(MOST_COPIES)
    for _ in range(NEWTON_STEPS):
        rate = np.exp(np.minimum(dual * x, top))
        gradient, curvature = float((whole * rate).sum()) - target, float((whole * x * rate)[dual * x < top].sum())
        if abs(gradient) <= TOLERANCE * target:
            break
        low, high = (dual, high) if gradient < 0 else (low, dual)
        reach = 1 + abs(dual)
        dual = min(max(dual - gradient / curvature, dual - reach), dual + reach) if curvature > 0 else dual - np.sign(gradient) * reach
        if not low < dual < high:
            dual = (low + high) / 2
    return np.exp(np.minimum(dual * x, top))


def _rated(sizes: pd.DataFrame) -> pd.DataFrame:
    """Of each size of one source: its documents' rate, the documents before it and the sum of their rates."""
    sizes = sizes.sort_values("size")
    n = sizes["n"].to_numpy(float)
    rate = dual_rates(sizes["size"].to_numpy(float), n, float(sizes["target"].iloc[0]))
    after = np.cumsum(n * rate)
    return sizes.assign(rate=rate, fewer=np.cumsum(sizes["n"]) - sizes["n"], base=np.concatenate([[0.0], after[:-1]]))[["source", "size", "rate", "fewer", "base"]]


def _repairs(counts: pd.DataFrame) -> pd.DataFrame:
    """Of one source, how many documents of which size get a copy more (step 1) or less (step -1): each time the change that leaves the least gap."""
    counts = counts.sort_values("size")
    gap = float(counts["target"].iloc[0]) - float(counts["taken"].sum())
    size, free = counts["size"].to_numpy(float), {1: counts["up"].to_numpy().copy(), -1: counts["down"].to_numpy().copy()}
    change: dict[tuple[int, int], int] = {}
    for _ in range(REPAIRS):
        step = 1 if gap > 0 else -1
        left = np.where(free[step] > 0, np.abs(abs(gap) - size), np.inf)
        k = int(left.argmin())
        if left[k] >= abs(gap):
            break
        free[step][k] -= 1
        gap -= step * size[k]
        change[k, step] = change.get((k, step), 0) + 1
    rows = [(counts["source"].iloc[0], int(size[k]), step, times) for (k, step), times in change.items()]
    return pd.DataFrame(rows, columns=["source", "size", "step", "times"])


def _same(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """b with renamed keys, and the condition that a's keys equal them, null included."""
    renamed = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    met = [a[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return renamed, met[0] if len(met) == 1 else met[0] & met[1]


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted) and copies.

    docs: doc_id, text, source (null is a source of its own), others ignored. One row per input row; a repeated row is a
    document of its own. Null and empty texts have size 0 and are taken 0 times. With no words at all every target is 0.
    """
    size = F.size(words(text_column(docs))).cast("bigint")
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    sized = stored(docs.select(docs["doc_id"], source.alias("source"), size.alias("size"), F.xxhash64(text_column(docs)).alias("tie")), "sizes")
    counted = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    aims = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))

    filled = counted.filter("size > 0")
    own, met = _same(filled, aims.select("source", "target"), "source")
    rated = stored(filled.join(own, met).select("source", "size", "n", "target").groupBy("source").applyInPandas(_rated, "source string, size bigint, rate double, fewer bigint, base double"), "rates")

    drop_stored(counted)

    # Number each source's documents by size: range partitions are numbered within, then offset by the counts of those before.
    order = ["source", "size", "doc_id", "tie"]
    dealt = _numbered(sized.filter("size > 0"), *order)
    parts = dealt.groupBy("source", "part").count()  # partitions plus sources rows
    before = parts.select("source", "part", F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("i", F.row_number().over(Window.partitionBy("part", "source").orderBy("row")))
    b, met = _same(numbered, before, "source", "part")
    placed = numbered.join(b, met).drop("_source", "_part")
    r, met = _same(placed, rated, "source", "size")
    among = F.col("before") + F.col("i") - F.col("fewer")
    copies = (F.floor(F.col("base") + among * F.col("rate") + 0.5) - F.floor(F.col("base") + (among - 1) * F.col("rate") + 0.5)).cast("bigint")
    rounded = stored(placed.join(r, met).select("doc_id", "source", "size", "row", F.greatest(F.lit(0), F.least(copies, F.lit(MOST_COPIES))).alias("copies")), "rounded")
    drop_stored(dealt, rated)

    room = rounded.groupBy("source", "size").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.count(F.when(F.col("copies") < MOST_COPIES, 1)).alias("up"), F.count(F.when(F.col("copies") > 0, 1)).alias("down"))
    own, met = _same(room, aims.select("source", "target"), "source")
    changes = room.join(own, met).drop("_source").groupBy("source").applyInPandas(_repairs, "source string, size bigint, step int, times int")
    c, met = _same(rounded, changes, "source", "size")
    free = F.when(F.col("step") > 0, F.col("copies") < MOST_COPIES).otherwise(F.col("copies") > 0)
    first = F.row_number().over(Window.partitionBy("source", "size", "step").orderBy("row"))
    flips = rounded.join(c, met).filter(free).withColumn("k", first).filter(F.col("k") <= REPAIRS).filter("k <= times").select(F.col("row").alias("flip"), "step")
    final = rounded.join(stored(flips, "flips"), F.col("row") == F.col("flip"), "left").select("doc_id", "source", "size", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies"))
    whole = final.union(sized.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("bigint")))
    own, met = _same(whole, aims, "source")
    return whole.join(own, met).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
