"""Vectors: centroids, exact nearest neighbours, and the nearest centroid.

Exact search is a grid of products. Queries and items are dealt into blocks of bounded size; each pair of blocks is one matrix product in a task, taken a tile at a time, of which
only the k best items of each query are kept while the items pass. The k best of the blocks then merge: a window with a limit on the rank,
which Spark applies before and after the shuffle. No pair of a query and an item becomes a row, and no key holds more than a pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.registry import query
from quern.sources.tables import load

#: Rows of a block of queries and of items, rows of a block of items below which there is no sense in more tasks, and the sides of a tile.
QUERIES, ITEMS, FEWEST, TILE = 1 << 14, 1 << 16, 1 << 9, 1 << 10
#: Products count as equal if they are in this many decimals; of equals the least id comes first.
DECIMALS = 9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _best(queries: np.ndarray, own: np.ndarray, items: np.ndarray, ids: np.ndarray, k: int, skip: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, item's row, product) of the k best items of each query. ids are in order, so of equal products the earlier item wins by staying."""
    value = np.full((len(queries), k), -np.inf)
    place = np.full((len(queries), k), -1)
    begin, width = 0, max(4 * k, 64)  # a narrow first tile finds what later ones have to beat
    while begin < len(items):
        end = min(begin + width, len(items))
        product = queries @ items[begin:end].T
        if skip:
            product[own[:, None] == ids[None, begin:end]] = -np.inf
        row, col = np.nonzero(product > value[:, -1:] + 0.4 * 10.0**-DECIMALS)
        found = np.round(product[row, col], DECIMALS)
        better = found > value[row, -1]
        row, col, found = row[better], col[better] + begin, found[better]
        if len(row):
            some = np.unique(row)
            row = np.concatenate([np.repeat(some, k), row])
            found, col = np.concatenate([value[some].ravel(), found]), np.concatenate([place[some].ravel(), col])
            order = np.lexsort((col, -found, row))
            row, found, col = row[order], found[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            value[row[keep], rank[keep]], place[row[keep], rank[keep]] = found[keep], col[keep]
        begin, width = end, TILE
    row, rank = np.nonzero(place >= 0)
    return row, place[row, rank], value[row, rank]


def k_best(queries: DataFrame, items: DataFrame, k: int, skip_own: bool = False) -> DataFrame:
    """query, item, product and rank (from 1): for each query the k items of greatest product, by product descending and id.

    queries and items: id (bigint) and vec (array of double); all vectors have one length, null ones and those with a null number have no products. skip_own: an item is no
    neighbour of a query of its own id. Queries without any item are left out; a repeated query or item counts as often as it is there.
    """
    spark = queries.sparkSession
    whole = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    queries, items = queries.select("id", "vec").filter(whole), items.select("id", "vec").filter(whole)
    n_queries, n_items = queries.count(), items.count()
    rows = max(1, -(-n_queries // QUERIES))
    columns = max(-(-n_items // ITEMS), min(spark.sparkContext.defaultParallelism, -(-n_items // FEWEST)), 1)
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n))  # noqa: E731  evenly, whatever the ids
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = queries.withColumn("at", F.monotonically_increasing_id()).withColumn("row", F.pmod("at", F.lit(rows))).withColumn("column", each(columns))
    right = items.withColumn("column", deal(columns)).withColumn("row", each(rows))

    def products(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.sort_by("id")
        own, ids = q["id"].to_numpy(), v["id"].to_numpy()
        a, b = _matrix(q["vec"]), _matrix(v["vec"])
        parts = [(x + i, y, z) for i in range(0, len(a), TILE) for x, y, z in [_best(a[i : i + TILE], own[i : i + TILE], b, ids, k, skip_own)]] if len(b) else []
        row, col, value = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query": own[row], "at": q["at"].to_numpy()[row], "item": ids[col], "product": value})

    found = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(products, "query bigint, at bigint, item bigint, product double")
    rank = F.row_number().over(Window.partitionBy("query", "at").orderBy(F.desc("product"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "item", "product", "rank")


def _unit(vector: str) -> F.Column:
    """The vector in doubles, of length 1; null for one of length 0."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length))


NEIGHBOURS = 10


@query("vec_topk", f"""WITH units AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings)),
    pairs AS (SELECT q.vec_id, v.vec_id AS neighbour, round(list_inner_product(q.u, v.u), 9) AS s FROM units q JOIN units v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM pairs) SELECT vec_id, neighbour, round(s, 6) AS similarity, rank FROM ranked WHERE rank <= {NEIGHBOURS}""")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact NEIGHBOURS nearest of all vectors by cosine, for every vector whose id is divisible by 20."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _unit("embedding").alias("vec"))
    found = k_best(vectors.filter(F.col("id") % 20 == 0), vectors, NEIGHBOURS, skip_own=True)
    return found.select(F.col("query").alias("vec_id"), F.col("item").alias("neighbour"), F.round("product", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("vec_centroid", """SELECT label, i::BIGINT AS position, round(avg(CAST(x AS DOUBLE)), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def vec_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
    return parts.groupBy("label", F.col("position").cast("bigint").alias("position")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("vec_nearest_label", """WITH means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
    centres AS (SELECT label, list(m ORDER BY i) AS centre FROM means GROUP BY label)
    SELECT vec_id, e.label, arg_max(c.label, round(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), centre), 9)) AS nearest FROM embeddings e CROSS JOIN centres c GROUP BY vec_id, e.label""")
def vec_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the label whose centroid has the greatest product with it; the least label of equals."""
    vectors = load(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("vec"))
    wide = vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    nearest = k_best(wide, centres.select(F.col("label").cast("bigint").alias("id"), "vec"), 1)
    return vectors.select("vec_id", "label").join(nearest.select(F.col("query").alias("vec_id"), F.col("item").cast("int").alias("nearest")), "vec_id")
