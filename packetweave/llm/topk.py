"""Exact top-k inner products by Fagin's threshold algorithm, in tiles.

Every candidate tile is sorted once per dimension.  A query walks the lists from
their largest values, or from their smallest where its component is negative, and
scores the rows it meets.  No unseen row can score more than the threshold, the
query's product with the values at the present depth, so the walk stops when
the threshold cannot beat, or tie, the k-th score.  Queries of a tile walk together;
rows that any of them meets are scored by one matrix product.  Tops of tiles
are merged per query.

A tile pair is one group of at most about ``ROWS`` candidates and ``QUERIES`` queries, whatever the
keys, so repeated ids or vectors do not gather in one task.

Vectors that are null or hold null or non-finite components, and rows without
id, take no part; vectors are compared with those of equal length.  Repeated
rows are candidates of each other.  Ties go to the smaller id.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetweave.storage import materialize

SCALE, BEST = 64, 20
ROWS, QUERIES, TOGETHER = 8192, 1024, 256
FIRST_DEPTH, DEEPER = 32, 4
FOUND = "query long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, size, v): usable vectors as integers, written with a number per row."""
    part = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(usable)
    return materialize(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("size"), part.alias("v")), "scaled-vectors")


def _exact(c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which every inner product is exact."""
    bound = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return c.astype(kind), q.astype(kind)


def threshold_walk(c: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (query by row) and a mask of the rows that can be among the k best of each query.

    own: the place of each query among the rows, or -1.
    """
    (n, d), m = c.shape, len(q)
    c, q = _exact(c, q)
    order = np.argsort(-c, axis=0, kind="stable")
    values = np.take_along_axis(c, order, axis=0)
    lowest = np.iinfo(np.int64).min if c.dtype == np.int64 else -np.inf
    scores = np.full((m, n), lowest, c.dtype)
    scored, best = np.zeros(n, bool), np.zeros((m, n), bool)
    active, depth = np.arange(m), min(FIRST_DEPTH, n)
    up = q >= 0
    high, low = np.where(up, q, 0), np.where(up, 0, q)
    while len(active):
        met = np.zeros((len(active), n), bool)
        for i in range(d):
            top, bottom = np.zeros(n, bool), np.zeros(n, bool)
            top[order[:depth, i]] = True
            bottom[order[n - depth :, i]] = True
            met[up[active, i]] |= top
            met[~up[active, i]] |= bottom
        if depth == n:
            met[:] = True
        fresh = np.flatnonzero(met.any(axis=0) & ~scored)
        scores[:, fresh] = q @ c[fresh].T
        scored[fresh] = True
        inside = np.flatnonzero(own[active] >= 0)
        met[inside, own[active[inside]]] = False
        seen = np.where(met, scores[active], lowest)
        kth = np.partition(seen, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), lowest)
        threshold = high[active] @ values[depth - 1] + low[active] @ values[n - depth]
        over = (kth > threshold) | (depth == n)
        best[active[over]] = met[over] & (scores[active[over]] >= kth[over, None])
        active, depth = active[~over], min(n, depth * DEEPER)
    return scores, best


def _tile_top(table: pa.Table, k: int) -> pa.Table:
    """The k best of each query of a group within its candidates."""
    table = table.combine_chunks()
    asks = table["asks"].to_numpy()
    size = table["size"][0].as_py()
    v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(asks), size)
    row, ids = table["row"].to_numpy(), table["vec_id"].to_numpy()
    c, rows, cand = v[~asks], row[~asks], ids[~asks]
    found = [[], [], [], []]
    queries = np.flatnonzero(asks) if len(rows) else []
    place = {r: i for i, r in enumerate(rows.tolist())}
    for at in range(0, len(queries), TOGETHER):
        some = queries[at : at + TOGETHER]
        own = np.array([place.get(r, -1) for r in row[some].tolist()])
        scores, best = threshold_walk(c, v[some], own, k)
        for j, q in enumerate(some):
            hits = np.flatnonzero(best[j])
            hits = hits[np.lexsort((cand[hits], -scores[j, hits]))][:k]
            for column, x in zip(found, (np.full(len(hits), row[q]), np.full(len(hits), ids[q]), cand[hits], scores[j, hits].astype(np.int64)), strict=True):
                column.append(x)
    whole = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in found]
    return pa.table(whole, names=["query", "query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = BEST, tile_rows: int = ROWS, tile_queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries against rows, both from ``scaled``."""
    row_tiles, query_tiles = -(-rows.count() // tile_rows), -(-queries.count() // tile_queries)
    if not row_tiles or not query_tiles:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tile = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("*", F.lit(False).alias("asks"), tile(row_tiles).alias("row_tile"), every(query_tiles).alias("query_tile"))
    asked = queries.select("*", F.lit(True).alias("asks"), every(row_tiles).alias("row_tile"), tile(query_tiles).alias("query_tile"))
    tops = dealt.unionByName(asked).groupBy("size", "row_tile", "query_tile").applyInArrow(lambda t: _tile_top(t, k), FOUND)
    # Tasks keep k per query before the shuffle, so that few rows of each query meet.
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
