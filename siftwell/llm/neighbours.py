"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of length one are hashed by `TABLES` tables of `HASHES` functions floor((a . x + b) / w) with Gaussian a. A query
visits its own bucket and `PROBES` perturbed ones of each table in the order of their estimated success: functions are
ranked by how near the query lies to a border of its slot, and sets of perturbations by the expected squared distances
of these ranks. Candidates of all tables are merged and ranked by exact cosine in double precision.

Rows are dealt to shards of about `SHARD` rows; each has its tables in memory. Queries meet the shards in blocks of at most
`QUERIES`, and only a shard's k nearest go on, so neither a crowded bucket nor copies of one vector ever become pairs.
A query that finds fewer than k candidates in a shard looks at all of that shard's rows.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part, nor do rows without an id. Rows with the query's id are not its neighbours; rows that repeat an id and
vector count once. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.plans.staging import ship_package, stage

TABLES, HASHES, WIDTH, PROBES, SHARD, QUERIES = 12, 8, 2.0, 60, 16_384, 4_096


def perturbations(hashes: int, probes: int) -> np.ndarray:
    """Sets of ranks (0: the nearest border of any function) by expected score; a row of 0 and 1 for each set.

    Ranks r and 2 * hashes - 1 - r are the two borders of one function, so no set holds both.
    """
    m = hashes
    near = np.arange(1, m + 1)
    score = np.concatenate([near * (near + 1) / (4 * (m + 1) * (m + 2)), (1 - (near[::-1]) / (m + 1) + near[::-1] * (near[::-1] + 1) / (4 * (m + 1) * (m + 2)))])
    rows, heap = [np.zeros(2 * m, np.int64)], [(score[0], (0,))]
    while heap and len(rows) <= probes:
        total, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            row = np.zeros(2 * m, np.int64)
            row[list(ranks)] = 1
            rows.append(row)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*ranks, last + 1)))
    return np.array(rows)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine): the k nearest rows that each query's probes find among x."""
    rng = np.random.default_rng(8)
    lengths, query_lengths = np.sqrt((x * x).sum(1)), np.sqrt((queries * queries).sum(1))
    unit, query_unit = x / lengths[:, None], queries / query_lengths[:, None]
    sets = perturbations(hashes, probes)
    at = []
    for _ in range(tables):
        a, b = rng.normal(size=(x.shape[1], hashes)), rng.uniform(0, width, hashes)
        r = rng.integers(1, 1 << 62, hashes) | 1
        codes = np.floor((unit @ a + b) / width).astype(np.int64) @ r
        order = np.argsort(codes, kind="stable")
        slot = (query_unit @ a + b) / width
        low = np.floor(slot)
        down = slot - low
        # Borders by distance; moving over the lower one takes one from the slot's number.
        moves = np.argsort(np.concatenate([down, 1 - down], 1), axis=1)
        step = np.take_along_axis(np.tile(np.concatenate([-r, r]), (len(queries), 1)), moves, 1)
        probe = (low.astype(np.int64) @ r)[:, None] + step @ sets.T
        codes = codes[order]
        at.append((order, np.searchsorted(codes, probe, "left"), np.searchsorted(codes, probe, "right")))
    out = []
    for q in range(len(queries)):
        seen = np.zeros(len(x), bool)
        for order, first, last in at:
            for i, j in zip(first[q], last[q]):
                if j > i:
                    seen[order[i:j]] = True
        found = np.flatnonzero(seen & (ids != query_ids[q]))
        if len(found) < k:
            found = np.flatnonzero(ids != query_ids[q])
        cosine = (x[found] * queries[q]).sum(1) / (lengths[found] * query_lengths[q])
        best = np.lexsort((ids[found], -cosine))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[found][best], cosine[best]))
    return tuple(np.concatenate(c) if out else np.zeros(0) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    ship_package(spark)
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    rows = stage(rows.where(F.size("v") == (sizes["d"] if sizes else 0)).dropDuplicates(["vec_id", "v"]), "ann-rows")
    total = rows.count()
    shards = max(1, -(-total // SHARD))
    asked = F.col("vec_id") % every == 0
    blocks = max(1, -(-rows.where(asked).count() // QUERIES))
    # Each shard meets each block of queries; both sides are rows of the grid's cells.
    side = F.sequence(F.lit(0), F.lit(blocks - 1))
    index = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).alias("shard"), F.explode(side).alias("block"))
    queries = rows.where(asked).select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))

    def cell(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        q, n, s = search(data["vec_id"].to_numpy(), np.stack(data["v"].to_list()), asks["vec_id"].to_numpy(), np.stack(asks["v"].to_list()), k)
        return pd.DataFrame({"query_id": q, "vec_id": n, "score": s})

    found = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(cell, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
