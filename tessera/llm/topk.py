"""Exact top-k search by inner product, by columnar branch and bound.

Vectors lie in vertical layout, one array for each dimension. Blocks of dimensions are added up
for all candidates still alive; what a candidate can still gain is bounded by the product of
the remaining masses (the norms of the rest of query and candidate), and candidates that can't
reach the k-th best score known are compacted away before the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, discard

#: Queries that are searched for in one pass over the candidates; bounds what the driver and each task hold.
QUERY_BLOCK = 4096
#: Candidates that are laid out at a time, and dimensions added at a time.
CANDIDATES, DIMENSIONS = 4096, 16
#: Scores beyond a long are taken as the nearest one.
LEAST, MOST = -(2**63), 2**63 - 1
#: Products of smaller totals are exact in doubles.
EXACT = 2.0**53


def quantised(col, scale: int):
    """``floor(scale * x)`` of every component; null if the vector is, or has a null or non-finite one."""
    x = col.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return F.when(fine, whole)


def best(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int, own: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of at most ``k`` candidates (all ties of the last included) of one query that score ``floor`` or more.

    ``columns`` is dimensions x candidates; ``rest[b]`` are the candidates' norms from block b on.
    """
    dims = len(query)
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive))
    for b, at in enumerate(range(0, dims, DIMENSIONS)):
        part = columns[at : at + DIMENSIONS]
        score = score + query[at : at + DIMENSIONS] @ (part if len(alive) == part.shape[1] else part[:, alive])
        left = query[at + DIMENSIONS :]
        gain = np.sqrt(left @ left) * rest[b + 1][alive] * (1 + 1e-9)
        if len(alive) > k:
            low = score - gain
            floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        keep = score + gain >= floor
        if not keep.all():
            alive, score = alive[keep], score[keep]
    return ids[alive], score


def _searcher(queries: dict[int, list], k: int):
    """queries: by number of dimensions, ids and vectors."""
    blocks = {d: (np.array([q[0] for q in qs], np.int64), np.array([q[1] for q in qs], np.int64).reshape(len(qs), d)) for d, qs in queries.items()}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, np.ndarray] = {d: np.full(len(b[0]), -np.inf) for d, b in blocks.items()}
        tops: dict[tuple[int, int], list] = {}
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for d, (query_ids, vectors) in blocks.items():
                part = batch[sizes == d]
                for at in range(0, len(part), CANDIDATES):
                    ids = part["id"].to_numpy()[at : at + CANDIDATES]
                    whole = np.stack(part["v"].to_numpy()[at : at + CANDIDATES]).astype(np.int64).reshape(len(ids), d)
                    peak = float(np.abs(whole.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * max(d, 1)
                    columns = np.ascontiguousarray(whole.T.astype(float))
                    rest = [np.sqrt((columns[b:] ** 2).sum(axis=0)) for b in range(0, d, DIMENSIONS)] + [np.zeros(len(ids))]
                    for q in range(len(query_ids)):
                        own, key = int(query_ids[q]), (d, q)
                        if peak < EXACT:
                            found, score = best(vectors[q].astype(float), ids, columns, rest, k, own, floors[d][q])
                            score = score.astype(np.int64).tolist()
                        else:  # totals that doubles can't hold: whole numbers of any size
                            found = ids[ids != own]
                            score = [min(max(sum(int(a) * int(b) for a, b in zip(vectors[q], w, strict=True)), LEAST), MOST) for w in whole[ids != own]]
                        if len(found):
                            top = sorted([*tops.get(key, ()), *zip(score, found.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                            tops[key] = top
                            if len(top) == k:
                                floors[d][q] = top[-1][0]
        rows = [(int(blocks[d][0][q]), i, s) for (d, q), top in tops.items() for s, i in top]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` for each row of ``queries``.

    The score is the inner product of the vectors' ``floor(scale * x)``, ties go to the smaller
    id, and a row of the query's own id is no candidate. Vectors that are null or hold a null or
    non-finite component, and rows of a null id, take no part; only vectors of as many dimensions
    are compared. Rows that repeat an id are candidates of their own; queries that repeat an id
    are one query each by its first vector. Components and scores that a long can't hold are taken as
    the nearest that it can. With fewer candidates all are returned.

    Queries are taken in blocks of about ``QUERY_BLOCK``, one after the other: each block, held by
    the driver and every task while it lasts, passes over all candidates, and each task's ``k`` best
    for each of its queries are written before the next block is read.
    """
    spark = vectors.sparkSession
    shaped = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    asked = cut(shaped(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    parts = -(-asked.count() // QUERY_BLOCK)
    schema = "query_id bigint, vec_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        block: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect():
            block.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        if block:
            found = found.union(cut(shaped(vectors).mapInPandas(_searcher(block, k), schema), "best"))
    discard(asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
