"""Approximate nearest neighbours by collision counting.

Each of M random projections holds the vectors of a data block in sorted order. A query opens a window around its own projection on each
of these arrays, between two places found by binary search; a vector collides if its own place lies between them. Virtual rehashing widens all windows round by round by the factor WIDEN. A vector that lies in at least THRESHOLD of the
windows has collided often enough and is verified: its cosine is computed on the original vector in double precision. A query
stops in a block when its windows are as wide as SAFE times its k-th best distance. On vectors without clusters about a sixth of a block is
verified so, at a recall of 0.988 of the 5 nearest of all.

Queries meet every block: a query block and a data block make one task, so memory is bounded by the two, whatever the tables hold.
The table goes out once for each QUERY_BLOCK queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.storage import slots, written

#: Projections, and the share of windows that a vector must lie in.
M, THRESHOLD = 256, 0.6
#: First half-width of a window on unit vectors (in standard deviations of a projection of a difference), its growth, and rounds at most.
FIRST, WIDEN, ROUNDS = 0.5, 1.2, 10
#: A query stops at a radius beyond SAFE times its k-th best distance.
SAFE = 0.8
#: Vectors in a data block, queries in a query block, queries whose windows are laid at once, and pairs verified at once.
DATA_BLOCK, QUERY_BLOCK, LAID, PAIRS = 2048, 8192, 128, 1 << 14
SEED = 7


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best found in the block: (number of the query, rows of ``data``, cosines)."""
    n, d = data.shape
    norm, qnorm = (np.sqrt((x * x).sum(1)) for x in (data, queries))
    lines = np.random.default_rng(SEED).standard_normal((d, M))
    at, qat = (data / norm[:, None]) @ lines, (queries / qnorm[:, None]) @ lines  # a difference is the distance times a standard normal number
    kind = np.uint16 if n < 1 << 16 else np.uint32
    order = np.argsort(at, axis=0, kind="stable")
    place = np.empty((M, n), kind)  # of each vector in each sorted array
    np.put_along_axis(place, order.T, np.arange(n, dtype=kind)[None, :], 1)
    sorted_ = np.take_along_axis(at, order, 0).T.copy()
    need, widths = int(np.ceil(THRESHOLD * M)), FIRST * WIDEN ** np.arange(ROUNDS)
    for first in range(0, len(queries), LAID):
        asks = np.arange(first, min(first + LAID, len(queries)))
        seen, cosines = ids[None, :] == own[asks, None], np.full((len(asks), n), -np.inf)
        active = np.arange(len(asks))

        def verify(q: np.ndarray, row: np.ndarray) -> None:
            seen[q, row] = True
            for x in range(0, len(q), PAIRS):
                i, j = asks[q[x : x + PAIRS]], row[x : x + PAIRS]
                cosines[q[x : x + PAIRS], j] = (data[j] * queries[i]).sum(1) / (norm[j] * qnorm[i])  # noqa: B023

        for w in widths:
            near = qat[asks[active]]
            gap, inside = np.empty((len(active), n), kind), np.empty((len(active), n), bool)
            hits, some = np.zeros((len(active), n), np.uint16), np.zeros((len(active), n), np.uint8)
            for j in range(M):
                if j and j % 255 == 0:  # what a byte can count
                    hits += some
                    some[:] = 0
                low = np.searchsorted(sorted_[j], near[:, j] - w, "left").astype(kind)[:, None]
                size = np.searchsorted(sorted_[j], near[:, j] + w, "right").astype(kind)[:, None] - low
                np.subtract(place[j], low, out=gap)  # below the window's lower end the unsigned difference is huge
                np.add(some, np.less(gap, size, out=inside).view(np.uint8), out=some)
            hits += some
            q, row = np.nonzero((hits >= need) & ~seen[active])
            verify(active[q], row)
            if n >= k:
                kth = np.partition(cosines[active], n - k, axis=1)[:, n - k]
                # A vector at distance s lies in a window of half-width w with probability erf(w / s / sqrt 2), THRESHOLD at w = 0.84 s.
                active = active[~(w >= SAFE * np.sqrt(np.maximum(0.0, 2 - 2 * kth)))]
            if not len(active):
                break
        few = np.flatnonzero((cosines > -np.inf).sum(1) < k)  # too few collided: the block's others, exactly
        q, row = np.nonzero(~seen[few])
        verify(few[q], row)
        for i in range(len(asks)):
            rows = np.flatnonzero(cosines[i] > -np.inf)
            best = np.lexsort((ids[rows], -cosines[i, rows]))[:k]
            yield first + i, rows[best], cosines[i, rows[best]]


def searched(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding) -> (query_id, rank, vec_id, score): each query's ``k`` nearest by cosine.

    ``queries``: by default the rows whose vec_id is divisible by 50. A row with the query's own vec_id is no candidate for it; with fewer
    than k candidates all are returned; ties go to the smaller vec_id. Vectors that are null or zero, or hold a null or a number that is not
    finite, take no part; neither do rows without vec_id, nor vectors of another dimension than the query's. Repeated rows with one
    vec_id and vector count once; of a vec_id with several vectors the nearest counts, as candidate and as query. Empty tables give an
    empty result.
    """
    good = lambda t: t.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = good(queries if queries is not None else vectors.where("vec_id % 50 = 0"))
    data = good(vectors)
    if not (n_data := data.count()) or not (n_queries := asked.count()):
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_blocks, n_lots = -(-n_data // data_block), -(-n_queries // query_block)
    # Every (data block, lot of queries) is a task: vectors go to each lot, queries to each block.
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
    lot = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_lots))
    left = data.withColumn("block", block).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lots - 1).cast("long"))))
    right = asked.withColumn("lot", lot).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    rows = left.select("block", "lot", F.lit(False).alias("asks"), "vec_id", "v").unionByName(right.select("block", "lot", F.lit(True).alias("asks"), "vec_id", "v"))
    n = max(slots(data.sparkSession), n_blocks * n_lots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            for dim in sorted({len(v) for _, _, v in held}):
                ids, vs = _unique([(i, v) for a, i, v in held if not a and len(v) == dim])
                own, qs = _unique([(i, v) for a, i, v in held if a and len(v) == dim])
                if len(ids) and len(own):
                    for q, at, cos in nearest(vs, ids, qs, own, k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own[q])), pa.array(ids[at]), pa.array(cos)], names=["query_id", "vec_id", "score"])

        now, held = None, []
        for b in batches:
            lists = b.column("v")
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (x, y, asks, vec) in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "lot", "asks", "vec_id")), strict=True)):
                if (x, y) != now:
                    yield from found()
                    now, held = (x, y), []
                held.append((asks, vec, values[at[i] : at[i + 1]].copy()))
        yield from found()

    near = rows.repartition(n, "block", "lot").sortWithinPartitions("block", "lot").mapInArrow(run, "query_id long, vec_id long, score double")
    near = written(near, "ann-near").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unique(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Repeated rows once. Of one vec_id with several vectors each stays."""
    kept = {(i, v.tobytes()): (i, v) for i, v in rows}
    ordered = [kept[x] for x in sorted(kept)]
    return np.array([i for i, _ in ordered], np.int64), np.array([v for _, v in ordered], float).reshape(len(ordered), -1)
