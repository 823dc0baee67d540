"""Exact top-k by inner product, with bounds from segment means and deviations at several resolutions.

A vector is cut into segments of equal length. With each segment's mean m and deviation s, the squared
distance of q and x is at least the sum over segments of length * ((mq - mx)^2 + (sq - sx)^2), so their
inner product is at most the sum of length * (mq mx + sq sx). Bounds go from coarse to fine; a candidate
that falls below the k-th score so far is dropped, and survivors get their exact integer score.

Rows stay where they are: blocks of queries of bounded size go to all tasks, one block after another, each
query with a score that its k-th best reaches at least, from a bounded sample of the rows. A task sends
its k best rows of each query, and only those are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

#: Bytes of the vectors of a block of queries; rows of the sample for first scores; rows compared at once; segments of each resolution, coarse to fine.
QUERY_BYTES, SAMPLE, ROWS, SEGMENTS = 16_000_000, 4096, 4096, (4, 16, 32, 48, 96, 192, 384, 768, 1536)
#: Components beyond this are scored with Python's integers, as their products may leave 64 bits.
SAFE = 1 << 24


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that the product of two rows bounds their inner product from above."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    spread = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cuts[:-1], axis=1) / size, 0))
    return np.concatenate([mean, spread], axis=1) * np.sqrt(np.concatenate([size, size]))


class Rows:
    """Vectors of one length, whole numbers as doubles, with what bounds need."""

    def __init__(self, x: np.ndarray):
        self.x, self.whole = x, None
        self.large = not x.shape[1] or np.abs(x).max(initial=0) > SAFE
        if not self.large:
            self.whole = x.astype(np.int64)
            self.levels = [statistics(x, s) for s in SEGMENTS if s < x.shape[1]]
            self.length = np.linalg.norm(x, axis=1)


def scored(q: Rows, i: int, x: Rows, places: np.ndarray) -> list[int]:
    """Exact scores of query i with rows at places."""
    if q.large or x.large:
        one = [int(c) for c in q.x[i]]
        return [sum(a * int(c) for a, c in zip(one, x.x[j])) for j in places]
    return (x.whole[places] @ q.whole[i]).tolist()


def survivors(q: Rows, i: int, x: Rows, least: float) -> list[np.ndarray]:
    """After each resolution, the places of the rows whose score with query i may be least or more."""
    out = [np.arange(len(x.x))]
    if q.large or x.large:
        return out
    # rounding of the bounds is far below this share of the product of the lengths
    room = 1e-9 * x.length.max(initial=0) * (1 + q.length[i]) + 1e-6
    for a, b in zip(q.levels, x.levels):
        left = out[-1]
        bound = (b if len(left) == len(b) else b[left]) @ a[i]
        out.append(left[bound + room >= least])
    return out


def best(q: Rows, x: Rows, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, list]]:
    """For each query the places and scores of the k best rows (ties to the smaller id), of those that reach least."""
    out = []
    for i in range(len(q.x)):
        floor = -np.inf if least is None else least[i]
        if not x.large and not q.large and x.levels and len(x.x) > k:
            # the k rows of largest coarse bound give a k-th score
            bound = x.levels[0] @ q.levels[0][i]
            first = np.argpartition(-bound, k - 1)[:k]
            floor = max(floor, min(scored(q, i, x, first)))
        left = survivors(q, i, x, floor)[-1]
        score = scored(q, i, x, left)
        order = sorted((j for j in range(len(left)) if score[j] >= floor), key=lambda j: (-score[j], ids[left[j]]))[:k]
        out.append((left[order], [score[j] for j in order]))
    return out


def vectors_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of an array of lists: by length, the places and floor(256 * x) of the lists of that length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[int(n)] = at, flat[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))
    return out


FOUND = "query_row long, query_id long, own long, vec_id long, score long"


def found(asked, k: int):
    """From rows (id, raw): the k best of this task for each query. asked: by length of vectors, (numbers, ids, vectors, least scores) of queries."""

    def clip(s: int) -> int:
        return max(-(1 << 63), min((1 << 63) - 1, s))

    def f(batches):
        queries = {n: (row, own_id, Rows(v), least.copy()) for n, (row, own_id, v, least) in asked.value.items()}
        kept: dict[tuple[int, int], list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for n, (at, v) in vectors_of(batch.column(1)).items():
                if n not in queries:
                    continue
                _, _, q, least = queries[n]
                for a in range(0, len(at), ROWS):
                    of = ids[at[a : a + ROWS]]
                    for i, (places, scores) in enumerate(best(q, Rows(v[a : a + ROWS]), of, k, least)):
                        if scores:
                            mine = sorted(kept.get((n, i), []) + [(-s, int(of[j])) for j, s in zip(places, scores)])[:k]
                            kept[n, i] = mine
                            if len(mine) == k:
                                least[i] = max(least[i], float(-mine[-1][0]))
        rows = []
        for (n, i), mine in kept.items():
            row, own_id, q, _ = queries[n]
            own = clip(scored(q, i, q, np.array([i]))[0])
            rows += [(int(row[i]), int(own_id[i]), own, j, clip(-s)) for s, j in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["query_row", "query_id", "own", "vec_id", "score"])

    return f


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k highest integer inner products with every other row.

    Components become floor(256 * x). Rows with a null id or vector, or a null or non-finite component,
    take no part; vectors meet those of their own length only. Ties go to the smaller id. Rows that
    repeat an id stay apart: a query leaves out one row, its own. Scores beyond 64 bits are clipped, and tie.
    """
    spark = vectors.sparkSession
    raw = F.col(embedding).cast("array<double>")
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), raw.alias("raw"), F.coalesce(queries, F.lit(False)).alias("q")).where("id IS NOT NULL AND raw IS NOT NULL").where(finite)
    asking = written(rows.where("q").select("id", "raw", F.monotonically_increasing_id().alias("row")), "queries")
    size = asking.agg(F.coalesce(F.sum(F.size("raw") + 2), F.lit(0))).first()[0]
    blocks = max(1, -(-8 * size // QUERY_BYTES))
    some = vectors_of(rows.select("id", "raw").limit(SAMPLE).toArrow().column("raw"))
    some = {n: Rows(v) for n, (_, v) in some.items()}
    parts = None
    for b in range(blocks):
        block = asking.where(F.pmod("row", F.lit(blocks)) == b).toArrow()
        asked = {}
        for n, (at, v) in vectors_of(block.column("raw")).items():
            least = np.full(len(at), -np.inf)
            if n in some and len(some[n].x) > k:
                of = Rows(v)
                # the query's own row may be in the sample or not: k + 1 rows of which it is one at most
                every = np.arange(len(some[n].x))
                for i in range(len(at)):
                    score = scored(of, i, some[n], every)
                    least[i] = sorted(score)[-k - 1] if of.large or some[n].large else np.partition(score, -k - 1)[-k - 1]
            asked[n] = block.column("row").to_numpy()[at], block.column("id").to_numpy()[at], v, least
        shared = spark.sparkContext.broadcast(asked)
        part = written(rows.select("id", "raw").mapInArrow(found(shared, k + 1), FOUND), "best")
        shared.destroy()
        parts = part if parts is None else parts.union(part)
    discard(asking)
    # a query's own row is one with its id and its own product; where it is not among the k + 1 best there is nothing to leave out
    per = Window.partitionBy("query_row")
    order = per.orderBy(F.desc("score"), "vec_id")
    own = F.col("vec_id") == F.col("query_id")
    own = own & (F.col("score") == F.col("own"))
    best_of = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).withColumn("own_at", F.min(F.when(own, F.col("rank"))).over(per))
    ranked = best_of.where("own_at IS NULL OR rank != own_at").withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("own_at"), 1).otherwise(0))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]))::BIGINT AS score
 FROM v q JOIN v x ON q.rid <> x.rid AND len(q.e) = len(x.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
