"""Exact top-k search by inner product with vector-approximation files.

Vectors are dealt into blocks. A block keeps, beside the vectors, each component's cell among ``CELLS`` equal ones between
the block's smallest and largest value. A query scans the cells, gets a lower and an upper bound of every score, and
reads vectors in the order of their bounds until no unread vector can reach the kth best score. One in some blocks is
searched first: the kth best score there is a floor for all others, most of which then have nothing to give.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyseries.llm.frames import Written

#: Of the registered query: components times this, every so-manieth id asks, so many come back.
SCALE, QUERY_STEP, K = 1024, 100, 10
CELLS = 16
#: Vectors of a block, and queries that meet a block in one task, on average.
BLOCK = 8192
QUERIES = 8192
#: One in so many blocks is searched first.
PILOT = 16
#: Exact vectors that a query reads at first; then twice as many each time.
READ = 32
#: Queries whose bounds a task holds at a time.
SLICE = 256


class ApproximationFile:
    """``vectors``: int64 (n, d). Bounds come from the cells alone."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low = vectors.min(axis=0) if len(vectors) else np.zeros(vectors.shape[1], np.int64)
        high = vectors.max(axis=0) if len(vectors) else self.low
        self.width = (high - self.low) // CELLS + 1
        self.cells = ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each vector."""
        low = (self.low + self.cells * self.width).astype(np.float64)
        high = low + (self.width - 1)
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        # Sums beyond 2**53 are rounded, by a share of the sum of their absolute terms.
        slack = (up - down) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-13
        return least - slack, most + slack

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, id and score of its k best vectors; ties go to smaller ids, its own row is no candidate.

        Vectors below a query's floor are left out. Of rows equal to the query one is its own.
        """
        found = ([], [], [])
        for place, own in enumerate(query_ids):
            q = place % SLICE
            if not q:
                least, most = self.bounds(queries[place: place + SLICE])
            alike = np.flatnonzero(self.ids == own)
            alike = alike[(self.vectors[alike] == queries[place]).all(axis=1)][:1]
            open_ = np.delete(np.arange(len(self.ids)), alike)
            if floors is not None:
                open_ = open_[most[q, open_] >= floors[place]]
            if len(open_) > k:
                floor = np.partition(least[q, open_], len(open_) - k)[len(open_) - k]
                open_ = open_[most[q, open_] >= floor]
            open_ = open_[np.lexsort((self.ids[open_], -most[q, open_]))]
            scores, read, step = np.empty(0, np.int64), 0, READ
            best = np.empty(0, np.int64)
            while read < len(open_):
                if read >= k:
                    # Bounds fall from here on; among equal bounds, ids rise.
                    last, bound = best[k - 1], most[q, open_[read]]
                    if bound < scores[last] or (bound == scores[last] and self.ids[open_[read]] > self.ids[open_[last]]):
                        break
                scores = np.concatenate((scores, self.vectors[open_[read: read + step]] @ queries[place]))
                read, step = read + step, 2 * step
                best = np.lexsort((self.ids[open_[: len(scores)]], -scores))[:k]
            best = best[:k]
            if floors is not None:
                best = best[scores[best] >= floors[place]]
            found[0].append(np.full(len(best), place))
            found[1].append(self.ids[open_[best]])
            found[2].append(scores[best])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def _search(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        def matrix(rows):
            values = rows.column("vector").combine_chunks()
            return values.flatten().to_numpy().reshape(rows.num_rows, -1)

        names, types = ["query_id", "query_key", "vec_id", "score"], [pa.int64()] * 4
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        ids, keys = queries.column("vec_id").to_numpy(), queries.column("query_key").to_numpy()
        file, floors = ApproximationFile(vectors.column("vec_id").to_numpy(), matrix(vectors)), queries.column("floor").to_numpy()
        place, found, score = file.search(ids, matrix(queries), k, floors)
        return pa.table([ids[place], keys[place], found, score], names=names)

    return search


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector, size): floor(scale * x) of each component; rows that take no part are left out.

    Left out are null ids, null vectors, and vectors with a null, NaN or infinite component.
    """
    x = F.col("vector")
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vector"), F.size(x).alias("size")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors of its size.

    Both frames are as ``integer_vectors`` makes them. Fewer than k come back if there are no more; ties go to the
    smaller id; a query's own row is no candidate, other rows with its id are; every row of a repeated id is a candidate
    of its own, and equal query rows are one query, to which their copies are candidates. Scores are exact while they fit
    64 bits.

    All queries have to meet all vectors. Each block of vectors meets each group of queries in one task of bounded size;
    blocks and groups follow the numbers of rows. The first blocks give each query a floor, so that only rows which may be
    among its best leave the others.
    """
    blocks = max(1, -(-vectors.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERIES))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = vectors.select("vec_id", "vector", "size", deal(blocks, "vec_id", "vector").alias("block"))
    asked = queries.dropDuplicates(["vec_id", "vector"]).withColumn("query_key", F.xxhash64("vector"))
    asked = asked.select("vec_id", "query_key", "vector", "size", deal(groups, "vec_id", "vector").alias("asking"))
    key = ["block", "asking", "size"]
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))

    def best(stored, asked, n_blocks):
        rows = stored.select("vec_id", "vector", "size", "block", every(groups).alias("asking"))
        out = "query_id bigint, query_key bigint, vec_id bigint, score bigint"
        found = rows.groupBy(*key).cogroup(asked.select("*", every(n_blocks).alias("block")).groupBy(*key)).applyInArrow(_search(k), out)
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    lowest = F.lit(-(2**63)).cast("bigint")
    pilots = blocks // PILOT
    if pilots:
        first = best(dealt.where(F.col("block") < pilots), asked.withColumn("floor", lowest), pilots)
        floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("query_key").alias("key"), F.col("score").alias("floor"))
        same = (F.col("vec_id") == F.col("of")) & (F.col("query_key") == F.col("key"))
        written = Written(vectors.sparkSession, "floors")
        known = asked.join(written.put(floors), same, "left").drop("of", "key")
        asked = written.put(known.withColumn("floor", F.coalesce("floor", lowest)))
    else:
        asked = asked.withColumn("floor", lowest)
    return best(dealt, asked, blocks).select("query_id", "rank", "vec_id", "score")
