"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions and its norm. For an anchor ``a`` and a row ``x``, the angles
of both to one direction ``r`` bound the angle between them (triangle inequality on the sphere):

    |angle(a, r) - angle(x, r)| <= angle(a, x) <= min(s, 2 pi - s),  s = angle(a, r) + angle(x, r)

The tightest bounds over all directions give an interval of cosines and, times the norms, of scores, widened by more than
rounding can lose. A row whose interval lies outside every window of scores the anchor still looks at is never read; the
others get their exact integer score.

Rows are dealt into blocks and anchors into groups; each block meets each group in one task of bounded size. Positives
come first: a block gives each anchor its best of the same label. They fix the windows of the second round. Before it, one
slice of the rows shows how high the tenth best of each window reaches at least; what lies below is closed from then on, so
few rows leave a block. Both rounds are exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyseries.llm.frames import Written

#: Of the registered query: components times this, every so-manieth id is an anchor, labels move on where the id divides.
SCALE, ANCHOR_STEP, MOVED_STEP, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in hundredths of the positive's.
LEAST, MOST = 30, 90
#: Reference directions, and rows of each vector size that they are chosen from.
DIRECTIONS, SAMPLE = 12, 1024
#: Rows of a block, and anchors that meet it in one task.
BLOCK, ANCHORS = 8192, 512
#: One in so many blocks is searched first, for the floors of the windows.
PILOT = 16
#: Rows whose bounds are held against an anchor group at a time.
SLICE = 2048
#: By how much angles (radians) and scores (relative to the norms) may be off by rounding, with room to spare.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


def integer_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector, size, copies): floor(scale * x) of each component, equal rows once with their number.

    Left out are rows with a null id, label or vector, or with a null, NaN or infinite component.
    """
    x = F.col("vector")
    rows = rows.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
    )
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    rows = rows.select("vec_id", "label", whole.alias("vector"), F.size(x).alias("size"))
    return rows.groupBy("vec_id", "label", "vector", "size").agg(F.count(F.lit(1)).alias("copies"))


def moved_labels(rows: DataFrame, label_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    """``rows`` with the label one further, of ten, where the id divides by seven."""
    moved = F.when(F.col(id_col) % MOVED_STEP == 0, (F.col(label_col) + 1) % LABELS).otherwise(F.col(label_col))
    return rows.withColumn(label_col, moved)


def directions(vectors: np.ndarray, n: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors spread over the given ones: each the mean direction of those nearest to a row far from the others."""
    v = vectors.astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    v = v[np.isfinite(norm) & (norm > 0)] / norm[np.isfinite(norm) & (norm > 0), None]
    if not len(v):
        return np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    picked = [0]
    near = v @ v[0]
    while len(picked) < min(n, len(v)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    centres = v[picked]
    for _ in range(4):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def angles(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm, angles to each direction) of integer vectors; a vector without length has a right angle to all."""
    v = vectors.astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    cosine = (v @ centres.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(norm_a, angles_a, norm_x, angles_x) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, anchors by rows, of the integer scores; not a number where norms are beyond doubles."""
    least = np.zeros((len(norm_a), len(norm_x)))
    most = np.full(least.shape, np.pi)
    for k in range(angles_a.shape[1]):
        a, x = angles_a[:, k, None], angles_x[None, :, k]
        np.maximum(least, np.abs(a - x), out=least)
        total = a + x
        np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
    product = norm_a[:, None] * norm_x[None, :]
    room = product * SCORE_SLACK + 1
    high = product * np.cos(np.maximum(least - ANGLE_SLACK, 0)) + room
    low = product * np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) - room
    return low, high


def _matrix(table, name, kind=np.int64):
    values = table.column(name).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(table.num_rows, -1)


def _best(order_ids, scores, copies, k):
    """Places of the k best by score, then id, counting copies; and how many of each count."""
    order = np.lexsort((order_ids, -scores))
    if len(order) > k:
        order = order[:k]
    before = np.cumsum(copies[order]) - copies[order]
    order = order[before < k]
    return order, np.minimum(copies[order], k - before[before < k])


class Block:
    """Rows of one vector size, with norms and angles; anchors come as tables of the same kind."""

    def __init__(self, rows):
        self.ids, self.labels, self.copies = (rows.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
        self.vectors, self.norm, self.angles = _matrix(rows, "vector"), rows.column("norm").to_numpy(), _matrix(rows, "angles", np.float64)

    def sliced(self, anchors):
        """Bounds of all anchors with a slice of the rows: (first row, lower, upper)."""
        norm, angle = anchors.column("norm").to_numpy(), _matrix(anchors, "angles", np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            for at in range(0, len(self.ids), SLICE):
                yield at, *score_bounds(norm, angle, self.norm[at: at + SLICE], self.angles[at: at + SLICE])

    def positives(self, anchors, k: int):
        """Per anchor its k best of its label: (anchor place, row place, score, copies)."""
        ids, labels, vectors = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors, "vector")
        held = [(np.empty(0, np.int64),) * 2] * len(ids)
        floor = np.full(len(ids), -np.inf)
        for at, _, high in self.sliced(anchors):
            part = slice(at, at + SLICE)
            for q in range(len(ids)):
                open_ = at + np.flatnonzero((self.labels[part] == labels[q]) & ~(high[q] < floor[q]))
                if len(open_):
                    scores = self.vectors[open_] @ vectors[q]
                    places, scores = np.concatenate((held[q][0], open_)), np.concatenate((held[q][1], scores))
                    # One more than asked for: the anchor's own row does not count.
                    best, counted = _best(self.ids[places], scores, self.copies[places], k + 1)
                    held[q] = places[best], scores[best]
                    if counted.sum() > k:
                        floor[q] = scores[best[-1]]
        for q, (places, scores) in enumerate(held):
            for place, score in zip(places, scores):
                own = self.ids[place] == ids[q] and (self.vectors[place] == vectors[q]).all()
                copies = min(int(self.copies[place]) - own, k)
                if copies > 0:
                    yield q, place, int(score), copies

    def negatives(self, anchors, windows, k: int):
        """Per anchor and window its k best of other labels: (anchor place, window number, row place, score, copies).

        ``windows``: per anchor the (lowest, highest) scores that are still asked for.
        """
        labels, vectors = anchors.column("label").to_numpy(), _matrix(anchors, "vector")
        held = [[(np.empty(0, np.int64),) * 2 for _ in own] for own in windows]
        floors = [[low for low, _ in own] for own in windows]
        for at, low, high in self.sliced(anchors):
            part = slice(at, at + SLICE)
            for q, own in enumerate(windows):
                if not own:
                    continue
                overlap = np.zeros(low.shape[1], bool)
                for floor, (_, top) in zip(floors[q], own):
                    overlap |= ~(high[q] < floor) & ~(low[q] > top)
                open_ = at + np.flatnonzero(overlap & (self.labels[part] != labels[q]))
                if not len(open_):
                    continue
                exact = self.vectors[open_] @ vectors[q]
                for w, (floor, (_, top)) in enumerate(zip(floors[q], own)):
                    inside = (exact >= floor) & (exact <= top)
                    if inside.any():
                        places = np.concatenate((held[q][w][0], open_[inside]))
                        scores = np.concatenate((held[q][w][1], exact[inside]))
                        best, counted = _best(self.ids[places], scores, self.copies[places], k)
                        held[q][w] = places[best], scores[best]
                        if counted.sum() >= k:
                            floors[q][w] = int(scores[best[-1]])
        for q, own in enumerate(held):
            for w, (places, scores) in enumerate(own):
                for place, score in zip(places, scores):
                    yield q, w, place, int(score), min(int(self.copies[place]), k)


def _columns(rows, n):
    return [list(c) for c in zip(*rows)] or [[] for _ in range(n)]


def _positives(k):
    names = ["anchor_key", "vec_id", "score", "copies"]

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and anchors.num_rows:
            block, keys = Block(rows), anchors.column("anchor_key").to_pylist()
            found = [(keys[q], int(block.ids[place]), score, copies) for q, place, score, copies in block.positives(anchors, k)]
        return pa.table([pa.array(c, pa.int64()) for c in _columns(found, 4)], names=names)

    return search


def _negatives(k):
    names = ["anchor_key", "low", "high", "vec_id", "score", "copies"]

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and anchors.num_rows:
            block, keys = Block(rows), anchors.column("anchor_key").to_pylist()
            asked = [[(w["floor"], w["high"], w["low"]) for w in own] for own in anchors.column("windows").to_pylist()]
            search = block.negatives(anchors, [[w[:2] for w in own] for own in asked], k)
            found = [(keys[q], asked[q][w][2], asked[q][w][1], int(block.ids[place]), score, copies) for q, w, place, score, copies in search]
        return pa.table([pa.array(c, pa.int64()) for c in _columns(found, 6)], names=names)

    return search


def _with_angles(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with their norm and their angles to the directions of their size, stored beside them."""
    def add(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            vectors = batch.column("vector")
            norms, found = np.zeros(batch.num_rows), [[]] * batch.num_rows
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                part = vectors.take(pa.array(own))
                matrix = part.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                known = centres.get(int(size), np.zeros((0, int(size))))
                with np.errstate(invalid="ignore", over="ignore"):
                    norms[own], angle = angles(matrix, known)
                for place, row in zip(own, angle):
                    found[place] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norms), pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "norm", "angles"])

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(add, f"{fields}, norm double, angles array<double>")


def _directions_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Reference directions for each of the most frequent vector sizes, from ``SAMPLE`` rows of each by hash.

    Sizes beyond the 16 most frequent have none: their rows are all scored.
    """
    sizes = [r["size"] for r in rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(16).collect()]
    order = Window.partitionBy("size").orderBy(F.xxhash64("vec_id", "label", "vector"), "vec_id")
    drawn = rows.where(F.col("size").isin(sizes)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)
    found = drawn.select("size", "vector", "n").toPandas() if sizes else None
    if found is None:
        return {}
    return {int(size): directions(np.array(own.sort_values("n")["vector"].tolist(), np.int64).reshape(len(own), -1)) for size, own in found.groupby("size")}


def _deal(n, *columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors, of ``integer_rows``.

    An anchor's positives are the ``positives`` highest scores among the other rows of its label, ties by smaller id. For
    each, the ``negatives`` highest scores among rows of other labels with least * p <= 100 * n <= most * p come back,
    ranked from 1; ties by smaller id. Rows are compared with rows of their vector size. Scores are exact while they fit
    64 bits. Every row of a repeated id is a row of its own, also as candidate of its twin; equal rows are one anchor, and
    each of their copies counts as positive and negative. Anchors without positives or negatives give no row.
    """
    spark = rows.sparkSession
    written = Written(spark, "hard-negatives")
    stored = written.put(_with_angles(rows, _directions_of(rows)))
    n_rows, n_anchors = stored.count(), stored.where(is_anchor).count()
    blocks, groups = max(1, -(-n_rows // BLOCK)), max(1, -(-n_anchors // ANCHORS))
    whole_key = ("vec_id", "label", "vector")
    anchors = stored.where(is_anchor).withColumn("anchor_key", F.xxhash64(*whole_key))
    anchors = anchors.select("anchor_key", "vec_id", "label", "vector", "size", "norm", "angles", _deal(groups, "anchor_key").alias("asking"))
    dealt = stored.select("*", _deal(blocks, *whole_key).alias("block"))
    kept = ["vec_id", "label", "vector", "size", "copies", "norm", "angles"]

    def met(rows, anchors, keys, search, out):
        left = rows.select(*kept, *[k for k in keys if k not in kept], _every(groups).alias("asking"))
        key = [*keys, "asking", "size"]
        return left.groupBy(*key).cogroup(anchors.groupBy(*key)).applyInArrow(search, out)

    every_block = anchors.select("*", _every(blocks).alias("block"))
    mine = met(dealt, every_block, ["block"], _positives(positives), "anchor_key bigint, vec_id bigint, score bigint, copies bigint")
    best = Window.partitionBy("anchor_key").orderBy(F.desc("score"), "vec_id", "copy")
    mine = mine.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    mine = mine.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).select("anchor_key", F.col("vec_id").alias("positive_id"), "score", "n")
    mine = written.put(mine)

    # 100 n between least * p and most * p, in whole numbers; Spark's % has the sign of the first operand.
    ceiling = lambda x: F.ceil(x.cast("decimal(38,0)") / F.lit(100)).cast("bigint")
    floor = lambda x: F.floor(x.cast("decimal(38,0)") / F.lit(100)).cast("bigint")
    wide = F.col("score").cast("decimal(38,0)")
    spans = mine.select("*", ceiling(wide * least).alias("low"), floor(wide * most).alias("high")).where("low <= high")
    asked = spans.groupBy("anchor_key").agg(F.collect_set(F.struct("low", "high", F.col("low").alias("floor"))).alias("windows"))
    asked = written.put(anchors.join(asked, "anchor_key"))

    result = "anchor_key bigint, low bigint, high bigint, vec_id bigint, score bigint, copies bigint"
    top = Window.partitionBy("anchor_key", "low", "high").orderBy(F.desc("score"), "vec_id", "copy")

    def first_of(found):
        found = found.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
        return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= negatives).drop("copies", "copy")

    pilots = blocks // PILOT
    if pilots:
        block = F.col("block") < pilots
        seen = first_of(met(dealt.where(block), asked.select("*", _every(pilots).alias("block")), ["block"], _negatives(negatives), result))
        raised = seen.where(F.col("rank") == negatives).select("anchor_key", F.struct("low", "high", F.col("score").alias("floor")).alias("window"))
        raised = raised.groupBy("anchor_key").agg(F.collect_list("window").alias("raised"))
        same = lambda w: F.filter("raised", lambda r: (r["low"] == w["low"]) & (r["high"] == w["high"]))
        better = F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.get(same(w), 0)["floor"], w["floor"]).alias("floor")))
        asked = written.put(asked.join(raised, "anchor_key", "left").withColumn("windows", better).drop("raised"))
    found = first_of(met(dealt, asked.select("*", _every(blocks).alias("block")), ["block"], _negatives(negatives), result))
    named = spans.join(anchors.select("anchor_key", F.col("vec_id").alias("anchor_id")), "anchor_key")
    out = named.select("anchor_key", "low", "high", "anchor_id", "positive_id", F.col("score").alias("positive_score")).join(found, ["anchor_key", "low", "high"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
