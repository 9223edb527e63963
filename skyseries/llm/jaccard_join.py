"""Jaccard join of word shingles by T-occurrence search, with components of linked documents.

Two texts link when their shingle sets overlap by ``PERCENT`` of their union or more, so the overlap is at least that
share of the larger set. The work is kept near-linear by five steps, each of which loses no link:

1. Texts with equal sets form a class, named by a hash of its set, so that no text has to move to find its copies.
2. Shingles have one global order, by hash. Of the n shingles of a class only the first n - T + l are looked at, T being
   the least overlap with any partner and l a tenth of n: linked classes share at least l of them (of the smaller l).
   Hash buckets drop every shingle that one class alone holds, and then every class with fewer than l left, twice.
3. An inverted list with more than ``LONG_LIST`` classes is long. A class with fewer than l long lists leaves them out:
   with a partner it still shares a short one. This is where passages common to millions of documents drop out.
4. Each list names its smallest class as centre; classes go once to each centre of their lists, so linked classes meet.
   A block above ``BLOCK`` classes is dealt out over several tasks.
5. In a block, each class in turn asks the inverted lists of whole sets: the shortest lists are merged and counted, the
   few longest ones are left to binary probes of the candidates (DivideSkip). What reaches the overlap links. Links
   inside one component are not asked again.

Blocks of several tasks are settled in two rounds: within each task, then only classes outside the block's largest
component against all its tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyseries.llm import words as W
from skyseries.llm.components import connected
from skyseries.llm.frames import Written, by_bytes

SHINGLE = 5
PERCENT = 80
#: More classes than this make an inverted list long.
LONG_LIST = 256
#: Classes of one block that a task takes at a time.
BLOCK = 2048
#: Shingles of a hash bucket, on average.
BUCKET = 250_000
#: Within one batch of documents, a shingle of more documents than this is dealt out over tasks by itself.
BATCH_HOT = 16


def least_overlap(n, percent: int = PERCENT):
    """Of a set of n with any partner: the overlap is at least this share of the larger set."""
    return -(-n * percent // 100)


def _least_shared(n):
    return np.maximum(1, n // 10)


def shingle_sets(texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a string column; A-Z count as a-z.

    A text of fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    found = W.Words(*W.utf8(texts))
    hashes = found.hashes(lower=True)
    runs = W.windows(hashes, size)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a: b - size + 1]))
        elif b > a:
            short = hashes[a:b] * W.PLACES[: b - a]
            out.append(W.mix(short.sum(dtype=np.uint64, keepdims=True), 1000 + int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each class of equal sets."""
    return np.array([W.mix(s, 2).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, hi, node): the size of each set and 128 bits that equal sets alone share."""

    def signed(batches):
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column(1), size)
            high = np.array([W.mix(s, 1).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(_names(sets))],
                names=["doc_id", "n_shingles", "hi", "node"],
            )

    return docs.mapInArrow(signed, "doc_id bigint, n_shingles bigint, hi bigint, node bigint")


def with_classes(docs: DataFrame, names: list[str], text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the class of each row's text, as ``signatures`` gives it, in three columns of these names."""

    def classed(batches):
        for batch in by_bytes(batches, text_col):
            sets = shingle_sets(batch.column(text_col), size)
            high = np.array([W.mix(s, 1).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(_names(sets))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *names])

    return docs.mapInArrow(classed, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def _prefixes(docs: DataFrame, buckets: int, size: int, percent: int) -> DataFrame:
    """The leading shingles of every class, packed by bucket and batch of documents; a class counts once in a batch.

    A row holds class ids, and per shingle 32 bits of it and the place of its class. A shingle that many classes of one
    batch share leaves a mark in its bucket; its other holders go to one of as many further groups, dealt out by batch,
    so that a shingle of a third of all classes does not meet in one task.
    """

    def packed(batches):
        for batch in by_bytes(batches, "text", 8 << 20):
            sets = [s for piece in by_bytes([batch], "text") for s in shingle_sets(piece.column(0), size) if len(s)]
            nodes, first = np.unique(_names(sets), return_index=True)
            sets = [sets[i] for i in first]
            lead = [s[: len(s) - least_overlap(len(s), percent) + int(_least_shared(len(s)))] for s in sets]
            owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), [len(s) for s in lead])
            if not lead:
                continue
            token = np.concatenate(lead)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(heads, len(token)))
            first = np.zeros(len(token), bool)
            first[heads] = True
            hot = np.repeat(count > BATCH_HOT, count)
            # The order of the shingles is that of all their bits; the low ones choose the bucket, others name them in it.
            bucket, name = (token & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), (token >> np.uint64(16)).astype(np.uint32)
            spread = -1 - int(W.mix(nodes[:1].astype(np.uint64))[0] % np.uint64(buckets))
            rows = []
            for places, apart in ((np.flatnonzero(~hot | first), False), (np.flatnonzero(hot & ~first), True)):
                places = places[np.argsort(bucket[places], kind="stable")]
                cuts = np.flatnonzero(np.diff(bucket[places])) + 1
                for own in np.split(places, cuts) if len(places) else ():
                    used, place = np.unique(owner[own], return_inverse=True)
                    number = int(bucket[own[0]])
                    packs = (nodes[used].astype("<i8"), name[own].astype("<u4"), place.astype("<u4"), np.packbits(hot[own]))
                    rows.append((spread if apart else number, number, *(p.tobytes() for p in packs)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(6)],
                names=["deal", "bucket", "nodes", "names", "places", "marks"],
            )

    return docs.mapInArrow(packed, "deal int, bucket int, nodes binary, names binary, places binary, marks binary")


def _shared(rows: pa.Table) -> pa.Table:
    """(token, node) for the shingles of one bucket that two classes or more hold, and for all that come marked."""
    token, node, mark = [], [], []
    for bucket, own, name, place, marks in zip(*(rows.column(c).to_pylist() for c in ("bucket", "nodes", "names", "places", "marks"))):
        name = np.frombuffer(name, "<u4")
        token.append((np.int64(bucket) << np.int64(32)) + name.astype(np.int64))
        node.append(np.frombuffer(own, "<i8")[np.frombuffer(place, "<u4")])
        mark.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(name)).astype(bool))
    token, node, mark = (np.concatenate(x) for x in (token, node, mark))
    order = np.lexsort((node, token))
    token, node, mark = token[order], node[order], mark[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    other = new | np.concatenate(([True], node[1:] != node[:-1]))
    heads = np.flatnonzero(new)
    several = (np.add.reduceat(other.astype(np.int64), heads) > 1) | np.logical_or.reduceat(mark, heads)
    keep = several[np.cumsum(new) - 1] & other
    return pa.table({"token": token[keep], "node": node[keep]})


class _Forest:
    """Union-find over places; ``links`` are the joins that were made."""

    def __init__(self, n: int):
        self.above, self.left, self.links = np.arange(n), n, []

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def roots(self) -> np.ndarray:
        above = self.above
        while (up := above[above]).tobytes() != above.tobytes():
            above = up
        self.above = above
        return above

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.above[max(a, b)] = min(a, b)
            self.left -= 1
            self.links.append((i, j))


def t_occurrence(sets: list[np.ndarray], percent: int = PERCENT, asking: np.ndarray | None = None, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets that are connected by links; a link inside a component already joined is left out.

    ``asking`` marks the sets that ask (all by default); ``same`` gives sets with an equal number as joined beforehand.
    Each asking set merges the inverted lists of its shingles, smallest lists first, and leaves the longest ones, fewer
    than its least overlap, to binary probes of the candidates.
    """
    sizes = np.array([len(s) for s in sets])
    forest = _Forest(len(sets))
    if same is not None:
        _, first, back = np.unique(same, return_index=True, return_inverse=True)
        forest.above = first[back].copy()
        forest.left = len(first)
    token = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
    tails, names = np.append(heads[1:], len(token)), token[heads]
    asks = range(len(sets)) if asking is None else np.flatnonzero(asking)
    for i in sorted(asks, key=lambda k: -sizes[k]):
        if forest.left == 1:
            break
        n = int(sizes[i])
        if not n:
            continue
        at = np.searchsorted(names, sets[i])
        length = tails[at] - heads[at]
        order = np.argsort(length[length > 1], kind="stable")
        at, length = at[length > 1][order], length[length > 1][order]
        # The overlap that a set of each size needs. Those that ask by themselves and are larger have asked already.
        needed = -(-percent * (n + sizes) // (100 + percent))
        open_ = (sizes <= n) if asking is None else np.ones(len(sets), bool)
        roots = forest.roots()
        open_ &= (100 * sizes >= percent * n) & (100 * n >= percent * sizes) & (needed <= len(at)) & (roots != roots[i])
        if not open_.any():
            continue
        least = int(needed[open_].min())
        skipped = max(0, min(int(least / (0.01 * np.log(int(length[-1]) + 1) + 1)), least - 1, len(at) - 1))
        short, long = at[: len(at) - skipped], at[len(at) - skipped:]
        merged = np.concatenate([owner[heads[t]: tails[t]] for t in short])
        both = np.bincount(merged, minlength=len(sets))
        candidates = np.flatnonzero(open_ & (both >= needed - skipped))
        for k, t in enumerate(long):
            if not len(candidates):
                break
            holders = owner[heads[t]: tails[t]]
            place = np.searchsorted(holders, candidates)
            both[candidates] += holders[np.minimum(place, len(holders) - 1)] == candidates
            if k % 8 == 7:
                candidates = candidates[both[candidates] >= needed[candidates] - (skipped - k - 1)]
        for j in candidates[both[candidates] >= needed[candidates]]:
            forest.join(i, int(j))
    return forest.links


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def found(batches):
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column(0), size)
            packed = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_names(sets)), packed], names=["node", "shingles"])

    return docs.mapInArrow(found, "node bigint, shingles binary")


def _links_in_block(percent: int):
    def links(block: pa.Table) -> pa.Table:
        nodes = block.column("node").to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in block.column("shingles").to_pylist()]
        asking = same = None
        if "component" in block.column_names:
            same, asking = block.column("component").to_numpy(), block.column("asks").to_numpy(zero_copy_only=False)
        found = t_occurrence(sets, percent, asking, same)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return links


def _candidates(written: Written, docs: DataFrame, classes: DataFrame, total: int, size: int, percent: int) -> DataFrame:
    """(centre, node): where classes that may have partners meet."""
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (3 * BUCKET))
    entries = written.put(_prefixes(docs.select("text"), buckets, size, percent).groupBy("deal").applyInArrow(_shared, "token bigint, node bigint"))
    least = classes.groupBy("node").agg(F.greatest(F.lit(1), F.floor(F.min("n_shingles") / 10)).alias("least"))
    for _ in range(2):
        enough = entries.groupBy("node").agg(F.count(F.lit(1)).alias("has")).join(least, "node").where("has >= least").select("node")
        left = entries.join(enough, "node", "left_semi")
        lists = left.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("token")
        left = written.put(left.join(lists, "token", "left_semi"))
        written.drop(entries)
        entries = left
    lists = entries.groupBy("token").agg(F.min("node").alias("centre"), (F.count(F.lit(1)) > LONG_LIST).cast("int").alias("long"))
    routes = entries.join(lists, "token").groupBy("node", "centre").agg(F.sum("long").alias("longs"), F.count(F.lit(1)).alias("both"))
    routes = written.put(routes)
    deep = routes.groupBy("node").agg(F.sum("longs").alias("all_longs"), F.sum("both").alias("has")).join(least, "node").where("has >= least")
    out = routes.join(deep, "node").where((F.col("longs") < F.col("both")) | (F.col("all_longs") >= F.col("least"))).select("centre", "node")
    out = written.put(out)
    written.drop(entries, routes)
    return out


def _links(spark: SparkSession, docs: DataFrame, classes: DataFrame, total: int, size: int, percent: int) -> DataFrame:
    written = Written(spark, "jaccard")
    routes = _candidates(written, docs, classes, total, size, percent)
    # Of each class one document's text is read again. The plan is the same at every size: texts go by id, once.
    readers = classes.join(routes.select("node").distinct(), "node", "left_semi").select("doc_id").hint("merge")
    sets = written.put(_sets(docs.join(readers, "doc_id", "left_semi").select("text"), size))
    blocks = routes.groupBy("centre").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = blocks.select("centre", F.ceil(F.col("members") / BLOCK).alias("parts"))
    placed = written.put(routes.join(blocks, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))
    # The centre sits in every part of its block, so the parts of a group of copies are joined through it.
    centres = placed.where("node = centre").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = placed.where("node <> centre").unionByName(centres).join(sets, "node").select("centre", "part", "node", "shingles")
    links = written.put(dealt.groupBy("centre", "part").applyInArrow(_links_in_block(percent), "a bigint, b bigint"))
    split = placed.where("parts > 1")
    if split.isEmpty():
        return links
    # Second round: what the first has not joined to the block's largest component asks all parts of the block.
    found = connected(links)
    joined = split.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    largest = joined.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("centre").agg(
        F.max_by("component", F.struct("held", "component")).alias("main")
    )
    joined = written.put(joined.join(largest, "centre"))
    outside = joined.where("component <> main").withColumn("batch", F.col("part"))
    # One task holds one part of the members and the asking classes of one part.
    asking = outside.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("asks", F.lit(True))
    batches = asking.select("centre", "part", "batch").distinct()
    members = joined.withColumn("asks", F.lit(False)).join(batches, ["centre", "part"])
    columns = ["centre", "part", "batch", "node", "component"]
    # A class that asks its own part is there once, as one that asks.
    both = asking.select(*columns, "asks").unionByName(members.select(*columns, "asks")).groupBy(*columns).agg(F.max("asks").alias("asks"))
    dealt = both.join(sets, "node").select(*columns, "asks", "shingles")
    more = written.put(dealt.groupBy("centre", "part", "batch").applyInArrow(_links_in_block(percent), "a bigint, b bigint"))
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, by_text: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own included. Null, empty and blank texts have no
    shingles and no links; rows that share an id are one node of the graph; a row without an id keeps a null component.
    The result is exact up to collisions of 64-bit shingle hashes.

    With ``by_text``, rows that share an id stay nodes of their own, linked by their texts alone; the columns hi and node,
    the row's class, and component, which names the group of texts (null without shingles), are there too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    written = Written(spark, "signatures")
    signed = written.put(signatures(docs, size))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "hi", "node"]
    classes = written.put(filled.groupBy(*key).agg(F.min("doc_id").alias("doc_id")))
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        more = ["hi", "node", F.lit(None).cast("bigint").alias("component")] if by_text else []
        return signed.select("doc_id", "n_shingles", *more, F.col("doc_id").alias("component_id"))
    links = _links(spark, docs, classes, total, size, percent)
    if not by_text:
        # Texts of one id are one node.
        shared = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
        links = links.unionByName(filled.join(shared, "doc_id").select("a", F.col("node").alias("b")))
    found = written.put(connected(links))
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "component").select(*key, "component", "component_id")
    kept = signed.join(of_class, key, "left")
    more = ["hi", "node", "component"] if by_text else []
    return kept.select("doc_id", "n_shingles", *more, F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
