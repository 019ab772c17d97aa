"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

* A shingle is five consecutive words (runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, A-Z lower-cased); a text of one to four words is one
  shingle. Its weight is the count in the text times ``min(1, ln(N / df) / ln(3))``: shingles in over a third of all distinct texts count less. N is
  ``LEAST_TEXTS`` at least, as shares say nothing in a small table.
* ``df`` comes from a count-min sketch over the distinct texts (2 x 65,536 counters, summed by Spark, of fixed size), less what other shingles are
  expected to add to a counter.
* ``SAMPLES`` consistent samples per text form ``BANDS`` bands of ``ROWS``; texts that agree in a band meet in its bucket. Two texts
  of similarity 0.8 meet with probability 1 - (1 - 0.8 ** 3) ** 12 = 0.9998. A text with shingles of less weight also gets the bands of its plain
  counts (which a text of full weights has anyway), so the same holds for plain similarity, however large a group of copies is.
* Texts with equal shingles and counts are one node. Buckets that hold the same nodes are one bucket. A bucket is cut into blocks of about
  ``BLOCK_NODES`` nodes, and every pair of blocks (also a block with itself) is one unit of work: all pairs of its nodes are compared exactly, by
  weighted and by plain Jaccard similarity over all shingles (either links), as matrix products inside the task. Pairs never become rows; a unit returns
  each node's class within the unit, one row per node. So a bucket of thousands takes many small tasks, none grows with it, and no link is lost.
* Classes are the connected components of the links.

Hashes of texts and shingles have 64 bits (32 for a shingle inside one comparison).

Defined cases: a text without words is a class of its own; rows without ``doc_id`` take part and a class is named by the smallest id it has (null if
none); repeated rows share a class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intake_spark.llm import words as W
from intake_spark.llm.tables import in_arrow, keeps_names
from intake_spark.session import publish

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
SKETCH_ROWS, SKETCH_WIDTH, SKETCH_BLOCK = 2, 1 << 16, 1 << 11
BLOCK_NODES, SLAB = 400, 4096
COMMON = 3.0  # a shingle in more than 1 / COMMON of all texts loses weight
LEAST_TEXTS = 1000
U64 = np.uint64


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal shares, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) - np.log1p(-p)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_GAMMA = _gamma2_quantiles(1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_UNIFORM = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_SALT = np.frombuffer(b"".join(hashlib.sha256(b"sample %d" % k).digest()[:8] for k in range(SAMPLES)), "<u8").astype(U64)


class Shingles:
    """Distinct shingles of each row of a block: ``hash`` and ``count``, rows one after the other from ``first``."""

    def __init__(self, block: W.Block, size: int = SHINGLE):
        h = block.hashes()
        n = block.last - block.first
        rows = np.flatnonzero(n >= size)
        runs = W.run_hash(h, size)
        begin, many = block.first[rows], n[rows] - size + 1
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        value, row = runs[at], np.repeat(rows, many)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            value = np.concatenate([value, [W.run_hash(h[block.first[i]:block.last[i]], int(n[i]))[0] for i in short]]).astype(U64)
            row = np.concatenate([row, short])
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        self.hash, self.row = value[start], row[start]
        self.count = np.diff(np.append(start, len(value)))
        self.first = np.searchsorted(self.row, np.arange(block.rows + 1))

    def keys(self) -> np.ndarray:
        """A 64-bit name of each row's shingles and counts; 0 for a row without shingles."""
        part = W.mix(self.hash * U64(3) + W.mix(self.count.astype(U64)))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=sums[1:])
        size = (self.first[1:] - self.first[:-1]).astype(U64)
        return np.where(size > 0, W.mix(sums[self.first[1:]] - sums[self.first[:-1]] + size), U64(0)).view(np.int64)


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> U64(16 * r) & U64(SKETCH_WIDTH - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def sketch(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(texts with shingles, counters) of distinct texts: every task sums its own, Spark sums the tasks' blocks of counters."""

    def count(batches):
        total = np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.int64)
        n = 0
        for batch in batches:
            for block in W.blocks(batch.column(0), W.ALNUM, lower=True):
                s = Shingles(block)
                n += int((s.first[1:] > s.first[:-1]).sum())
                for r, cell in enumerate(_cells(s.hash)):
                    total[r] += np.bincount(cell, minlength=SKETCH_WIDTH)
        parts = total.reshape(-1, SKETCH_BLOCK)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(parts)), -1], pa.int32()), pa.array([*(p.tobytes() for p in parts), np.int64(n).tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(v.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    counters = np.zeros((SKETCH_ROWS * SKETCH_WIDTH // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    n = 0
    for r in parts.collect():  # a fixed number of blocks, 1 MB together
        if r.block < 0:
            n = int(np.frombuffer(r.counts, np.int64)[0])
        else:
            counters[r.block] = np.frombuffer(r.counts, np.int64)
    return n, counters.reshape(SKETCH_ROWS, SKETCH_WIDTH)


def cell_weights(n: int, counters: np.ndarray) -> np.ndarray:
    """Saturated inverse document frequency by counter."""
    others = (counters.sum(axis=1, keepdims=True) - counters) / (SKETCH_WIDTH - 1)  # expected from other shingles
    share = np.maximum(counters - others, 1) / max(n, LEAST_TEXTS)
    return np.clip(-np.log(np.minimum(share, 1)) / math.log(COMMON), 0.01, 1).astype(np.float32)


def weights(s: Shingles, cells: np.ndarray) -> np.ndarray:
    """The larger of the two rows' weights belongs to the smaller, hence better, count."""
    rare = np.max([cells[r][c] for r, c in enumerate(_cells(s.hash))], axis=0)
    return (s.count * rare).astype(np.float32)


def samples(s: Shingles, weight: np.ndarray) -> np.ndarray:
    """(rows with shingles, SAMPLES) consistent weighted samples, each named by shingle and level."""
    rows = np.flatnonzero(s.first[1:] > s.first[:-1])
    start, size = s.first[rows], (s.first[1:] - s.first[:-1])[rows]
    out = np.empty((len(rows), SAMPLES), U64)
    if not len(rows):
        return out
    log_w = np.log(weight)
    for k in range(SAMPLES):
        x = W.mix(s.hash ^ _SALT[k])
        r = _GAMMA[(x & U64(0xFFFF)).astype(np.uint16)]
        log_c = _LOG_GAMMA[(x >> U64(16) & U64(0xFFFF)).astype(np.uint16)]
        beta = _UNIFORM[(x >> U64(32) & U64(0xFFFF)).astype(np.uint16)]
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta) - r
        least = np.minimum.reduceat(log_a, start)
        hit = np.flatnonzero(log_a == np.repeat(least, size))
        best = hit[np.searchsorted(hit, start)]
        out[:, k] = W.mix(s.hash[best] + level[best].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def bands(values: np.ndarray) -> np.ndarray:
    out = np.empty((len(values), BANDS), U64)
    for b in range(BANDS):
        x = np.full(len(values), b + 1, U64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = W.mix(x * U64(0xD1342543DE82EF95) + values[:, k])
        out[:, b] = x
    return out.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, node: a key of the text's shingles and counts, 0 for a text without words."""

    def work(batch):
        for block in W.blocks(batch.column(1), W.ALNUM, lower=True):
            yield {"doc_id": batch.column(0).slice(block.first_row, block.rows), "text": batch.column(1).slice(block.first_row, block.rows),
                   "node": Shingles(block).keys()}

    return in_arrow(docs.select("doc_id", "text"), "doc_id long, text string, node long", work)


def signatures(texts: DataFrame, shared) -> DataFrame:
    """node and its band buckets, by weights and, where these are not full, by plain counts."""

    def work(batch):
        for block in W.blocks(batch.column(1), W.ALNUM, lower=True):
            s = Shingles(block)
            weight = weights(s, shared.value)
            found = bands(samples(s, weight))
            less = np.add.reduceat(np.append(weight < s.count, False), s.first[:-1]) > 0  # every text here has shingles
            buckets = list(found)
            if less.any():
                plain = bands(samples(s, s.count.astype(np.float32)))
                for i in np.flatnonzero(less):
                    buckets[i] = np.unique(np.concatenate([found[i], plain[i]]))
            ends = np.concatenate([[0], np.cumsum([len(b) for b in buckets])])
            yield {"node": batch.column(0).slice(block.first_row, block.rows),
                   "buckets": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *buckets]), pa.int64()))}

    return in_arrow(texts.select("node", "text"), "node long, buckets array<long>", work)


def vectors(joined: DataFrame, shared) -> DataFrame:
    """node, its elements as sorted 32-bit hashes, and their weights unless all are 1.

    The k-th occurrence of a shingle is an element of its own with the shingle's rarity as weight, so the smaller of two
    weights of a shingle is the sum over common elements.
    """

    def run(batches):
        for batch in batches:
            for block in W.blocks(batch.column(1), W.ALNUM, lower=True):
                s = Shingles(block)
                rare = weights(s, shared.value) / s.count
                node, element, heavy = batch.column(0).slice(block.first_row, block.rows), [], []
                for i in range(block.rows):
                    part = slice(s.first[i], s.first[i + 1])
                    many = s.count[part]
                    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    small = (W.mix(np.repeat(s.hash[part], many) + nth.astype(U64)) >> U64(32)).astype(np.uint32)
                    order = np.argsort(small, kind="stable")
                    element.append(small[order].tobytes())
                    w = np.repeat(rare[part], many).astype(np.float32)[order]
                    heavy.append(None if (w == 1).all() else w.tobytes())
                yield pa.RecordBatch.from_arrays([node, pa.array(element, pa.binary()), pa.array(heavy, pa.binary())], names=["node", "elements", "weights"])

    return joined.select("node", "text").mapInArrow(run, "node long, elements binary, weights binary")


def common_weight(elements: list[np.ndarray], heavy: list[np.ndarray]) -> np.ndarray:
    """For each pair of rows the weight of their common elements, as matrix products over slabs of columns."""
    n = len(elements)
    value, at, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(e) for e in elements])
    weight = np.concatenate(heavy)
    shared = np.flatnonzero(count[at] > 1)  # an element of one row alone is common to no pair
    number = np.cumsum(count > 1) - 1
    column, row, weight = number[at[shared]], row[shared], weight[shared]
    order = np.argsort(column, kind="stable")
    column, row, weight = column[order], row[order], weight[order]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, SLAB):
        part = slice(*np.searchsorted(column, [low, low + SLAB]))
        a = np.zeros((n, SLAB), np.float32)
        a[row[part], column[part] - low] = np.sqrt(weight[part])
        out += a @ a.T
    return out


def similar(elements: list[np.ndarray], heavy: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of two rows reaches the threshold, for every pair."""
    total = np.array([w.sum() for w in heavy], np.float32)
    common = common_weight(elements, heavy)
    return common >= (threshold - 1e-6) * (total[:, None] + total[None, :] - common)


def forest(elements: list[np.ndarray], heavy: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float, nodes: list[int]) -> list[tuple[int, int]]:
    """Classes over the pairs that reach the threshold, as (row, smallest node of its class); ``cross``: only pairs of different sides."""
    near = similar(elements, heavy, threshold)
    if any((w != 1).any() for w in heavy):
        near |= similar(elements, [np.ones(len(e), np.float32) for e in elements], threshold)
    if cross:
        near &= side[:, None] != side[None, :]
    root = np.arange(len(nodes))
    for i in range(len(nodes)):
        others = np.flatnonzero(near[i, i + 1:]) + i + 1
        for r in np.unique(root[others]):
            if r != root[i]:
                root[root == r] = root[i]
    named = np.array(nodes, np.int64)
    out = []
    for r in np.unique(root):
        rows = np.flatnonzero(root == r)
        low = int(named[rows].min())
        out += [(int(x), low) for x in rows if named[x] != low]
    return out


def unit_links(units: DataFrame, threshold: float) -> DataFrame:
    """(node, smallest node of its class) in every unit; rows of a unit stand together in one partition."""
    names = ["bucket", "i", "j", "side", "node", "elements", "weights"]

    def run(batches):
        def solved(rows):
            parts = [(np.frombuffer(e, np.uint32), w) for _, _, e, w in rows]
            elements = [e for e, _ in parts]
            heavy = [np.ones(len(e), np.float32) if w is None else np.frombuffer(w, np.float32) for e, w in parts]
            nodes = [r[1] for r in rows]
            for x, low in forest(elements, heavy, np.array([r[0] for r in rows]), unit[1] != unit[2], threshold, nodes):
                a.append(nodes[x])
                b.append(low)

        unit, rows, a, b = None, [], [], []
        for batch in batches:
            for r in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in names)):
                if r[:3] != unit:
                    if len(rows) > 1:
                        solved(rows)
                    unit, rows = r[:3], []
                rows.append(r[3:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        if len(rows) > 1:
            solved(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.select(names).mapInArrow(run, "a long, b long")


def thinned(stars: DataFrame) -> DataFrame:
    """Edges with the same components: each node to its smallest root, and that root to the node's other roots, which many nodes share."""
    roots = publish(stars.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("roots")), "dup-roots-of")
    first = roots.select("a", F.col("roots")[0].alias("b"))
    rest = roots.where(F.size("roots") > 1).select(F.explode(F.slice("roots", F.lit(2), F.size("roots"))).alias("a"), F.col("roots")[0].alias("b"))
    return first.union(rest.distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that it is connected with, by smallest neighbours and shortened chains."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = publish(both.distinct(), "dup-edges")
    label = publish(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "dup-labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("next"), "root")
        jump = label.select(F.col("node").alias("n"), F.col("root").alias("r"))
        step = publish(step.join(jump, F.col("next") == F.col("n"), "left").select("node", F.least("next", F.coalesce("r", "next")).alias("next"), "root"), "dup-labels")
        changed = step.where("next < root").limit(1).count()
        label = step.select("node", F.col("next").alias("root"))
        if not changed:
            return label


def _named(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, digest of the text, node and root (both 0 for a text without words) for every row of (doc_id, text)."""
    spark = docs.sparkSession
    own = keyed(docs)
    rows = publish(own.select("doc_id", F.xxhash64("text").alias("digest"), "node"), "dup-rows")
    # one text per node; equal texts meet before they move
    texts = publish(own.where("node != 0").groupBy("node").agg(F.first("text").alias("text")), "dup-texts")
    shared = spark.sparkContext.broadcast(cell_weights(*sketch(texts)))  # 0.5 MB, always
    members = publish(signatures(texts, shared).select("node", F.explode("buckets").alias("bucket")), "dup-buckets")
    # buckets of the same nodes: equal sizes and equal sums of two hashes
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *sums).where("size > 1")
    sizes = publish(sizes.groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "dup-sizes")
    members = publish(members.join(sizes, "bucket"), "dup-members")
    wanted = publish(members.select("node").distinct(), "dup-nodes")
    vector = publish(vectors(texts.join(wanted.hint("shuffle_hash"), "node"), shared), "dup-vectors")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK_NODES)).cast("int")
    units = members.select("bucket", "node", blocks.alias("blocks")).withColumn("side", F.pmod(F.xxhash64("bucket", "node"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node").join(vector, "node")
    links = publish(unit_links(units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), threshold), "dup-links")
    label = wanted.select("node", F.col("node").alias("root"))
    if not links.isEmpty():
        root = components(thinned(links))
        label = publish(wanted.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "dup-roots")
    # a text without words is alone; nodes outside any bucket as well
    named = rows.join(label, "node", "left").select("doc_id", "digest", "node", F.coalesce("root", "node").alias("root"))
    return publish(named, "dup-named")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``class_id``, the smallest id of its class, and how many rows the class has."""
    named = _named(_texts(docs, doc_id, text), threshold)
    group = publish(named.where("node != 0").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows")), "dup-classes")
    out = named.join(group, "root", "left")
    alone = F.col("node") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, 1).otherwise(F.col("class_rows")).cast("long").alias("class_rows"))


@keeps_names
def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is the first of its class: the smallest id, rows without id last, then the smallest digest.

    Of rows with equal id and text one stays; texts without words and without id all stay.
    """
    named = _named(_texts(docs, doc_id, text), THRESHOLD).where("node != 0").select("root", "doc_id", "digest").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    named = publish(named.withColumn("place", place), "dup-places")
    first = publish(named.groupBy("root").agg(F.min("place").alias("first")), "dup-firsts")
    later = named.join(first, "root").where(~F.col("place").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    own = docs.withColumn("__own", F.xxhash64(text))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    left = own.join(later.hint("shuffle_hash"), same, "left_anti")
    told = F.col(doc_id).isNotNull() | F.coalesce(F.col(text).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    return left.where(told).dropDuplicates([doc_id, "__own"]).unionByName(left.where(~told)).drop("__own")
