"""Conversation prefix trie, and subtree totals by time-forward processing.

Conversations are sequences of turns (role, text); each distinct sequence of first d turns is a node. Sequences are told apart by two
64-bit lanes of hashes of (place, role, text), combined by exclusive or, so a prefix of any length is a running total.
Neighbouring nodes with the same members form a chain; along a chain only sums of lengths matter, so the tree that
is worked on has chains as its nodes and at most twice as many as there are different conversations.

Time-forward processing: chains are sorted by falling depth (Spark's external sort); each takes the messages addressed to it from a priority
queue that spills sorted runs, and sends its own totals to its parent, which comes later in that order. Chains with more members than a
bound are heavy, among them those with all. Below them every subtree is a shard: it has at most the bound of members, and shards are worked on side by
side. The totals of shard roots are summed per heavy parent, and then one pass goes over the heavy chains; at any
depth fewer than conversations / bound of them exist.

Defined cases: rows without conversation id belong to no conversation; null roles and texts are empty; null turn numbers come first and
equal ones follow the hashes of role and text; repeated rows are turns of their own; an empty table has no nodes; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookups import lookup
from ..operators.ordered import PIECE, carried, in_pieces
from ..session import publish

#: Conversations share the first turns of the first conversation of their hundred.
FAMILY, SHARED = 100, 6
#: Messages that a queue holds in memory before a sorted run goes to disk, and the least bound of a heavy chain.
HELD, LEAST = 1 << 17, 100
#: Conversation ids in one text of a listing.
LISTED = 4_096
KEY = ["a", "b", "depth"]


class SpillingQueue:
    """A priority queue of integer tuples of one width; beyond ``held`` entries it writes sorted runs to unnamed scratch files of the task."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.spilled = held, [], [], 0

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._open(self._written())

    def _written(self) -> Iterator[tuple[int, ...]]:
        rows = np.array(sorted(self.heap), np.int64)
        self.heap, self.spilled = [], self.spilled + len(rows)
        file = tempfile.TemporaryFile()  # gone with the task, whatever becomes of it
        file.write(rows.tobytes())
        file.seek(0)
        return self._read(file, rows.shape[1])

    @staticmethod
    def _read(file, width: int) -> Iterator[tuple[int, ...]]:
        with file:
            while raw := file.read(width * 8 << 12):
                yield from map(tuple, np.frombuffer(raw, np.int64).reshape(-1, width).tolist())

    def _open(self, run: Iterator[tuple[int, ...]]) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, self.spilled, id(run), run))

    def pop_equal(self, key: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Take out the entries that begin with ``key``; smaller ones must have been taken before."""
        n = len(key)
        while self.heap and self.heap[0][:n] <= key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:n] <= key:
            head, _, _, run = heapq.heappop(self.runs)
            yield head
            self._open(run)

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Published paths (conv_id, a, b, depth, parent_a, parent_b, width, last) and conversations (conv_id, n_turns, ...).

    A conversation takes its first h turns (h from the checksum of its id) from the first conversation of its hundred.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.xxhash64(F.lit(11), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("ra"),
        F.xxhash64(F.lit(12), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("rb"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("width"))
    order = [F.asc_nulls_first("turn"), F.asc("ra"), F.asc("rb")]
    turns = publish(carried(in_pieces(rows, ["conv_id"], order), ["conv_id"], order, {"i": ("count", F.lit(1))}).drop("turn"), "turns")
    own = turns.groupBy("conv_id").agg(F.max("i").alias("own"))
    heads = (turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("i") < SHARED)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("i", "ra", "rb", "width"))).alias("head")))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED))
    plan = own.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), "h": h}).join(heads, "base", "left")
    plan = plan.withColumn("lent", F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    plan = plan.withColumn("lent", F.when(F.col("head").isNull(), 0).otherwise(F.col("lent")))
    first = F.when(F.col("lent") > 0, F.slice("head", F.lit(1), F.col("lent").cast("int")))
    plan = plan.select("conv_id", "own", "h", "lent", first.alias("head"), (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))

    def lane(seed: int, place: Column, ra: Column, rb: Column) -> Column:
        return F.xxhash64(F.lit(seed), place, ra, rb)

    def of_head(seed: int) -> Column:
        each = F.transform("head", lambda t: lane(seed, t["i"], t["ra"], t["rb"]))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)), F.lit(0).cast("long"))

    plan = publish(plan.withColumns({"head_a": of_head(1), "head_b": of_head(2)}), "rebuilt")
    lent = plan.where("lent > 0").select("conv_id", "n_turns", F.explode("head").alias("t")).select(
        "conv_id", "n_turns", F.col("t.i").alias("depth"), F.col("t.width").alias("width"),
        *(lane(s, F.col("t.i"), F.col("t.ra"), F.col("t.rb")).alias(z) for s, z in ((1, "za"), (2, "zb"))))
    up = Window.partitionBy("conv_id").orderBy("depth")  # five rows at most
    lent = lent.withColumns({"a": F.bit_xor("za").over(up), "b": F.bit_xor("zb").over(up)})
    # what a conversation needs meets its turns by piece, so that a giant one stays cut up
    needs = turns.select("conv_id", PIECE).distinct().join(plan.select("conv_id", "h", "lent", "n_turns", "head_a", "head_b"), "conv_id")
    rest = turns.join(needs, ["conv_id", PIECE]).where("i > h").withColumn("depth", F.col("i") - F.col("h") + F.col("lent"))
    rest = publish(rest.select("conv_id", PIECE, "n_turns", "depth", "width", "head_a", "head_b",
                               *(lane(s, F.col("depth"), F.col("ra"), F.col("rb")).alias(z) for s, z in ((1, "za"), (2, "zb")))), "own-turns")
    rest = carried(rest, ["conv_id"], [F.asc("depth")], {"a": ("xor", F.col("za")), "b": ("xor", F.col("zb"))})
    rest = rest.withColumns({"a": F.col("a").bitwiseXOR(F.col("head_a")), "b": F.col("b").bitwiseXOR(F.col("head_b"))})
    paths = lent.unionByName(rest.select(lent.columns)).select(
        "conv_id", "a", "b", "depth", F.col("a").bitwiseXOR(F.col("za")).alias("parent_a"), F.col("b").bitwiseXOR(F.col("zb")).alias("parent_b"),
        "width", (F.col("depth") == F.col("n_turns")).alias("last"))
    return publish(paths, "paths"), plan.select("conv_id", "n_turns")


def listings(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) of nodes where conversations end; a node's ids are streamed in order, in texts of bounded size."""
    zero = F.lit(0).cast("long")
    ends = paths.where("last").select(*KEY, "conv_id").unionByName(
        conversations.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id"))
    slab = F.floor(F.col("conv_id") / LISTED).cast("long")
    texts = ends.groupBy(*KEY, slab.alias("slab")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        node, state, done = None, None, []
        for batch in batches:
            for a, b, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b, depth) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b, depth), hashlib.sha256(ids.encode())
            yield _batch(done, [*KEY, "ends_sha256"])
            done = []
        if node is not None:
            yield _batch([(*node, state.hexdigest())], [*KEY, "ends_sha256"])

    placed = texts.repartition(*(F.col(k) for k in KEY)).sortWithinPartitions(*KEY, "slab")
    return placed.mapInArrow(run, "a long, b long, depth long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n == "ends_sha256" else pa.bool_() if n == "outside" else pa.int64())
                                       for n, c in zip(names, columns)], names=names)


CHAIN = ["conv_id", "n_convs", "over_conv", "over_convs", "outside", "own_saved", "leaves", "saved", "children"]


def time_forward(chains: DataFrame, held: int = HELD) -> DataFrame:
    """Totals of each chain from its own part and its children's messages.

    Rows come sorted by (shard, falling bottom, conv_id, n_convs); ``leaves``, ``saved`` and ``children`` are what other shards
    brought. ``outside`` marks chains whose parent is in no shard of this run; they send no message.
    """
    columns = ["shard", "bottom", "conv_id", "n_convs", "top", "over_conv", "over_convs", "outside", "own_saved", "leaves", "saved", "children"]

    def run(batches):
        queue = SpillingQueue(held)
        for batch in batches:
            done = []
            for shard, bottom, conv, n, top, over, over_n, outside, own, leaves, saved, children in zip(*(c.to_pylist() for c in batch.columns)):
                for message in queue.pop_equal((shard, -bottom, conv, n)):
                    leaves, saved, children = leaves + message[4], saved + message[5], children + 1
                if not children:
                    leaves = 1
                done.append((conv, n, over, over_n, outside, own, leaves, saved, children))
                if not outside:
                    queue.push((shard, 1 - top, over, over_n, leaves, saved + own))  # the parent's bottom is right above the top
            yield _batch(done, CHAIN)

    kinds = {"outside": "boolean"}
    return chains.select(columns).mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in CHAIN))


def trie(conversations: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """One row per node, with the columns of ``report`` and the node's two hash lanes."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths, convs = rebuilt(conversations)
    zero = F.lit(0).cast("long")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("width").alias("width"),
                                    F.min("parent_a").alias("parent_a"), F.min("parent_b").alias("parent_b"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("width"), zero.alias("parent_a"), zero.alias("parent_b"))
    nodes = publish(nodes.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("width")), "nodes")
    n = convs.count()
    bound = min(max(least, n // (4 * parts)), max(n - 1, 0))  # what all share is heavy, the root first of all
    heavy = F.col("n_convs") > bound

    # chains: nodes with the same members
    top, bottom = F.struct("parent_a", "parent_b", "depth"), F.struct("a", "b", "depth")
    chains = nodes.groupBy("conv_id", "n_convs").agg(
        F.min_by(top, "depth").alias("t"), F.max_by(bottom, "depth").alias("z"), F.sum("own").alias("own_saved"))
    chains = publish(chains.select("conv_id", "n_convs", "own_saved", F.col("t.depth").alias("top"), F.col("z.depth").alias("bottom"),
                                   F.col("t.parent_a").alias("pa"), F.col("t.parent_b").alias("pb"), (F.col("t.depth") - 1).alias("pdepth"),
                                   F.col("z.a").alias("a"), F.col("z.b").alias("b")), "chains")
    bottoms = publish(chains.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("bottom").alias("pdepth"),
                                    F.col("conv_id").alias("over_conv"), F.col("n_convs").alias("over_convs")), "chain-ends")
    chains = lookup(chains.select("conv_id", "n_convs", "own_saved", "top", "bottom", "pa", "pb", "pdepth"), bottoms, ["pa", "pb", "pdepth"], ["conv_id", "n_convs"])

    # the shard of a conversation: the first node of its path that is not heavy
    heavy_nodes = publish(nodes.where(heavy).select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), (F.col("depth") + 1).alias("depth")), "heavy")
    heavy_self = publish(nodes.where(heavy).select(*KEY), "heavy")
    below = lookup(paths.select("conv_id", *KEY, "parent_a", "parent_b"), heavy_nodes, ["parent_a", "parent_b", "depth"], ["conv_id"], "left_semi")
    below = lookup(below, heavy_self, KEY, ["conv_id"], "left_anti")
    shards = below.select("conv_id", F.xxhash64(*KEY).alias("shard"))
    nothing = {"leaves": zero, "saved": zero, "children": zero}
    light = chains.where(~heavy).join(shards, "conv_id").withColumns({**nothing, "outside": F.col("over_convs") > bound})
    # two shards with one hash are worked on as one forest: chains are told apart by conversation and count
    light_done = publish(time_forward(light.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("bottom"), "conv_id", "n_convs"), held), "light")
    sent = light_done.where("outside").groupBy(F.col("over_conv").alias("conv_id"), F.col("over_convs").alias("n_convs")).agg(
        F.sum("leaves").alias("leaves"), F.sum(F.col("saved") + F.col("own_saved")).alias("saved"), F.count("*").alias("children"))
    top_part = chains.where(heavy).join(sent, ["conv_id", "n_convs"], "left").na.fill(0, ["leaves", "saved", "children"])
    top_part = top_part.withColumns({"shard": zero, "outside": F.col("top") == 0, "over_conv": F.coalesce("over_conv", zero), "over_convs": F.coalesce("over_convs", zero)})
    heavy_done = time_forward(top_part.repartition(1).sortWithinPartitions("shard", F.desc("bottom"), "conv_id", "n_convs"), held)
    totals = light_done.unionByName(heavy_done).select("conv_id", "n_convs", "leaves", "saved", "children", F.when(~F.col("outside") | (F.col("over_convs") > 0), F.col("over_conv")).alias("over_conv"))
    ends = chains.select("conv_id", "n_convs", "top", "bottom")
    totals = publish(totals.join(ends, ["conv_id", "n_convs"]), "totals")

    # back to nodes: what lies below the chain, and the chain's own rest
    shared = nodes.where("n_convs > 1").select("conv_id", "n_convs", "depth", "own")
    down = [F.desc("depth")]
    rest = carried(in_pieces(shared, ["conv_id", "n_convs"], down), ["conv_id", "n_convs"], down, {"rest": ("sum", F.col("own"))})
    rest = publish(rest.select("conv_id", "n_convs", "depth", "rest"), "rests")
    out = lookup(nodes, totals, ["conv_id", "n_convs"], KEY)
    out = out.join(rest, ["conv_id", "n_convs", "depth"], "left").join(listings(paths, convs), KEY, "left")
    at_bottom = F.col("depth") == F.col("bottom")
    return out.select(
        "a", "b", "conv_id", "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("over_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(at_bottom, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.coalesce("rest", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(conversations).drop("a", "b")
