"""Ranked lexical search over an impact-sorted inverted index, with no random access (NRA).

``index`` cuts the documents into shards of bounded bytes. A shard has one row per term: the documents that hold it, by
falling impact, and the impacts; an impact is the integer part of a score that depends on the document alone, so one order
serves every query. ``search`` joins the terms of the queries to the lists and reads, for each query and shard, all its lists
side by side from the top, in steps of doubling length. Every document met has a lower bound (what was read of it) and an upper one (for each
list in which it was not met yet, at most the contribution read last there). Documents whose upper bound is under the
tenth lower bound are given up; reading goes on until no document outside the best ten can enter them or tie with them, and the bounds of
the ten agree. The best of all shards are merged by one windowed ranking.

Lists stay with their shard, so a term in every document is many lists. No index or query set passes through the driver; queries are dealt in blocks of
bounded size, and a task holds one block's lists of one shard.

Defined cases: null texts have no terms; queries without terms or without matches give no rows; every row of ``queries`` is
ranked by itself, also if ids repeat or are null; rows of ``docs`` are documents of their own even if ids repeat; equal scores are ordered by
ascending id, nulls last; empty tables give empty results; other columns of both tables are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import publish
from .tables import small_batches
from .words import ALNUM, blocks

TOP = 10
#: Bytes of text in a shard (a longer text is a shard of its own), and terms of queries in a block.
SHARD, BLOCK_TERMS = 8 << 20, 1 << 16
FIRST_STEP = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words as ``words.ALNUM`` finds in lower-cased bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def measure(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of documents with a term, and number of all their terms."""
    def run(batches):
        for batch in batches:
            n = t = 0
            for b in blocks(batch.column(0), ALNUM, lower=True):
                n += int((b.last > b.first).sum())
                t += len(b.start)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([t], pa.int64())], names=["n", "t"])

    small_batches(docs.sparkSession)
    row = docs.select(text).mapInArrow(run, "n long, t long").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    return row["n"] or 0, row["t"] or 0


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word a group number, and for each group one of its words; equal only if both hashes are."""
    _, first, group = np.unique(h1, return_index=True, return_inverse=True)
    if (h2[first][group] != h2).any():
        _, first, group = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True, return_inverse=True)
    return group.ravel(), first


def _lists(texts: pa.Array, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The lists of one shard: term, places of the documents in the shard by falling impact, impacts."""
    data, starts, ends, doc, h1, h2, base = [], [], [], [], [], [], 0
    for b in blocks(texts, ALNUM, lower=True):
        data.append(b.data)
        starts.append(b.start + base)
        ends.append(b.end + base)
        doc.append(b.doc_of_word() + b.first_row)
        h1.append(b.hashes(1))
        h2.append(b.hashes(2))
        base += len(b.data)
    data, starts, ends, doc, h1, h2 = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (data, starts, ends, doc, h1, h2))
    if not len(starts):
        return
    group, word = _grouped(h1, h2)
    del h1, h2
    size = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    pair, tf = np.unique(group.astype(np.int64) * len(texts) + doc, return_counts=True)
    term, at = pair // len(texts), pair % len(texts)
    m = 100 - 75 + (75 * size[at] * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    order = np.lexsort((at, -impact, term))
    offsets = np.zeros(len(word) + 1, np.int32)
    np.cumsum(np.bincount(term, minlength=len(word)), out=offsets[1:])
    width = ends[word] - starts[word]
    text_end = np.cumsum(width)
    letters = data[np.arange(int(text_end[-1])) - np.repeat(text_end - width, width) + np.repeat(starts[word], width)]
    names = pa.StringArray.from_buffers(len(word), pa.py_buffer(np.append(0, text_end).astype(np.int32)), pa.py_buffer(letters))
    # pieces of bounded size: a reader never meets one batch with the whole shard
    places, impacts = pa.array(at[order].astype(np.int32)), pa.array(impact[order].astype(np.int32))
    for lo in range(0, len(word), 1 << 14):
        hi = min(len(word), lo + (1 << 14))
        cut = pa.array(offsets[lo:hi + 1] - offsets[lo])
        part = slice(int(offsets[lo]), int(offsets[hi]))
        yield pa.RecordBatch.from_arrays([names[lo:hi], pa.array(offsets[lo + 1:hi + 1] - offsets[lo:hi]),
                                          pa.ListArray.from_arrays(cut, places[part]), pa.ListArray.from_arrays(cut, impacts[part])],
                                         names=["term", "n", "places", "impacts"])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The published index, (shard, term, n, places, impacts), and the number of documents with a term.

    A row without term holds a shard's ids (as a list of one-field structs) in the order of its places, ascending and nulls last.
    """
    n_docs, n_terms = measure(docs, text)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, term string, n int, places array<int>, impacts array<int>, ids array<struct<id:{kind}>>"

    def shards(batches):
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column(1)[row].as_buffer()
                width = width.size if width is not None else 0
                if held and size + width > SHARD:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(batch.slice(row, 1))
                size += width
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for k, shard in enumerate(shards(batches)):
            shard = shard.sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls come last
            ids = shard.column(0).combine_chunks() if shard.column(0).num_chunks else shard.column(0)
            texts = shard.column(1).combine_chunks().cast(pa.large_string())
            number = (task << 32) + k
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            wrapped = pa.StructArray.from_arrays([ids], names=["id"])
            all_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), wrapped)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([len(ids)], pa.int32()),
                                              pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), all_ids],
                                             names=["shard", "term", "n", "places", "impacts", "ids"])
            for part in _lists(texts, n_docs, n_terms):
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number), pa.int64()), *part.columns, pa.nulls(rows, all_ids.type)],
                                                 names=["shard", "term", "n", "places", "impacts", "ids"])

    small_batches(docs.sparkSession)
    return publish(own.mapInArrow(run, schema), "lexical-index"), n_docs


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term, times) of every row of ``queries``, published; ``item`` numbers the rows."""
    own = publish(queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "queries")
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return publish(own.select("item", "item_id", F.explode(words).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "query-terms")


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, top: int = TOP) -> list[tuple[int, int]]:
    """(place, score) of the best documents, by falling score and rising place; each list is (places, impacts, factor)."""
    lists = [(p, i, f) for p, i, f in lists if len(p) and f > 0]
    if not lists:
        return []
    low = np.zeros(n_docs, np.int64)
    met = np.zeros((n_docs, len(lists)), bool)
    alive = None  # places that may still be among the best, once documents never met cannot
    read, step = 0, FIRST_STEP
    longest = max(len(p) for p, _, _ in lists)
    while True:
        bound = np.zeros(len(lists), np.int64)
        for k, (places, impacts, factor) in enumerate(lists):
            part = slice(read, read + step)
            at = places[part]
            if len(at):
                low[at] += impacts[part].astype(np.int64) * factor
                met[at, k] = True
            if len(places) > read + step:  # whatever follows is at most this
                bound[k] = int(impacts[read + step - 1]) * factor
        read, step = read + step, read + step
        rest = int(bound.sum())
        at = np.flatnonzero(low) if alive is None else alive
        lower = low[at]
        upper = lower + rest - met[at] @ bound
        if len(at) > top:
            kth = np.partition(lower, len(at) - top)[len(at) - top]
            # those who can still reach the tenth lower bound, ties included
            keep = upper >= kth
            if rest < kth:  # documents never met cannot
                alive = at = at[keep]
                lower, upper = lower[keep], upper[keep]
        if read >= longest or (alive is not None and len(at) <= top and (lower == upper).all()):
            break
        if alive is not None and (lower == upper).all():  # all scores final: only ties are left, and places settle them
            break
    best = at[np.lexsort((at, -low[at]))][:top]
    return [(int(d), int(low[d])) for d in best if low[d] > 0]


def search(lists: DataFrame, n_docs: int, terms: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each query: item, item_id, rank, doc_id, score.

    ``terms`` is the result of ``query_terms`` and ``lists`` that of ``index``.
    """
    spark = lists.sparkSession
    blocks_n = max(1, -(-terms.count() // BLOCK_TERMS))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks_n)).cast("int"))
    wanted = terms.select("term").distinct()
    found = lists.where(F.col("term").isNotNull()).join(wanted, "term", "left_semi")
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = publish(terms.join(df, "term").withColumn("factor", weight * F.col("times")).where("factor > 0").select("block", "item", "term", "factor"), "query-weights")
    shards = lists.where(F.col("term").isNull()).select(F.col("shard").alias("at"), F.col("n").alias("docs"), F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1))).alias("asking"))
    # each shard meets each block of queries: one row of a block's queries, and the lists of its terms
    asked = weighed.groupBy(F.col("block").alias("asking"), "item").agg(F.collect_list(F.struct("term", "factor")).alias("asked"))
    asked = asked.groupBy("asking").agg(F.collect_list(F.struct("item", "asked")).alias("items"))
    asked = shards.join(asked, "asking")
    met = (lists.select("shard", "term", "places", "impacts").join(weighed.select("block", "term").distinct(), "term"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        item, place, score = [], [], []
        if right.num_rows:
            names = {t: k for k, t in enumerate(left.column("term").to_pylist())}
            offsets, values = _flat(left.column("places"))
            _, impacts = _flat(left.column("impacts"))
            for row in range(right.num_rows):
                docs = right.column("docs")[row].as_py()
                for asks in right.column("items")[row].as_py():
                    mine = [(names[a["term"]], a["factor"]) for a in asks["asked"] if a["term"] in names]
                    for d, s in nra([(values[offsets[k]:offsets[k + 1]], impacts[offsets[k]:offsets[k + 1]], f) for k, f in mine], docs, top):
                        item.append(asks["item"])
                        place.append(d)
                        score.append(s)
        number = left.column("shard")[0].as_py() if left.num_rows else right.column("at")[0].as_py()
        return pa.table({"shard": pa.array([number] * len(item), pa.int64()), "item": pa.array(item, pa.int64()),
                         "place": pa.array(place, pa.int32()), "score": pa.array(score, pa.int64())})

    small_batches(spark)
    best = met.groupBy("shard", "block").cogroup(asked.groupBy("at", "asking")).applyInArrow(run, "shard long, item long, place int, score long")
    ids = lists.where(F.col("term").isNull()).select("shard", F.posexplode("ids").alias("place", "held"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = (best.join(ids, ["shard", "place"]).select("item", "score", F.col("held.id").alias("doc_id"))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.join(terms.select("item", "item_id").distinct(), "item").select("item", "item_id", "rank", "doc_id", "score")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column.offsets) else 0), column.flatten().to_numpy()


def report(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the best ten documents of each query."""
    lists, n_docs = index(docs)
    return search(lists, n_docs, query_terms(queries)).select("item_id", "rank", "doc_id", "score")
