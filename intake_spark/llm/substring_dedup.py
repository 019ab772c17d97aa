"""Substring dedup: words covered by a window of ``LENGTH`` words that also starts earlier are removed.

Level-wise doubling. The first level looks at windows of ``LENGTH / 2`` words. Not all of them are needed: of the half-length
windows inside a full window, the one with the smallest hash (leftmost on ties) stands for it, which leaves about one in six and is the
same wherever the full window occurs. A half-length window that occurs once decides that no full window around it repeats. The
windows around the others are extended to twice the length and judged there; longer repeats are covered by their full windows,
so the doubling ends at ``LENGTH``: one step, and no further level can remove another word.

* Exact copies are told by the digest of their words. Only the earliest copy takes part; a later copy of ``LENGTH`` words
  or more loses every word, since all of its windows start earlier.
* Both levels are one hash aggregation with partial sums, so a passage that a third of all texts hold is one row per task. The
  aggregate of a half-length window says whether it stands in one place alone; that of a full window gives its first place. Nothing is joined on
  a window's hash, and no group is collected.
* Texts are joined with what is known about them by ``doc_id`` and digest, once; after that only texts with candidate windows are kept.

Half-length windows are compared by a 64-bit hash (a clash only adds a candidate), full ones by two 64-bit hashes.

Defined cases: a null or empty text has no words; a text of under ``LENGTH`` words loses none; rows that share a ``doc_id``
and hold a window at the same start are ordered by digest, so repeated rows get equal results; rows without ``doc_id`` come last
and count as one such id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intake_spark.llm import words as W
from intake_spark.llm.tables import in_arrow
from intake_spark.session import publish

LENGTH = 20
LAST = (1 << 63) - 1
NOTHING = hashlib.sha256(b"").hexdigest()


def _key(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def _digests(block: W.Block) -> list[bytes]:
    return [_digest(block.text(i)) for i in range(block.rows)]


def anchors(block: W.Block, h: np.ndarray, length: int) -> np.ndarray:
    """Whether the half-length window that starts at a word stands for some full window."""
    half, n = length // 2, len(block.start)
    chosen = np.zeros(n, bool)
    if n < length:
        return chosen
    best = leftmost_smallest(W.run_hash(h, half), length - half + 1)
    chosen[best[np.flatnonzero(full_starts(block, length)[:len(best)])]] = True
    return chosen


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values the place of its smallest one."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


def full_starts(block: W.Block, length: int) -> np.ndarray:
    """Whether a window of ``length`` words that starts at a word ends inside its text."""
    n = len(block.start)
    room = np.repeat(block.last, block.last - block.first) - np.arange(n)
    return room >= length


def candidates(block: W.Block, h: np.ndarray, length: int, alone: np.ndarray) -> np.ndarray:
    """Starts of full windows whose half-length window is not alone."""
    if len(block.start) < length:
        return np.empty(0, np.int64)
    best = leftmost_smallest(W.run_hash(h, length // 2), length - length // 2 + 1)
    starts = np.flatnonzero(full_starts(block, length)[:len(best)])
    return starts[~alone[best[starts]]]


def _flags(block: W.Block, places: pa.Array) -> np.ndarray:
    """Per-word flags from each row's list of word numbers."""
    flag = np.zeros(len(block.start), bool)
    size = np.array(pa.compute.fill_null(pa.compute.list_value_length(places), 0)).astype(np.int64)
    flag[np.repeat(block.first, size) + np.array(places.flatten()).astype(np.int64)] = True
    return flag


def _parts(batch: pa.RecordBatch):
    """Blocks of a batch with their rows; packed texts are unpacked block by block."""
    if "text" in batch.schema.names:
        for block in W.blocks(batch.column("text")):
            yield block, batch.slice(block.first_row, block.rows)
        return
    opener, rows = zstandard.ZstdDecompressor(), batch.column("packed").to_pylist()
    first, texts, size = 0, [], 0
    for k, raw in enumerate(rows):
        texts.append(opener.decompress(raw))
        size += len(texts[-1])
        if size >= W.BLOCK or k == len(rows) - 1:
            for block in W.blocks(pa.array(texts, pa.binary())):
                yield block, batch.slice(first + block.first_row, block.rows)
            first, texts, size = k + 1, [], 0


def packed(docs: DataFrame, length: int) -> DataFrame:
    """doc, key and compressed text, of texts that hold a full window; they move twice."""

    def work(batch):
        closer = zstandard.ZstdCompressor(level=6)
        for block, part in _parts(batch):
            rows = np.flatnonzero(block.last - block.first >= length)
            texts = [block.text(i) for i in rows]
            yield {"doc": part.column("doc").take(pa.array(rows)), "key": [_key(_digest(t)) for t in texts], "packed": [closer.compress(t) for t in texts]}

    return in_arrow(docs.select("doc", "text"), "doc long, key long, packed binary", work)


def summaries(docs: DataFrame) -> DataFrame:
    """doc, number of words, digest of the words."""

    def work(batch):
        for block, part in _parts(batch):
            shas = _digests(block)
            yield {"doc": part.column("doc"), "doc_id": part.column("doc_id"), "n_words": block.last - block.first,
                   "key": [_key(s) for s in shas], "sha": [s.hex() for s in shas]}

    return in_arrow(docs, "doc long, doc_id long, n_words long, key long, sha string", work)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def work(batch):
        for block, _ in _parts(batch):
            h = block.hashes()
            at = np.flatnonzero(anchors(block, h, length))
            if len(at):
                doc = block.doc_of_word()[at]
                key = np.array([_key(s) for s in _digests(block)], np.int64)
                yield {"h": W.run_hash(h, length // 2)[at].view(np.int64), "key": key[doc], "place": (at - block.first[doc]).astype(np.int32)}

    return in_arrow(docs.select("text"), "h long, key long, place int", work)


def with_candidates(joined: DataFrame, length: int) -> DataFrame:
    """Texts that have full windows worth comparing, with the starts of these windows."""

    def work(batch):
        for block, part in _parts(batch):
            starts = candidates(block, block.hashes(), length, _flags(block, part.column("alone")))
            doc = block.doc_of_word()[starts] if len(starts) else np.empty(0, np.int64)
            rows = np.unique(doc)
            if len(rows):
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc, rows), len(doc)), pa.int32()),
                                                 pa.array((starts - block.first[doc]).astype(np.int32), pa.int32()))
                take = pa.array(rows)
                yield {"doc": part.column("doc").take(take), "key": part.column("key").take(take),
                       "packed": part.column("packed").take(take), "starts": lists}

    return in_arrow(joined.select("doc", "key", "alone", "packed"), "doc long, key long, packed binary, starts array<int>", work)


def window_rows(kept: DataFrame, length: int) -> DataFrame:
    def work(batch):
        for block, part in _parts(batch):
            at = np.flatnonzero(_flags(block, part.column("starts")))
            doc = block.doc_of_word()[at]
            yield {"a": W.run_hash(block.hashes(1), length)[at].view(np.int64), "b": W.run_hash(block.hashes(2), length)[at].view(np.int64),
                   "doc": np.array(part.column("doc"))[doc], "key": np.array(part.column("key"))[doc], "start": (at - block.first[doc]).astype(np.int32)}

    return in_arrow(kept.select("doc", "key", "packed", "starts"), "a long, b long, doc long, key long, start int", work)


def removals(kept: DataFrame, length: int) -> DataFrame:
    """Words left once every candidate window that is not the first of its kind has been taken out."""

    def work(batch):
        for block, part in _parts(batch):
            gone = np.flatnonzero(_flags(block, part.column("starts")) & ~_flags(block, part.column("firsts")))
            change = np.zeros(len(block.start) + 1, np.int64)
            np.add.at(change, gone, 1)
            np.add.at(change, gone + length, -1)
            covered = np.cumsum(change[:-1]) > 0
            left, texts = [], []
            for i in range(block.rows):
                own = slice(block.first[i], block.last[i])
                stay = ~covered[own]
                texts.append(W.joined(block.data, block.start[own][stay], block.end[own][stay]).decode())
                left.append(int((~stay).sum()))
            yield {"doc": part.column("doc"), "key": part.column("key"), "n_removed": left, "kept_text": texts}

    return in_arrow(kept.select("doc", "key", "packed", "starts", "firsts"), "doc long, key long, n_removed long, kept_text string", work)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(one row per document, texts of documents that lost some words but not as exact copies)."""
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = publish(summaries(docs), "repeat-docs")
    leaders = publish(every.groupBy("sha", "key").agg(F.min("doc").alias("doc"), F.max("n_words").alias("n")), "repeat-leaders")
    # level 1: half-length windows that stand in one place alone (exact copies count as one place)
    alone = (anchor_rows(docs, length).groupBy("h")
             .agg(F.min("key").alias("key"), F.max("key").alias("k2"), F.min("place").alias("place"), F.max("place").alias("p2"))
             .where("key = k2 and place = p2").groupBy("key").agg(F.collect_list("place").alias("alone")))
    known = leaders.where(F.col("n") >= length).join(alone, "key", "left").select("doc", "key", "alone")
    kept = publish(with_candidates(packed(docs, length).join(known.hint("shuffle_hash"), ["doc", "key"]), length), "repeat-candidates")
    # level 2: the first place of each full window, as one number that sorts by document, start and text
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    low = F.shiftrightunsigned("key", 33).cast("decimal(20,0)")
    at = (whole("doc") * F.lit(1 << 32).cast("decimal(10,0)") + whole("start")) * F.lit(1 << 31).cast("decimal(10,0)") + low
    first = window_rows(kept, length).withColumn("at", at).groupBy("a", "b").agg(*(F.min_by(c, "at").alias(c) for c in ("doc", "key", "start")))
    firsts = first.groupBy("doc", "key").agg(F.collect_list("start").alias("firsts"))
    cut = publish(removals(kept.join(firsts.hint("shuffle_hash"), ["doc", "key"], "left"), length), "repeat-removed").dropDuplicates(["doc", "key"])
    first_copy = leaders.select(F.col("sha").alias("sha1"), F.col("doc").alias("doc1"))
    own = every.join(first_copy, (F.col("sha") == F.col("sha1"))).withColumn("later", F.col("doc") > F.col("doc1"))
    digests = cut.select("doc", "key", F.col("n_removed").alias("cut"), F.sha2("kept_text", 256).alias("cut_sha"))
    out = own.join(digests, ["doc", "key"], "left")
    copy = F.col("later") & (F.col("n_words") >= length)
    return out.select("doc_id", "n_words",
                      F.when(copy, F.col("n_words")).when(F.col("later"), 0).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(copy, F.lit(NOTHING)).when(F.col("later"), F.col("sha")).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")), cut


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return dedup(docs, length=length)[0]
