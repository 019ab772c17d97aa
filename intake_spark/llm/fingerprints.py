"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is the run of five words (``[^\\x20\\x09-\\x0D]+``) that ends at a word; the first four words of a text end shorter runs, so a
text of few words has shingles too. A sketch is the ``k`` smallest distinct 64-bit shingle hashes in ascending order. It is that of
a set: sketches of parts merge to the sketch of the whole (``merge``), and two of them give the resemblance (Jaccard), the containment and the
number of distinct shingles. With fewer than ``k`` distinct shingles all three are exact; else the standard error of a
resemblance r is about ``sqrt(r * (1 - r) / k)``.

In columns a sketch is an ``array<long>`` whose signed order is that of the unsigned hashes; ``fingerprint`` strings are base64 of the
big-endian unsigned values.

Defined cases: null texts count as empty; a text without words has the empty sketch; two empty sketches resemble each other fully, an
empty and another one not at all; equal texts have equal sketches, wherever they stand; empty tables give
empty results; other columns stay under any name in ``sketch`` and ``merge`` replaces nothing but the sketch column.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches
from .words import SPACED, blocks, run_hash

K, WORDS = 128, 5
#: Sampled rows per bucket of the ordering by id, and buckets per shuffle partition.
SAMPLED, BUCKETS = 32, 4
SIGN = np.uint64(1 << 63)


def sketches(texts: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """The sketch of each text of an Arrow string column, as unsigned values."""
    for b in blocks(texts, SPACED):
        words = b.hashes()
        ends = np.empty(len(words), np.uint64)
        full = run_hash(words, WORDS)
        ends[WORDS - 1:] = full
        for n in range(1, WORDS):  # over the first words of each text
            first = b.first[b.last - b.first >= n]
            ends[first + n - 1] = run_hash(words, n)[first]
        for lo, hi in zip(b.first.tolist(), b.last.tolist()):
            yield np.unique(ends[lo:hi])[:k]


def estimates(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """Resemblance of two sketches, and the share of the first one's shingles that the second has too."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, 1.0 if not len(a) else 0.0
    both = np.union1d(a, b)[:k]
    shared = np.isin(both, np.intersect1d(a, b, True), True).sum() / len(both)
    return float(shared), min(1.0, float(shared) * distinct(both, k) / distinct(a, k))


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: counted while there are fewer than ``k``, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** 64 / (float(a[k - 1]) + 1.0)


def as_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def sketch(docs: DataFrame, text: str = "text", name: str = "sketch", k: int = K) -> DataFrame:
    """All columns of ``docs`` and the sketch of each text; a column of that name is replaced."""
    kept = docs.drop(name)
    names = kept.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            found = [(s ^ SIGN).view(np.int64) for s in sketches(batch.column(at), k)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                                             pa.array(np.concatenate([*found, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, name])

    small_batches(docs.sparkSession)
    return kept.mapInArrow(run, kept.withColumn(name, F.array().cast("array<long>")).schema)


def merge(parts: DataFrame, by: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for all rows of each group of ``by``.

    A group may hold any share of the rows: equal hashes are combined before the shuffle, and the smallest ``k`` of each
    task's share are picked before they meet.
    """
    value, place = "__value", "__place"
    smallest = Window.partitionBy(*by).orderBy(value)
    found = (parts.select(*by, F.explode_outer(name).alias(value)).distinct()
             .withColumn(place, F.row_number().over(smallest)).where(F.col(place) <= k + 1))  # one may be the null of an empty sketch
    return found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(value)), 1, k).alias(name))


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketch columns."""
    both = union_sketch(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch column."""
    kth = F.element_at(a, k).cast("double") + F.lit(2.0 ** 63)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0 ** 64) / (kth + 1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; an empty ``a`` is contained in everything."""
    share = resemblance(a, b, k) * distinct_count(union_sketch(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (bucket, tail, id, place, text) in buckets of neighbouring ids, in descending order of (id, text digest), nulls last.

    Buckets end at ids of sampled rows. The row that a bucket begins with is sent to the following bucket too, as its tail, and
    the first of all to the last bucket: so each row meets its successor in its own bucket, and texts are shuffled once.
    A hot id is split among buckets by the digest; only rows alike in id and text stay together, and they are streamed.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("place", F.xxhash64("text"))
    keys = own.select(F.col("doc_id").isNotNull().alias("known"), "doc_id", "place")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = own.count()
    every = max(1, rows // (parts * BUCKETS * SAMPLED))
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64(F.struct("doc_id", "place")), F.lit(every)) == 0).distinct().collect())
    sample = sample[SAMPLED - 1::SAMPLED]
    top = keys.agg(F.max(F.struct("known", "doc_id", "place")).alias("top")).first()["top"]
    ends = sorted({*sample, *([tuple(top)] if top else [])})  # the last key of each bucket, in ascending order
    schema = f"bucket int, tail boolean, doc_id {own.schema['doc_id'].dataType.simpleString()}, place long, text string"

    def route(batches):
        for batch in batches:
            ids, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            bucket = [bisect_left(ends, (i is not None, i, p)) for i, p in zip(ids, places)]
            lent = [r for r, b in enumerate(bucket) if ends[b] == (ids[r] is not None, ids[r], places[r])]
            for rows, at, tail in ((range(len(ids)), bucket, False), (lent, [(bucket[r] + 1) % len(ends) for r in lent], True)):
                part = batch.take(pa.array(rows, pa.int64())) if tail else batch
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([tail] * len(at)), part.column(0), part.column(2), part.column(1)],
                                                     names=["bucket", "tail", "doc_id", "place", "text"])

    small_batches(spark)
    return (own.mapInArrow(route, schema).repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.desc("place")))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (last half replaced by the beginning of the next document, in
    descending order of ids), and the likeness to the edited text and to the next document.

    Rows without id come last; rows that share an id follow the digest of their texts. The next of the last one is the first,
    so a single document is its own successor.
    """
    placed = with_next(docs, doc_id, text)
    kind = placed.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "held"]
    types = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held double"

    def run(batches):
        last = None  # bucket, id, text, sketch of a row that waits for its successor
        for batch in batches:
            bucket, tail, ids = (batch.column(c).to_pylist() for c in (0, 1, 2))
            texts = batch.column(4).to_pylist()
            own = list(sketches(batch.column(4), k))
            pairs = []
            for row in zip(bucket, tail, ids, texts, own):
                if last is not None and last[0] == row[0]:
                    pairs.append((last, row))
                last = None if row[1] else row
            if not pairs:
                continue
            edited = [a[3][:len(a[3]) - len(a[3]) // 2] + b[3][:len(a[3]) // 2] for a, b in pairs]
            out = {f: [] for f in fields}
            for (a, b), text, new in zip(pairs, edited, sketches(pa.array(edited, pa.large_string()), k)):
                near, held = estimates(a[4], new, k)
                for f, v in zip(fields, (a[2], len(a[3]), hashlib.sha256(text.encode()).hexdigest(), as_text(a[4]), as_text(new),
                                         near, estimates(a[4], b[4], k)[0], distinct(a[4], k), held)):
                    out[f].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field(2).type), pa.array(out["n_chars"], pa.int64()),
                                              *(pa.array(out[f], pa.string()) for f in fields[2:5]), *(pa.array(out[f], pa.float64()) for f in fields[5:])],
                                             names=fields)

    return placed.mapInArrow(run, types)
