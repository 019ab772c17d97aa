"""Benchmark decontamination: an FM-index per training shard, searched backward for all benchmark windows at once.

A window is ten consecutive words of an item; an item of one to nine words is one window. Words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Words count as equal when two 64-bit hashes agree.

A shard is a run of neighbouring documents (about 2 MB of text). Its words become numbers in the benchmark's vocabulary. A window can only
lie inside a run of vocabulary words at least as long as the shortest window, so the index is built over those runs;
every other stretch is one separator. The index holds the Burrows-Wheeler transform as a wavelet tree (one bit vector per level,
ranks from prefix sums) and every eighth suffix position; found intervals are located by stepping to a sampled suffix.

Benchmark texts are the stated query set. They are read in blocks of at most ``BLOCK_CHARS`` characters, each block one
broadcast and one pass inside the same scan, so no broadcast grows with the benchmark.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items that share an
id count as one; an item without id counts under the empty string; empty tables give no hits; repeated rows give repeated
rows; other columns of the input stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intake_spark.llm import words as W
from intake_spark.llm.tables import keeps_names

WINDOW = 10
SHARD_BYTES = 2 << 20
SAMPLED = 8
BLOCK_CHARS = 4_000_000


# ------------------------------------------------------------------------------------ index
def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks of length k pairs give ranks of length 2k, until all ranks differ."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=fresh[1:])
        rank[order] = fresh
        if fresh[-1] == n - 1 or k >= n:
            return order
        k *= 2


class WaveletTree:
    """Ranks of any symbol in a sequence, for many questions at once; levels are stored one after the other."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            counts = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(seq) - int(counts[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


class FmIndex:
    """``seq`` holds symbols from 1; 0 is the end mark."""

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.append(seq, 0)
        order = suffix_array(seq)
        self.last = seq[order - 1]
        self.tree = WaveletTree(self.last, symbols)
        self.before = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols), out=self.before[1:])
        self.sampled = order % SAMPLED == 0
        self.sample_rank = np.zeros(len(seq) + 1, np.int64)
        np.cumsum(self.sampled, out=self.sample_rank[1:])
        self.samples = order[self.sampled]

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all phrases (rows padded at the right), word by word from their ends."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for k in range(int(lengths.max(initial=0))):
            alive = np.flatnonzero((lengths > k) & (low < high))
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - k]
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]]))
            low[alive], high[alive] = both[:len(alive)], both[len(alive):]
        return low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk back to a sampled one and count the steps."""
        suffix, steps = suffix.copy(), np.zeros(len(suffix), np.int64)
        open_ = np.flatnonzero(~self.sampled[suffix])
        while len(open_):
            at = suffix[open_]
            suffix[open_] = self.step(self.last[at], at)
            steps[open_] += 1
            open_ = open_[~self.sampled[suffix[open_]]]
        return self.samples[self.sample_rank[suffix]] + steps


# ------------------------------------------------------------------------------------ phrases
class Phrases:
    """The windows of one block of items: vocabulary by word hash, distinct windows, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        column = pa.array([t for _, t in items], pa.string())
        self.ids = np.array(sorted({i for i, _ in items}), object)
        number = {i: k for k, i in enumerate(self.ids)}
        windows: dict[tuple, set] = {}
        vocabulary: dict[tuple, int] = {}
        for block in W.blocks(column, W.ALNUM, lower=True):
            both = list(zip(block.hashes(1).tolist(), block.hashes(2).tolist()))
            for i in range(block.rows):
                own = [vocabulary.setdefault(x, len(vocabulary)) for x in both[block.first[i]:block.last[i]]]
                size = min(window, len(own))
                for k in range(len(own) - size + 1 if size else 0):
                    windows.setdefault(tuple(own[k:k + size]), set()).add(number[items[block.first_row + i][0]])
        keys = np.array(list(vocabulary), np.uint64).reshape(-1, 2)
        order = np.argsort(keys[:, 0], kind="stable")
        self.first, self.second = keys[order, 0], keys[order, 1]
        symbol = np.empty(len(keys), np.int64)
        symbol[order] = np.arange(len(keys)) + 2  # 0 ends a shard, 1 separates runs
        self.symbols = len(keys) + 2
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.phrases = np.zeros((len(windows), int(self.lengths.max(initial=0))), np.int64)
        for k, w in enumerate(windows):
            self.phrases[k, :len(w)] = symbol[list(w)]
        self.item_at = np.concatenate([[0], np.cumsum([len(v) for v in windows.values()])]).astype(np.int64)
        self.items = np.array([x for v in windows.values() for x in sorted(v)], np.int64)

    def numbers(self, block: W.Block) -> np.ndarray:
        """The symbol of each word, 1 for a word that no item has."""
        h = block.hashes(1)
        out = np.ones(len(h), np.int64)
        if not len(self.first):
            return out
        at = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        known = np.flatnonzero(self.first[at] == h)
        second = W.segment_hash_of(block, known, 2)
        # equal first hashes with different second ones would be neighbours; the first that agrees wins
        same = self.second[at[known]] == second
        out[known[same]] = at[known[same]] + 2
        return out


def occurrences(block: W.Block, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in the block."""
    none = np.empty(0, np.int64)
    n = len(block.start)
    if not n or not len(phrases.lengths):
        return none, none
    symbol = phrases.numbers(block)
    known = symbol > 1
    # runs of vocabulary words that stay inside one text
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    firsts = block.first[(block.first < block.last)]
    begins[firsts] = known[firsts]
    run_start = np.flatnonzero(begins)
    ends = known.copy()
    ends[:-1] &= ~known[1:]
    lasts = block.last[(block.first < block.last)] - 1
    ends[lasts] = known[lasts]
    run_end = np.flatnonzero(ends) + 1
    long = run_end - run_start >= phrases.shortest
    run_start, size = run_start[long], (run_end - run_start)[long]
    if not len(size):
        return none, none
    # runs one after the other with a separator behind each
    total = int(size.sum() + len(size))
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    word = np.arange(total) - np.repeat(at, size + 1) + np.repeat(run_start, size + 1)
    seq = np.where(np.arange(total) - np.repeat(at, size + 1) < np.repeat(size, size + 1), symbol[np.minimum(word, n - 1)], 1)
    index = FmIndex(seq, phrases.symbols)
    low, high = index.search(phrases.phrases, phrases.lengths)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    suffix = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return word[index.locate(suffix)], which


def marks(block: W.Block, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit flag of every word; distinct (row, item number) pairs as two arrays."""
    first, which = occurrences(block, phrases)
    change = np.zeros(len(block.start) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    row = np.searchsorted(block.last, first, "right")
    n = (phrases.item_at[1:] - phrases.item_at[:-1])[which]
    item = phrases.items[np.repeat(phrases.item_at[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    pairs = np.unique(np.repeat(row, n) * np.int64(max(1, len(phrases.ids))) + item)
    return hit, pairs // max(1, len(phrases.ids)), pairs % max(1, len(phrases.ids))


def spans(block: W.Block, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged removal spans: row, first byte, byte behind the last, within the text."""
    doc = block.doc_of_word()
    new = hit.copy()
    if len(hit):
        new[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
    over = hit.copy()
    if len(hit):
        over[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
    row = doc[new]
    return row, block.start[new] - block.offsets[row], block.end[over] - block.offsets[row]


# ------------------------------------------------------------------------------------ operator
def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Phrases]:
    """The benchmark in blocks of a bounded number of characters."""
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chars = own.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Phrases([(r.i, r.t) for r in part.collect()])


def scan(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__hits``: n_words, the byte spans to remove, and the ids of items found.

    Each block of items adds to the struct inside the same scan; nothing is shuffled.
    """
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                    F.array().cast("array<int>").alias("words"), F.array().cast("array<long>").alias("spans"),
                    F.array().cast("array<string>").alias("items"))
    out = docs.withColumn("__hits", none)
    found = False
    for phrases in item_blocks(items):
        found = True
        out = _pass(out, phrases, text)
    return out if found else _pass(out, Phrases([]), text)


def _pass(df: DataFrame, phrases: Phrases, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(phrases)
    schema = df.schema

    def run(batches):
        own = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("__hits")
            old = batch.column(at)
            for block in W.blocks(batch.column(batch.schema.get_field_index(text)), W.ALNUM, lower=True, size=SHARD_BYTES):
                part = batch.slice(block.first_row, block.rows)
                hits = _hits(block, own, old.slice(block.first_row, block.rows))
                yield pa.RecordBatch.from_arrays([hits.cast(f.type) if k == at else part.column(k) for k, f in enumerate(part.schema)], schema=part.schema)

    return df.mapInArrow(run, schema)


def _ragged(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


def _hits(block: W.Block, phrases: Phrases, old: pa.StructArray) -> pa.StructArray:
    hit, row, item = marks(block, phrases)
    earlier = old.field("words")
    if len(earlier.flatten()):  # words that an earlier block of items has marked
        size = np.array(pa.compute.list_value_length(earlier))
        hit[np.repeat(block.first, size) + np.array(earlier.flatten())] = True
    at, start, end = spans(block, hit)
    doc = block.doc_of_word()
    hit_doc = doc[hit]
    ids = _ragged(phrases.ids[item].tolist() if len(item) else [], row, block.rows, pa.string())
    before = old.field("items")
    if len(before.flatten()):
        ids = pa.array([sorted({*a, *b}) for a, b in zip(before.to_pylist(), ids.to_pylist())], pa.list_(pa.string()))
    both = np.empty(2 * len(start), np.int64)
    both[::2], both[1::2] = start, end
    return pa.StructArray.from_arrays([
        pa.array(block.last - block.first, pa.int64()), pa.array(np.bincount(hit_doc, minlength=block.rows), pa.int64()),
        _ragged((np.flatnonzero(hit) - block.first[hit_doc]).astype(np.int32), hit_doc, block.rows, pa.int32()),
        _ragged(both, np.repeat(at, 2), block.rows, pa.int64()), ids], ["n_words", "n_hit", "words", "spans", "items"])


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how many words are hit and which items were found."""
    h = F.col("__hits")
    return scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items).select(
        "doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(h["items"]), ","), 256).alias("items_sha256"), (h["n_hit"] > 0).alias("contaminated"))


@keeps_names
def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs``; every removal span is cut out of its text. Texts without hits stay byte for byte."""
    marked = scan(docs, items, text)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at, hits = batch.schema.get_field_index(text), batch.schema.get_field_index("__hits")
            spans_ = batch.column(hits).field("spans")
            out = batch.column(at)
            if len(spans_.flatten()):
                out = pa.array([_cut(t.as_py(), s.as_py()) if len(s) else t.as_py() for t, s in zip(out, spans_)], out.type)
            yield pa.RecordBatch.from_arrays([out if k == at else batch.column(k) for k in range(batch.num_columns) if k != hits],
                                             names=[n for n in batch.schema.names if n != "__hits"])

    return marked.mapInArrow(run, schema)


def _cut(text: str, places: list[int]) -> str:
    raw, at, out = text.encode(), 0, []
    for start, end in zip(places[::2], places[1::2]):
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]]).decode()


def sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
