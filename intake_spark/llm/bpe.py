"""BPE encoding and decoding with a byte-level vocabulary.

Encoding follows the file's own rules: strings of added tokens stand for themselves, the rest is cut by the byte-level pattern, and
each piece is merged by a priority queue of merge ranks over a doubly linked list of symbols. Entries whose pair has changed since
they were queued are skipped when they come up. Decoding concatenates the vocabulary's strings (as bytes) and reads the result as UTF-8.

Pieces of text repeat, so a task keeps the results of short pieces in dictionaries of bounded size. A text is cut at single spaces
before it is cut by the pattern, because a space followed by a visible character always starts a new piece; texts with
a space before other white space go through the pattern as a whole.

Defined cases: a null text counts as empty and has no tokens; texts of any length are encoded whole; repeated rows get equal
results; empty tables give empty results; other columns stay.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published cut of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Results in one generation of a worker's memories (of pieces behind a space, of words inside pieces, of first pieces), and the longest piece worth remembering.
BEHIND_SPACE, INSIDE, FIRST, LONGEST = 150_000, 60_000, 10_000, 64
#: Bytes of text that are coded before their rows are handed on.
SLICE = 4 << 20
LATER, SHORT = 32, 13


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Memory(dict):
    """Results by piece in two generations: a full one becomes the old one, and what is asked for again moves back from there."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if spec["normalizer"] or odd or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = byte_letters()
        vocabulary = model["vocab"]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.symbol = [vocabulary[c] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocabulary[a] << LATER | vocabulary[b]] = k
            self.made.append(vocabulary[a + b])
        self.first = [self.rank.get(self.symbol[a] << LATER | self.symbol[b], -1) for a in range(256) for b in range(256)]
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s.encode() for s, i in self.added.items()})
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.space_before_space = re.compile(r" \s")
        self.pieces = _Memory(lambda p: self._by_pattern(p), FIRST)
        self.after_space = _Memory(lambda p: self._by_pattern(" " + p), BEHIND_SPACE)
        self.words = _Memory(lambda w: array("I", self.merge(w.encode())).tobytes(), INSIDE)

    def merge(self, data: bytes) -> list[int]:
        """Merge pairs by rank, leftmost first, over a doubly linked list.

        ``now`` holds the rank of the pair that begins at a place; an entry of the queue with another rank is stale.
        """
        symbol = [self.symbol[b] for b in data]
        first, n = self.first, len(symbol)
        now = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        low = SHORT if n < 1 << SHORT else LATER  # small numbers are quicker
        mask = (1 << low) - 1
        queue = [r << low | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return symbol
        heapq.heapify(queue)
        pop, push, rank, made = heapq.heappop, heapq.heappush, self.rank.get, self.made
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        now.append(-1)
        while queue:
            entry = pop(queue)
            i, r = entry & mask, entry >> low
            if now[i] != r:
                continue  # stale: one of the two has been merged since
            j = right[i]
            a = symbol[i] = made[r]
            symbol[j] = now[j] = now[i] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rank(a << LATER | symbol[k], -1)
                if r >= 0:
                    now[i] = r
                    push(queue, r << low | i)
            h = left[i]
            if h >= 0:
                r = now[h] = rank(symbol[h] << LATER | a, -1)
                if r >= 0:
                    push(queue, r << low | h)
        return [s for s in symbol if s >= 0]

    def _by_pattern(self, text: str) -> bytes:
        words = self.pattern.findall(text)
        if len(words) == 1:  # the caller remembers it
            return array("I", self.merge(text.encode())).tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        if self.space_before_space.search(text):
            return self._by_pattern(text)
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.after_space.__getitem__, rest)) if rest else self.pieces[first]

    def encode(self, text: str) -> np.ndarray:
        """Token ids as unsigned 32-bit numbers."""
        if self.cut_added is None or not self.cut_added.search(text):
            raw = self._plain(text)
        else:
            raw = b"".join(array("I", [self.added[p]]).tobytes() if k % 2 else self._plain(p)
                           for k, p in enumerate(self.cut_added.split(text)))
        return np.frombuffer(raw, np.uint32).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def release() -> None:
    """Give a worker's vocabularies and memories back: idle workers stay for a minute, beside the executor's next stage."""
    load.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the decoded text."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def coded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``docs``, the token ids, and the text that the ids decode to; columns of those names are replaced.

    Both come from one pass, so a task needs one Python worker, and rows are handed on in slices of bounded size.
    """
    kept = docs.drop(ids, decoded)
    names = kept.columns

    def slices(batch):
        first, size = 0, 0
        for k, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(names.index(text))), 0).to_pylist()):
            size += n
            if size >= SLICE:
                yield batch.slice(first, k + 1 - first)
                first, size = k + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                found = [bpe.encode(t.as_py() or "") for t in part.column(names.index(text))]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(map(bpe.decode, found), pa.string())], names=[*names, ids, decoded])
        del bpe
        release()

    return kept.mapInArrow(run, kept.withColumns({ids: F.array().cast("array<int>"), decoded: F.lit("")}).schema)


def with_ids(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the token ids; a column of that name is replaced."""
    kept = docs.drop(name)
    names = kept.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            found = [bpe.encode(t.as_py() or "") for t in batch.column(names.index(text))]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, name])

    return kept.mapInArrow(run, kept.withColumn(name, F.array().cast("array<int>")).schema)


def with_text(coded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns of ``coded`` and the decoded text; a null list decodes to an empty text."""
    kept = coded.drop(name)
    names = kept.columns

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.uint32)) for x in batch.column(names.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, name])

    return kept.mapInArrow(run, kept.withColumn(name, F.lit("")).schema)
