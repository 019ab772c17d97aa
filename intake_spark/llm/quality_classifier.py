"""Quality classifier: a byte-level convolutional network in NumPy.

The bytes of a whole text are cut into overlapping chunks of 256 bytes (steps of 128). Two banks of learned filters look at each chunk:

* ``FILTERS`` filters of 8 bytes, applied at every fourth byte; each has one weight per place and byte value
* ``ECHOES`` filters over 32 self-match channels (how often a byte equals the one d places before it, d = 1..32), which show repetition

Responses pass a rectifier, are averaged within a chunk and max-pooled over all chunks; a logistic unit combines the pooled values into one
probability. All weights are learned together by full-batch Adam on at most ``SAMPLE`` labelled texts per class (those with the smallest hash
of their id; a documented bound), and the prior is set back to that of all training labels. Everything else covers all rows. Inputs are bytes alone.

Defined cases: a null or empty text is one empty chunk and gets a score as well; without labels every score is 0.5, with one class only the smoothed
share of label 1; rows with a null label or id do not teach; a document with several labels counts with the lowest; repeated rows get
equal results whatever their neighbours are; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intake_spark.llm import words as W

UNIT, STRIDE, WIDTH, LAGS = 128, 4, 8, 32
FILTERS, ECHOES = 16, 8
SAMPLE, STEPS, RATE, DECAY = 500, 70, 0.03, 1e-4
THRESHOLD = 0.3
GAP = 40  # zero bytes behind each text, more than any lag or filter


class Layout:
    """Texts of a block, each padded to whole units, so that no filter sees two texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        units = (size + GAP + UNIT - 1) // UNIT
        self.first = np.concatenate([[0], np.cumsum(units)]).astype(np.int64)
        n = int(self.first[-1])
        at = np.arange(len(data)) + np.repeat(self.first[:-1] * UNIT - offsets[:-1], size)
        self.flat = np.zeros(n * UNIT + WIDTH, np.uint8)
        self.flat[at] = data
        other = np.ones(n * UNIT, np.uint8)  # padding that equals no padding of the first copy
        other[at] = data
        flat = self.flat[:n * UNIT]
        self.places = (flat[::STRIDE] != 0).reshape(n, -1)
        used = (flat != 0).reshape(n, UNIT).sum(1)
        echo = np.empty((n, LAGS), np.float32)
        same = np.zeros(n * UNIT, np.uint8)
        for d in range(1, LAGS + 1):
            same[:d] = 0
            np.equal(flat[d:], other[:-d], out=same[d:].view(bool))
            echo[:, d - 1] = same.reshape(n, UNIT).sum(1, dtype=np.uint8)
        # a chunk is a unit and the next one of the same text; a text of one unit is one chunk
        last = np.zeros(n, bool)
        last[self.first[1:] - 1] = True
        self.pair = np.where(last, np.arange(n), np.arange(n) + 1)
        own = ~last
        self.echo = (echo + echo[self.pair] * own[:, None]) / np.maximum(1, used + used[self.pair] * own)[:, None]
        self.own = own
        count = self.places.sum(1)
        self.count = np.maximum(1, count + count[self.pair] * own).astype(np.float32)

    def responses(self, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Rectified responses by place and filter; places in padding give 0."""
        n = self.places.size
        out = np.tile(bias, (n, 1))
        for j in range(WIDTH):
            out += table[j].take(self.flat[j:j + n * STRIDE:STRIDE], axis=0)
        np.maximum(out, 0, out=out)
        out *= self.places.reshape(-1, 1)
        return out

    def pooled(self, per_chunk: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(per_chunk, self.first[:-1], axis=0)

    def chunk_means(self, responses: np.ndarray) -> np.ndarray:
        sums = responses.reshape(len(self.places), -1, responses.shape[1]).sum(1)
        return (sums + sums[self.pair] * self.own[:, None]) / self.count[:, None]


def forward(x: Layout, w: dict[str, np.ndarray]) -> np.ndarray:
    """Log odds of label 1 for each text."""
    a = x.pooled(x.chunk_means(x.responses(w["table"], w["bias"])))
    b = x.pooled(np.maximum(x.echo @ w["echo"] + w["echo_bias"], 0))
    return np.hstack([a, b]) @ w["out"] + w["out_bias"][0]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    x = Layout(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    w = {"table": r.normal(0, 0.1, (WIDTH, 256, FILTERS)), "bias": np.full(FILTERS, 0.1), "echo": r.normal(0, 0.5, (LAGS, ECHOES)),
         "echo_bias": np.zeros(ECHOES), "out": r.normal(0, 0.3, FILTERS + ECHOES), "out_bias": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    docs, per_unit = np.arange(len(texts)), UNIT // STRIDE
    doc_of = np.repeat(docs, np.diff(x.first))

    def best(per_chunk, top):
        """The first chunk of each text that reaches the pooled value."""
        at = np.empty(top.shape, np.int64)
        for f in range(top.shape[1]):
            hit = np.flatnonzero(per_chunk[:, f] == top[doc_of, f])
            at[:, f] = hit[np.searchsorted(doc_of[hit], docs)]
        return at

    for step in range(1, STEPS + 1):
        resp = x.responses(w["table"], w["bias"])
        mean = x.chunk_means(resp)
        top = x.pooled(mean)
        echo = np.maximum(x.echo @ w["echo"] + w["echo_bias"], 0)
        echo_top = x.pooled(echo)
        feature = np.hstack([top, echo_top])
        p = 1 / (1 + np.exp(-np.clip(feature @ w["out"] + w["out_bias"][0], -30, 30)))
        g = ((p - labels) / len(texts)).astype(np.float32)
        grad = {"out": feature.T @ g, "out_bias": np.array([g.sum()])}
        back = g[:, None] * w["out"][None, :]
        chunk = best(echo, echo_top)
        live = back[:, FILTERS:] * (echo_top > 0)
        grad["echo"] = np.stack([x.echo[chunk[:, f]].T @ live[:, f] for f in range(ECHOES)], 1)
        grad["echo_bias"] = live.sum(0)
        chunk = best(mean, top)
        table = np.zeros((WIDTH, 256, FILTERS), np.float32)
        bias = np.zeros(FILTERS, np.float32)
        for f in range(FILTERS):
            units = np.stack([chunk[:, f], np.where(x.own[chunk[:, f]], x.pair[chunk[:, f]], -1)], 1)
            flow = np.repeat((back[:, f] / x.count[chunk[:, f]])[:, None], 2, 1) * (units >= 0)
            at = (np.maximum(units, 0)[:, :, None] * per_unit + np.arange(per_unit)).ravel()
            flow = np.repeat(flow.ravel(), per_unit) * (resp[at, f] > 0)
            bias[f] = flow.sum()
            for j in range(WIDTH):
                table[j, :, f] = np.bincount(x.flat[at * STRIDE + j], flow, 256)
        grad |= {"table": table, "bias": bias}
        for k, v in grad.items():
            v = v + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            w[k] = (w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Weights from the labelled rows that are not held out."""
    teach = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    teach = teach.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r.n for r in teach.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    zero, one = counts.get(0, 0), counts.get(1, 0)
    blank = {"prior": np.array([np.log((one + 1) / (zero + 1))])}
    if not zero or not one:
        return blank
    picked = [teach.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    ids = picked[0].union(picked[1])  # 2 x SAMPLE rows
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    y = np.array([r.quality for r in rows], np.float32)
    if y.min(initial=1) == y.max(initial=0):
        return blank
    w = train([(r.text or "").encode() for r in rows], y)
    # the sample is balanced, the labels are not
    return w | {"prior": np.array([np.log(one / zero) - np.log(y.sum() / (len(y) - y.sum()))], np.float32)}


def score(docs: DataFrame, weights: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # fixed size, under 200 kB

    def run(batches):
        w = shared.value
        for batch in batches:
            out = [np.empty(0)]
            for block in W.blocks(batch.column(1)):
                odds = forward(Layout(block.data, block.offsets), w) if "table" in w else np.zeros(block.rows)
                out.append(1 / (1 + np.exp(-np.clip(odds.astype(np.float64) + w["prior"][0], -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], names=["doc_id", "score"])

    scored = own.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
