"""Prefix trie, fingerprints and ranked search against plain versions."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from intake_spark.llm import fingerprints, lexical_search, prefix_trie
from intake_spark.llm.oracles import SQL


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) without ties in turn."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                    brute.sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n)))))) for n, m in members.items())


def odd_conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 206, 301, 12345678901]:
        n = r.choice([1, 2, 3, 4, 7, 12])
        for t in range(n):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, r.choice(["user", "user", None]), r.choice(["a", "b", "", None, "🙂é", "x" * 300])))
    for c in range(400, 440):  # copies, and one that goes on for long
        rows += [(c, t, "user", f"turn {t}") for t in range(3)]
    rows += [(500, t, "user", str(t % 7)) for t in range(900)] + [(501 + k, t, "user", str(t % 7)) for k in range(9) for t in range(50 * k)]
    return rows + [(None, 1, "user", "nobody")] * 3


@pytest.mark.parametrize("least, held", [(100, 1 << 17), (1, 1)])
def test_trie(spark, least, held):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("other")).repartition(5)
    got = Counter(tuple(r) for r in prefix_trie.trie(frame, least, held).drop("a", "b").collect())
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.report(none).count() == 0
    assert prefix_trie.report(spark.createDataFrame([(None, 0, "user", "x")], none.schema)).count() == 0


def test_queue_spills_in_order():
    r = random.Random(2)
    items = [(r.randrange(50), r.randrange(9), k) for k in range(2000)]
    queue = prefix_trie.SpillingQueue(16)
    for i in items:
        queue.push(i)
    out = [i for key in range(50) for i in queue.pop_equal((key,))]
    assert queue.spilled and sorted(out) == sorted(items) and [i[0] for i in out] == sorted(i[0] for i in items) and not len(queue)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[max(0, i - 4):i + 1]) for i in range(len(w))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", ["3", "8"])
def test_fingerprints(spark, odd_docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(i, f"w{i} " * (i % 9) + "end") for i in range(100, 180)], "doc_id long, text string")
        rows = [(r.doc_id, r.text) for r in docs.unionByName(odd_docs.select("doc_id", "text")).collect()]
        got = fingerprints.report(docs.unionByName(odd_docs.select("doc_id", "text"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    # ties are ordered by a digest, so those rows are only counted
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    many = Counter(i for i, _ in order)
    by_id = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:]):
        if many[a[0]] > 1 or (many[b[0]] > 1 and len({t for i, t in order if i == b[0]}) > 1):
            continue
        x, t, nxt = by_id[a[0]], a[1] or "", b[1] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        assert (x.n_chars, x.edited_sha256) == (len(t), brute.sha(edited))
        A, B, C = shingles(t), shingles(edited), shingles(nxt)
        exact = len(A | B) <= fingerprints.K and len(A) < fingerprints.K
        assert abs(x.near_edited - jaccard(A, B)) <= (1e-9 if exact else 0.2)
        assert abs(x.near_next - jaccard(A, C)) <= 0.2 and (len(A) >= fingerprints.K or x.n_shingles == len(A))
    same = defaultdict(set)
    for r in got:
        if r.doc_id is not None and many[r.doc_id] == 1:
            same[dict(rows)[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.report(odd_docs.limit(0)).count() == 0
    one = fingerprints.report(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == brute.sha("ab ab")


def test_sketches_merge_and_estimate(spark):
    r = random.Random(1)
    text = " ".join(f"v{r.randrange(10**6)}" for _ in range(3000))
    words = text.split(" ")
    half, all_of = " ".join(words[:1500]), text
    frame = spark.createDataFrame([("x", half), ("x", all_of), ("y", None), ("y", ""), ("z", "one")] + [("x", half)] * 50, "part string, text string").withColumn("value", F.lit(1)).repartition(4)
    own = fingerprints.sketch(frame)
    assert own.columns == ["part", "text", "value", "sketch"]
    merged = {m.part: m.sketch for m in fingerprints.merge(own, ["part"]).collect()}
    whole = next(fingerprints.sketches(fingerprints.pa.array([text])))
    assert merged["x"] == (whole ^ fingerprints.SIGN).view(np.int64).tolist() and merged["y"] == [] and len(merged["z"]) == 1
    pair = own.where(F.col("text") == half).limit(1).select(F.col("sketch").alias("p")).join(own.where(F.col("text") == all_of).select(F.col("sketch").alias("q")))
    p, q = F.col("p"), F.col("q")
    got = pair.select(fingerprints.resemblance(p, q).alias("r"), fingerprints.containment(p, q).alias("c"), fingerprints.distinct_count(q).alias("n"), "p", "q").first()
    assert abs(got.r - 0.5) < 0.15 and got.c > 0.8 and abs(got.n - 3000) < 900
    a, b = ((np.array(x, np.int64).view(np.uint64) ^ fingerprints.SIGN) for x in (got.p, got.q))
    assert fingerprints.estimates(a, b) == pytest.approx((got.r, got.c)) and fingerprints.distinct(b) == pytest.approx(got.n)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items):
    terms = [(i, TERM.findall((t or "").translate(brute.LOWER))) for i, t in docs]
    N, L = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = Counter()
    for item, text in items:
        scores = []
        for i, t in terms:
            tf, m, s = Counter(t), 0, 0
            if t:
                m = 25 + 75 * len(t) * N // L
            for x in TERM.findall((text or "").translate(brute.LOWER)):
                if tf[x]:
                    s += floor(1000 * log((2 * N + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out.update((item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10], 1))
    return out


@pytest.mark.parametrize("shard, block", [(8 << 20, 1 << 16), (2000, 7)])
def test_search(spark, monkeypatch, odd_docs, shard, block):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "FIRST_STEP", 2)
    r = random.Random(4)
    more = [(1000 + k, " ".join(r.choice("the The a of fox dog jumps quick word é ΑΣ 日本語".split()) for _ in range(r.randrange(40)))) for k in range(150)]
    docs = spark.createDataFrame(more, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    items = [(1, "the quick brown fox"), (2, None), (3, ""), (4, "word WORD word dog"), (4, "nothing-known-here"), (None, "日本語 é ½"), (5, "same words here x"), (1, "the quick brown fox"), (6, "the of a " * 50)]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(0)).repartition(3)
    got = Counter(tuple(x) for x in lexical_search.report(docs.withColumn("places", F.lit(1)), queries).collect())
    assert got == plain_search([(x.doc_id, x.text) for x in docs.collect()], items)
    assert lexical_search.report(docs.limit(0), queries).count() == 0 and lexical_search.report(docs, queries.limit(0)).count() == 0


def test_nra_stops_early():
    """Reading ends as soon as the result is settled, and the result is that of reading everything."""
    r = np.random.default_rng(3)
    for trial in range(20):
        lists, total = [], np.zeros(5000, np.int64)
        for _ in range(4):
            places = r.permutation(5000)[:r.integers(1, 5000)]
            impacts = np.sort(r.zipf(1.3, len(places)).clip(1, 10**6))[::-1]
            factor = int(r.integers(1, 2000))
            lists.append((places.astype(np.int32), impacts.astype(np.int32), factor))
            total[places] += impacts * factor
        want = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s))[:10]
        assert lexical_search.nra(lists, 5000) == [(d, -s) for s, d in want]


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracles(spark, name):
    from intake_spark.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = duck.sql(SQL[name])
    got = QUERIES[name](spark, folder).select(want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
