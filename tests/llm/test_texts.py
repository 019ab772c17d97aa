"""The per-text operators against plain versions, on odd texts and on the smallest tables."""
import random

import brute
import public_tokenizers
import pytest
from conftest import ODD_TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from intake_spark.llm import bpe, decontaminate, quality_rules, secrets, substring_dedup, token_counts

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(params=["odd", "given"])
def some(request, odd_docs, docs):
    return odd_docs if request.param == "odd" else docs


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_bpe(some):
    t = Tokenizer.from_file(BYTE_BPE)
    want = []
    for i, x in pairs(some):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), __import__("hashlib").sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(),
                     brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert by_id(bpe.digests(some, BYTE_BPE).collect()) == by_id(want)


def fuzz(n, seed):
    r = random.Random(seed)
    alphabet = ["a", "B", "é", "ß", "Σ", "İ", "ñ", "日", "1", "٣", "½", "'s", "'LL", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "​",
                "́", "̈", "!", "##", "_", "<|endoftext|>", "<|startoftext|>", "🙂", "‍", "﻿", "\x00", "tion", "the", "ﬁ", "Å", "K"]
    return ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(n)]


def test_bpe_on_random_texts():
    t, own = Tokenizer.from_file(BYTE_BPE), bpe.load(BYTE_BPE)
    for x in fuzz(3000, 1):
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x).tolist() == ids, repr(x)
        assert own.decode(own.encode(x)) == t.decode(ids, skip_special_tokens=False), repr(x)


def test_bpe_columns(some):
    coded = bpe.with_text(bpe.with_ids(some, BYTE_BPE), BYTE_BPE)
    assert coded.columns == [*some.columns, "ids", "decoded"]
    assert coded.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    once = bpe.coded(some, BYTE_BPE)
    assert once.schema == coded.schema and by_id(once.collect()) == by_id(coded.collect())


def test_bpe_memory_is_bounded():
    memory = bpe._Memory(str.encode, 3)
    for x in ["a", "b", "a", "c", "d", "a", "e", "f", "g", "x" * 100, "a"]:
        assert memory[x] == x.encode() and len(memory) <= 3 and len(memory.old) <= 3
    assert "x" * 100 not in memory and "x" * 100 not in memory.old


def test_counts_on_random_texts():
    t = Tokenizer.from_file(WORD_BPE)
    texts = fuzz(3000, 2)
    assert token_counts.count_tokens(texts, WORD_BPE) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_counts(some, tmp_path):
    t = Tokenizer.from_file(WORD_BPE)
    want = by_id((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in pairs(some))
    cache = f"file://{tmp_path}/cache"
    assert by_id(token_counts.counts(some, WORD_BPE, cache).collect()) == want
    stored = some.sparkSession.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count()
    assert by_id(token_counts.counts(some, WORD_BPE, cache).collect()) == want
    assert some.sparkSession.read.parquet(cache).count() == n  # nothing left to encode


def test_quality(some):
    q = F.col(quality_rules.OWN)
    got = quality_rules.judge(some).select("doc_id", "text", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))).collect()
    assert by_id(r[:8] for r in got) == by_id((i, x, *brute.quality(x)) for i, x in pairs(some))
    assert not any(r.base_failed and r.kept for r in got)


def test_order_of_rules_changes_no_verdict(docs):
    q = F.col(quality_rules.OWN)
    a, b = (by_id(quality_rules.judge(docs, rules=r).select("doc_id", q["kept"]).collect()) for r in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert a == b
    assert {r.name for r in quality_rules.plan_cascade(docs)} == {r.name for r in quality_rules.RULES}


def test_good_texts_stay(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    q = F.col(quality_rules.OWN)
    rows = quality_rules.judge(docs).join(labels, "doc_id").select("quality", q["base_failed"].alias("base_failed"), q["kept"].alias("kept")).collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good)
    assert sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_substring_dedup(some):
    want = brute.substring_dedup(pairs(some))
    got = substring_dedup.report(some).collect()
    assert by_id(got) == by_id((i, *want[i, x]) for i, x in pairs(some))


def test_decontaminate(spark, some):
    items = spark.createDataFrame([(1, "The quick, brown fox!"), (2, "jumps over the lazy dog and runs far away from the big bad wolf in"), (2, "same words"), (None, "nul"), (7, None),
                                   (8, " .,"), (9, "ΑΣ οδος")], "item_id long, text string")
    items = items.union(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text"))
    want = brute.decontaminate(pairs(some), [tuple(r) for r in items.collect()])
    got = decontaminate.report(some, items).collect()
    assert by_id(got) == by_id((i, *want[i, x]) for i, x in pairs(some))


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = by_id(decontaminate.report(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert len(list(decontaminate.item_blocks(items))) > 2
    assert by_id(decontaminate.report(docs, items).collect()) == whole
    assert sum(r[-1] for r in whole) > 0


def test_cut_texts_hold_no_window(spark, some):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    cut = decontaminate.clean(some, items)
    assert cut.columns == some.columns and cut.count() == some.count()
    left = decontaminate.report(cut, items).where("contaminated").count()
    assert left == 0
    same = decontaminate.report(some, items).where("not contaminated and doc_id is not null").select("doc_id")
    key = ["doc_id", "text"]
    assert some.join(same, "doc_id").select(key).exceptAll(cut.join(same, "doc_id").select(key)).count() == 0


def test_fm_index():
    import numpy as np
    r = np.random.default_rng(0)
    for n, k in ((1, 1), (5, 1), (200, 2), (500, 9)):
        seq = r.integers(1, k + 1, n)
        index = decontaminate.FmIndex(seq, k + 1)
        phrases = r.integers(1, k + 1, (30, 3))
        lengths = r.integers(1, 4, 30)
        low, high = index.search(phrases, lengths)
        for p, size, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(n - size + 1) if (seq[i:i + size] == p[:size]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_secrets(some):
    got = secrets.report(some).collect()
    assert by_id(r[:5] for r in got) == by_id((i, *brute.secrets(x)) for i, x in pairs(some))


def test_secrets_in_layers(spark):
    import base64
    import bz2
    import gzip
    import urllib.parse
    import zlib
    plain = "password=hunter2hunter2"
    b64 = lambda b: base64.b64encode(b).decode()
    layers = {
        "plain": plain,
        "url": urllib.parse.quote(plain, safe=""),
        "url of url": urllib.parse.quote(urllib.parse.quote(plain, safe=""), safe=""),
        "escapes": "".join(f"\\u{ord(c):04x}" for c in plain),
        "references": "".join(f"&#{ord(c)};" for c in plain),
        "base64": b64(plain.encode()),
        "url-safe": base64.urlsafe_b64encode(b"~~~???" + plain.encode()).decode(),
        "gzip": b64(gzip.compress(plain.encode())), "zlib": b64(zlib.compress(plain.encode())), "bzip2": b64(bz2.compress(plain.encode())),
        "deep": b64(urllib.parse.quote(b64(gzip.compress(b64(plain.encode()).encode())), safe="").encode()),
    }
    rows = [(k, f"ä🙂 before {v} after", v) for k, v in layers.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string, v string")
    for r in secrets.report(df).collect():
        v = layers[r.doc_id]
        spans = [tuple(x.split(":")) for x in r.spans.split(",")]
        assert any(k == "assign" for k, _, _ in spans), r
        assert all(10 <= int(s) < int(e) <= 10 + len(v) for _, s, e in spans), r
    for r in secrets.hide(df).collect():
        assert "hunter" not in r.text and r.text.startswith("ä🙂 before ") and r.text.endswith(" after")
        assert not secrets.find(r.text)[1]
    assert secrets.find("%2525252541 \\u005cu0041 " + b64(b"nothing to see here"))[1] == []


def test_empty_tables(no_docs, spark, tmp_path):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for df in (bpe.digests(no_docs, BYTE_BPE), substring_dedup.report(no_docs), token_counts.counts(no_docs, WORD_BPE, f"file://{tmp_path}/none"),
               decontaminate.report(no_docs, items), secrets.report(no_docs), quality_rules.keep_good(no_docs)):
        assert df.count() == 0


def test_no_items(docs, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, items).where("n_hit > 0 or n_items > 0").count() == 0
    assert len(ODD_TEXTS) > 30
