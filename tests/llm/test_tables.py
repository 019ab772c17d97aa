"""The operators over whole tables: near duplicates, classifier, URL filter, surrogates, pipeline."""
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from intake_spark.llm import decontaminate, near_dup, quality_classifier, quality_rules, secrets, surrogates, url_filter

SF = "/root/testdata/sf0.001"


def classes_of(rows, threshold=0.8):
    """{(doc_id, text): set of ids} by comparing every pair."""
    grams = {}
    for _, t in rows:
        w = brute.CONTAM.findall((t or "").translate(brute.LOWER))
        grams[t] = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])
    texts = [t for t in grams if grams[t]]
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            both = sum((grams[a] & grams[b]).values())
            if both >= threshold * (sum(grams[a].values()) + sum(grams[b].values()) - both):
                root[top(a)] = top(b)
    out = {}
    for i, t in rows:
        out[i, t] = min((j for j, u in rows if j is not None and grams[u] and grams[t] and top(u) == top(t)), default=None) if grams[t] else i
    return out


def near_copies(n=60, seed=3):
    r = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    # the copies stay under a third of all texts, so every shingle has its full weight
    rows += [(n + i, " ".join(r.choices(base, k=40))) for i in range(3 * n)]
    return rows + [(5, rows[5][1]), (None, rows[7][1]), (1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, "v " * 500), (1005, "v " * 500 + "u")]


@pytest.mark.parametrize("block", [400, 16])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", block)
    rows = near_copies()
    want = classes_of(rows)
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {i for i, _ in rows if i is not None}
    by = {i: c for (i, _), c in want.items() if i is not None}
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == by and set(by) == ids
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(by.values()))


def test_near_copies_in_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = classes_of(rows)
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == {i: c for (i, _), c in want.items()}


def test_samples_follow_similarity():
    import pyarrow as pa

    from intake_spark.llm import words as W
    r = random.Random(1)
    same = []
    for k in range(40):
        words = [f"{k}a{i}" for i in range(200)]
        other = words[:150] + [f"{k}b{i}" for i in range(50)]
        block = next(W.blocks(pa.array([" ".join(words), " ".join(other)]), W.ALNUM, lower=True))
        s = near_dup.Shingles(block)
        out = near_dup.samples(s, s.count.astype(np.float32))
        same.append((out[0] == out[1]).mean())
    assert abs(np.mean(same) - 146 / 246) < 0.05 and r


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.report(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.6 * len(bad)


def test_scores_ignore_neighbours(spark, odd_docs):
    r = np.random.default_rng(0)
    w = {"table": r.normal(0, 1, (8, 256, 16)), "bias": np.zeros(16), "echo": r.normal(0, 1, (32, 8)), "echo_bias": np.zeros(8), "out": r.normal(0, 1, 24), "out_bias": np.zeros(1), "prior": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    a = {(x.doc_id, x.score) for x in quality_classifier.score(odd_docs.coalesce(1), w).collect()}
    b = {(x.doc_id, x.score) for x in quality_classifier.score(odd_docs.repartition(9), w).collect()}
    assert {(i, round(s, 4)) for i, s in a} == {(i, round(s, 4)) for i, s in b}
    none = quality_classifier.report(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {x.score for x in none.collect()} == {0.5}


def plain_rule(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
    fit = [r for r, _ in url_filter.RULES if (host == r[:r.index("/")] or host.endswith("." + r[:r.index("/")])) and path.startswith(r[r.index("/"):])]
    rule = max(fit, key=len, default=None)
    return host, path, rule, dict(url_filter.RULES).get(rule)


def test_url_rules(spark):
    urls = ["http://www.Example.com/en/1?x", "https://a.www.example.com/en/", "http://example.com/en", "http://com/", "http://xcom/", "x.com/en/", None, "", "://", "http://a.net/es/1#f", "HTTP://A.NET?x=/es/",
            "http://a.org/" + "d/" * 3000, "http://a.net/ES/", "a://b://c.com/x", "http://u:p@h.com:80/é"] * 2
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.lit("z").alias("rule"))
    pages = pages.union(spark.createDataFrame([(10**6 + i, u, "y") for i, u in enumerate(urls)], "page_id long, url string, rule string"))
    got = url_filter.judge(pages).collect()
    plain = {r.page_id: plain_rule(r.url) for r in pages.collect()}
    assert len(got) == len(plain)
    for r in got:
        assert (r.host, r.path, r.rule) == plain[r.page_id][:3]
        assert r.verdict in ("allow", "block") and plain[r.page_id][3] in (None, r.verdict)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates(spark):
    rows = [f"http://bad.net/{lang}/{k}" for lang in ("es", "fr", "zz") for k in range(30)] + [f"http://good.org/a/{k}" for k in range(30)]
    got = {r.path: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).where("rule is null").collect()}
    assert got["/zz/3"].template == "/zz/*" and got["/zz/3"].verdict == "allow"  # no labelled page of its own
    assert got["/a/3"].template == "/a/*" and got["/a/3"].verdict == "allow"


PII = ["call +1 (716) 555-8176 or (716) 555-8176 or 716-555-8176. mail a.b.92@mail2.example.com or A.B.92@MAIL2.EXAMPLE.COM; ip 172.242.194.228, 10.1.2.3",
       "card 4111 1111 1111 1111 and 4111111111111111, ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00 or DE89370400440532013000",
       "Mrs. Anna Schmidt met Mr Peter Lang; later Ms Schmidt and Анна Каренина came. Госпожа Каренина. No Name here.", None, "", "nothing personal"]


def test_surrogates(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PII)] * 2, "doc_id long, text string, kind string")
    got = surrogates.replace(df)
    assert got.columns == [*df.columns, "__pii"] and got.count() == 12
    new = {r.doc_id: r.text for r in got.collect()}
    assert new[3] is None and new[4] == "" and new[5] == "nothing personal"
    for i in range(3):
        old = [m for p in (surrogates.EMAIL, surrogates.IP, surrogates.SSN, surrogates.CARD, surrogates.PHONE) for m in re.findall(p, PII[i])]
        assert not [x for x in old if isinstance(x, str) and x in new[i]]
    a, b, c = re.findall(r"\d{3}\)? ?-?\d{3}-\d{4}", new[0])
    assert len({re.sub(r"\D", "", x) for x in (a, b, c)}) == 1 and "+1 (" in new[0]
    m = re.findall(r"\S+@\S+?[.;]?(?=[ ;]|$)", new[0])
    assert m[0].rstrip(".;").lower() == m[1].rstrip(".;").lower() and m[1][0].isupper()
    assert re.search(r", 10\.\d+\.\d+\.\d+", new[0])
    x, y = re.search(r"card ([\d ]{19}) and (\d{16})", new[1]).groups()
    assert x.replace(" ", "") == y and y[0] == "4" and sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, y))) % 10 == 0
    iban = re.search(r"or (DE\d{20})", new[1])[1]
    assert int("".join(str(int(z, 36)) for z in iban[4:] + iban[:4])) % 97 == 1
    name = re.search(r"Mrs\. (\S+)ia (\S+) met", new[2])
    assert f"Ms {name[2]} and" in new[2] and "No Name here" in new[2] and "Госпожа" in new[2] and "Каренина" not in new[2]
    other = surrogates.replace(df, key="another").where("doc_id = 0").first().text
    assert other != new[0]


def test_surrogates_stay_distinct(spark, monkeypatch):
    # so few surrogates that draws must clash
    monkeypatch.setattr(surrogates, "draw", lambda kind, value, h, *_: F.concat(F.lit("s"), F.pmod(surrogates._byte(h, F.lit(0)), F.lit(64)).cast("string")))
    df = spark.createDataFrame([("email", f"e{i}") for i in range(40)], "kind string, value string")
    got = surrogates.mapping(df).collect()
    assert len(got) == 40 == len({r.surrogate for r in got})


def test_surrogates_leave_other_texts(docs):
    got = {r.doc_id: r for r in surrogates.report(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        if not got[r.doc_id].n_entities:
            assert got[r.doc_id].text == r.text
        for p in (surrogates.EMAIL, surrogates.IP, surrogates.CARD):
            assert not set(re.findall(p, r.text or "")) & set(re.findall(p, got[r.doc_id].text or ""))


def test_pipeline(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, SF)
    assert one.columns == docs.columns and set(one.select("doc_id").toPandas().doc_id) == {r.doc_id for r in quality_rules.judge(docs).select("doc_id", "__quality.kept").collect() if r.kept}
    one = spark.createDataFrame(one.collect(), docs.schema)
    two = spark.createDataFrame(stages[1](spark, one, SF).collect(), docs.schema)
    named = classes_of([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in two.collect()} == set(named.values())
    three = spark.createDataFrame(stages[2](spark, two, SF).collect(), docs.schema)
    assert decontaminate.report(three, items).where("contaminated").count() == 0 and three.count() == two.count()
    four = stages[3](spark, three, SF)
    assert four.columns == docs.columns and secrets.report(four).where("spans != ''").count() == 0
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = {r.doc_id: r for r in four.collect()}
    assert set(rows) == set(want)
    assert all(rows[i].decoded == want[i].text and rows[i].n_tokens == len(rows[i].ids) and want[i].n_chars == len(want[i].text) for i in rows)
