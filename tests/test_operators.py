"""Operators against brute force and against values worked out by hand."""
import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intake_spark import lexicon as L
from intake_spark.operators import business as B
from intake_spark.operators import evidence as E
from intake_spark.operators import lookups as LK
from intake_spark.operators import metrics as M
from intake_spark.operators import neighbors as N
from intake_spark.operators import repair as R
from intake_spark.operators import splits as S
from intake_spark.operators import stats as T
from intake_spark.session import publish


# ------------------------------------------------------------------------------------ repair
def test_hindi_phrases(spark):
    pairs = {"mera purifier kharab ho gaya": "mera purifier not working", "fan se paani tapak raha hai": "fan se leaking water",
             "bill nahi mila": "invoice not received"}
    df = spark.createDataFrame([(k, v) for k, v in pairs.items()], "s string, want string")
    assert all(r.got == r.want for r in df.select(R.hinglish_to_english(F.col("s")).alias("got"), "want").collect())


def test_spelling_keeps_hindi_words(spark):
    vocab = publish(spark.createDataFrame([(0, w) for w in ("purifier", "leaking", "water", "bottom")], "split int, word string"), "v")
    texts = spark.createDataFrame([(0, "purifer leking watr"), (0, "mera purifier"), (0, "Watr!")], "split int, text string")
    got = {r.text: r.fixed for r in R.spell_correct(texts, vocab).collect()}
    assert got == {"purifer leking watr": "purifier leaking water", "mera purifier": "mera purifier", "Watr!": "water!"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_spelling_finds_what_comparing_all_words_finds(spark, monkeypatch, broadcast):
    """The piece join must not miss a pair: checked against difflib over the whole vocabulary."""
    rng = random.Random(3)
    letters = "abcdeilnorst"
    vocab = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(400)}
                   | {"installation", "installer", "installed", "warranty", "replacement", "purifier"})

    def damage(w):
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            op = rng.choice("ids")
            if op == "i":
                w.insert(i, rng.choice(letters))
            elif i < len(w):
                if op == "d":
                    del w[i]
                else:
                    w[i] = rng.choice(letters)
        return "".join(w)

    words = sorted({d for d in (damage(rng.choice(vocab)) for _ in range(300)) if len(d) >= 4 and d not in vocab})
    want = {}
    for w in words:
        best = difflib.get_close_matches(w, vocab, n=1, cutoff=0.8)
        if best:
            want[w] = best[0]
    if not broadcast:
        monkeypatch.setattr(LK, "is_small", lambda *a, **k: False)
    v = publish(spark.createDataFrame([(0, w) for w in vocab], "split int, word string"), "v")
    u = publish(spark.createDataFrame([(0, w) for w in words], "split int, word string"), "u")
    got = {r.word: r.known for r in R.best_known_word(u, v).collect()}
    assert got == want and len(want) > 50


def test_typos_do_not_depend_on_partitions(spark, history):
    one = history.select("request_id", R.corrupt(F.col("text"), F.col("request_id"), 0.3, 5).alias("t"))
    many = history.repartition(7).select("request_id", R.corrupt(F.col("text"), F.col("request_id"), 0.3, 5).alias("t"))
    a, b = {r.request_id: r.t for r in one.collect()}, {r.request_id: r.t for r in many.collect()}
    assert a == b
    plain = {r.request_id: r.text for r in history.collect()}
    changed = sum(a[k] != plain[k] for k in a)
    assert 0.5 * len(a) < changed < len(a)


# ------------------------------------------------------------------------------------ neighbours
def _grams(text):
    out = {}
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            for i in range(max(1, len(w) - n + 1)):
                out[w[i:i + n]] = out.get(w[i:i + n], 0) + 1
            if len(w) <= n:
                break
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest_phrase_is_the_nearest(spark, monkeypatch, broadcast):
    rng = random.Random(11)
    stems = ["motor", "burnt", "smell", "water", "leaking", "invoice", "not", "received", "charged", "twice", "filter", "kit", "P", "of",
             "for", "the", "installer", "warranty", "rejected", "noise"]
    keys = sorted({" ".join(rng.choice(stems) for _ in range(rng.randint(2, 5))) for _ in range(120)})
    texts = sorted({" ".join(rng.choice(stems + ["moter", "leeking", "xyzzy"]) for _ in range(rng.randint(1, 5))) for _ in range(60)} - set(keys))
    df = {}
    for k in keys:
        for g in _grams(k):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(keys)) / (1 + c)) + 1 for g, c in df.items()}

    def unit(text):
        v = {g: (1 + math.log(c)) * idf[g] for g, c in _grams(text).items() if g in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / n for g, x in v.items()} if n else {}

    known = {k: unit(k) for k in keys}
    want = {}
    for t in texts:
        v = unit(t)
        sims = [(-round(sum(x * known[k].get(g, 0.0) for g, x in v.items()), 9), k) for k in keys]
        if v and min(sims)[0] < 0:
            want[t] = min(sims)
    if not broadcast:
        monkeypatch.setattr(LK, "is_small", lambda *a, **k: False)
    got = N.nearest_phrase(spark.createDataFrame([(0, t) for t in texts], "split int, last string"),
                           spark.createDataFrame([(0, k) for k in keys], "split int, key string")).collect()
    assert {r.last for r in got} == set(want)
    for r in got:
        assert abs(-want[r.last][0] - r.near_sim) < 1e-7
        assert abs(sum(x * known[r.near_key].get(g, 0.0) for g, x in unit(r.last).items()) - r.near_sim) < 1e-7


def test_k_nearest_is_exact_with_a_hot_cell(spark, monkeypatch):
    """A third of all points are copies of one vector, and blocks are tiny, so cells are cut into many pieces."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6))
    x[:50] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")
    got = {}
    for r in N.k_nearest(df, df, 4, cells=8, exclude_self=True).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.p_id, r.distance))
    for q in range(len(x)):
        d = [(round(1 - float(x[q] @ x[p]), 9), p) for p in range(len(x)) if p != q]
        want = sorted(d)[:4]
        mine = sorted(got[q])
        assert [round(a, 6) for a, _ in want] == [round(m[2], 6) for m in mine]


def test_k_nearest_in_many_groups_hands_on_few_rows(spark, monkeypatch):
    """Query groups and shares of a few rows; NULL vectors and empty sides take no part; a task hands on at most k rows per query."""
    monkeypatch.setattr(N, "GROUP_ROWS", 40)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    handed = []
    monkeypatch.setattr(N, "publish", lambda df, name: handed.append(publish(df, name)) or handed[-1])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:03}", [float(v) for v in row]) for i, row in enumerate(x)] + [("none", None)], "id string, vec array<double>")
    got = N.k_nearest(df, df, 3, exclude_self=True).orderBy("q_id", "rank").collect()
    d = np.round(1 - x @ x.T, 12)
    np.fill_diagonal(d, 9)
    assert [(r.q_id, r.p_id) for r in got] == [(f"v{q:03}", f"v{p:03}") for q in range(300) for p in np.argsort(d[q], kind="stable")[:3]]
    shares = max(1, -(-N.TASKS * spark.sparkContext.defaultParallelism // 8))
    assert handed[-1].count() <= 300 * 3 * shares
    none = df.where("id = 'no such id'")
    assert N.k_nearest(df, none, 3).count() == 0 == N.k_nearest(none, df, 3).count()


# ------------------------------------------------------------------------------------ skew
def test_spread_join_keeps_every_row(spark):
    left = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None).cast("string"))
                                    .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    table = publish(spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "key string, v int"), "t")
    want = {r.id: r.v for r in left.join(table, "key", "left").collect()}
    got = [(r.id, r.v) for r in LK.spread_join(left, table, ["key"], ["id"]).collect()]
    assert len(got) == 6000 and dict(got) == want


@pytest.mark.parametrize("small", [True, False])
def test_lookup_where_keeps_every_row(spark, monkeypatch, small):
    monkeypatch.setattr(LK, "is_small", lambda *a, **k: small)
    left = spark.range(3000).select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("key"))
    table = publish(spark.createDataFrame([("k0", [1]), ("k2", [2])], "key string, v array<int>"), "t")
    got = LK.lookup_where(left, table, ["key"], ["id"], F.col("key").isNotNull()).select("id", "v").collect()
    assert len(got) == 3000
    assert {r.id: r.v for r in got} == {i: {0: [1], 2: [2]}.get(i % 3) if i % 5 == 0 else None for i in range(3000)}


# ------------------------------------------------------------------------------------ statistics
def _two_sided(b, c):
    n, m = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2 ** n) if n else 1.0


def test_exact_paired_p(spark):
    cases = [(32, 16), (0, 0), (1, 0), (5, 5), (7, 3), (120, 90), (800, 700), (0, 40), (300, 299)]
    df = spark.createDataFrame(cases, "b bigint, c bigint")
    for r in df.select("b", "c", T.paired_p(F.col("b"), F.col("c")).alias("p")).collect():
        assert r.p == pytest.approx(_two_sided(r.b, r.c), rel=1e-8)
    assert round(_two_sided(32, 16), 3) == 0.029


def test_holm_is_monotone_and_capped(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "model string, p double")
    got = {r.model: r.p_holm for r in T.holm(df).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})


def test_exact_median(spark):
    rng = random.Random(1)
    rows = [("a", rng.uniform(0, 50)) for _ in range(101)] + [("b", float(rng.randint(0, 4))) for _ in range(60)] + [("c", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in T.exact_median(df, "v", ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(float(np.median([v for k, v in rows if k == g])))


def test_bootstrap_interval_covers(spark):
    df = spark.range(2135).withColumn("ok", F.col("id") < 1836)
    r = T.bootstrap_interval(df, F.col("ok")).first()
    assert r.accuracy == pytest.approx(1836 / 2135)
    assert 0.840 < r.low < 0.850 and 0.869 < r.high < 0.880


# ------------------------------------------------------------------------------------ folds
def test_folds_partition_rows(spark, history):
    parsed = history.withColumn("last", F.col("text"))
    strat = S.stratified_bucket(parsed, "final_team_cur", "request_id")
    per = {r.bucket: r["count"] for r in strat.groupBy("bucket").count().collect()}
    assert sum(per.values()) == history.count() and set(per) == set(range(5))
    groups = S.group_buckets(parsed, "last")
    assert groups.count() == parsed.select("last").distinct().count()


def test_min_support_changes_only_the_phrase_table(spark, evidence):
    assert evidence.with_support(1).phrases.count() >= evidence.phrases.count()
    assert evidence.with_support(10_000).phrases.count() == 0


# ------------------------------------------------------------------------------------ metrics and money
def _decided(spark):
    rows = [("Repairs", "Repairs", "Billing", "seen", 0.98), ("Repairs", "Billing", "Billing", "vague", 0.3),
            ("Billing", "Billing", "Billing", "seen", 0.95), ("Billing", "Repairs", "Repairs", "new_wording", 0.8)]
    return spark.createDataFrame(rows, "team string, final_team_cur string, bot_team string, route_type string, confidence double").withColumns({
        "auto_route": (F.col("confidence") >= 0.7) & (F.col("route_type") != "vague"), "inconsistent": F.lit(False),
        "alternatives": F.array(F.struct(F.col("team").alias("team"), F.lit(1.0).alias("share")))})


def test_team_report_by_hand(spark):
    got = {r.team: (r.precision, r.recall, r.support) for r in M.team_report(_decided(spark)).collect()}
    assert got == {"Repairs": (0.5, 0.5, 2), "Billing": (0.5, 0.5, 2)}
    matrix = {r.truth: r.asDict() for r in M.confusion_matrix(_decided(spark)).collect()}
    assert len(matrix) == 7 and matrix["Billing"]["Repairs"] == 1 and matrix["Product Advice"]["Repairs"] == 0


def test_selective_routing_by_hand(spark):
    got = {r.auto_route_when: (r.share_routed, r.accuracy_routed) for r in M.selective_routing(_decided(spark)).collect()}
    assert got["confidence >= 0.70"] == (0.75, pytest.approx(2 / 3)) and got["confidence >= 0.90"] == (0.5, 1.0)


def test_cost_of_a_misroute(spark):
    rows = [("2026-06-01", "Billing", "Repairs", 2, 10.0), ("2026-05-01", "Repairs", "Repairs", 1, 4.0), ("2025-05-31", "Billing", "Repairs", 9, 99.0)]
    df = spark.createDataFrame(rows, "d string, first_team_cur string, final_team_cur string, transfers int, hours_to_resolve double").withColumn(
        "created_at", F.col("d").cast("timestamp_ntz"))
    r = B.misroute_costs(df).first()
    assert (r.requests_12m, r.transfers_12m, r.cost_12m) == (2, 3, 3 * L.TRANSFER_RS + L.EXTRA_CONTACT_RS)
    assert r.cost_per_misroute == 2 * L.TRANSFER_RS + L.EXTRA_CONTACT_RS and (r.hours_misrouted, r.hours_right_first) == (10.0, 4.0)


def test_posterior_shrinks(spark, evidence_all):
    for r in evidence_all.products.collect():
        assert sum(r.post) == pytest.approx(1.0)
        assert len(r.post) == len(L.TEAMS) == len(E.L.TEAMS)


def test_p_of_chi_square(spark):
    """Against a printed table, and against the closed form for even degrees of freedom."""
    table = [(3.841459, 1, 0.05), (6.634897, 1, 0.01), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (43.772972, 30, 0.05), (0.0, 3, 1.0), (0.000157, 1, 0.99)]
    even = [(x, d, math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))) for x in (0.1, 3.0, 20.0, 90.0) for d in (2, 8, 24)]
    df = spark.createDataFrame(table + even, "x double, d int, want double")
    for r in df.withColumn("p", T.chi_square_p(F.col("x"), F.col("d"))).collect():
        assert r.p == pytest.approx(r.want, rel=1e-4 if (r.x, r.d, r.want) in table else 1e-9)
    assert spark.range(1).select(T.chi_square_p(F.lit(1.0), F.lit(0)).alias("p")).first().p is None


def test_similarity_is_that_of_matching_blocks(spark):
    rng = random.Random(8)
    draw = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(13)))
    pairs = [(draw(), draw()) for _ in range(250)] + [("", ""), ("", "a"), ("handle", "handel"), ("overheating", "overheting")]
    for r in spark.createDataFrame(pairs, "k string, w string").withColumn("r", R.match_ratio(F.col("k"), F.col("w"))).collect():
        assert r.r == pytest.approx(difflib.SequenceMatcher(None, r.k, r.w).ratio(), abs=1e-12)


def test_rank_in_a_hot_group(spark):
    """Two thirds of the rows are one group (and a sixth has no key); numbers go on over the pieces of a group."""
    from intake_spark.operators import ordered as O
    rows = spark.range(3000).select(F.when(F.col("id") % 6 == 0, F.lit(None)).when(F.col("id") % 6 < 5, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
                                    ((F.col("id") * 7919) % 3000).alias("v"))
    pieces = O.in_pieces(rows, ["g"], [F.asc("v")])
    got = O.carried(pieces, ["g"], [F.asc("v")], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "x": ("xor", F.col("v"))})
    assert got.where("g = 'hot'").select(O.PIECE).distinct().count() > 3
    by = {}
    for r in sorted(got.collect(), key=lambda r: r.v):
        n, s, x = by.get(r.g, (0, 0, 0))
        by[r.g] = (n + 1, s + r.v, x ^ r.v)
        assert (r.n, r.s, r.x) == by[r.g]
    assert {r.n for r in O.numbered(rows, ["g"], [F.asc("v")], "n").where("g = 'cold'").collect()} == set(range(1, 501))
