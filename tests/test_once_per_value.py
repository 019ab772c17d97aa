"""What repeats is worked out once: messages by their masked wording, texts by the values of their columns, decisions by the champion beside them."""
import pytest
from pyspark.sql import functions as F

from conftest import SF
from intake_spark import lexicon as L
from intake_spark.functions import parse as P
from intake_spark.operators import textmodel as TM
from intake_spark.plans import backtest as BT
from intake_spark.plans import catalog as Q
from intake_spark.plans import training as TR
from intake_spark.session import publish
from intake_spark.sources import fixtures as X
from intake_spark.sources import pack as K

BLOCKS = (TM.FULL, TM.CHARS, TM.LAST) + TM.META
TEXTS = ["urgent: water purifier kharab hai, fan not working order ko0012345 thanks", "sir, machine dead -- already paid in full", "ünï purifier\tdead… –",
         "box was open, mixer scratched pls call back", " ", "", "help fan..", "order  ko1, ko12345 sr123 sr1234 xsr12345 fans", "paid on upi air fryer",
         "hello team product ,, why, , asap", "mixer grinders thanksgiving, thanks", "i paid extra for this fan -", "fan thanks", None]


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_history_is_the_rows_parsed_one_by_one(spark):
    train, log = X.history_tables(spark, SF)
    want = P.with_phrases(K.clean_history(K.join_history(train, log))).drop("core", "clauses")
    got = TR.parsed_history(train, log)
    assert got.columns == want.columns and same(got, want)


@pytest.mark.parametrize("small", [True, False])
def test_wordings_are_parsed_once_or_where_they_lie(spark, monkeypatch, small):
    monkeypatch.setattr(TR, "is_small", lambda table: small)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "request_id int, text string")
    rows = publish(texts.withColumn("norm", P.normalise(F.col("text"))), "rows")
    got = TR.with_requests_once(rows)
    assert same(got, P.with_phrases(texts).drop("core", "clauses"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("regexp_replace" not in plan) == small and ("BroadcastHint" in plan or "broadcast" in plan) == small


def test_patterns_with_a_look_ahead_match_the_same(spark):
    texts = publish(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "texts")
    plain = {P._ID: L.ID_PATTERN, P._PRODUCT: rf"\b({L.PRODUCT_WORDS})\b", P._PAYMENT: rf"\b({L.PAYMENT_WORDS})\b",
             P._CLOSING: rf"\b({L.CLOSING_WORDS})(?=\s|$|,)|\.{{2,}}|[-–]+\s*$"}
    for quick, slow in plain.items():
        assert quick != slow
        for flag in ("", "(?U)"):
            differ = texts.where(F.regexp_replace("text", flag + quick, "#") != F.regexp_replace("text", flag + slow, "#"))
            assert differ.count() == 0, quick


def test_vectors_are_the_weights_of_all_columns(spark):
    rows = Q.history(spark, SF).limit(300).withColumn("channel", F.when(F.col("channel") != "ivr", F.col("channel")))
    texts = publish(TM.training_texts(rows, "final_team_cur", BLOCKS), "texts")
    idf = TM.idf_table(texts, BLOCKS)
    want = {}
    exploded = TM.term_counts(texts.withColumn("weight_", F.col("weight")), BLOCKS, [*TM._columns(BLOCKS), "team", "weight_"])
    for r in exploded.groupBy("block", "term").agg(F.sum("weight_").alias("df")).collect():
        want[r.block, r.term] = r.df
    got = {(r.block, r.term): r.df for r in idf.collect()}
    assert got == {k: v for k, v in want.items() if v >= BLOCKS[k[0]].min_df and k[1] is not None} | {k: v for k, v in got.items() if k[1] is None}
    keys = [*TM._columns(BLOCKS), "team"]
    ids = publish(texts.withColumn("_id", TM.text_id(keys)), "ids")
    want = {}
    for r in TM.weights(ids, idf, BLOCKS, ["_id"]).collect():
        want.setdefault(r["_id"], {})[r.idx] = pytest.approx(r.w)
    made = TM.vectors(ids, idf, BLOCKS, idf.count())
    assert made.columns == [*ids.columns, "features"] and made.count() == ids.count()
    for r in made.collect():
        assert list(r.features.indices) == sorted(r.features.indices)
        assert dict(zip(map(int, r.features.indices), r.features.values)) == want.get(r["_id"], {})


def test_terms_are_cut_once_per_value(spark, monkeypatch):
    """Forty texts of one wording: the wording's n-grams are cut out of one row."""
    asked = []
    counts = TM.term_counts
    monkeypatch.setattr(TM, "term_counts", lambda texts, *a: asked.append(texts.count()) or counts(texts, *a))
    texts = spark.createDataFrame([("fan not working", "not working", c, p, "shield", "Repairs", 1.0) for c in "abcd" for p in "0123456789"],
                                  "norm string, last string, channel string, product_family string, warranty_status string, team string, weight double")
    texts = publish(texts, "texts")
    assert TM.vectors(texts, TM.idf_table(texts, BLOCKS), BLOCKS, 1000).count() == 40
    assert sorted(asked) == [1, 1, 1, 4, 10]


def test_switches_carry_the_champion(spark):
    rows = Q.switches(spark, SF)
    assert "champion" in rows.columns
    plain = rows.where(F.col("model") == BT.BASE_VARIANT)
    assert plain.count() > 0 and plain.where("champion <> pred").count() == 0
    got, want = (sorted(map(str, Q.rounded(BT.compare(d, BT.BASE_VARIANT)).collect())) for d in (rows, rows.drop("champion")))
    assert got == want
    assert " Join " not in BT.compare(rows, BT.BASE_VARIANT).select("model", "n")._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ")


def test_a_small_fit_reads_one_piece(spark, monkeypatch):
    pieces = []

    class Kept:
        def fit(self, ready):
            pieces.append(ready.rdd.getNumPartitions())

    monkeypatch.setattr(TM, "estimator", lambda *a: Kept())
    texts = spark.createDataFrame([(f"fan {i} not working", "Repairs", 1.0) for i in range(200)], "norm string, team string, weight double")
    TM.fit_on_texts(publish(texts.repartition(8), "texts"), (TM.FULL,))
    assert pieces == [1]
