"""Shared tables hold what reports read; texts of plain ASCII take the quicker way with the same result."""
import functools

from pyspark.sql import functions as F

from conftest import SF
from intake_spark import lexicon as L
from intake_spark.functions import parse as P
from intake_spark.operators import repair as R
from intake_spark.plans import backtest as BT
from intake_spark.plans import catalog as Q

TEXTS = ["urgent: Water Purifier kharab hai, fan chal nahi raha order KO0012345 thanks", "sir, chalu nahi ho raha mixer – paid on upi", "ünï chal nahi raha fan",
         "box was open, mixer scratched pls call back", " ", "", "help fan..", "paid on upi air fryer", "bill nahi mila\tguarantee"]


def test_shared_tables_are_narrow(spark):
    quoted = {"core", "clauses", "shown", "first_shown", "last_shown"}
    assert not quoted & set(Q.history(spark, SF).columns)
    long = {"reasons", "clarifying_question", "norm", "deciding_request"}
    for table in (Q.oot(spark, SF), Q.rolling(spark, SF), Q.ruled(spark, SF)):
        assert not long & set(table.columns)


def test_quotes_and_reasons_come_from_the_slim_history(spark):
    slim, evidence = Q.history(spark, SF), Q.oot_evidence(spark, SF)
    wide = P.with_phrases(slim, shown=True)
    lean = Q.oot_decisions(spark, SF).select("request_id", "deciding_request", "reasons", "team")
    full = BT.run(BT.out_of_time(wide), evidence=evidence).select("request_id", "deciding_request", "reasons", "team")
    assert lean.count() == full.count() and lean.exceptAll(full).count() == 0


def test_ascii_texts_read_as_with_unicode_classes(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    low = F.lower("text")
    rows = df.select(
        R.hinglish_to_english(F.col("text")).alias("got"),
        P.squeeze(functools.reduce(lambda s, r: F.regexp_replace(s, rf"(?U)\b(?:{r[0]})\b", r[1]), L.HINGLISH, low)).alias("want"),
        P.has_payment_remark(F.col("text")).alias("paid"), low.rlike(rf"(?U)\b({L.PAYMENT_WORDS})\b").alias("want_paid")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and [r.paid for r in rows] == [r.want_paid for r in rows]


def test_champion_beside_the_rows_pairs_as_the_join_does(spark):
    rows = [(0, i, m, p, c, "seen" if i % 3 else "vague", "a" if i % 4 else "b") for i in range(40) for m, p, c in (("x", "a", "a"), ("y", "b" if i % 2 else "a", "a"))]
    long = spark.createDataFrame(rows, "split int, request_id int, model string, pred string, champion string, route_type string, final_team_cur string")
    both = [sorted(map(str, BT.compare(d, "x").collect())) for d in (long, long.drop("champion"))]
    assert both[0] == both[1]
