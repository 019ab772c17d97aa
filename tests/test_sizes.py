"""Work that must not be repeated or shuffled more often than its input needs."""
import pytest
from pyspark.sql import functions as F

from intake_spark.operators import textmodel as TM
from intake_spark.plans.catalog import QUERIES
from intake_spark.session import publish

SF = "/root/testdata/sf0.001"
BLOCK = TM.Block("text", 1, 2, 2)
TEXTS = ["red fan red fan", "red fan", "red fan", "blue fan is red", "", None, "single words only once", "blue fan blue"]


def test_idf_shuffles_only_sums_of_terms(spark, monkeypatch):
    planned = []
    monkeypatch.setattr(TM, "publish", lambda df, name: planned.append(df) or publish(df, name))
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("weight", F.lit(1))
    got = {r.term: r.df for r in TM.idf_table(texts, (BLOCK,), indexed=False).collect()}
    assert got == {"red": 4, "fan": 5, "red fan": 3, "blue": 2, "blue fan": 2}
    assert planned[-1]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_weight_sums_are_those_of_the_weights(spark, hot):
    rows = publish(spark.createDataFrame(list(enumerate(TEXTS)), "row long, text string"), "rows")
    idf = TM.idf_table(rows.withColumn("weight", F.lit(1)), (BLOCK,), indexed=False)
    want = {r.row: (r.n, r.top, r.sum) for r in TM.weights(rows, idf, (BLOCK,), ["row"]).groupBy("row").agg(
        F.count("*").alias("n"), F.max("w").alias("top"), F.sum("w").alias("sum")).collect()}
    got = {r.row: (r.terms, r.top_weight, r.weight_sum) for r in TM.weight_sums(rows, idf, BLOCK, "row", hot).collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 3, 7}
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_checks_read_the_ordered_predictions_once(spark):
    plan = QUERIES["deliverable_checks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan
