"""Headline queries, timed end to end. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""
import json
import os
import time

from pyspark.sql import functions as F

from intake_spark.operators import evidence as E
from intake_spark.operators.route import route
from intake_spark.plans import catalog as Q
from intake_spark.session import local_session

HEADLINES = [
    "history_clean", "phrase_parse", "phrase_majority", "vague_posterior", "rule_match", "hinglish_repair",
    "route_out_of_time", "accuracy_by_type", "selective_routing", "top_k", "cross_validation", "held_out_wording",
    "rolling_backtest", "corrections_curve", "misroute_costs", "team_volumes", "vague_rule_costs", "oracle_ceiling",
    "linked_requests", "recent_context", "spelling_repair", "nearest_wording", "knn_vote", "text_model_last",
    "document_vocabulary", "stream_event_windows",
]


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("intake-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    times = {}

    def timed(name, run):
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)

    timed("prepare_history", lambda: Q.history(spark, folder))
    history = Q.history(spark, folder)
    model = {}
    timed("train_all_history", lambda: model.update(e=E.fit(history, parsed=True)))
    timed("route_all_requests", lambda: drain(route(history.withColumn("split", F.lit(0)), model["e"], parsed=True)))
    for name in HEADLINES:
        timed(name, lambda: drain(Q.QUERIES[name](spark, folder)))
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "requests": history.count()}))


if __name__ == "__main__":
    main()
