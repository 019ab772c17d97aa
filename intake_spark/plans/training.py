"""History in, learned tables and predictions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import parse as P
from ..operators import evidence as E
from ..operators import textmodel as TM
from ..operators.lookups import is_small
from ..operators.route import majority_fallback, route
from ..session import publish
from ..sources import pack as K


def parsed_history(train: DataFrame, log: DataFrame) -> DataFrame:
    """Cleaned and parsed history: the table every other job reads. The requests as shown are worked out where decisions quote them."""
    cleaned = K.clean_history(K.join_history(train, log))
    return with_requests_once(publish(cleaned.withColumn("norm", P.normalise(F.col("text"))), "cleaned"))


def with_requests_once(rows: DataFrame) -> DataFrame:
    """Rows with ``norm`` parsed, without core and clauses. Messages repeat once their numbers and products are masked, so each distinct
    ``norm`` is parsed once and broadcast. Where the distinct ones are too many for that, each row is parsed where it lies: no row is shuffled.
    """
    norms = publish(rows.select("norm").distinct(), "norms")
    if not is_small(norms):
        return P.with_requests(rows).drop("core", "clauses")
    parsed = publish(P.with_requests(norms).drop("core", "clauses"), "parsed_norms")
    joined = rows.join(F.broadcast(parsed), "norm", "left")
    return joined.select(*rows.columns, *[c for c in parsed.columns if c != "norm"])


def last_resort(history: DataFrame, out: str):
    """The text model of all requests with a stated need, saved under ``out``; without any such request the majority class."""
    clear = history.where(~F.col("vague") & F.col("final_team_cur").isNotNull())
    if clear.isEmpty():
        return majority_fallback
    model = TM.fit_text_model(clear)
    TM.save(model, out)
    return TM.model_fallback({0: model})


def train_and_predict(spark: SparkSession, folder: str, out: str, features=L.DEFAULT_FEATURES,
                      fallback=None, paraphrases: str | None = None) -> DataFrame:
    """The batch job: learn from all history and corrections, decide the unlabelled requests, write the deliverable.

    Writes ``model`` (learned tables), ``text_model``, ``predictions`` (CSV in sample order), ``details`` and ``checks``.
    ``fallback`` takes the text model's place; ``paraphrases`` is the file of rewordings that feature B3 reads.
    """
    if "B3" in features and paraphrases is None:
        raise ValueError("feature B3 needs the file of paraphrases")
    history = K.with_corrections(K.load_history(spark, folder), K.load_corrections(spark, folder))
    history = publish(P.with_phrases(history), "history")
    evidence = E.fit(history, features=features, teams=K.load_teams(spark, folder), parsed=True,
                     paraphrases=K.load_paraphrases(spark, paraphrases) if paraphrases else None)
    E.save(evidence, f"{out}/model")
    fallback = fallback or last_resort(history, f"{out}/text_model")
    test = K.load_unlabelled(spark, folder)
    decided = publish(route(test, evidence, features, fallback=fallback), "decided")
    sample = K.load_sample(spark, folder)
    pred = publish(K.in_sample_order(sample, decided), "predictions")
    checks = publish(K.deliverable_checks(pred, sample, test), "checks")
    failed = [r["check_name"] for r in checks.where("not passed").collect()]  # at most five rows
    if failed:
        raise ValueError(f"deliverable checks failed: {failed}")
    K.write_predictions(pred, f"{out}/predictions")
    K.write_details(decided, f"{out}/details")
    K.write_result(checks, out, "checks")
    return decided


def readiness(evidence: E.Evidence) -> DataFrame:
    """Which model version answers, and what it was trained on."""
    return evidence.stats.select(
        F.lit("ok").alias("status"), F.col("version").alias("model_version"),
        F.col("trained_rows").alias("trained_on_requests"), "trained_until", F.lit(False).alias("uses_paid_api"))
