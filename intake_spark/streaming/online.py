"""The online half as Structured Streaming: score requests, queue the unsure ones, take corrections in, watch shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import lexicon as L
from ..operators.evidence import Evidence
from ..operators.route import majority_fallback, route
from ..schemas import FEEDBACK, REVIEW_QUEUE, TEST


# ------------------------------------------------------------------------------------ contract
def reject_reason(text: str = "request_text", team: str | None = None, columns: list[str] = ()) -> Column:
    """Why a record breaks the input contract, or NULL."""
    t = F.col(text)
    out = F.when(t.isNull() | (F.length(t) < 1), "request_text is missing or empty").when(
        F.length(t) > L.MAX_TEXT_CHARS, f"request_text is longer than {L.MAX_TEXT_CHARS} characters")
    if "channel" in columns:
        out = out.when(F.col("channel").isNotNull() & ~F.col("channel").isin(L.CHANNELS), "unknown channel")
    if "warranty_status" in columns:
        out = out.when(F.col("warranty_status").isNotNull() & ~F.col("warranty_status").isin(L.WARRANTY_STATUSES),
                       "unknown warranty_status")
    if team:
        out = out.when(F.col(team).isNull() | ~F.col(team).isin(L.TEAMS), "unknown team")
    return out


def with_contract(df: DataFrame, team: str | None = None) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(team=team, columns=df.columns))


def from_json_lines(raw: DataFrame, schema: str = TEST) -> DataFrame:
    """Records from a ``value`` column of JSON (a message bus); what does not parse has NULL text and is rejected."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


# ------------------------------------------------------------------------------------ scoring
REVIEW_COLUMNS = ["logged_at", "request_id", "request_text", "product_family", "router_team", "route_type", "confidence"]


def review_rows(decided: DataFrame) -> DataFrame:
    """What a person has to look at: everything that is not routed automatically."""
    return decided.where(~F.col("auto_route")).select(
        F.current_timestamp().cast("timestamp_ntz").alias("logged_at"), "request_id", "request_text", "product_family",
        F.col("team").alias("router_team"), "route_type", "confidence")


def route_stream(requests: DataFrame, evidence: Evidence, out: str, checkpoint: str, features=L.DEFAULT_FEATURES,
                 fallback=majority_fallback, once: bool = True) -> StreamingQuery:
    """Score each micro-batch and append three tables: ``decisions``, ``review_queue``, ``rejected``.

    Scoring is stateless. The learned tables are static: a new version is read when the query is
    restarted. A batch's files carry its number as a partition and are overwritten when the batch is
    replayed after a failure, so no request is written twice.
    """
    spark = requests.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        checked = with_contract(batch)
        _put(checked.where("reject_reason is not null"), f"{out}/rejected", number)
        decided = route(checked.where("reject_reason is null").drop("reject_reason"), evidence, features, fallback=fallback)
        # the queue is derived from the stored decisions, so a batch is scored once
        _put(decided, f"{out}/decisions", number)
        stored = spark.read.schema(decided.schema).parquet(f"{out}/decisions/batch={number}")
        _put(review_rows(stored), f"{out}/review_queue", number)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _put(df: DataFrame, folder: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={number}")


# ------------------------------------------------------------------------------------ corrections
def corrections_stream(feedback: DataFrame, out: str, checkpoint: str, event_time: str | None = None,
                       dedupe: bool = False, once: bool = True) -> StreamingQuery:
    """Validate confirmed teams and append them to ``corrections``; the others go to ``rejected``.

    As published, confirming a request twice counts twice; ``dedupe`` keeps one per request within the
    watermark of ``event_time`` instead.
    """
    if dedupe:
        stamped = feedback.withColumn("_event", F.col(event_time).cast("timestamp") if event_time else F.current_timestamp())
        feedback = stamped.withWatermark("_event", "1 day").dropDuplicatesWithinWatermark(["request_id"]).drop("_event")

    def write(batch: DataFrame, number: int) -> None:
        checked = with_contract(batch, team="team")
        now = F.current_timestamp().cast("timestamp_ntz")
        confirmed = F.col("confirmed_at").cast("timestamp_ntz") if "confirmed_at" in batch.columns else now
        good = checked.where("reject_reason is null").select(
            now.alias("logged_at"), "request_id", "request_text", "product_family", "team", confirmed.alias("confirmed_at"))
        _put(good, f"{out}/corrections", number)
        _put(checked.where("reject_reason is not null"), f"{out}/rejected", number)

    writer = feedback.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_feedback(spark: SparkSession, folder: str, schema: str = FEEDBACK) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def read_review_queue(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REVIEW_QUEUE).parquet(f"{out}/review_queue/batch=*")


# ------------------------------------------------------------------------------------ monitoring
def shares_by_window(decided: DataFrame, event_time: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests per window and the shares that were vague or newly worded; rows later than ``late`` are not counted.

    A watermark needs a zoned timestamp: the session's zone must be the data's (tests pin UTC).
    """
    stamped = decided.withColumn("_event", F.col(event_time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_event", late)
    out = stamped.groupBy(F.window("_event", size).alias("w")).agg(
        F.count("*").alias("n"), F.avg((F.col("route_type") == "vague").cast("int")).alias("vague_share"),
        F.avg((F.col("route_type") == "new_wording").cast("int")).alias("new_wording_share"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "vague_share", "new_wording_share")


def counts_by_window(events: DataFrame, event_time: str, by: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    stamped = events.withColumn("_event", F.col(event_time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_event", late)
    return stamped.groupBy(F.window("_event", size).alias("w"), by).agg(F.count("*").alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n")


def live_windows(counts: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep a table of open and closed windows: update mode, so a batch writes only the windows it changed.

    ``counts`` is a windowed aggregation behind a watermark: state of windows that it has passed is dropped, and so are rows for
    them. Each batch overwrites files of its own number, so a replayed batch changes nothing; ``read_windows`` takes the last value.
    """
    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: _put(batch, f"{out}/windows", number))
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_windows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last written row of each window."""
    rows = spark.read.option("basePath", f"{out}/windows").parquet(f"{out}/windows")
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def first_team_weekly(history: DataFrame) -> DataFrame:
    """Weekly share of requests closed by the team that got them first."""
    return history.groupBy(F.date_trunc("week", "created_at").cast("timestamp_ntz").alias("week")).agg(
        F.count("*").alias("n"), F.avg((F.col("first_team_cur") == F.col("final_team_cur")).cast("int")).alias("first_team_share"))
