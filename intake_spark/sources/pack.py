"""Reading and writing the data pack: labelled requests, resolution log, teams, corrections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import clean as C
from ..schemas import CORRECTIONS, PARAPHRASES, RESOLUTION_LOG, SAMPLE, TEAM_DIM, TEST, TRAIN


def find(spark: SparkSession, folder: str, name: str) -> str:
    """``folder/name``, or the first ``*name`` in name order (files may keep a download prefix)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        return path.toString()
    hits = sorted(s.getPath().toString() for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*{name}")) or []))
    if not hits:
        raise FileNotFoundError(f"{name} not found in {folder}")
    return hits[0]


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, messages over several lines; no type inference."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("enforceSchema", False).schema(schema).csv(path))


def join_history(train: DataFrame, log: DataFrame) -> DataFrame:
    """Labelled requests with their resolution record (left join on the request id)."""
    return train.join(log, "request_id", "left")


def duplicate_ids(df: DataFrame, key: str = "request_id") -> DataFrame:
    """Ids that occur more than once; the one-to-one check is that there are none."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def clean_history(joined: DataFrame) -> DataFrame:
    """Current team names, cleaned text, IST times, hours to resolve and the consistency flag."""
    df = joined.withColumns({
        "created_at": F.col("created_at_ist").cast("timestamp_ntz"),
        "bot_team": C.current_team(F.col("team_label")),
        "first_team_cur": C.current_team(F.col("first_team")),
        "final_team_cur": C.current_team(F.col("final_team")),
        "text": C.fix_text(F.col("request_text")),
        "resolved_at_ist": C.resolved_in_ist(F.col("resolved_at").cast("timestamp_ntz"), F.col("source")),
    })
    return df.withColumns({
        "hours_to_resolve": C.hours_between(F.col("created_at"), F.col("resolved_at_ist")),
        "inconsistent": (F.col("transfers") == 0) & (F.col("first_team_cur") != F.col("final_team_cur")),
    })


def load_history(spark: SparkSession, folder: str) -> DataFrame:
    train = read_csv(spark, find(spark, folder, "train.csv"), TRAIN)
    log = read_csv(spark, find(spark, folder, "resolution_log.csv"), RESOLUTION_LOG)
    for name, df in (("train.csv", train), ("resolution_log.csv", log)):
        if duplicate_ids(df).limit(1).count():
            raise ValueError(f"{name} holds a request_id more than once")
    return clean_history(join_history(train, log))


def load_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    df = read_csv(spark, find(spark, folder, "test_unlabelled.csv"), TEST)
    return df.withColumns({"created_at": F.col("created_at_ist").cast("timestamp_ntz"),
                           "text": C.fix_text(F.col("request_text"))})


def team_dimension(teams: DataFrame) -> DataFrame:
    """(team, handles) under the current names; seven rows."""
    return teams.select(C.dimension_name(F.col("team"), F.col("renamed_to")).alias("team"), "handles")


def load_teams(spark: SparkSession, folder: str) -> DataFrame:
    return team_dimension(read_csv(spark, find(spark, folder, "teams.csv"), TEAM_DIM))


def valid_corrections(corrections: DataFrame) -> DataFrame:
    """Confirmed teams in the shape of training history; rows without text or with an unknown team are left out."""
    ok = corrections.where(F.col("team").isin(L.TEAMS) & F.col("request_text").isNotNull())
    return ok.select("request_id", "request_text", C.fix_text(F.col("request_text")).alias("text"),
                     F.col("team").alias("final_team_cur"), "product_family",
                     F.col("confirmed_at").cast("timestamp_ntz").alias("created_at"))


def load_corrections(spark: SparkSession, folder: str, name: str = "corrections.csv") -> DataFrame:
    """The corrections file; a missing file is an empty table."""
    try:
        raw = read_csv(spark, f"{folder}/{name}", CORRECTIONS)
    except AnalysisException:
        raw = spark.createDataFrame([], CORRECTIONS)
    return valid_corrections(raw)


def with_corrections(history: DataFrame, corrections: DataFrame) -> DataFrame:
    return history.unionByName(corrections, allowMissingColumns=True)


def load_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Sample submission with its line order as a column (file offset order of a single CSV part)."""
    df = read_csv(spark, find(spark, folder, "sample_submission.csv"), SAMPLE)
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def load_paraphrases(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PARAPHRASES)


def in_sample_order(sample: DataFrame, decided: DataFrame) -> DataFrame:
    """(request_id, team, ordinal) for every sample row, in its order."""
    return sample.select("request_id", "ordinal").join(decided.select("request_id", "team"), "request_id", "left").orderBy("ordinal")


def deliverable_checks(pred: DataFrame, sample: DataFrame, test: DataFrame) -> DataFrame:
    """(check_name, passed, offending rows): same size, unique ids, same ids, valid teams. No ids reach the driver."""
    ids, other = pred.select("request_id"), test.select("request_id")

    def check(name, bad):
        return bad.agg(F.count("*").alias("offending")).select(F.lit(name).alias("check_name"),
                                                               (F.col("offending") == 0).alias("passed"), "offending")

    size = pred.agg(F.count("*").alias("n")).withColumn("t", F.lit("pred")).unionByName(
        sample.agg(F.count("*").alias("n")).withColumn("t", F.lit("sample"))).unionByName(
        test.agg(F.count("*").alias("n")).withColumn("t", F.lit("test")))
    row_count = size.agg((F.max("n") - F.min("n")).alias("offending")).select(
        F.lit("row_count").alias("check_name"), (F.col("offending") == 0).alias("passed"), "offending")
    return (row_count
            .unionByName(check("unique_id", duplicate_ids(pred)))
            .unionByName(check("ids_missing", other.join(ids, "request_id", "left_anti")))
            .unionByName(check("ids_unexpected", ids.join(other, "request_id", "left_anti")))
            .unionByName(check("team_valid", pred.where(~F.coalesce(F.col("team").isin(L.TEAMS), F.lit(False))))))


def write_predictions(pred: DataFrame, path: str) -> None:
    """The deliverable: one CSV in sample order."""
    pred.orderBy("ordinal").select("request_id", "team").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_details(decided: DataFrame, path: str) -> None:
    """Decisions by route type."""
    cols = ["request_id", "team", "confidence", "confidence_level", "route_type", "needs_clarification", "deciding_request"]
    decided.select(*cols).write.mode("overwrite").partitionBy("route_type").parquet(path)


def write_result(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A result table written by ``write_result``, for reports."""
    return spark.read.parquet(f"{folder}/{name}")
