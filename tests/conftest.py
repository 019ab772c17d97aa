import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
os.environ.setdefault("INTAKE_DRIVER_MEMORY", "6g")

from histories import PARAPHRASES, history_rows  # noqa: E402
from intake_spark import lexicon as L  # noqa: E402
from intake_spark.operators import evidence as E  # noqa: E402
from intake_spark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="session")
def spark():
    s = local_session("intake-tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def history(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(history_rows(), "request_id string, request_text string, final_team_cur string, "
                                               "bot_team string, product_family string")
    return df.withColumns({"text": F.col("request_text"), "created_at": F.lit("2026-01-01").cast("timestamp_ntz")})


@pytest.fixture(scope="session")
def teams(spark):
    return spark.createDataFrame([(t, f"what {t} does") for t in L.TEAMS], "team string, handles string")


@pytest.fixture(scope="session")
def evidence(history, teams):
    return E.fit(history.drop("product_family"), teams=teams)


@pytest.fixture(scope="session")
def evidence_all(spark, history, teams):
    para = spark.createDataFrame(PARAPHRASES, "source string, paraphrase string")
    return E.fit(history, features=L.ALL_FEATURES, paraphrases=para, teams=teams)
