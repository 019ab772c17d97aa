"""What a product's recent requests were about, kept up live: the closing team of the last 7, 30 and 90 days.

A windowed count per product and day comes first (partial counts before the shuffle, so a product with a third of all
requests is one small row per task and day); what reaches the keyed state is one row per product and closed day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import lexicon as L
from ..operators.evidence import ranked
from .online import _put

DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAYS = (7, 30, 90)


def closed_days(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """(product_family, at, day, n, counts): clear requests by team of each day that the watermark has passed.

    Days are numbered from 1970-01-01. Vague requests weigh nothing, but their days appear. Rows without ``created_at``
    belong to no day and are left out; a missing product is a product of its own.
    """
    stamped = requests.withColumn("_event", F.col("created_at").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("_event", late)
    clear = ~F.col("vague")
    by_team = [F.count_if(clear & (F.col("final_team_cur") == t)) for t in L.TEAMS]
    daily = stamped.groupBy(F.window("_event", "1 day").alias("w"), "product_family").agg(
        F.count_if(clear).alias("n"), F.array(*by_team).alias("counts"))
    return daily.select("product_family", F.window_time("w").alias("at"), F.unix_date(F.col("w.start").cast("date")).alias("day"), "n", "counts")


class RecentTeams(StatefulProcessor):
    """State per product: counts by team of at most ``keep`` days before the newest one.

    Days reach a product in order, as a day is handed on only when it is closed: a day's sums are final when it arrives.
    Each day has a timer that takes it out when no open day can reach back to it, so the state of a product that is no longer
    asked about vanishes.
    """

    def __init__(self, days: tuple[int, ...] = DAYS):
        self.spans, self.keep = days, max(days)

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "day int", "counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: list(v[0]) for k, v in self.counts.iterator()}
        new = sorted((int(r.day), int(r.n), [int(c) for c in r.counts]) for part in rows for r in part.itertuples())
        out = []
        for day, n, counts in new:
            sums = [[sum(c[i] for d, c in known.items() if day - span <= d < day) for i in range(len(counts))] for span in self.spans]
            out.append((key[0], day, n, sums))
            known[day] = counts
            self.counts.updateValue((day,), (counts,))
            self.handle.registerTimer((day + self.keep + 1) * DAY_MS)
        yield pd.DataFrame(out, columns=["product_family", "day", "n", "sums"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # rows come before timers, and later days reach back no further than to the watermark less ``keep`` days
        self.counts.removeKey((expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - self.keep - 1,))
        return iter(())

    def close(self) -> None:
        pass


SUMS = "product_family string, day int, n long, sums array<array<long>>"


def recent_teams(daily: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """(product_family, day, clear_requests, team_7d, ...): per closed day the team that closed most requests of the days before."""
    sums = daily.groupBy("product_family").transformWithStateInPandas(RecentTeams(days), SUMS, "Append", "EventTime")
    return sums.select("product_family", F.date_from_unix_date("day").alias("day"), F.col("n").alias("clear_requests"),
                       *[F.try_element_at(ranked(F.col("sums")[i]), F.lit(1))["team"].alias(f"team_{d}d") for i, d in enumerate(days)])


def context_stream(requests: DataFrame, out: str, checkpoint: str, late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Append each closed day's context to ``context``; a replayed batch overwrites its own files.

    ``requests`` is a parsed stream (product_family, created_at, final_team_cur, vague). Keyed state needs the RocksDB store, which
    is set for this query alone.
    """
    spark = requests.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = recent_teams(closed_days(requests, late)).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
            lambda batch, number: _put(batch, f"{out}/context", number))
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)
