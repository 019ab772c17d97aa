"""The live context of a product against plain counting, with late rows, a missing product and a gap longer than the longest span."""
from collections import Counter
from datetime import date, datetime, timedelta

from intake_spark import lexicon as L
from intake_spark.streaming import context as LC

SCHEMA = "product_family string, created_at timestamp_ntz, final_team_cur string, vague boolean"


def plain(rows, last):
    """{(product, day): (clear requests, team by span)} for days up to ``last``."""
    out = {}
    for p, d in {(r[0], r[1].date()) for r in rows if r[1].date() <= last}:
        own = [(r[1].date(), r[2]) for r in rows if r[0] == p and not r[3]]
        teams = []
        for span in LC.DAYS:
            c = Counter(t for day, t in own if d - timedelta(days=span) <= day < d)
            teams.append(min(c, key=lambda t: (-c[t], L.TEAMS.index(t))) if c else None)
        out[p, d] = (sum(day == d for day, _ in own), *teams)
    return out


def test_live_context(spark, tmp_path):
    start = datetime(2021, 3, 1, 9)
    rows = [(p, start + timedelta(days=d, hours=h), L.TEAMS[(d * 3 + h * h + len(p or "")) % 4], (d + h) % 5 == 0)
            for p in ("mixer", None, "fan") for d in (*range(0, 24, 2), *range(24, 40), 140, 141, 150) for h in range(1 + d % 4)]
    folder = f"{tmp_path}/requests"
    first, second = [r for r in rows if r[1] < start + timedelta(days=30)], [r for r in rows if r[1] >= start + timedelta(days=30)]
    late = [("fan", start, L.TEAMS[5], False)] * 50
    for k, part in enumerate((first, second, late)):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{folder}/in={k}")
        stream = spark.readStream.schema(SCHEMA).option("basePath", folder).parquet(f"{folder}/in=*")
        LC.context_stream(stream, f"{folder}-out", f"{folder}-offsets").awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{folder}-out/context").select("product_family", "day", "clear_requests", *(f"team_{d}d" for d in LC.DAYS)).collect()]
    closed = max(r[1] for r in rows) - timedelta(days=1)
    want = plain(rows, date(closed.year, closed.month, closed.day) - timedelta(days=1))
    assert {r[:2]: r[2:] for r in got} == want and len(got) == len(want)
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "counts").load(f"{folder}-offsets").collect()
    assert all(r.user_map_key.day >= (start.date() - date(1970, 1, 1)).days + 50 for r in state) and state
