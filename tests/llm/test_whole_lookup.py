"""Texts of rows without id: right results, and each text meets only its own row."""
import brute

from intake_spark.llm import substring_dedup

SCHEMA = "doc_id long, text string"


def passage(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_first_windows_are_kept_by_text(spark):
    shared = [passage(f"s{k}x", 25) for k in range(6)]
    rows = [(None, passage(f"p{k}", 3 + 40 * k) + " " + shared[k % 6] + " " + passage(f"q{k}", 1 + k)) for k in range(12)]
    # a long text without id whose first places lie behind the end of the short ones; one id with two texts
    rows += [(None, passage("long", 900) + " " + passage("far", 30)), (None, passage("far", 30) + " tail"), (3, passage("u", 30)), (3, passage("v", 90) + " " + passage("u", 30))]
    got = sorted(map(tuple, substring_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = brute.substring_dedup(rows)
    assert got == sorted(((i, *want[i, t]) for i, t in rows), key=str)


def test_equal_starts_have_one_first_text(spark):
    rows = [(None, passage("same", 30) + f" end{k}") for k in range(4)]
    got = substring_dedup.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_removed for r in got) == [0, 30, 30, 30]


def test_rows_without_id_do_not_multiply(spark, monkeypatch):
    df = spark.createDataFrame([(None, passage(f"t{k}z", 30)) for k in range(40)], SCHEMA)
    seen, real = [], substring_dedup.with_candidates
    monkeypatch.setattr(substring_dedup, "with_candidates", lambda joined, n: (seen.append(joined.count()), real(joined, n))[1])
    assert len(substring_dedup.report(df).collect()) == 40 and seen == [40]
