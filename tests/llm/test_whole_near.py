"""Near duplicates in large groups and small tables, rows without id, one id with several texts."""
import random

import pytest

from intake_spark.llm import near_dup

SCHEMA = "doc_id long, text string"


def group(share, n=200, seed=5):
    """``share`` of the rows are copies whose plain similarity to the first is 0.84, each with one changed end; the rest is unrelated."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    many = int(n * share)
    rows = [(0, " ".join(base))]
    rows += [(i, " ".join(base[:138] + [f"x{i}a{k}" for k in range(12)])) for i in range(1, many)]
    return rows + [(i, " ".join(f"y{r.randrange(10**6)}" for _ in range(60))) for i in range(many, n)], many


@pytest.mark.parametrize("share", [0.4, 0.6, 0.95])
def test_large_groups_keep_their_links(spark, monkeypatch, share):
    monkeypatch.setattr(near_dup, "LEAST_TEXTS", 1)
    rows, many = group(share)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 0 if i < many else i for i, _ in rows}


def test_two_rows(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-3] + ["x", "y", "z"]))]
    assert {r.class_id for r in near_dup.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}


def words(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_one_row_of_each_class(spark):
    near = words("a")[:-3] + "zz"
    rows = [(None, words(f"n{k}")) for k in range(20)] + [(None, words("n3"))] + [(7, words("a")), (None, near), (None, words("b")), (None, words("b").upper())]
    rows += [(8, words("c")), (8, words("d")), (8, words("d")), (9, words("e")), (10, words("e")), (10, words("f")), (None, None), (None, "..."), (None, "...")]
    kept = [(r.doc_id, r.text) for r in near_dup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(None, words(f"n{k}")) for k in range(20)] + [(7, words("a")), (8, words("c")), (8, words("d")), (9, words("e")), (10, words("f")), (None, None), (None, "..."), (None, "...")]
    left = [x for x in kept if x[1] not in (words("b"), words("b").upper())]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(left, key=key) == sorted(want, key=key) and len(kept) == len(left) + 1
