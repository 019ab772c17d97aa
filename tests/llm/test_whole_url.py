"""URL templates are rejected on their own examples only."""
from intake_spark.llm import url_filter


def test_unlabelled_branches_stand_alone(spark):
    rows = [f"http://h.net/{lang}/{k}" for lang in ("de", "en", "es", "fr") for k in range(30)] + [f"http://h.net//es/{k}" for k in range(100, 105)]
    rows += [f"http://s.net/{lang}/{k}" for lang in ("en", "es") for k in range(3)] + [f"http://a.com/{k}" for k in range(20)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).where("rule is null").collect()
    by = {(r.host, r.path): r for r in got}
    assert len(by) == 68
    for lang in ("de", "en"):
        r = by["h.net", f"/{lang}/3"]
        assert (r.template, r.verdict) == (f"/{lang}/*", "allow")
    # blocked pages still speak for a page of their own template
    assert (by["h.net", "//es/100"].template, by["h.net", "//es/100"].verdict) == ("/{es,fr}/*", "block")
    assert (by["s.net", "/en/1"].template, by["s.net", "/en/1"].verdict) == ("/en/*", "allow")


def test_templates_without_examples_stay(spark):
    rows = [f"http://h.net/es/{k}" for k in range(50)] + [f"http://o.org/a/{k}" for k in range(5)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).where("rule is null").collect()
    assert [(r.verdict, r.purity) for r in got] == [("allow", 1.0)] * 5
