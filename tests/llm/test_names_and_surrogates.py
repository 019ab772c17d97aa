"""Columns of any name survive, and surrogates stay distinct, end, and keep to the parts of a name."""
from pyspark.sql import functions as F

from intake_spark.llm import decontaminate, near_dup, quality_rules, surrogates


def test_own_names_of_a_table_survive(spark, odd_docs):
    names = ["__new", "__quality", "__own", "__id", "__hits", "__quality_w", "__i"]
    docs = odd_docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for n in names})
    items = spark.createDataFrame([(1, "same words here same words")], "item_id int, text string")
    for out in (surrogates.replace(docs).drop("__pii"), quality_rules.keep_good(docs), near_dup.keep_one(docs), decontaminate.clean(docs, items)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == n + ("?" if r.doc_id is None else str(r.doc_id)) for n in names)


def test_more_private_addresses_than_their_network_has(spark):
    ips = spark.range(40000).select(F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("192.168"), (F.col("id") / 200).cast("int") + 1, F.pmod("id", F.lit(200)) + 1).alias("value"))
    got = surrogates.mapping(ips, "k").toPandas()
    real = set(got.value)
    assert len(got) == 40000 == got.surrogate.nunique() and not real & set(got.surrogate)
    assert (got.surrogate.str.startswith("192.168.") | got.surrogate.str.startswith("10.")).all()


def test_names_are_replaced_by_part(spark):
    text = "John Johnson met Mr Johnson. Peter Peterson and Mr Peterson. call +44 7911 123456 or +49 7911 123456"
    new = surrogates.replace(spark.createDataFrame([(1, text)], "doc_id int, text string"), key="k").first().text
    words = new.replace(".", "").split()
    assert words[1] == words[4] and words[6] == words[9] and words[1] != words[6]
    assert not {"Johnson", "Peterson", "John", "Peter"} & set(words)
    assert words[11:14] != words[15:18] and words[10] == "call"
