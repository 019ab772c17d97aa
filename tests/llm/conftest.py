import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: texts that break careless code: nulls, empties, ties, odd white space, special strings, very long texts
ODD_TEXTS = [
    None, "", " ", "  \t\n\x0b\x0c\r ", "a", "a b", "one two three", "one two three one two three one two three",
    "x  y   z \n\n w\t\tq ", " lead", "trail ", "tab\tnew\nline\r\nend", "no break space　wide\x1cfile\x85next",
    "it's they're I'll 's 't", "ΑΣ ΟΔΟΣ İstanbul ǅ ß ﬁ", "é é ñ ̈x 가", "日本語 テキスト 123 ४५६ ½ Ⅷ", "🙂🙂 👩‍👩‍👧 flags 🇩🇪",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c<|startoftext|>d", "<|ENDOFTEXT|> <| endoftext |>",
    "#*$%&|<> a #b *c", "dup line\ndup line\n\ndup line \nother", "same words here " * 40, "word " * 30000,
    "q" * 20000, "a" * 70 + " " + "b" * 70, "\x00\x01 nul ﻿ bom", "123456 7 89 0.5 1,000", "!!! ??? ... ---",
    "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the deep dark wood today",
    "Intro words differ. the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the deep dark wood today",
    "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the deep dark wood today",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i * 2) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, ODD_TEXTS[3], "en", "s0", 0, 0), (30, ODD_TEXTS[30], "en", "s0", 0, 0), (None, "null id text", None, None, None, None),
             (None, None, None, None, None, None)]
    # columns whose names an operator might use for itself
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_words int").withColumn("key", F.lit("k"))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return docs.limit(0)
