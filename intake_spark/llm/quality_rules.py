"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Measures of a text (null: no words):

* words are runs of ``[^\\x20\\x09-\\x0D]``; ``n_words`` counts them, ``word_chars`` their code points
* ``n_symbols``: characters of ``[#*$%&|<>]`` in the text
* ``n_dup_lines``: lines (split at ``\\n``, holding a word) that equal an earlier line
* ``n_repeat_words``: words inside a window of three words that occurs twice or more in the text, the first included.
  Windows are compared by a 64-bit hash inside one text.

A text fails the base when it has under 50 words or over half of its words repeat. The other rules form a cascade:
``plan_cascade`` runs each rule alone over a sample, measures its seconds and the share it rejects, and orders the
rules by rejections per second; ``CASE WHEN`` then stops at a text's first failing rule. The order changes the cost
and never the verdict. Null and empty texts fail the base; equal rows get equal rows; columns of the input are kept
under any name, as the operator's own live in one struct column.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intake_spark.llm.tables import keeps_names
from intake_spark.session import publish

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Documented parameter: about so many texts are measured to order the rules.
SAMPLE_ROWS = 2000
OWN = "__quality"


@dataclass(frozen=True)
class Rule:
    """``fails`` gives a Boolean column from the text and from the struct of measures."""

    name: str
    fails: Callable[[Column, Column], Column]


def _letters(text: Column, kind: str) -> Column:
    return F.char_length(F.regexp_replace(text, rf"[^\p{{{kind}}}]+", ""))


RULES = [
    Rule("symbols", lambda t, m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("duplicate_lines", lambda t, m: (m["n_dup_lines"] > 3) & (m["n_dup_lines"] * 100 > F.size(F.split(t, "\n")) * 30)),
    Rule("word_length", lambda t, m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 20)),
    Rule("shouting", lambda t, m: _letters(t, "Lu") * 100 > m["word_chars"] * 40),
    Rule("exclamations", lambda t, m: F.regexp_count(t, F.lit("[!?]")) * 100 > m["n_words"] * 60),
    Rule("no_letters", lambda t, m: _letters(t, "L") * 100 < m["word_chars"] * 50),
]


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct ``__quality`` of measures; nothing is shuffled and each step is evaluated once per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, p = f"{OWN}_w", f"{OWN}_h", f"{OWN}_p"
    step = df.withColumn(w, F.btrim(t, F.lit(SPACES)))
    step = step.withColumn(w, F.when(F.col(w) == "", F.array().cast("array<string>")).otherwise(F.split(w, SPACE_RUN, -1)))
    # hashes of three neighbouring words
    step = step.withColumn(h, F.transform(
        F.when(F.size(w) > 2, F.slice(w, F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<string>")),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    # only a text in which some window repeats needs their places: equal hashes are neighbours once sorted
    step = step.withColumn(p, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn(f"{OWN}_l", lines)
    return step.withColumn(OWN, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(f"{OWN}_l") - F.size(F.array_distinct(f"{OWN}_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col(p).isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )).drop(w, h, p, f"{OWN}_l")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def plan_cascade(df: DataFrame, text: str = "text", rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second over a sample of about ``rows`` texts, drawn by a hash of the text.

    An empty table leaves the given order. The verdict of ``rejected_by`` does not depend on the outcome.
    """
    total = df.count()
    if not total:
        return list(rules)
    picked = df.where(F.pmod(F.xxhash64(F.lit(17), F.col(text)), F.lit(max(1, total // rows))) == 0)
    sample = publish(with_measures(picked.select(F.coalesce(F.col(text), F.lit("")).alias("t")), "t"), "rule-sample")
    sample.agg(F.count(F.lit(1))).collect()

    def measured(rule: Rule) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.fails(F.col("t"), F.col(OWN)))).first()[0]
        return time.perf_counter() - start, rejected

    for rule in rules:  # once for code generation, once for the clock
        measured(rule)
    gain = {rule.name: (lambda s, n: n / max(s, 1e-6))(*measured(rule)) for rule in rules}
    return sorted(rules, key=lambda r: -gain[r.name])


def rejected_by(text: Column, measures: Column, rules: list[Rule]) -> Column:
    """The name of the first failing rule, else null; later rules are not evaluated for that row."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(rule.fails(text, measures), F.lit(rule.name))
    return out


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of ``df`` and ``__quality`` with the measures, ``base_failed`` and ``kept``.

    To filter on the verdict use ``keep_good``, or write the result first: the optimizer copies the measures into a filter.
    """
    rules = plan_cascade(df, text) if rules is None else rules
    t = F.coalesce(F.col(text), F.lit(""))
    out = with_measures(df, text)
    m = F.col(OWN)
    kept = F.when(base_failed(m), False).otherwise(rejected_by(t, m, rules).isNull())
    return out.withColumn(OWN, m.withField("base_failed", base_failed(m)).withField("kept", kept))


@keeps_names
def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df`` alone.

    A filter on the verdict would be pushed below the measures, which writes their expressions out once per use; a
    generator in between keeps the measures evaluated once.
    """
    flag = f"{OWN}_kept"
    return judge(df, text).select("*", F.explode(F.array(F.col(OWN)["kept"])).alias(flag)).where(F.col(flag)).drop(OWN, flag)
