"""Repair of unknown wording: Hindi phrases to English, then spelling against the training vocabulary.

Spelling never compares every word with every other. Two words that are similar enough must share a
piece at nearly the same place (see ``_pieces``), so candidates come from an equi-join on pieces that
misses no pair, and only those are scored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import parse as P
from ..session import publish
from .lookups import lookup
from .splits import stable_hash


def hinglish_to_english(text: Column) -> Column:
    """The ordered phrase dictionary applied to lower-cased text, blanks squeezed.

    A text in which no entry occurs stays as it is, so one search for any of them spares most texts the thirty replacements.
    """
    any_entry = r"\b(?:" + "|".join(pattern for pattern, _ in L.HINGLISH) + r")\b"

    def steps(s: Column, u: str) -> Column:
        english = functools.reduce(lambda acc, r: F.regexp_replace(acc, rf"{u}\b(?:{r[0]})\b", r[1]), L.HINGLISH, s)
        return P.squeeze(F.when(s.rlike(u + any_entry), english).otherwise(s), u)

    return P.by_alphabet(F.lower(F.coalesce(text, F.lit(""))), steps)


def match_ratio(known: Column, word: Column) -> Column:
    """Matching-block similarity (Ratcliff-Obershelp) of a known word and a typed one: twice the matched letters by all letters.

    The longest common block is taken (of equal ones the first in the known word, then in the typed one), then the same on both
    sides of it, over a list of open ranges. A range is (start, end) in both words, from 0.
    """
    def ranges(*bounds) -> Column:
        return F.struct(*(b.cast("int").alias(n) for b, n in zip(bounds, ("alo", "ahi", "blo", "bhi"))))

    def block(r: Column) -> Column:
        """The best (size, -start, -start) of a range, or NULL."""
        inside = F.substring(word, r["blo"] + 1, r["bhi"] - r["blo"])

        def from_start(i):
            def of_size(k):
                at = F.position(F.substring(known, i + 1, k), inside)
                return F.when(at > 0, F.struct(k.alias("k"), (-i).alias("i"), (-(r["blo"] + at - 1)).alias("j")))
            return F.transform(F.sequence(F.lit(1), r["ahi"] - i), of_size)

        return F.array_max(F.flatten(F.transform(F.sequence(r["alo"], r["ahi"] - 1), from_start)))

    def step(state: Column, _: Column) -> Column:
        r = F.element_at(state["open"], -1)
        best = F.when((r["ahi"] > r["alo"]) & (r["bhi"] > r["blo"]), block(r))
        rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
        both = F.transform(F.array(best), lambda m: F.when(m.isNotNull(), F.concat(rest, F.array(
            ranges(r["alo"], -m["i"], r["blo"], -m["j"]), ranges(-m["i"] + m["k"], r["ahi"], -m["j"] + m["k"], r["bhi"])))).otherwise(rest))
        done = F.struct(F.element_at(both, 1).alias("open"), (state["matched"] + F.coalesce(best["k"], F.lit(0))).alias("matched"))
        return F.when(F.size(state["open"]) == 0, state).otherwise(done)

    letters = F.length(known) + F.length(word)
    start = F.struct(F.array(ranges(F.lit(0), F.length(known), F.lit(0), F.length(word))).alias("open"), F.lit(0).alias("matched"))
    matched = F.aggregate(F.sequence(F.lit(1), letters + 1), start, step, lambda s: s["matched"])
    return F.when(letters == 0, F.lit(1.0)).otherwise(2.0 * matched / letters)


# ------------------------------------------------------------------------------------ candidates
# ratio = 2M / (|a| + |b|) >= 0.8 leaves at most |a| + |b| - 2M <= 0.2 (|a| + |b|) unmatched letters
# in both words together. Cut b into (that many + 1) pieces: one of them has no unmatched letter in
# it and none of its neighbours' shifts add up to more than the budget, so it occurs in a unchanged,
# at most that many places away.
def _budget(a_len: Column, b_len: Column, cutoff: float) -> Column:
    slack = int(round((1 - cutoff) * 1000))
    return F.floor((a_len + b_len) * slack / 1000).cast("int")


def _lengths(length: Column, cutoff: float) -> Column:
    """Lengths the other word may have: 2 min / (a + b) >= cutoff."""
    r = cutoff / (2 - cutoff)
    return F.sequence(F.ceil(length * r - 1e-9).cast("int"), F.floor(length / r + 1e-9).cast("int"))


def _cuts(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start (1-based) and size of piece i out of n nearly equal pieces."""
    start = F.floor(length * i / n).cast("int")
    end = F.floor(length * (i + 1) / n).cast("int")
    return start + 1, end - start


def _known_pieces(vocab: DataFrame, words: DataFrame, cutoff: float) -> DataFrame:
    b = vocab.withColumn("b_len", F.length("known"))
    b = b.withColumn("a_len", F.explode(_lengths(F.col("b_len"), cutoff)))
    b = b.join(F.broadcast(words.select("split", F.length("word").alias("a_len")).distinct()), ["split", "a_len"])
    b = b.withColumn("budget", _budget(F.col("a_len"), F.col("b_len"), cutoff))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("budget"))))
    start, size = _cuts(F.col("b_len"), F.col("budget") + 1, F.col("i"))
    return b.withColumn("piece", F.substring("known", start, size)).select(
        "split", "known", "a_len", "b_len", "i", "piece")


def _word_pieces(words: DataFrame, vocab: DataFrame, cutoff: float) -> DataFrame:
    a = words.withColumn("a_len", F.length("word"))
    a = a.withColumn("b_len", F.explode(_lengths(F.col("a_len"), cutoff)))
    a = a.join(F.broadcast(vocab.select("split", F.length("known").alias("b_len")).distinct()), ["split", "b_len"])
    a = a.withColumn("budget", _budget(F.col("a_len"), F.col("b_len"), cutoff))
    a = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("budget"))))
    start, size = _cuts(F.col("b_len"), F.col("budget") + 1, F.col("i"))
    first = F.greatest(F.lit(1), start - F.col("budget"))
    last = F.least(F.col("a_len") - size + 1, start + F.col("budget"))
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    a = a.withColumn("size", size)
    a = a.withColumn("piece", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("word"), p, F.col("size"))))))
    return a.select("split", "word", "a_len", "b_len", "i", "budget", "piece")


def best_known_word(words: DataFrame, vocab: DataFrame, cutoff: float = L.SPELL_CUTOFF) -> DataFrame:
    """(split, word) -> the most similar known word with ratio >= cutoff (equal ratios: the larger word).

    ``words`` are distinct and unknown. Pieces are cut only for lengths that the other side has (the
    distinct lengths are what is broadcast: no more than the longest word has letters). Edit distance never exceeds the number of unmatched letters,
    so the built-in ``levenshtein`` discards most candidates before the exact ratio is taken.
    """
    keys = ["split", "a_len", "b_len", "i", "piece"]
    known = vocab.withColumnRenamed("word", "known")
    # a short piece may be in very many words: beyond broadcast size, hot pieces are spread over several tasks
    pieces = publish(_known_pieces(known, words, cutoff), "known_pieces")
    pairs = lookup(_word_pieces(words, known, cutoff), pieces, keys, ["split", "word"], "inner")
    near = F.levenshtein(F.col("word"), F.col("known"))
    pairs = pairs.where(near <= F.col("budget")).select("split", "word", "known").distinct()
    # few bytes and much work: the pairs are dealt over all cores, where shuffles of their size would end in one task
    pairs = pairs.repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "split", "word")
    scored = pairs.withColumn("ratio", match_ratio(F.col("known"), F.col("word"))).where(F.col("ratio") >= cutoff)
    return scored.groupBy("split", "word").agg(F.max(F.struct("ratio", "known")).alias("s")).select(
        "split", "word", F.col("s.known").alias("known"), F.col("s.ratio").alias("ratio"))


def tokens(text: Column) -> Column:
    """The text cut into runs of a-z and everything between them."""
    return F.regexp_extract_all(text, F.lit("[a-z]+|[^a-z]+"), F.lit(0))


def unknown_words(texts: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(split, word): distinct words of four letters or more that the training texts do not have."""
    candidates = F.filter(F.array_distinct(tokens(F.col(text))),
                          lambda w: w.rlike("^[a-z]{%d,}$" % L.SPELL_MIN_CHARS) & ~w.isin(L.KEEP_WORDS))
    words = texts.select("split", F.explode(candidates).alias("word")).distinct()
    return words.join(vocab, ["split", "word"], "left_anti")


def spell_correct(texts: DataFrame, vocab: DataFrame, text: str = "text", out: str = "fixed",
                  cutoff: float = L.SPELL_CUTOFF) -> DataFrame:
    """Adds ``out``: the lower-cased text with unknown words replaced by their best known word.

    ``texts`` are distinct per (split, text). Only texts that hold a corrected word are taken apart
    and put together again; a text's own pieces are the only thing ever collected.
    """
    lowered = texts.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    words = publish(unknown_words(lowered, vocab, "_low"), "unknown_words")
    fixes = publish(best_known_word(words, vocab, cutoff).select("split", "word", "known"), "fixes")
    parts = lowered.select("split", text, F.posexplode(tokens(F.col("_low"))).alias("_at", "word"))
    swapped = lookup(parts, fixes, ["split", "word"], ["split", text, "_at"])
    rebuilt = swapped.groupBy("split", text).agg(
        F.max(F.col("known").isNotNull()).alias("_hit"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("known", "word").alias("w")))),
                                 lambda s: s["w"]), "").alias("_new"))
    joined = lowered.join(rebuilt.where("_hit").select("split", text, "_new"), ["split", text], "left")
    return joined.withColumn(out, F.coalesce("_new", "_low")).drop("_new", "_low")


def repair(texts: DataFrame, vocab: DataFrame, text: str = "text", out: str = "fixed") -> DataFrame:
    """Adds ``out``: English for Hindi phrases, then spelling; rows are distinct per (split, text).

    A stored ``_english`` column (the first step's result) is used when the texts have one.
    """
    english = texts if "_english" in texts.columns else texts.withColumn("_english", hinglish_to_english(F.col(text)))
    fixed = spell_correct(english.select("split", "_english").distinct(), vocab, "_english", out)
    return english.join(fixed, ["split", "_english"], "left").drop("_english")


# ------------------------------------------------------------------------------------ stress test
def corrupt(text: Column, row_id: Column, p: float, seed: int = 0) -> Column:
    """Synthetic typos: each word of three letters or more is hit with probability p by one edit.

    Letter position, edit and substitute come from a hash of (row, word position, seed): the result
    does not depend on partitioning and can be recomputed after a lost task.
    """
    def draw(i, what, n):
        return (stable_hash(row_id, i, F.lit(what), F.lit(seed)) % n).cast("int")

    def edit_at(w, d):
        at, op = d["at"], d["op"]
        head, tail = F.substring(w, F.lit(1), at - 1), F.substring(w, at + 1, F.length(w))
        c = F.substring(w, at, F.lit(1))
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), d["letter"], F.lit(1))
        swapped = F.concat(head, F.substring(tail, F.lit(1), F.lit(1)), c, F.substring(tail, F.lit(2), F.length(w)))
        return (F.when(op == 0, F.concat(head, tail))
                .when((op == 1) & (at < F.length(w)), swapped)
                .when(op == 2, F.concat(head, letter, tail))
                .otherwise(F.concat(head, c, c, tail)))

    def edit(w, i):
        # a list of one, so that each draw of a word is made once and not at each place that reads it
        draws = F.array(F.struct((draw(i, "at", 1_000_003) % F.length(w) + 1).alias("at"), draw(i, "op", 4).alias("op"),
                                 (draw(i, "letter", 26) + 1).alias("letter")))
        edited = F.element_at(F.transform(draws, lambda d: edit_at(w, d)), 1)
        hit = draw(i, "hit", 1_000_000) < int(p * 1_000_000)
        return F.when(w.rlike("^[A-Za-z]{3,}$") & hit, edited).otherwise(w)

    parts = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, edit), "")
