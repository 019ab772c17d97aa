"""Tokens and n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Runs of two or more word characters of the lower-cased text (so the mask ``P`` drops out)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_ngrams(text: Column, low: int, high: int) -> Column:
    """Word n-grams for every n from low to high, joined by blanks."""
    def of_size(words, n):
        # a word and the next ones by their places: cutting a piece out of the array for each n-gram costs several times the rest
        following = lambda w, i: F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))])
        first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.when(F.size(words) >= n, F.transform(first, following)).otherwise(F.array().cast("array<string>"))

    def all_sizes(words):
        parts = [words if n == 1 else of_size(words, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    # the tokens are bound to a lambda variable, so the text is tokenized once and not once per n-gram
    return F.element_at(F.transform(F.array(word_tokens(text)), all_sizes), 1)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside word borders: every word is padded with one blank on each side.

    A padded word no longer than n gives itself once, and no larger n is tried for it.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def of_word(w):
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        m = F.length(padded)
        out = []
        for n in range(low, high + 1):
            starts = F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1)))
            grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
            out.append(grams if n == low else F.when(m >= n, grams).otherwise(F.array().cast("array<string>")))
        return F.concat(*out)

    return F.flatten(F.transform(words, of_word))

