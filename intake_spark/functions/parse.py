"""From a message to its requests, as Column expressions.

A message is a greeting, one or two requests and some filler. The LAST request decides. All patterns
run with Unicode character classes, so that word borders and blanks mean the same as in the
definitions; each level is its own projection so that no regex is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L



def _starts(words: str, more: str = "") -> str:
    """A look at one letter: most places of a text are passed by without trying each word there. What matches stays the same."""
    return "(?=[" + "".join(sorted({w[0] for w in words.split("|")})) + more + "])"


_U = "(?U)"
_PRODUCT = rf"{_starts(L.PRODUCT_WORDS)}\b({L.PRODUCT_WORDS})\b"
_ID = _starts(L.ID_PATTERN.removeprefix(r"\b(")) + L.ID_PATTERN
_GREETING = L.GREETING_PATTERN
_PAYMENT = rf"{_starts(L.PAYMENT_WORDS)}\b({L.PAYMENT_WORDS})\b"
_CLOSING = rf"{_starts(L.CLOSING_WORDS, '.–-')}(?:\b({L.CLOSING_WORDS})(?=\s|$|,)|\.{{2,}}|[-–]+\s*$)"
_VAGUE = "^(" + "|".join(L.VAGUE_PHRASES) + ")$"
_JOINER = "\u0001"
_FIXED_TAILS = "|".join(c for c in L.CONTINUATIONS if "P" not in c)
_MASKED_TAIL = ", (" + "|".join(L.CONTINUATIONS) + ")(?=,|$)"
_SHOWN_TAIL = f", ({_FIXED_TAILS}|(?:{L.PRODUCT_WORDS}) scratched)(?=,|$)"


def by_alphabet(s: Column, steps) -> Column:
    """``steps(s, flag)``: with Unicode classes, or for ASCII, where both mean the same, with the plain ones, which Java matches faster."""
    return F.when(F.octet_length(s) == F.char_length(s), steps(s, "")).otherwise(steps(s, _U))


def without_ids(text: Column) -> Column:
    """Lower-cased, order and registration numbers blanked."""
    return by_alphabet(F.lower(F.coalesce(text, F.lit(""))), lambda s, u: F.regexp_replace(s, u + _ID, " "))


def squeeze(s: Column, flag: str = _U) -> Column:
    return F.trim(F.regexp_replace(s, flag + r"\s+", " "))


def normalise(text: Column, mask_products: bool = True) -> Column:
    """Lower-cased, ids blanked, product words masked as ``P``, blanks squeezed."""
    def steps(s: Column, u: str) -> Column:
        s = F.regexp_replace(s, u + _ID, " ")
        if mask_products:
            s = F.regexp_replace(s, u + _PRODUCT, "P")
        return squeeze(s, u)

    return by_alphabet(F.lower(F.coalesce(text, F.lit(""))), steps)


def core_of(norm: Column) -> Column:
    """A normalised message without greeting, payment remarks and closings."""
    def steps(s: Column, u: str) -> Column:
        s = F.regexp_replace(s, u + _GREETING, "")
        s = F.regexp_replace(s, u + _PAYMENT, " ")
        s = F.regexp_replace(s, u + _CLOSING, " ")
        s = F.regexp_replace(s, u + r"\s+", " ")
        s = F.regexp_replace(s, u + r"\s*,\s*", ", ")
        s = F.btrim(s, F.lit(" ,"))
        return F.regexp_replace(s, "(, )+", ", ")

    return by_alphabet(norm, steps)


def core(text: Column, mask_products: bool = True) -> Column:
    return core_of(normalise(text, mask_products))


def split_core(core_text: Column, shown: bool = False) -> Column:
    """The requests in a core. Known second halves ("need replacement") stay with what precedes them."""
    tail = _SHOWN_TAIL if shown else _MASKED_TAIL
    marked = F.regexp_replace(core_text, tail, _JOINER + "$1")
    return F.transform(F.split(marked, ", "), lambda x: F.replace(x, F.lit(_JOINER), F.lit(", ")))


def clauses(text: Column) -> Column:
    return split_core(core(text))


def shown_clauses(text: Column) -> Column:
    """The same requests with the product words kept; the masked ones if the two ever disagree."""
    masked, shown = clauses(text), split_core(core(text, False), shown=True)
    return F.when(F.size(masked) == F.size(shown), shown).otherwise(masked)


def last_clause(text: Column) -> Column:
    return F.element_at(clauses(text), -1)


def is_vague_clause(last: Column) -> Column:
    """The deciding request states no need."""
    return last.rlike(_VAGUE)


def is_vague(text: Column) -> Column:
    return is_vague_clause(last_clause(text))


def payment_remark(text: Column) -> Column:
    """Which payment remark the message makes, or NULL."""
    found = by_alphabet(F.lower(F.coalesce(text, F.lit(""))), lambda s, u: F.regexp_extract(s, u + _PAYMENT, 1))
    return F.nullif(found, F.lit(""))


def has_payment_remark(text: Column) -> Column:
    return by_alphabet(F.lower(F.coalesce(text, F.lit(""))), lambda s, u: s.rlike(u + _PAYMENT))


def with_phrases(df: DataFrame, text: str = "text", prefix: str = "", shown: bool = False) -> DataFrame:
    """Adds norm, core, clauses, n_clauses, first, last, vague (and shown, first_shown, last_shown).

    Every step reads the one before it, which keeps the regex chain linear in the plan.
    """
    out = with_requests(df.withColumn(prefix + "norm", normalise(F.col(text))), prefix)
    return with_shown(out, text, prefix) if shown else out


def with_requests(df: DataFrame, prefix: str = "") -> DataFrame:
    """Adds core, clauses, n_clauses, first, last and vague, all of which follow from ``norm``."""
    p = prefix
    out = df.withColumn(p + "core", core_of(F.col(p + "norm")))
    out = out.withColumn(p + "clauses", split_core(F.col(p + "core")))
    out = out.withColumns({
        p + "n_clauses": F.size(p + "clauses"),
        p + "first": F.element_at(p + "clauses", 1),
        p + "last": F.element_at(p + "clauses", -1),
    })
    return out.withColumn(p + "vague", is_vague_clause(F.col(p + "last")))


def with_shown(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds shown, first_shown and last_shown to rows of ``with_phrases``; ``core`` and ``clauses`` may have been dropped."""
    p = prefix
    out = df.withColumn("_masked", F.col(p + "clauses") if p + "clauses" in df.columns else split_core(core_of(F.col(p + "norm"))))
    out = out.withColumn("_shown", split_core(core(F.col(text), False), shown=True))
    out = out.withColumn(p + "shown", F.when(F.size("_shown") == F.size("_masked"), F.col("_shown")).otherwise(F.col("_masked")))
    return out.withColumns({
        p + "first_shown": F.element_at(p + "shown", 1),
        p + "last_shown": F.element_at(p + "shown", -1),
    }).drop("_shown", "_masked")


def answer_team(answer: Column) -> Column:
    """The team named in a free-text answer: longest full name first, then an alias, else UNPARSED."""
    o = F.lower(F.trim(answer))
    out = F
    for team in sorted(L.TEAMS, key=len, reverse=True):
        out = out.when(o.contains(team.lower()), F.lit(team))
    for alias, team in L.ANSWER_ALIASES:
        out = out.when(o.contains(alias), F.lit(team))
    return out.otherwise(F.lit("UNPARSED"))


def paraphrase_lines(answer: Column) -> Column:
    """Candidate paraphrases in a language model's answer: one per line, no bullets or quotes, 3-120 characters."""
    lines = F.transform(F.split(answer, r"\r\n|\n|\r"), _clean_line)
    return F.filter(lines, lambda x: F.length(x).between(3, 120))


def _clean_line(line: Column) -> Column:
    s = F.regexp_replace(line, _U + r"^\s*(?:\d+[.)]|[-*•])\s*", "")
    for pattern in (r"^\s+|\s+$", '^"+|"+$', r"^\s+|\s+$"):
        s = F.regexp_replace(s, _U + pattern, "")
    return s
