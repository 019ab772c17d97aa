"""Cleaning expressions: damaged text, renamed teams, mixed time zones. All are JVM-side Columns."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L


@functools.lru_cache(maxsize=1)
def _cp1252() -> tuple[str, str]:
    """The printable cp1252 characters outside Latin-1, and the bytes (as C1 characters) they stand for."""
    special, byte = [], []
    for b in range(0x80, 0xA0):
        try:
            special.append(bytes([b]).decode("cp1252"))
            byte.append(chr(b))
        except UnicodeDecodeError:
            pass
    return "".join(special), "".join(byte)


@functools.lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """NFKD without combining marks, as rules for ``translate``: (from, to, deleted, longer results).

    Hangul syllables are left out: they decompose by arithmetic.
    """
    one_from, one_to, deleted, longer = [], [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            deleted.append(c)
        elif len(plain) == 1:
            one_from.append(c)
            one_to.append(plain)
        else:
            longer[c] = plain
    return "".join(one_from), "".join(one_to), "".join(deleted), longer


def _char_class(chars) -> str:
    """A regex class of code point ranges."""
    codes = sorted(map(ord, chars))
    spans, start = [], codes[0]
    for a, b in zip(codes, codes[1:] + [None]):
        if b != a + 1:
            spans.append(f"\\x{{{start:X}}}-\\x{{{a:X}}}" if a > start else f"\\x{{{a:X}}}")
            start = b
    return "[" + "".join(spans) + "]"


def _hangul(c: Column) -> Column:
    """A precomposed Hangul syllable as its two or three jamo."""
    lead = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + i)) for i in range(21)])
    tail = F.array(*[F.lit(chr(0x11A7 + i) if i else "") for i in range(28)])
    i = F.ascii(c) - F.lit(0xAC00)
    return F.concat(
        F.element_at(lead, (F.floor(i / 588) + 1).cast("int")),
        F.element_at(vowel, (F.floor((i % 588) / 28) + 1).cast("int")),
        F.element_at(tail, (i % 28 + 1).cast("int")),
    )


def _strip_accents(s: Column) -> Column:
    one_from, one_to, deleted, longer = _decompositions()
    simple = F.translate(s, one_from + deleted, one_to)
    # one string literal that the optimizer folds into one map literal, instead of thousands of nodes
    table = F.str_to_map(F.lit("\u0002".join(f"{k}\u0003{v}" for k, v in sorted(longer.items()))),
                         F.lit("\u0002"), F.lit("\u0003"))
    has_longer = "[가-힣]|" + _char_class(longer)
    expanded = F.array_join(
        F.transform(
            F.split(simple, ""),
            lambda c: F.when(c < F.lit("\u0080"), c)
            .when((c >= F.lit("가")) & (c <= F.lit("힣")), _hangul(c))
            .otherwise(F.coalesce(F.try_element_at(table, c), c)),
        ),
        "",
    )
    return F.when(~s.rlike("[^\\x00-\\x7F]"), s).when(simple.rlike(has_longer), expanded).otherwise(simple)


def undo_double_encoding(s: Column) -> Column:
    """Text that was UTF-8 read as cp1252 is turned back; anything that does not round-trip stays as it is."""
    special, byte = _cp1252()
    encodable = s.rlike("^[\\x00-\\x7F\\xA0-\\xFF" + special + "]*$")
    raw = F.encode(F.translate(s, special, byte), "ISO-8859-1").cast("string")
    # plain ASCII reads the same both ways, so only the other rows pay for the round trip
    return F.when(s.rlike("[^\\x00-\\x7F]") & encodable, F.coalesce(F.try_validate_utf8(raw), s)).otherwise(s)


def repair_damaged(text: Column) -> Column:
    """The part of the cleaning that mends encodings; accents are still there afterwards."""
    s = F.coalesce(text, F.lit(""))
    for bad, good in L.DOUBLE_ENCODED:
        s = F.replace(s, F.lit(bad), F.lit(good))
    s = undo_double_encoding(s)
    for bad, good in L.PUNCTUATION:
        s = F.replace(s, F.lit(bad), F.lit(good))
    return s


def fix_text(text: Column) -> Column:
    """Mended encodings, ASCII punctuation, no accents; NULL becomes the empty string.

    Rows of plain ASCII (nearly all of them) take the first branch and skip every step.
    """
    s = F.coalesce(text, F.lit(""))
    return F.when(~s.rlike("[^\\x00-\\x7F]"), s).otherwise(_strip_accents(repair_damaged(text)))


def current_team(team: Column) -> Column:
    """The team's name after the renames; the mapping has two entries, so it is part of the plan."""
    out = F
    for old, new in L.RENAMES.items():
        out = out.when(team == old, F.lit(new))
    return out.otherwise(team)


def resolved_in_ist(resolved_at: Column, source: Column) -> Column:
    """Resolution events of the legacy source are UTC; all others are IST already."""
    shift = F.when(source == L.LEGACY_SOURCE, F.expr(f"INTERVAL '{L.LEGACY_SHIFT_MINUTES}' MINUTE")).otherwise(
        F.expr("INTERVAL '0' MINUTE"))
    return resolved_at + shift


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def dimension_name(team: Column, renamed_to: Column) -> Column:
    """Current name out of ``"X (note)"``, or the team itself when it was not renamed."""
    return F.coalesce(F.split(renamed_to, " \\(").getItem(0), team)


def redact(text: Column, width: int = 90) -> Column:
    """Lower-cased text without order or registration numbers, cut for display."""
    return F.substring(F.regexp_replace(F.lower(text), "(?U)" + L.ID_PATTERN, "[no.]"), 1, width)


def phrase_family(phrase: Column) -> Column:
    """Phrases that differ only in a number are one family."""
    return F.regexp_replace(phrase, "(?U)\\d+", "#")


def unmask(phrase: Column, word: str = "product") -> Column:
    return F.replace(phrase, F.lit("P"), F.lit(word))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def has_damage(text: Column) -> Column:
    """Signs that damaged text is left."""
    return text.rlike("Ã|Â|â€")
