"""Surrogates for personal data, in DataFrame functions only.

Detected: e-mail addresses, IBANs, IPv4 addresses, US social security numbers, telephone numbers, card and other numbers of 13 to 19 digits, and
persons (a title with one or two capitalised words, or a known given name with a capitalised word), in Latin and Cyrillic script.

Every entity has a canonical value (digits of a number, lower case of an address or name; telephone numbers by their last ten digits), so different
spellings of one entity get one surrogate. A surrogate is drawn from a keyed hash of kind, canonical value and attempt number:

* numbers keep length and grouping; card numbers keep the first digit and stay valid or invalid under the check digit rule; IBANs keep
  the country and get right check digits; addresses keep a private range
* e-mail addresses keep the pattern of letters, digits and marks and the top-level domain
* names keep script, capitals and gender (given names of women end in a vowel pair of their own, those of men in a consonant)

Collision checks: a surrogate that equals a real entity of its kind or one drawn for another entity goes back and is drawn again with the next attempt, until
none is left. So distinct entities stay distinct, over the whole table and not per text.

Entities move as narrow rows; a common one is pre-aggregated and its join can be split. Texts move once, by id and text hash.

Defined cases: null texts stay null; texts without entities stay as they are; rows without id and repeated rows are
treated by their text; an empty table gives an empty result; other columns stay and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intake_spark.llm.tables import keeps_names
from intake_spark.session import publish

KEY = "change-me"

# The shapes that are looked for, in order of preference.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{2,3}(?:[ .-]?[0-9]{2,5}){2,5}(?![0-9])"
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mademoiselle", "Госпожа"]
TITLES_M = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"]
TITLES_X = ["Dr", "Prof"]
GIVEN_F = ["Anna", "Maria", "Emma", "Laura", "Sophie", "Julia", "Claire", "Elena", "Carmen", "Sarah", "Alice", "Анна", "Мария", "Ольга", "Елена"]
GIVEN_M = ["John", "James", "Peter", "Paul", "Thomas", "Hans", "Pierre", "Carlos", "David", "Robert", "Michael", "Иван", "Сергей", "Пётр", "Алексей"]
NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
TITLE = "|".join(TITLES_F + TITLES_M + TITLES_X)
PERSON = rf"(?<!\p{{L}})(?:(?:{TITLE})\.? {NAME}(?: {NAME})?|(?:{'|'.join(GIVEN_F + GIVEN_M)}) {NAME})(?!\p{{L}})"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, IP, SSN, CARD, PHONE, PERSON))
KINDS = ["email", "iban", "ip", "ssn", "card", "phone", "person"]
#: Attempts after which the choice of surrogates grows, and the last attempt.
WIDER, ATTEMPTS = 4, 40
BETWEEN = r"(?!^)(?!\z)"  # between two characters
# Syllables of invented names.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe fi ga ge ha he ka ke la le li lo ma me mi mo na ne ni no pa ra re".split(),
             "cyrillic": "ба бе би бо да де ди до фа фе фи га ге ха хе ка ке ла ле ли ло ма ме ми мо на не ни но па ра ре".split()}


def occurrences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(raw: Column) -> Column:
    out = None
    for kind, pattern in zip(KINDS, (EMAIL, IBAN, IP, SSN, CARD, PHONE, PERSON)):
        test = raw.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def units(raw: Column) -> Column:
    """The parts of an occurrence that get surrogates: (kind, canonical value, part as written)."""
    kind = kind_of(raw)
    digits = _digits(raw)
    # ten digits with or without the country code 1 are one number; other codes tell numbers apart
    phone = F.when((F.length(digits) == 11) & digits.startswith("1"), F.right(digits, F.lit(10))).otherwise(digits)
    value = (F.when(kind == "email", F.lower(raw)).when(kind == "iban", F.regexp_replace(raw, " ", "")).when(kind == "ip", raw)
             .when(kind == "phone", phone).otherwise(digits))
    title = F.regexp_extract(raw, rf"^({TITLE})\.? ", 1)
    names = F.split(F.regexp_replace(raw, rf"^(?:{TITLE})\.? ", ""), " ")
    given = F.when(F.size(names) > 1, names[0])
    woman = title.isin(TITLES_F) | F.coalesce(given.isin(GIVEN_F), F.lit(False))
    man = title.isin(TITLES_M) | F.coalesce(given.isin(GIVEN_M), F.lit(False))
    gender = F.when(woman, "f").when(man, "m").otherwise("x")
    script = lambda c: F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    last = F.element_at(names, -1)
    surname = F.struct(F.concat(F.lit("surname "), script(last)).alias("kind"), F.lower(last).alias("value"), last.alias("raw"))
    first = F.struct(F.concat(F.lit("given "), gender, F.lit(" "), script(given)).alias("kind"), F.lower(given).alias("value"), given.alias("raw"))
    person = F.when(F.size(names) > 1, F.array(first, surname)).otherwise(F.array(surname))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"), raw.alias("raw"))))


def _byte(h: Column, i: Column) -> Column:
    """Byte i of a hash in hex (64 of them, then from the start)."""
    return F.conv(F.substr(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _keyed(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """64 bytes in hex: a nested keyed hash and its continuation."""
    inner = F.sha2(F.concat(F.lit(key + "|inner|"), kind, F.lit("|"), value, F.lit(f"|{attempt}")), 256)
    outer = F.sha2(F.concat(F.lit(key + "|outer|"), inner), 256)
    return F.concat(outer, F.sha2(F.concat(F.lit(key + "|more|"), outer), 256))


def _redrawn(value: Column, h: Column, shift: int = 0) -> Column:
    """Letters and digits of a lower-case text redrawn one by one, marks kept."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(h, i + shift)
        return (F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
                .when(c.rlike("[a-z]"), F.char(F.lit(97) + F.pmod(b, F.lit(26))))
                .when(c.rlike("[A-Z]"), F.char(F.lit(65) + F.pmod(b, F.lit(26)))).otherwise(c))
    return F.array_join(F.transform(F.split(value, BETWEEN), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of the check digit rule, the last digit included as written."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(F.pmod(i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _iban_check(country: Column, account: Column) -> Column:
    letters = F.split(F.concat(account, country, F.lit("00")), BETWEEN)
    numbers = F.split(F.array_join(F.transform(letters, lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), ""), BETWEEN)
    rest = F.aggregate(numbers, F.lit(0), lambda acc, d: F.pmod(acc * 10 + d.cast("int"), F.lit(97)))
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def _syllables(h: Column, n: int, script: str) -> Column:
    pool = F.array(*map(F.lit, SYLLABLES[script]))
    return F.concat(*(F.get(pool, F.pmod(_byte(h, F.lit(k)), F.lit(32))) for k in range(n)))


def draw(kind: Column, value: Column, h: Column, attempt: int = 0) -> Column:
    """A surrogate in canonical form.

    Every ``WIDER`` attempts more of them are possible: longer local parts and names, and for addresses of a private network those of
    the next larger private one, then all.
    """
    more = attempt // WIDER
    many = _redrawn(value, h)
    local, domain = F.substring_index(value, "@", 1), F.regexp_extract(value, "@(.*)$", 1)
    top = F.substring_index(domain, ".", -1)
    # a short local part leaves too few choices: it is filled up to eight letters
    email = F.concat(_redrawn(F.rpad(local, F.greatest(F.length(local), F.lit(8)) + 2 * more, F.lit("x")), h), F.lit("@"),
                     _redrawn(F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1), h, 31), F.lit("."), top)
    country = F.substr(value, F.lit(1), F.lit(2))
    account = _redrawn(F.substr(value, F.lit(5)), h)
    octet = lambda k: (F.lit(1) + F.pmod(_byte(h, F.lit(2 * k)) * 256 + _byte(h, F.lit(2 * k + 1)), F.lit(254))).cast("string")
    private = F.regexp_extract(value, r"^(10|192\.168)\.", 1)
    private = F.when(private == "", "").when(F.lit(more > 1), "").when(F.lit(more == 1), "10").otherwise(private)
    ip = F.when(private == "10", F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).when(private != "", F.concat_ws(".", private, octet(2), octet(3))).otherwise(F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
    card = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(many, F.lit(2)))
    stem = F.substr(card, F.lit(1), F.length(card) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))
    check = F.when(F.pmod(_luhn(value), F.lit(10)) == 0, check).otherwise(F.pmod(check + 1 + F.pmod(_byte(h, F.lit(40)), F.lit(9)), F.lit(10)))
    leading = (F.lit(2) + F.pmod(_byte(h, F.lit(50)), F.lit(7))).cast("string")
    out = (F.when(kind == "email", email).when(kind == "iban", F.concat(country, _iban_check(country, account), account)).when(kind == "ip", ip)
           .when(kind == "card", F.concat(stem, check.cast("string"))).when(kind.isin("phone", "ssn"), F.concat(leading, F.substr(many, F.lit(2)))))
    for script, (f, m, x, s) in {"latin": ("ia", "n", "el", "son"), "cyrillic": ("ия", "н", "ель", "ко")}.items():
        out = (out.when(kind == f"given f {script}", F.concat(_syllables(h, 4 + more, script), F.lit(f))).when(kind == f"given m {script}", F.concat(_syllables(h, 4 + more, script), F.lit(m)))
               .when(kind == f"given x {script}", F.concat(_syllables(h, 4 + more, script), F.lit(x))).when(kind == f"surname {script}", F.concat(_syllables(h, 5 + more, script), F.lit(s))))
    return out


def mapping(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value) rows; draws again until no surrogate clashes.

    The number of open rows falls with each attempt, as the choice grows; where a fixed shape (nine digits, say) has no free value
    left, the last attempt raises an error instead of giving two entities one surrogate.
    """
    entities = publish(entities, "entities")
    settled, open_, attempt = None, entities, 0
    real = entities.select(F.col("kind").alias("k"), F.col("value").alias("surrogate"))
    while attempt < ATTEMPTS:
        h = _keyed(key, F.col("kind"), F.col("value"), attempt)
        drawn = publish(open_.withColumn("h", h).select("kind", "value", draw(F.col("kind"), F.col("value"), F.col("h"), attempt).alias("surrogate")), "drawn")
        free = drawn.join(real, (drawn["kind"] == real["k"]) & (drawn["surrogate"] == real["surrogate"]), "left_anti")
        if settled is not None:
            taken = settled.select(F.col("kind").alias("k"), F.col("surrogate").alias("s"))
            free = free.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left_anti")
        one = publish(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "settled")
        settled = one if settled is None else settled.union(one)
        open_ = publish(drawn.join(one, ["kind", "value"], "left_anti").select("kind", "value"), "clashes")
        attempt += 1
        if open_.isEmpty():
            return settled
    raise ValueError(f"no distinct surrogates left for {open_.count()} entities after {ATTEMPTS} attempts")


def _cased(raw: Column, new: Column) -> Column:
    return F.when((F.length(raw) > 1) & (F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(new)).otherwise(new)


def _placed(raw: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the written form of the occurrence: its digits from the right, its marks, its capitals."""
    n = F.length(new)

    def digit(c: Column, i: Column) -> Column:
        behind = F.length(_digits(F.substr(raw, i + 2)))
        return F.when(c.rlike("[0-9]") & (behind < n), F.substr(new, n - behind, F.lit(1))).otherwise(c)

    # an IBAN as written has blanks between groups of four
    spaced = F.when(raw.contains(" "), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)
    return (F.when(kind == "email", _cased(raw, new)).when(kind == "iban", spaced).when(kind == "ip", new)
            .when(kind.isin("ssn", "card", "phone"), F.array_join(F.transform(F.split(raw, BETWEEN), digit), "")).otherwise(F.initcap(new)))


@keeps_names
def replace(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key: str = KEY) -> DataFrame:
    """All columns of ``docs`` with surrogates in ``text``, and ``__pii``: the kinds of its entities; a column of that name is replaced."""
    docs = docs.select(*(c for c in docs.columns if not c.endswith(" __pii") and c != "__pii"))
    keyed = docs.select(F.col(doc_id).cast("string").alias("id"), F.xxhash64(text).alias("th"), occurrences(F.col(text)).alias("raws")).where(F.size("raws") > 0)
    one = keyed.select("id", "th", F.posexplode("raws").alias("at", "raw"))
    parts = one.select("id", "th", "at", F.posexplode(units(F.col("raw"))).alias("part", "u"))
    parts = publish(parts.select("id", "th", "at", "part", F.col("u.kind").alias("kind"), F.col("u.value").alias("value"), F.col("u.raw").alias("raw")), "entity-places")
    found = publish(mapping(parts.select("kind", "value").distinct(), key), "surrogates")
    placed = parts.join(found, ["kind", "value"])
    placed = placed.select("id", "th", "at", "part", "kind", "raw", _placed(F.col("raw"), F.col("kind"), F.col("surrogate")).alias("new"))
    rows = placed.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("at", "part", "kind", "raw", "new"))).alias("__new"))
    rows = rows.select(F.col("id").alias("__i"), F.col("th").alias("__t"), "__new")
    out = docs.join(rows.hint("shuffle_hash"), F.col(doc_id).cast("string").eqNullSafe(F.col("__i")) & (F.xxhash64(text) == F.col("__t")), "left")
    between, raws = F.split(F.col(text), ANY, -1), occurrences(F.col(text))

    def written(raw: Column, i: Column) -> Column:
        """The occurrence anew; the parts of a name are set by their place, so equal letters elsewhere in it stay out of it."""
        own = F.filter("__new", lambda x: x["at"] == i)
        title = F.regexp_extract(raw, rf"^(?:{TITLE})\.? ", 0)
        names = F.split(F.substr(raw, F.length(title) + 1), " ")
        whole = F.size(own) > 1  # given name and surname

        def name(n: Column, k: Column) -> Column:
            return (F.when(whole & (k == 0), F.get(own, F.lit(0))["new"]).when(k == F.size(names) - 1, F.element_at(own, -1)["new"]).otherwise(n))

        first = F.get(own, F.lit(0))
        person = first["kind"].startswith("given") | first["kind"].startswith("surname")
        return F.when(F.size(own) == 0, raw).when(person, F.concat(title, F.array_join(F.transform(names, name), " "))).otherwise(first["new"])

    news = F.transform(raws, written)
    joined = F.array_join(F.flatten(F.transform(between, lambda p, i: F.array(p, F.coalesce(F.get("__newer", i), F.lit(""))))), "")
    kinds = F.transform(F.filter("__new", lambda x: x["part"] == 0), lambda x: F.when(x["kind"].startswith("given") | x["kind"].startswith("surname"), "person").otherwise(x["kind"]))
    out = out.withColumn("__newer", F.when(F.col("__new").isNotNull(), news))
    out = out.withColumn("__pii", F.coalesce(kinds, F.array().cast("array<string>")))
    return out.withColumn(text, F.when(F.col("__new").isNull(), F.col(text)).otherwise(joined)).drop("__i", "__t", "__new", "__newer")


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per document: the text with surrogates, how many entities it had, and how many of each kind."""
    out = replace(docs.select("doc_id", "text"), key=key)

    def number(kind: str) -> Column:
        return F.size(F.filter("__pii", lambda x: x == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", "text", F.size("__pii").cast("long").alias("n_entities"), *map(number, KINDS))
