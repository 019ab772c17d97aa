"""Golden strings for the cleaning and parsing expressions."""
import unicodedata

from pyspark.sql import functions as F

from intake_spark.functions import clean as C
from intake_spark.functions import grams as G
from intake_spark.functions import parse as P


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_damaged_text_is_mended(spark):
    pairs = {
        "urgÃ©nt: installer did not turn up": "urgent: installer did not turn up",
        "purifier not working Ã¢â‚¬Â¦": "purifier not working ...",
        "pls hÃ©lp Ã¢â‚¬â€œ issue": "pls help - issue",
        "plain text": "plain text",
        None: "",
    }
    assert column(spark, list(pairs), C.fix_text) == list(pairs.values())


def test_accents_match_unicode_decomposition(spark):
    samples = ["naïve café", "ﬁne ½ ™", "한국어 각", "日本 “quoted”", "é", "Ǆ ẛ̣ ①", "\u0085x", "a b"]

    def expected(s):
        try:
            s = s.encode("cp1252").decode("utf8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    assert column(spark, samples, C.fix_text) == [expected(s) for s in samples]


def test_greeting_ids_closing_and_payment_are_stripped(spark):
    s = "namaste, motor of air fryer burnt smell paid on upi order KO7654321 pls call back"
    assert column(spark, [s], P.clauses) == [["motor of P burnt smell"]]
    assert column(spark, [s, "nothing"], P.payment_remark) == ["paid on upi", None]


def test_two_requests_are_split_and_second_halves_stay(spark):
    cases = {
        "pls help - is ceiling fan safe for kids, ceiling fan leaking water from bottom paid by emi kindly resolve":
            ["is P safe for kids", "P leaking water from bottom"],
        "hi, air fryer arrived damaged, need replacement thanks": ["P arrived damaged, need replacement"],
        "warranty rejected for mixer, why": ["warranty rejected for P, why"],
        "sir box was open, fan scratched": ["box was open, P scratched"],
        "why, why, want exchange": ["why, why, want exchange"],
        "": [""],
        " ,, ": [""],
    }
    assert column(spark, list(cases), P.clauses) == list(cases.values())


def test_shown_requests_keep_product_words(spark):
    s = "good morning, want AMC filter kit for purifier, purifier arrived damaged, need replacement"
    assert column(spark, [s, "box was open, mixer grinder scratched"], P.shown_clauses) == [
        ["want amc filter kit for purifier", "purifier arrived damaged, need replacement"],
        ["box was open, mixer grinder scratched"]]


def test_vague_is_decided_by_the_last_request(spark):
    s = ["sir please call back regarding product reg no SR12345",
         "box was open, purifier scratched, please call back regarding purifier",
         "please call back regarding purifier, purifier leaking water from bottom",
         "water purifier not turning on pls call back"]
    assert column(spark, s, P.is_vague) == [True, True, False, False]
    assert column(spark, s[:1], P.clauses) == [["please call back regarding P"]]


def test_language_model_answers(spark):
    assert column(spark, ["Team: installs & demo.", "returns please", "no idea"], P.answer_team) == [
        "Installs & Demo", "Returns & Replacement", "UNPARSED"]
    assert column(spark, ['1. "my fan is dead"\n- x\n * fan broke '], P.paraphrase_lines) == [["my fan is dead", "fan broke"]]


def test_names_families_and_redaction(spark):
    assert column(spark, ["Installations", "Repairs"], C.current_team) == ["Installs & Demo", "Repairs"]
    assert column(spark, ["error code e12 on P"], C.phrase_family) == ["error code e# on P"]
    assert column(spark, ["Order KO12345 late"], C.redact) == ["[no.] late"]


def test_char_grams_stay_inside_words(spark):
    def by_hand(text):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                out += [w[i:i + n] for i in range(max(1, len(w) - n + 1))]
                if len(w) <= n:
                    break
        return sorted(out)

    texts = ["motor of P burnt smell", "a", "why"]
    assert [sorted(x) for x in column(spark, texts, G.char_ngrams)] == [by_hand(t) for t in texts]
    assert column(spark, ["is P safe for kids"], lambda c: G.word_ngrams(c, 1, 2)) == [
        ["is", "safe", "for", "kids", "is safe", "safe for", "for kids"]]
