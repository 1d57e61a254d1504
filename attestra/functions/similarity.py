"""Text similarity: closed forms as Columns, and Arrow UDFs over distinct pairs where Spark has no expression."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.normalise import let


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    hit_a, hit_b, common = [False] * n, [False] * m, 0
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not hit_b[j] and b[j] == x:
                hit_a[i] = hit_b[j] = True
                common += 1
                break
    if not common:
        return 0.0
    left = [x for x, h in zip(a, hit_a) if h]
    right = [x for x, h in zip(b, hit_b) if h]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (common / n + common / m + (common - moved) / common) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, n, m)) if a[k] != b[k]), min(4, n, m))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """SIM-01: Jaro-Winkler similarity of lower-case strings; null where one is null."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x.lower(), y.lower()) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def jaro_winkler_each(pairs: pd.Series) -> pd.Series:
    """SIM-01 of each struct (a, b) of an array, trimmed; 0 where one is blank, null where one is null."""
    out, known = [], {}
    for row in pairs:
        scores = []
        for p in row:
            a, b = p["a"], p["b"]
            if a is None or b is None:
                scores.append(None)
                continue
            if (a, b) not in known:
                x, y = a.strip().lower(), b.strip().lower()
                known[a, b] = _jaro_winkler(x, y) if x and y else 0.0
            scores.append(known[a, b])
        out.append(scores)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """SIM-03: ratio of matching blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _word_edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(T.DoubleType())
def word_error_rate(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """SIM-05, SIM-06: word edits per expected word, at most 1."""

    def one(x, y):
        if x is None or y is None:
            return None
        p, q = x.split(), y.split()
        return float(bool(q)) if not p else min(1.0, _word_edits(p, q) / len(p))

    return pd.Series([one(x, y) for x, y in zip(expected, actual)], dtype="float64")


def over_distinct(pairs: DataFrame, a: str, b: str, udf, out: str) -> DataFrame:
    """pairs with a column `out` of a UDF over (a, b), which runs once for each distinct pair."""
    scored = pairs.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct().select(F.col(a).alias("_a"), F.col(b).alias("_b"), udf(F.col(a), F.col(b)).alias(out))
    return pairs.join(scored, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").drop("_a", "_b")


def char_error_rate(expected: Column, actual: Column) -> Column:
    """SIM-04, SIM-06: character edits per expected character, at most 1."""
    n = F.length(expected)
    return F.when(n == 0, (F.length(actual) > 0).cast("double")).otherwise(F.least(F.lit(1.0), F.levenshtein(expected, actual) / n))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """SIM-02: cosine of the tf-idf vectors of two texts as a corpus of two.

    With two documents, the idf of a word is 1 if both have it and ln(3/2)+1 if one has. Equal texts (but for case) give
    1, an empty text or one without words of two letters 0.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    x, y = words(a), words(b)
    own = 1.4054651081081644
    count = lambda ws, w: F.size(F.filter(ws, lambda v: v == w)).cast("double")
    norm = lambda p, q: F.aggregate(
        F.array_distinct(p), F.lit(0.0), lambda s, w: s + F.pow(count(p, w) * F.when(F.array_contains(q, w), 1.0).otherwise(own), F.lit(2.0))
    )
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(dot / F.sqrt(norm(x, y) * norm(y, x)))
    )


def ascii_normal(c: Column) -> Column:
    """SIM-06: ASCII characters alone, lower case, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")), r"\s+", " "))


def plain_normal(c: Column) -> Column:
    """SIM-07: without the combining marks of Latin letters, lower case, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, *_ACCENTS)), r"\s+", " "))


def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without them, by Unicode's decompositions."""
    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(i))) == 2 and d[0].isascii() and unicodedata.combining(d[1])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTS = _accents()


def recalled(text: Column, value: Column, tolerance: float = 0.25) -> Column:
    """SIM-07: how a value stands in a text: "exact" as it is, "compact" without blanks, "near" in a window with a character error rate
    of at most `tolerance`, null if not at all. A blank value is there.

    A window is eight characters longer than the value and so at least six edits away from it (two blanks at its ends may go): a value
    that six edits are too many for is looked for in no window, unless the text itself is that short.
    """
    p, v, w = plain_normal(text), plain_normal(value), ascii_normal(plain_normal(value))
    n = F.length(v)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(p) - 2 * n))
    near = F.exists(starts, lambda i: F.levenshtein(ascii_normal(F.substr(p, i + 1, n + 8)), w) <= tolerance * F.length(w))
    worth = (F.length(w) > 0) & ((F.length(w) * tolerance >= 6) | (F.length(p) < n + 8) | (F.length(w) < n))
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.when(v == "", "exact").when(F.contains(p, v), "exact").when(F.contains(squeeze(p), squeeze(v)), "compact").when(worth & near, "near")


#: Ranges of letters by script.
SCRIPTS = {
    "devanagari": r"[\x{0900}-\x{097F}]", "kana": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]", "han": r"[\x{4E00}-\x{9FFF}]",
    "hangul": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]", "latin": r"[a-zA-Z]",
}


def script_of(c: Column) -> Column:
    """SIM-13: struct<script, mixed, confidence> of a text: latin, devanagari, japanese, chinese, korean, mixed, or unknown for a blank one.

    Devanagari and Latin are mixed if each has a fifth of the letters. A text without letters counts as Latin.
    """
    def counted(s: Column) -> Column:
        return F.struct(s.alias("s"), *[(F.length(s) - F.length(F.regexp_replace(s, r, ""))).alias(k) for k, r in SCRIPTS.items()])

    def shares(n: Column) -> Column:
        letters = n["devanagari"] + n["kana"] + n["han"] + n["hangul"] + n["latin"]
        total = F.nullif(letters, F.lit(0))
        return F.struct(
            (F.coalesce(n["s"], F.lit("")) == "").alias("blank"), letters.alias("total"), (n["kana"] > 0).alias("kana"), (n["han"] > 0).alias("han"), (n["devanagari"] / total).alias("dev"), (n["latin"] / total).alias("lat"),
            ((n["kana"] + F.when(n["kana"] > 0, n["han"]).otherwise(0)) / total).alias("jap"), (F.when(n["kana"] == 0, n["han"]).otherwise(0) / total).alias("chi"), (n["hangul"] / total).alias("kor"),
        )

    def judged(x: Column) -> Column:
        dev, lat = x["dev"], x["lat"]
        both = (dev > 0) & (lat > 0)
        say = lambda script, mixed, sure: F.struct(F.lit(script).alias("script"), F.lit(mixed).alias("mixed"), (F.floor(sure * 100 + 0.5) / 100).alias("confidence"))
        return (
            F.when(x["blank"], say("unknown", False, F.lit(1.0)))
            .when(x["total"] == 0, say("latin", False, F.lit(0.90)))
            .when(both & (dev >= 0.20) & (lat >= 0.20), say("mixed", True, F.greatest(dev, lat)))
            .when(both & (dev > lat), say("devanagari", True, dev))
            .when(both, say("latin", True, lat))
            .when(dev >= 0.15, say("devanagari", False, dev))
            .when(x["kana"] | x["han"] & (x["jap"] >= 0.20), say("japanese", False, x["jap"]))
            .when(x["kor"] > 0, say("korean", False, x["kor"]))
            .when(x["chi"] >= 0.30, say("chinese", False, x["chi"]))
            .otherwise(say("latin", False, F.when(lat > 0, lat).otherwise(0.90)))
        )

    return let(let(let(F.trim(c), counted), shares), judged)


def script_mismatch(expected: Column, c: Column) -> Column:
    """SIM-14: whether a text is in another script than expected: Latin alone for Devanagari, any Devanagari for Latin."""
    has = c.rlike(SCRIPTS["devanagari"])
    e = F.lower(expected)
    wrong = F.when(e.isin("devanagari", "hindi", "marathi"), ~has & (script_of(c)["script"] == "latin")).when(e.isin("latin", "english"), has)
    return (F.trim(F.coalesce(c, F.lit(""))) != "") & F.coalesce(wrong, F.lit(False))


def script_counts(c: Column) -> dict[str, Column]:
    """Letters of a text by script of the languages at hand."""
    ranges = {"latin": r"[A-Za-z]", "devanagari": r"[\x{0900}-\x{097F}]", "tamil": r"[\x{0B80}-\x{0BFF}]", "telugu": r"[\x{0C00}-\x{0C7F}]", "kannada": r"[\x{0C80}-\x{0CFF}]"}
    return {name: F.length(c) - F.length(F.regexp_replace(c, r, "")) for name, r in ranges.items()}


#: Tax, bank and trade identifiers.
IDENTIFIER = r"(?i)\b([A-Z]{5}\s?[0-9]{4}[A-Z]|[A-Z]{4}0[A-Z0-9]{6}|[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b"


def recoverable(c: Column) -> Column:
    """SIM-15: whether a line holds a value worth keeping: an identifier, an e-mail address, five digits in a row, or a token of six
    characters and more with letters and digits."""
    mixed = F.exists(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]{6,})"), 1), lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]"))
    found = c.rlike(IDENTIFIER) | c.rlike(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}") | c.rlike("[0-9]{5,}") | mixed
    return (F.trim(F.coalesce(c, F.lit(""))) != "") & F.coalesce(found, F.lit(False))


def ambiguous_pan(c: Column) -> Column:
    """FN-33: whether the first ten letters and digits of a line that speaks of a PAN are none."""
    u = F.upper(c)
    found = F.regexp_extract(u, "([A-Z0-9]{10})", 1)
    return F.coalesce((found != "") & (u.contains("PAN") | u.contains("PERMANENT ACCOUNT")) & ~found.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), F.lit(False))


# Words of amounts, names of banks, headings, brands, labels and what they hold, as forms print them.
AMOUNT_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand lakh lakhs crore crores only rupees"
).split()
BANKS = ("punjab national bank", "punjabnationalbank", "state bank", "hdfc bank", "icici bank")
SECTION_HEADERS = (
    "debit", "frequency", "type", "debit type", "mandate details", "bill parameter", "consumer parameter", "billing computation & charges breakdown", "billingcomputation&chargesbreakdown",
    "charges breakdown", "summary",
)
BRANDING_KEYWORDS = (
    "financial services", "financial services ltd", "hdb", "chdb", "hdbfinancialservicesltd", "electricity distribution", "mahastate", "bank ltd", "limited", "prakashgad", "toll free", "registered office",
)
KNOWN_LABELS = (
    "sponsor bank code", "utility code", "urllity code", "umrn", "date", "with bank", "ifsc/micr", "ifsc", "micr", "an amount of rupees", "amount of rupees", "amount", "consumer name", "consumer no",
    "bill number", "bill date", "billing period", "due date", "bu / subdivision", "billing address", "reference", "reference 1", "reference 2", "rederence1", "reference a", "bank a/c number", "bauka/cumber",
    "application id", "loan id", "pan number", "pan", "applicant name", "permanent account number", "permanentaccountnumber", "permanent account no", "permanent account",
)
LABEL_INDICATORS = ("code", "name", "date", "bank", "no", "number", "amount", "period", "tenure", "reference", "address")
NO_LABELS = ("limited", "ltd", "corporation", "office")


def _any(c: Column, words) -> Column:
    return F.greatest(*[c.contains(w) for w in words])


def amount_in_words(c: Column) -> Column:
    """SIM-16: whether at least half of two or more words are those of an amount."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(*AMOUNT_WORDS)))
    return (F.size(words) >= 2) & (hits >= 1) & (2 * hits >= F.size(words))


def definite_value(c: Column) -> Column:
    """SIM-16: whether a line is a value rather than a label."""
    t = F.trim(c)
    one = ~t.rlike(r"\s")
    return (
        t.rlike(r"^[0-9,.]+$") | one & t.rlike("[A-Za-z]") & t.rlike("[0-9]") | amount_in_words(t) | _any(F.lower(t), BANKS)
        | t.rlike(r"\b[0-9]{1,2}[-/.](?:[A-Za-z]{3}|[0-9]{1,2})[-/.][0-9]{2,4}\b")
    )


def form_label(c: Column) -> Column:
    """SIM-16: whether a line is the label of a form's field; headings and brands are none."""
    t = F.trim(c)
    low = F.lower(t)
    bare = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_\s/]", ""))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    titled = (n <= 4) & t.rlike(r"^\p{Lu}") & ~_any(low, NO_LABELS) & _any(low, LABEL_INDICATORS)
    named = _any(bare, KNOWN_LABELS) | t.endswith(":") | titled
    return (t != "") & (F.length(t) <= 55) & (n <= 6) & ~definite_value(t) & ~bare.isin(*SECTION_HEADERS) & ~_any(bare, BRANDING_KEYWORDS) & named


def gibberish(c: Column) -> Column:
    """SIM-16: whether a line is unreadable: more than forty characters without a blank, or hardly a vowel among more than twenty letters."""
    t = F.trim(c)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    vowels = F.length(F.regexp_replace(F.lower(t), "[^aeiou]", ""))
    return (F.length(t) > 40) & ~t.contains(" ") | (letters > 20) & (vowels / letters < 0.15)


def label_key(c: Column) -> Column:
    """SIM-16: a label as a name of lower-case words joined by underscores; "field" if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))), r"\s+", "_")
    return F.when(bare == "", "field").otherwise(bare)


#: Capitalised words of labels that are no values.
CAPITAL_LABELS = "APPLICANT NAME FATHER MOTHER APPLICATION ACCOUNT NUMBER DATE BIRTH MONTH YEAR SIGNATURE ADDRESS BRANCH AMOUNT MOBILE PHONE GENDER AADHAAR PAN".split()


def value_runs(c: Column) -> Column:
    """SIM-20: runs of four or more capitals and digits in a line that are values: with two digits, or letters alone that are no label."""
    t = F.trim(c)
    return F.filter(
        F.regexp_extract_all(t, F.lit("([A-Z0-9]{4,})"), 1),
        lambda r: (r != t) & ((F.length(F.regexp_replace(r, "[^0-9]", "")) >= 2) | ~r.rlike("[0-9]") & ~r.isin(*CAPITAL_LABELS)),
    )


def fused_row(c: Column, width: Column, height: Column) -> Column:
    """SIM-20: whether a line is a row of character boxes read as one: wide and flat, with a label and a value."""
    t = F.trim(c)
    return F.coalesce((F.length(t) >= 8) & t.rlike("[A-Za-z:]") & (width > 0) & (height > 0) & (width / height >= 6.0) & (F.size(value_runs(t)) > 0), F.lit(False))
