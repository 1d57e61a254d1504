"""How far a line of recognised text may be trusted: rules over its characters and words, as Column expressions.

The rules are read in order; the first that speaks decides. All of them look at one line, which bounds their cost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.similarity import IDENTIFIER

# Symbols, misread n-grams and tokens that only noise has, and known acronyms. N-grams with symbols of the first
# list are left out of the second, as the first speaks before. "HAR" before "I" cannot end a word, so it needs no exception.
FOREIGN_SYMBOLS = "[παβγδεζηθικλμνξοπρστυφχψω∫∑√∝∞∠∧∨∩∪≈≠≡≤≥ąęįųπ×]"
ONLY_SYMBOLS = r"^[~`!@#$%^&*()_+={}\[\]|\\:;\"'<>,?/]+$"
MISREAD_NGRAMS = r"(?i)\b(RROR|HRAR|HRTRR|RHR|HTT|3QRR|oalh|2alalehule|3ITETT|31CT|3HTETR)\b"
MISREAD_TOKENS = r"(?i)\b(TE|RAA|HOTRT|Signralid|Brih|HAR|Hin|Wuy|Nane|Empioyee|OSV)\b"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
BLOB = r"(\b[0-9]+[A-Z]{2,}[0-9]*\b|\b[A-Z]{2,}[0-9]+\s?[0-9]*\b)"
PUNCTUATED = r"[a-z]{1,2}\s*[,)(]\s*[a-z0-9\s,)(]{8,}"
ACRONYMS = (
    "HTML", "HTTP", "HTTPS", "PDF", "JSON", "KYC", "PAN", "VKYC", "IFSC", "NEFT", "RTGS", "GST", "HDFC", "ICICI", "UTI", "UIDAI", "DPI", "OCR", "VLM", "API", "XML", "S3", "URL", "ID", "DOB", "S/O", "D/O", "W/O",
    "VTC", "PVT", "LTD", "MNC", "PSU", "LLP", "HUF", "SMS", "STD", "VPA", "CKYC", "UPI", "EMI", "CIN", "TAN", "MSME", "NRI", "NBFC", "NACH", "KFS", "HDB", "LTV", "ROI", "PIO", "OCI", "TDS", "MICR", "CVL", "CDSL", "NSDL",
)
REPEATED = "(?:" + "|".join(f"{c}{{5}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + ")"
CONSONANTS = r"\b[BCDFGHJKLMNPQRSTVWXYZbcdfghjklmnpqrstvwxyz]{3,}\b"
SCRIPTS = r"\x{0900}-\x{097F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
SYMBOL, SCRIPT, LETTER = rf"[^a-zA-Z0-9{SCRIPTS}\s]", f"[{SCRIPTS}a-zA-Z0-9]", f"[{SCRIPTS}a-zA-Z]"
VALID_INITIALS = ("th", "sh", "ch", "wh", "ph", "sc", "sk", "sl", "sm", "sn", "sp", "st", "sw", "tr", "pr", "br", "cr", "dr", "fr", "gr", "pl", "cl", "bl", "fl", "gl")
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Shri", "Smt.")


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def noisy(c: Column) -> Column:
    """SIM-11: whether a line is noise. Null and blank lines are not."""
    s = F.trim(c)
    words = F.split(s, r"\s+")
    named = s.rlike(IDENTIFIER)
    blobs = F.exists(F.regexp_extract_all(s, F.lit(BLOB), 1), lambda b: (F.length(F.trim(b)) <= 5) & (_count(b, "[0-9]") <= 2))
    clusters = F.exists(F.regexp_extract_all(s, F.lit(f"({CONSONANTS})"), 1), lambda w: ~F.upper(w).isin(*ACRONYMS))
    letters = lambda w: F.regexp_replace(w, "[^a-zA-Z]", "")
    vowelless = F.exists(
        words,
        lambda w: ~w.rlike("[0-9]") & (F.length(letters(w)) >= 4) & ~F.upper(letters(w)).isin(*ACRONYMS) & (F.length(F.regexp_replace(letters(w), "[^aeiouyAEIOUY]", "")) < 0.15 * F.length(letters(w))),
    )
    return (
        F.when(s.isNull() | (s == ""), False)
        .when(s.rlike(FOREIGN_SYMBOLS) | s.rlike(ONLY_SYMBOLS) | s.rlike(REPEATED) | s.rlike(MISREAD_NGRAMS) | s.rlike(CJK) | s.rlike(MISREAD_TOKENS), True)
        .when(~named & blobs, True)
        .when(s.rlike(PUNCTUATED), True)
        .when(s.rlike("^[A-Z]{1,2}$"), True)
        .when(s.rlike("^[0-9]+$"), False)
        .when(~named & (clusters | vowelless), True)
        .when(~s.rlike(SCRIPT), True)
        .when((F.length(s) > 4) & s.rlike(LETTER) & (_count(s, SYMBOL) > 0.40 * F.length(s)), True)
        .otherwise(False)
    )


def trust(c: Column, flat: Column | None = None) -> Column:
    """SIM-12: 0 for a blank line, 0.35 for noise, else 0.96 (0.98 for titles and clean capitals) less what its words cost, from 0.15 to 0.99.

    flat: whether the line's box has no width or height, which costs 0.30.
    """
    s = F.trim(c)
    words = F.split(s, r"\s+")
    initial = lambda w: w.rlike(r"\b[bcdfghjklmnpqrstvwxz]{2}[a-z]{3,}\b") & ~F.substring(F.lower(w), 1, 2).isin(*VALID_INITIALS)
    cost = F.aggregate(
        words,
        F.lit(0.0),
        lambda a, w: a
        + F.when(w.rlike(IDENTIFIER) | F.upper(w).isin(*ACRONYMS), 0.0).otherwise(
            F.when(w.rlike("[A-Z]+[a-z]+[A-Z]+"), 0.18).otherwise(0.0)
            + F.when(w.rlike("[a-z][A-Z]"), 0.15).otherwise(0.0)
            + F.when(initial(w), 0.15).otherwise(0.0)
            + F.when(w.rlike(r"\b[A-Za-z]+[0-9]+[A-Za-z]+\b"), 0.12).otherwise(0.0)
            + F.when((F.length(w) > 22) & ~w.rlike(r"[-_./\\@]"), 0.10).otherwise(0.0)
        ),
    )
    marks = F.when(s.rlike(r"[,.;:!?_\-/\\|]{2,}") & ~s.contains("--") & ~s.contains("..."), 0.08).otherwise(0.0)
    single = F.when((F.length(s) == 1) & ~s.rlike("[0-9aAiI]"), 0.20).otherwise(0.0)
    box = F.when(flat, 0.30).otherwise(0.0) if flat is not None else F.lit(0.0)
    total = cost + marks + single + box
    clean = s.isin(*TITLES) | s.rlike("[A-Z]") & ~s.rlike(r"\p{Ll}") & F.size(words).between(2, 5) & (total == 0)
    score = F.greatest(F.lit(0.15), F.least(F.lit(0.99), F.when(clean, 0.98).otherwise(0.96) - total))
    return F.when(s.isNull() | (s == ""), 0.0).when(noisy(s), 0.35).otherwise(F.floor(score * 10000 + 0.5) / 10000)


def label_noise(c: Column) -> Column:
    """SIM-10: a line of an identity document without what misread labels in another script leave behind, by ten rules in order.

    Short blobs of capitals and at most two digits go, identifiers and longer numbers stay. A lone capital goes unless it is an
    initial (next to a letter or digit) or of a line of single characters. Null and blank lines stay as they are.
    """
    s = F.trim(c)
    for pattern in (r"^[fF](ua)?\s*/\s*", r"^[aA]\s*/\s*(?=[Dd]ate|[sS]ignature|[dD][oO][bB])", r"^[aA][tT]&?\s*/\s*", r"^GR@\s*/?\s*", r"(?i)\b(FarHToT|3RRTO|HRAHRR|PA ROR)\b", r"^[a-z]\s+(?=[A-Z])",
                    r"\b(TE|RAA|HOTRT|Signralid|HAR|Hin|Wuy|Nane|Empioyee|OSV)\b", CJK):
        s = F.regexp_replace(s, pattern, "")
    # A blob of at most five characters holds no identifier. Digits after a blank belong to a blob of the second kind.
    s = F.regexp_replace(s, r"\b(?:[0-9][A-Z]{2,4}|[0-9]{2}[A-Z]{2,3}|[0-9][A-Z]{2,3}[0-9])\b", "")
    s = F.regexp_replace(s, r"\b(?:(?:[A-Z]{2,4}[0-9]|[A-Z]{2,3}[0-9]{2})\b(?!\s?[0-9]+\b)|[A-Z]{2}[0-9]\s[0-9]\b)", "")
    tokens = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    spaced = (F.size(tokens) >= 2) & (F.size(F.filter(tokens, lambda w: F.length(w) <= 2)) >= 0.6 * F.size(tokens))
    s = F.when(spaced, s).otherwise(F.regexp_replace(s, r"(?<![\p{L}\p{N}]\s{0,20})\b[A-Z]\b(?!\s*[\p{L}\p{N}_])", ""))
    for pattern in (r"\b[a-z]{1,2}\s*[,)(]\s*[a-z0-9\s,)(]{5,}\b", r"^[A-Za-z]*[0-9]+/(?=[A-Za-z])", r"\b[A-Z]{1,2}\s+[0-9][A-Z]+\b", r"^\s*/\s*"):
        s = F.regexp_replace(s, pattern, "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"^[^\p{L}\p{N}_\s(\[{#$]+|[^\p{L}\p{N}_\s)}\].,:\-%]+$", "")
    return F.when(F.trim(c) == "", c).otherwise(s)


# What is taken out of a line or protected from it, as patterns and tokens.
GARBAGE_TOKENS = r"(?i)\b(VERIFIEO|Nane|Empioyee|OSV|Wuy)\b"
LABEL_PREFIXES = (r"^[fF](ua)?\s*/\s*(?=[A-Z])", r"^[aA]\s*/\s*(?=[A-Z][a-z]{2,})", r"^[a-z]\s+(?=[A-Z][a-z]{2,})")
SCRIPT_PREFIX = r"^[0-9]{1,3}[A-Z]{2,4}\s+(?=[A-Z][a-z])"
PROTECTED = (
    r"(?i)\b([A-Z]{5}\s?[0-9]{4}[A-Z]|[A-Z]{4}0[A-Z0-9]{6}|\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]|\d{4}/\d{5}/\d{5}|\d{2}/\d{2}/\d{4}|\d{1,5}/\d{1,5}|[A-Z]{2,}-\d+|VID:\d+|PIN\s*Code:\s*\d{6}"
    r"|[SD]/O:\s*[A-Za-z\s]+(?:Khatri|Singh|Kumar|Sharma|Patel|Gupta))\b"
)
PROTECTED_ACRONYMS = "AADHAAR PAN KYC VKYC IFSC NEFT RTGS GST HDFC ICICI UTI UIDAI DPI OCR VLM API S/O D/O W/O VTC PO PIN DOB DIST".split()


def sanitized(c: Column) -> Column:
    """SIM-08, SIM-09: struct<text, score, valid> of a line cleaned in four stages: characters, label noise, structure, judgement.

    Null and blank lines give '', 0 and false. The structural stage leaves lines with a protected pattern alone. The score starts at 1
    and is judged before the outer punctuation is taken off; a line of at least 0.4 is valid.
    """
    strip = lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(F.regexp_replace(c, CJK, ""), FOREIGN_SYMBOLS, "")
    s = F.regexp_replace(s, r"([a-zA-Z])\1{4,}", "$1$1")
    for prefix in LABEL_PREFIXES:
        s = F.regexp_replace(s, prefix, "")
    kept = F.filter(F.split(F.trim(s), r"\s+"), lambda w: ~w.rlike(GARBAGE_TOKENS) | F.upper(w).isin(PROTECTED_ACRONYMS))
    s = F.regexp_replace(F.array_join(kept, " "), SCRIPT_PREFIX, "")
    bare = F.regexp_replace(F.regexp_replace(s, r"^[A-Z]\s+$", ""), r"^\d{1,3}\s*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r",\s*,+", ""), r"^\s*,\s*", ""), r"\s*,\s*$", "")
    s = F.when(s.rlike(PROTECTED), s).otherwise(F.regexp_replace(strip(bare), r"\s*,\s*", ", "))
    t = F.trim(s)
    latin = F.regexp_replace(t, "[^a-zA-Z]", "")
    few = t.rlike("[a-zA-Z]{5,}") & (F.length(F.regexp_replace(latin, "[^aeiouyAEIOUY]", "")) < 0.10 * F.length(latin))
    score = 1.0 - F.when(F.length(t) == 1, 0.3).when(F.length(t) == 2, 0.1).otherwise(0.0) - F.when(few, 0.3).otherwise(0.0)
    score = F.when(F.upper(t).isin(PROTECTED_ACRONYMS) | t.rlike(PROTECTED), F.least(F.lit(1.0), score + 0.2)).otherwise(score)
    score = F.when((t == "") | t.rlike(ONLY_SYMBOLS) | ~t.rlike(SCRIPT), 0.0).otherwise(F.round(score, 3))
    text = F.trim(F.regexp_replace(strip(s), r"^[^\p{L}\p{N}_\s]+|[^\p{L}\p{N}_\s]+$", ""))
    blank = c.isNull() | (F.trim(c) == "")
    return F.struct(
        F.when(blank, "").otherwise(text).alias("text"), F.when(blank, 0.0).otherwise(score).alias("score"), F.when(blank, False).otherwise(score >= 0.4).alias("valid")
    )
