"""Scalar normalisers as Column expressions. All of them give null for null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The notations of dates, tried in this order; the first that parses counts.
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "ddMMyyyy", "yyyyMMdd")


def clean_numeric(c: Column) -> Column:
    """FN-01: the number in a text, from its digits and dots alone (so a sign is lost); null where they are no number."""
    return F.regexp_replace(c.cast("string"), "[^0-9.]", "").try_cast("double")


def clean_id(c: Column) -> Column:
    """FN-02: an identifier without white space, in capitals; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(c, r"\s+", "")), F.lit(""))


def clean_string(c: Column) -> Column:
    """FN-03: trimmed text; '' for null."""
    return F.trim(F.coalesce(c, F.lit("")))


def normalize_date(c: Column) -> Column:
    """FN-04: ISO day by the first of DATE_FORMATS that parses, else the lower-case text."""
    s = F.trim(c)
    # The guard keeps the parser from formats that the text cannot have.
    shapes = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$",
              r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", r"^\d{8}$", r"^\d{8}$")
    tried = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(f)).cast("date")) for f, shape in zip(DATE_FORMATS, shapes)]
    return F.coalesce(F.date_format(F.coalesce(*tried), "yyyy-MM-dd"), F.lower(s))


def clean_aadhaar(c: Column) -> Column:
    """FN-05: an identity number without separators, in capitals."""
    return F.upper(F.regexp_replace(c, r"[\s\-_.]", ""))


def is_masked(c: Column) -> Column:
    """FN-06: whether some characters are masked."""
    return F.upper(c).rlike("[X*•]")


def mask_aadhaar(c: Column) -> Column:
    """FN-07: all but the last four digits masked; null for fewer than four digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("XXXXXXXX"), F.right(digits, F.lit(4))))


def tenure_months(c: Column) -> Column:
    """FN-08: months of a tenure: years times twelve if the text is a number of years, else its first integer; null if not positive."""
    s = F.lower(F.trim(c.cast("string")))
    years = F.regexp_extract(s, r"^(\d+(\.\d+)?)\s*(years|year|yrs|yr|ys|y)$", 1)
    months = F.when(years != "", F.bround(years.try_cast("double") * 12).cast("int")).otherwise(F.regexp_extract(s, r"(\d+)", 1).try_cast("int"))
    return F.when(months > 0, months)


def alnum(c: Column) -> Column:
    """FN-23, SIM-17: lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def rupees(c: Column) -> Column:
    """FN-16: a whole amount with separators of thousands."""
    return F.concat(F.lit("₹"), F.format_number(c.cast("bigint"), 0))


def clock_12h(ts: Column) -> Column:
    """FN-18: time of day in the fixed zone +05:30, twelve-hour, lower case."""
    return F.lower(F.date_format(ts + F.expr("interval '5:30' hour to minute"), "h:mm a"))


def duration_text(seconds: Column) -> Column:
    """FN-22: "3m 07s", or "7s" below a minute."""
    s = seconds.cast("int")
    return F.when(s >= 60, F.format_string("%dm %02ds", (s / 60).cast("int"), s % 60)).otherwise(F.format_string("%ds", s))


def tenure_text(c: Column) -> Column:
    """FN-17: a tenure with its unit once: "12" and "12 month months" are "12 Months". Null, blank and none are "N/A"."""
    s = F.trim(c.cast("string"))
    with_unit = F.trim(F.regexp_replace(s, r"(?i)(\s*\bmonths?\b)+", " Months"))
    return F.when(s.isNull() | F.lower(s).isin("", "none", "null", "n/a"), "N/A").when(F.lower(s).contains("month"), with_unit).otherwise(F.concat(s, F.lit(" Months")))


def mask_pii(c: Column) -> Column:
    """FN-24: identity numbers, tax numbers and numbers of 10 to 18 digits masked but for their last characters, in this order."""
    s = F.regexp_replace(c, r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?([0-9]{4})\b", "XXXX-XXXX-$1")
    s = F.regexp_replace(s, r"\b[A-Z]{5}([0-9]{4}[A-Z])\b", "XXXXX$1")
    for n in range(10, 19):
        s = F.regexp_replace(s, rf"\b[0-9]{{{n - 4}}}([0-9]{{4}})\b", "X" * (n - 4) + "$1")
    return s


def redact_log(c: Column) -> Column:
    """FN-25: identity numbers, tax numbers and secrets of a log line replaced, in this order."""
    s = F.regexp_replace(c, r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", "[REDACTED-AADHAAR]")
    s = F.regexp_replace(s, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[REDACTED-PAN]")
    return F.regexp_replace(s, r"(?i)(api_key|secret|password|token)\s*=\s*['\"]?[a-zA-Z0-9_-]+['\"]?", "$1=[REDACTED-SECRET]")


def json_response(c: Column) -> Column:
    """FN-26: the JSON inside a model's answer: without reasoning, from a fenced block or else the outermost object or array."""
    s = F.trim(F.regexp_replace(F.trim(c), r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*\}|\[.*\])\s*```", 1)
    outer = F.regexp_extract(s, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "{}").when(fenced != "", F.trim(fenced)).when(outer != "", F.trim(outer)).otherwise(s)


def provider(model: Column, key: Column, url: Column) -> Column:
    """FN-27: who serves a model, by its address, key and name, in this order."""
    m, k, u = F.lower(F.coalesce(model, F.lit(""))), F.coalesce(key, F.lit("")), F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(u.contains("groq.com") | k.startswith("gsk_") | m.startswith("groq/"), "groq")
        .when(u.contains("openrouter.ai") | k.startswith("sk-or-"), "openrouter")
        .when(k.startswith("AQ.") | k.startswith("AIza") | m.contains("gemini"), "gemini")
        .when(u != "", "openai_compatible")
        .when(m.contains("/"), "openrouter")
        .otherwise("openai_compatible")
    )


def doc_name(c: Column) -> Column:
    """FN-14: a document name in lower case without generated ids and the kind's own prefix, with one spelling of it."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^doc-[a-z0-9_-]+_", "")
    s = F.regexp_replace(s, r"^(aadhaar|aadhar|adhar)[_\s-]+", "")
    return F.replace(F.replace(s, F.lit("aadhaar"), F.lit("aadhar")), F.lit("adhar"), F.lit("aadhar"))


#: What documents are called in reports.
DISPLAY_NAMES = {
    "aadhaar": "Aadhaar", "aadhaar_xml": "Aadhaar XML", "pan": "PAN Card", "application_form": "Application Form", "account_statement": "Bank Statement", "kfs": "Key Fact Statement (KFS)",
    "sanction_letter": "Sanction Letter", "loan_agreement": "Loan Agreement", "disbursal_memo": "Disbursal Memo", "vkyc": "VKYC Audit Trail", "bt_details": "BT Foreclosure Details",
}


def canonical_type(c: Column, aliases: dict[str, str]) -> Column:
    """FN-11: the kind of document that a file name or key says: by alias, as it is, without its case prefix or with underscores, then by words in it.

    aliases: canonical name to its aliases, blank-separated. Nothing gives "miscellaneous", an unknown name itself.
    """
    named = F.create_map(*[F.lit(x) for canon, names in aliases.items() for n in names.split() for x in (n, canon)])

    def read(x: Column) -> Column:
        stem, bare = x["stem"], x["bare"]
        has = lambda *ws: F.greatest(*[stem.contains(w) for w in ws], F.lit(False))
        by_word = (
            F.when(stem.contains("xml") & has("aadhaar", "aadhar"), "aadhaar_xml")
            .when(has("aadhaar", "aadhar"), "aadhaar")
            .when(stem.contains("kfs") | stem.contains("key") & stem.contains("fact"), "kfs")
            .when(stem.contains("sanction"), "sanction_letter")
            .when(stem.contains("agreement"), "loan_agreement")
            .when(has("memo", "disbursal"), "disbursal_memo")
            .when(has("statement", "bank"), "account_statement")
            .when(stem.contains("vkyc"), "vkyc")
            .when(has("bt", "foreclosure"), "bt_details")
            .when(stem.contains("pan"), "pan")
            .when(stem.contains("application") | bare.rlike(r"(?:^|_)app(?:lication)?(?:_|$)"), "application_form")
            .otherwise(stem)
        )
        return F.coalesce(*[F.try_element_at(named, y) for y in (stem, bare, F.replace(stem, F.lit(" "), F.lit("_")))], by_word)

    stem = F.trim(F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/]+)/*$", 1), r"(.)\.[^.]*$", "$1")))
    cut = lambda s: F.struct(s.alias("stem"), F.regexp_replace(s, r"^(?:appl\d+|loan_\d+|[a-z0-9]+)_(.+)$", "$1").alias("bare"))
    return F.when(F.coalesce(c, F.lit("")) == "", "miscellaneous").otherwise(let(let(stem, cut), read))


def display_name(canonical: Column) -> Column:
    """FN-12: what a kind of document is called; an unknown one by its own name in title case."""
    named = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, canonical), F.initcap(F.replace(canonical, F.lit("_"), F.lit(" "))))


def layout_profile(kind: Column, scanned: Column) -> Column:
    """FN-31: how a document is to be read, by its kind and, where known, by whether it is a scan."""
    return (
        F.when(kind.isin("aadhaar", "pan", "pan_card", "dl", "driving_license", "voter_id", "passport"), "identity_document")
        .when(kind == "application_form", F.when(F.coalesce(scanned, F.lit(False)), "scanned_character_box_forms").otherwise("character_box_forms"))
        .when(scanned, "scanned_documents")
        .when(~scanned, "digital_pdf")
        .when(kind.isin("bank_statement", "salary_slip"), "scanned_documents")
        .when(kind.isin("loan_agreement", "sanction_letter", "nach_mandate"), "digital_pdf")
        .otherwise("mixed_content")
    )


#: Fields with a form: least and most characters, pattern and the kinds of characters that may occur.
FIELD_FORMS = {
    "application_no": (10, 15, r"^[A-Z0-9\-_/]{10,15}$", "upper digit symbol"),
    "bank_account_no": (9, 18, r"^[0-9]{9,18}$", "digit"),
    "aadhaar_number": (12, 12, r"^[0-9]{12}$", "digit"),
    "pan_number": (10, 10, r"^[A-Z]{5}[0-9]{4}[A-Z]$", "upper digit"),
    "loan_amount": (5, 10, r"^[0-9]{5,10}$", "digit"),
    "mobile_no": (10, 10, r"^[0-9]{10}$", "digit"),
    "ifsc_code": (11, 11, r"^[A-Z]{4}0[A-Z0-9]{6}$", "upper digit"),
}


def field_form(field: Column, value: Column, boxed: Column) -> Column:
    """FN-32: struct<valid, confidence, strict_valid, strict_confidence> of a field's value.

    Blank values are not valid; fields without a form are, with 0.8. A length outside of a range costs 0.7, other than an exact one 0.6,
    a pattern that does not match 0.5, unexpected kinds of characters 0.8; `boxed` (read character by character) earns 1.1.
    Strictly, a wrong length gives 0.3 and a wrong pattern 0.4 at once.
    """
    kinds = {"upper": r"\p{Lu}", "lower": r"\p{Ll}", "digit": r"\p{Nd}", "symbol": r"[^\p{L}\p{N}]"}
    other = lambda allowed: "|".join(p for k, p in kinds.items() if k not in allowed.split())
    forms = F.create_map(*[x for f, (lo, hi, pattern, allowed) in FIELD_FORMS.items() for x in (F.lit(f), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(pattern).alias("pattern"), F.lit(other(allowed)).alias("other")))])

    def tested(x: Column) -> Column:
        k = x["form"]
        return F.struct(x["v"].alias("v"), k.isNotNull().alias("known"), (k["lo"] == k["hi"]).alias("exact"), F.length(x["v"]).between(k["lo"], k["hi"]).alias("fits"),
                        F.rlike(x["v"], k["pattern"]).alias("matches"), F.rlike(x["v"], k["other"]).alias("other"))

    def weighed(x: Column) -> Column:
        c = F.when(x["fits"], 1.0).when(x["exact"], 0.6).otherwise(0.7) * F.when(x["matches"], 1.0).otherwise(0.5) * F.when(x["other"], 0.8).otherwise(1.0)
        return F.struct(x.alias("x"), F.when(boxed, F.least(F.lit(1.0), c * 1.1)).otherwise(c).alias("c"))

    def judged(y: Column) -> Column:
        x, c = y["x"], y["c"]
        blank, free = F.coalesce(x["v"], F.lit("")) == "", ~x["known"]
        valid = F.when(blank, False).when(free, True).otherwise((c >= 0.5) & x["matches"])
        sure = F.when(blank, 0.0).when(free, 0.8).otherwise(c)
        wrong = ~blank & ~free & (~x["fits"] | ~x["matches"])
        return F.struct(
            valid.alias("valid"), F.round(sure, 3).alias("confidence"), F.when(wrong, False).otherwise(valid).alias("strict_valid"),
            F.round(F.when(wrong, F.when(~x["fits"], 0.3).otherwise(0.4)).otherwise(sure), 3).alias("strict_confidence"),
        )

    return let(let(let(F.struct(F.trim(value).alias("v"), F.try_element_at(forms, field).alias("form")), tested), weighed), judged)


#: The template of a document's fields, each with the names under which it may come, in order.
TEMPLATE = {
    "applicant_name": "customer_name borrower_name full_name name", "fathers_name": "", "dob": "", "mobile_no": "", "gender": "", "aadhaar_number": "aadhaar", "pan_number": "pan", "address": "address_text",
    "current_address": "", "bank_account_no": "account_no", "type_of_account": "", "loan_amount": "sanctioned_amount funding_amount disbursal_amount requested_loan_amount",
    "loan_validity": "tenure_months tenure tenor tenure_of_loan", "loan_type": "type_of_loan end_use purpose_of_loan", "application_no": "loan_no loan_account_no application_id loan_id appl_no los_id",
    "application_date": "", "BPI": "bpi broken_period_interest", "irr_percent": "roi interest_rate irr", "emi": "", "customer_consent": "consent is_consented otp_consent borrower_consent customer_acceptance",
}


def template(m: Column) -> dict[str, Column]:
    """FN-28: the fields of the template from a map of names to values; customer_consent is true for any value that says so, else false."""
    out = {f: F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in (f, *names.split())]) for f, names in TEMPLATE.items()}
    out["customer_consent"] = F.coalesce(~F.lower(out["customer_consent"]).isin("", "false", "0", "0.0"), F.lit(False))
    return out


def key_value(c: Column) -> Column:
    """FN-37: struct<key, value> of a "key: value" or "key = value" line, split at the first delimiter, a colon preferred."""
    at = F.when(F.instr(c, ":") > 0, F.lit(":")).when(F.instr(c, "=") > 0, F.lit("="))
    pos = F.when(F.instr(c, ":") > 0, F.instr(c, ":")).otherwise(F.instr(c, "="))
    return F.when(at.isNotNull(), F.struct(F.trim(F.substr(c, F.lit(1), pos - 1)).alias("key"), F.trim(F.substr(c, pos + 1)).alias("value")))
