"""Record comparison: document fields against the system-of-record row of the same loan, in one plan for all loans.

The checks are a relation. A loan's documents become one map, so loans and documents meet in a single equi-join on the loan, one row
each; the checks are exploded beside it without a shuffle, and one CASE over the method compares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import normalise as fn
from attestra.functions.similarity import jaro_winkler, jaro_winkler_each, over_distinct, tfidf_cosine

#: Subnode, document, its field, the field of the loan's row, the method, further names of the field, whether a
#: missing value leaves no row, and the check's own id if it has one.
CHECKS = (
    ("check_kyc", "aadhaar", "applicant_name", "applicant_name", "jaro_winkler", "name full_name", False, None),
    ("check_kyc", "aadhaar", "fathers_name", "fathers_name", "jaro_winkler", "father_name", True, None),
    ("check_kyc", "aadhaar", "gender", "applicant_gender", "exact_string_ci", "applicant_gender", True, None),
    ("check_kyc", "aadhaar", "address", "current_address", "tfidf_cosine", "current_address address_text", False, None),
    ("check_kyc", "aadhaar", "aadhaar_number", "aadhaar_no", "masked_aadhaar", "aadhaar aadhaar_no uid", False, None),
    ("check_kyc", "aadhaar", "mobile_no", "applicant_mobile_no", "exact_string", "applicant_mobile_no mobile phone", False, None),
    ("check_kyc", "aadhaar", "dob", "applicant_dob", "exact_date", "applicant_dob date_of_birth", False, None),
    ("check_kyc", "pan", "applicant_name", "applicant_name", "jaro_winkler", "name full_name", False, None),
    ("check_kyc", "pan", "fathers_name", "fathers_name", "jaro_winkler", "father_name", False, None),
    ("check_kyc", "pan", "pan_number", "applicant_pan_number", "exact_id", "pan applicant_pan_number", False, None),
    ("check_kyc", "pan", "dob", "applicant_dob", "exact_date", "applicant_dob date_of_birth", False, None),
    ("check_kyc", "application_form", "applicant_name", "applicant_name", "jaro_winkler", "name", False, None),
    ("check_kyc", "application_form", "fathers_name", "fathers_name", "jaro_winkler", "father_name", False, None),
    ("check_kyc", "application_form", "dob", "applicant_dob", "exact_date", "applicant_dob date_of_birth", False, None),
    ("check_kyc", "application_form", "mobile_no", "applicant_mobile_no", "exact_string", "applicant_mobile_no mobile", False, None),
    ("check_kyc", "application_form", "gender", "applicant_gender", "exact_string_ci", "applicant_gender", False, None),
    ("check_kyc", "application_form", "pan_number", "applicant_pan_number", "exact_id", "pan applicant_pan_number", False, None),
    ("check_kyc", "aadhaar_xml", "aadhaar_number", "aadhaar_no", "masked_aadhaar", "aadhaar uid aadhaar_no", True, "chk_aadhaar_xml_aadhaar_no_vs_los"),
    ("check_financial", "application_form", "loan_amount", "loan_amount", "[exact_numeric]", "funding_amount amount", False, None),
    ("check_financial", "application_form", "loan_validity", "loan_validity", "tenure_months", "tenure tenure_months loan_tenure loan_term term validity", False, None),
    ("check_financial", "application_form", "account_no", "applicant_bank_account_no", "exact_id", "account_number applicant_bank_account_no bank_account_no", False, None),
    ("check_financial", "application_form", "type_of_account", "bank_account_type", "exact_string_ci", "bank_account_type account_type", False, None),
    ("check_financial", "application_form", "loan_type", "loan_type", "exact_string_ci", "", False, None),
    ("check_financial", "kfs", "loan_amount", "loan_amount", "exact_numeric", "funding_amount amount", False, None),
    ("check_financial", "kfs", "loan_validity", "loan_validity", "tenure_months", "tenure tenure_months loan_tenure loan_term term validity", False, None),
    ("check_financial", "kfs", "loan_type", "loan_type", "exact_string_ci", "", False, None),
    ("check_financial", "kfs", "irr_percent", "irr_percent", "exact_numeric", "irr roi interest_rate", False, None),
    ("check_financial", "kfs", "emi", "emi", "exact_numeric", "monthly_emi emi_amount", False, None),
    ("check_financial", "kfs", "bpi", "bpi_charges", "exact_numeric", "bpi_charges bpi_charge broken_period_interest BPI", True, None),
    ("check_financial", "kfs", "customer_consent", None, "presence_only", "consent is_consented", False, None),
    ("check_financial", "disbursal_memo", "loan_no", "loan_id", "exact_id", "loan_id loan_number application_id", False, None),
    ("check_financial", "disbursal_memo", "loan_amount", "loan_amount", "exact_numeric", "disbursal_amount amount", False, None),
    ("check_financial", "sanction_letter", "applicant_name", "applicant_name", "jaro_winkler", "name", False, None),
    ("check_financial", "sanction_letter", "loan_amount", "loan_amount", "exact_numeric", "funding_amount amount sanctioned_amount", False, None),
    ("check_financial", "sanction_letter", "loan_validity", "loan_validity", "tenure_months", "tenure tenure_months loan_tenure loan_term term validity", False, None),
    ("check_financial", "sanction_letter", "irr_percent", "irr_percent", "exact_numeric", "irr roi interest_rate", False, None),
    ("check_financial", "sanction_letter", "emi", "emi", "exact_numeric", "monthly_emi emi_amount", False, None),
    ("check_financial", "sanction_letter", "loan_type", "loan_type", "exact_string_ci", "", True, None),
    ("check_financial", "sanction_letter", "mobile_no", "applicant_mobile_no", "exact_string", "applicant_mobile_no mobile phone", True, None),
    ("check_financial", "sanction_letter", "address", "current_address", "tfidf_cosine", "current_address address_text", True, None),
    ("check_financial", "account_statement", "account_no", "applicant_bank_account_no", "exact_id", "account_number bank_account_no applicant_bank_account_no", False, None),
    ("check_financial", "account_statement", "applicant_name", "applicant_name", "jaro_winkler", "name account_holder_name", False, None),
    ("check_financial", "account_statement", "current_address", "current_address", "tfidf_cosine", "address address_text", True, None),
    ("check_loan_application", "application_form", "application_no", "loan_id", "exact_id", "application_id loan_id", False, None),
    ("check_loan_application", "kfs", "application_no", "loan_id", "exact_id", "application_id loan_id", False, None),
    ("check_loan_application", "sanction_letter", "application_no", "loan_id", "exact_id", "application_id loan_id", False, None),
    ("check_loan_application", "disbursal_memo", "loan_no", "loan_id", "exact_id", "loan_id loan_number application_id", False, None),
)
#: Further names of fields, after those of a check.
FIELD_ALIASES = {
    "loan_validity": "tenure tenure_months loan_tenure loan_term term validity",
    "loan_amount": "funding_amount amount sanctioned_amount disbursal_amount",
    "pan_number": "pan applicant_pan_number",
    "aadhaar_number": "aadhaar aadhaar_no uid",
    "applicant_name": "customer_name name full_name",
    "fathers_name": "father_name",
    "account_no": "bank_account_no account_number applicant_bank_account_no",
    "current_address": "address address_text permanent_address",
    "application_no": "application_id loan_id loan_no",
    "dob": "applicant_dob date_of_birth",
    "mobile_no": "applicant_mobile_no mobile phone",
}
#: The names under which a document may be filed, the first of them its canonical one.
DOCUMENT_ALIASES = {
    "aadhaar": "aadhaar kyc_address_proof aadhaar_card aadhar",
    "aadhaar_xml": "aadhaar_xml aadhaarxml xml_aadhaar",
    "pan": "pan kyc_pan pan_card",
    "application_form": "application_form loan_application application appform app_form",
    "account_statement": "account_statement bank_statement bank_account_statement bank_statement_6m",
    "kfs": "kfs key_fact_statement key_fact_statement_kfs",
    "sanction_letter": "sanction_letter sanction",
    "loan_agreement": "loan_agreement agreement",
    "disbursal_memo": "disbursal_memo disbursement_memo memo disbursalmemo",
    "vkyc": "vkyc vkyc_audit_trail vkyc_audit",
    "bt_details": "bt_details foreclosure_letter bt",
}
#: Fields that are compared as identity numbers or tenures whatever unknown method a check names.
MASKED_FIELDS, TENURE_FIELDS = ("aadhaar_number", "aadhaar_no", "aadhaar", "uid"), ("loan_validity", "tenure", "tenure_months", "loan_term", "term")
METHODS = ("jaro_winkler", "tfidf_cosine", "exact_id", "exact_date", "exact_string_ci", "exact_numeric", "threshold_90", "masked_aadhaar", "tenure_months", "presence_only", "exact_string")
#: The kind of match of a method; all others are exact_string.
MATCH_TYPES = {
    "jaro_winkler": "fuzzy", "tfidf_cosine": "fuzzy", "exact_id": "exact_id", "masked_aadhaar": "masked_id", "tenure_months": "tenure", "exact_date": "exact_date",
    "threshold_90": "threshold", "presence_only": "presence",
}
#: Similarity from which names and addresses match, and from which they match in part; ratio of amounts that are near enough.
MATCH_BAND, PARTIAL_BAND, NEAR_AMOUNT = 0.5, 0.4, 0.90
_CONSENT = ("true", "1", "yes", "y", "verified", "accepted", "consented")


def latest_rows(los: DataFrame) -> DataFrame:
    """SRC-02, DED-02: the newest row of each loan (ties: the larger row_id). Map-side combined, so copies of a loan are cheap."""
    rest = [c for c in los.columns if c != "loan_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col("loaded_at"), F.col("row_id")))
    return los.where(F.col("loan_id").isNotNull()).groupBy("loan_id").agg(best.alias("r")).select("loan_id", "r.*")


def latest_fields(fields: DataFrame) -> DataFrame:
    """One value per (loan, document, field): the last extracted (ties: the larger field_id)."""
    known = fields.where(F.col("loan_id").isNotNull() & F.col("doc_key").isNotNull() & F.col("field").isNotNull())
    best = F.max_by(F.struct("value", "kind"), F.struct("extracted_at", "field_id"))
    return known.groupBy("loan_id", "doc_key", "field").agg(best.alias("v")).select("loan_id", "doc_key", "field", "v.value", "v.kind")


def names_of(field: str | None, aliases: str) -> list[str]:
    """The names under which a field's value is looked for, in order: its own, the check's, then those of all checks."""
    return list(dict.fromkeys([field, *aliases.split(), *FIELD_ALIASES.get(field, "").split()])) if field else []


def effective(method: str, field: str) -> str:
    """The method that an unknown one falls back to: by the field's name, else equality of strings."""
    if method in METHODS:
        return method
    return "masked_aadhaar" if field in MASKED_FIELDS else "tenure_months" if field in TENURE_FIELDS else "exact_string"


def loan_documents(fields: DataFrame) -> DataFrame:
    """JN-02, FN-10: one row per loan: `docs`, the canonical names of its documents, and `m`, the value and kind under "document|field".

    Of several documents of one kind the one under the first of its names counts, whole. Null values are as absent.
    """
    alias = F.create_map(*[F.lit(x) for canon, names in DOCUMENT_ALIASES.items() for i, n in enumerate(names.split()) for x in (n, f"{i:02d}{canon}")])
    filed = latest_fields(fields).withColumn("_c", F.coalesce(F.try_element_at(alias, F.col("doc_key")), F.concat(F.lit("00"), "doc_key")))
    each = filed.groupBy("loan_id", F.substring("_c", 3, 100).alias("canon")).agg(
        F.min(F.substring("_c", 1, 2)).alias("first"), F.collect_list(F.struct(F.substring("_c", 1, 2).alias("rank"), "field", "value", "kind")).alias("fs")
    )
    kept = F.filter("fs", lambda x: (x["rank"] == F.col("first")) & x["value"].isNotNull())
    entries = F.transform(kept, lambda x: F.struct(F.concat_ws("|", "canon", x["field"]).alias("key"), F.struct(x["value"].alias("value"), x["kind"].alias("kind")).alias("value")))
    return each.select("loan_id", "canon", entries.alias("es")).groupBy("loan_id").agg(F.collect_list("canon").alias("docs"), F.map_from_entries(F.flatten(F.collect_list("es"))).alias("m"))


def tri_state(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), "MATCH").otherwise("MISMATCH")


def band(score: Column) -> Column:
    """CMP-01, CMP-02: the status of a similarity."""
    return F.when(score >= MATCH_BAND, "MATCH").when(score >= PARTIAL_BAND, "PARTIAL").otherwise("MISMATCH")


def present(value: Column, kind: Column) -> Column:
    """CMP-11: whether a value says yes; a number does if it is positive."""
    return F.when(kind == "number", value.try_cast("double") > 0).otherwise(F.lower(F.trim(value)).isin(*_CONSENT))


def likeness(method: Column, doc: Column, los: Column, score: Column | None = None) -> Column:
    """CMP-01, CMP-02, CMP-07: how near two values are by a method that asks for it, to four places; null for the others.

    score: the similarity of names, computed before; without it names are not compared.
    """
    a, b = fn.clean_numeric(doc), fn.clean_numeric(los)
    ratio = F.when((a <= 0) | (b <= 0), (a == b).cast("double")).otherwise(F.least(a, b) / F.greatest(a, b))
    named = F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)
    return F.when(method == "jaro_winkler", F.round(named, 4)).when(method == "tfidf_cosine", F.round(tfidf_cosine(los, doc), 4)).when(method == "threshold_90", ratio)


def _last4(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Of two cleaned identity numbers: whether one is masked, whether the last four digits agree, and whether one is these four alone."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    same = (F.length(digits(x)) >= 4) & (F.length(digits(y)) >= 4) & (F.right(digits(x), F.lit(4)) == F.right(digits(y), F.lit(4)))
    both12 = (F.length(digits(x)) == 12) & (F.length(digits(y)) == 12)
    return fn.is_masked(x) | fn.is_masked(y), same, same & ((F.length(x) == 4) | (F.length(y) == 4)) & ~both12


def status_of(method: Column, doc: Column, los: Column, near: Column, kind: Column | None = None) -> Column:
    """CMP-01 to CMP-13: the status of one check. A missing value gives NOT_FOUND, an unparsable number too. near: its likeness."""
    a, b = fn.clean_numeric(doc), fn.clean_numeric(los)
    x, y = fn.clean_aadhaar(doc), fn.clean_aadhaar(los)
    masked, last4, short = _last4(x, y)
    filled = (F.trim(doc) != "") & (F.trim(los) != "")
    return (
        F.when(method == "presence_only", tri_state(present(doc, kind if kind is not None else F.lit("string"))))
        .when(doc.isNull() | los.isNull(), "NOT_FOUND")
        .when(method.isin("jaro_winkler", "tfidf_cosine"), band(near))
        .when(method == "exact_id", tri_state(fn.clean_id(doc) == fn.clean_id(los)))
        .when(method == "exact_date", tri_state((fn.normalize_date(doc) == fn.normalize_date(los)) & (F.trim(doc) != "")))
        .when(method == "exact_string_ci", tri_state((F.lower(F.trim(doc)) == F.lower(F.trim(los))) & filled))
        .when(method == "exact_numeric", F.when(a.isNull() | b.isNull(), "NOT_FOUND").otherwise(tri_state(F.abs(a - b) < 0.01)))
        .when(method == "threshold_90", F.when(near.isNull(), "NOT_FOUND").otherwise(tri_state(near >= NEAR_AMOUNT)))
        .when(method == "masked_aadhaar", tri_state((x != "") & (y != "") & F.when(masked, last4).otherwise((x == y) | short)))
        .when(method == "tenure_months", tri_state(fn.tenure_months(doc) == fn.tenure_months(los)))
        .otherwise(tri_state((F.trim(doc) == F.trim(los)) & filled))
    )


def confidence_of(method: Column, doc: Column, los: Column, near: Column, status: Column) -> Column:
    """The confidence of a check's status: its likeness where the method has one, 0.95 for four digits against twelve, else 1 or 0."""
    x, y = fn.clean_aadhaar(doc), fn.clean_aadhaar(los)
    masked, _, short = _last4(x, y)
    return (
        F.when(status == "NOT_FOUND", 0.0)
        .when(method.isin("jaro_winkler", "tfidf_cosine"), near)
        .when(method == "threshold_90", F.round(F.least(F.lit(1.0), near), 4))
        .when((method == "masked_aadhaar") & short & ~masked & (x != y), 0.95)
        .otherwise((status == "MATCH").cast("double"))
    )


def compare(los: DataFrame, fields: DataFrame, checks: tuple = CHECKS) -> DataFrame:
    """JN-01: one row per loan and check: loan_id, check_id, subnode, doc_key, field, match_type, method, status, confidence, values.

    values: the value of the document (null for none) and that of the loan. Missing documents and values give NOT_FOUND, or no row where
    the check is optional. Repeated rows and restatements count once; documents of unknown loans give no rows; an empty table gives an
    empty result.
    """
    newest = latest_rows(los)
    columns = set(newest.columns)
    own = {f: names_of(f, "") for f in {c[3] for c in checks if c[3]}}
    needed = sorted({n for c in checks for n in names_of(c[3], c[5]) if n in columns} | set(own) & columns)
    of_los = F.map_from_arrays(F.array(*map(F.lit, needed)), F.array(*[F.col(c).cast("string") for c in needed]))
    base = newest.select("loan_id", of_los.alias("l")).join(loan_documents(fields), "loan_id", "left")
    value = lambda c: F.coalesce(*[F.try_element_at("m", F.lit(f"{c[1]}|{n}")) for n in names_of(c[2], c[5])])
    ours = lambda c: F.coalesce(F.lit(None), *[F.try_element_at("l", F.lit(n)) for n in names_of(c[3], c[5]) if n in columns])
    # Names are scored for a whole loan at once, before its checks are exploded.
    fuzzy = [i for i, c in enumerate(checks) if c[4] == "jaro_winkler"]
    pairs = F.array(*[F.struct(value(checks[i])["value"].alias("a"), ours(checks[i]).alias("b")) for i in fuzzy]) if fuzzy else F.array().cast("array<struct<a:string,b:string>>")
    scored = base.withColumn("scores", jaro_winkler_each(pairs))
    rows = F.array(*[
        F.struct(
            F.lit(c[7] or f"chk_{c[0]}_{c[1]}_{c[2]}_vs_los").alias("check_id"), F.lit(c[0]).alias("subnode"), F.lit(c[1]).alias("doc_key"), F.lit(c[2]).alias("field"),
            F.lit(MATCH_TYPES.get(c[4], "exact_string")).alias("match_type"), F.lit(c[4]).alias("method"), F.lit(effective(c[4], c[2])).alias("how"), F.lit(c[6]).alias("optional"), F.lit(c[3] is None).alias("alone"),
            F.array(*[F.lit(f"{c[1]}|{n}") for n in names_of(c[2], c[5])]).alias("doc_names"),
            F.array(*[F.lit(n) for n in names_of(c[3], c[5]) if n in columns]).cast("array<string>").alias("los_names"), F.lit(fuzzy.index(i) if i in fuzzy else None).cast("int").alias("at"),
        ) for i, c in enumerate(checks)
    ])
    first = lambda m, ns: F.try_element_at(F.array_compact(F.transform(ns, lambda n: F.try_element_at(m, n))), F.lit(1))
    each = scored.select("loan_id", "l", "m", "docs", "scores", F.explode(rows).alias("k")).select(
        "loan_id", "k.*", first(F.col("m"), F.col("k.doc_names")).alias("d"), first(F.col("l"), F.col("k.los_names")).alias("los_value"),
        F.get("scores", F.col("k.at")).alias("score"), F.coalesce(F.array_contains("docs", F.col("k.doc_key")), F.lit(False)).alias("filed"),
    )
    doc = F.col("d")["value"]
    missing = ~F.col("filed") | ~F.col("alone") & (doc.isNull() | F.col("los_value").isNull())
    how, own = F.col("how"), F.col("los_value")
    # Step by step, so that what the next step needs is computed once.
    each = each.withColumn("_doc", doc).withColumn("_near", likeness(how, F.col("_doc"), own, F.col("score")))
    status = F.when(missing, "NOT_FOUND").otherwise(status_of(how, F.col("_doc"), own, F.col("_near"), F.col("d")["kind"]))
    judged = each.where(~(missing & F.col("optional"))).withColumn("status", status)
    shown = F.when(how == "exact_id", F.array(fn.clean_id(F.col("_doc")), fn.clean_id(own))).otherwise(F.array("_doc", "los_value"))
    return judged.select(
        "loan_id", "check_id", "subnode", "doc_key", "field", "match_type", "method", "status", confidence_of(how, F.col("_doc"), own, F.col("_near"), F.col("status")).alias("confidence"),
        F.when(F.col("alone"), F.array("_doc")).when(missing, F.array("_doc", "los_value")).otherwise(shown).alias("values"),
    )


def document_value(fields: DataFrame, doc: str, *names: str) -> DataFrame:
    """(loan_id, v): the first value of a document's field under its names, as a number."""
    docs = loan_documents(fields.where(F.col("doc_key").isin(*DOCUMENT_ALIASES[doc].split()) & F.col("field").isin(*names)))
    value = F.coalesce(*[F.try_element_at("m", F.lit(f"{doc}|{n}")) for n in names])["value"]
    return docs.select("loan_id", fn.clean_numeric(value).alias("v"))


def signatures(fields: DataFrame, inspections: DataFrame) -> DataFrame:
    """CMP-15: the check of each loan's agreement: loan_id, check_id, subnode, doc_key, field, match_type, method, status, confidence, values.

    The last inspection of a loan decides: acceptable is MATCH 100, signed but not acceptable MISMATCH 0; else a flag in the agreement's
    own fields gives MATCH 85, an agreement without it MISMATCH 0. A loan without agreement and inspection has no row.
    """
    seen = inspections.where(F.col("loan_id").isNotNull() & F.col("pyhanko_inspection").isNotNull()).groupBy("loan_id").agg(
        F.max_by(F.struct("pyhanko_inspection.is_signed", "pyhanko_inspection.is_acceptable"), F.struct("inspected_at", "inspection_id")).alias("i")
    )
    agreements = loan_documents(fields.where(F.col("doc_key").isin(*DOCUMENT_ALIASES["loan_agreement"].split()))).select(
        "loan_id", F.lit(True).alias("filed"), F.try_element_at("m", F.lit("loan_agreement|loan_agreement_signed")).alias("flag")
    )
    both = seen.join(agreements, "loan_id", "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    flagged = F.coalesce((F.col("flag.kind") == "bool") & (F.lower("flag.value") == "true"), F.lit(False))
    confidence = F.when(yes("i.is_acceptable"), 100.0).when(yes("i.is_signed"), 0.0).when(flagged, 85.0).otherwise(0.0)
    return both.select(
        "loan_id", F.lit("chk_loan_agreement_digital_signature").alias("check_id"), F.lit("check_loan_application").alias("subnode"), F.lit("loan_agreement").alias("doc_key"),
        F.lit("digital_signature").alias("field"), F.lit("exact").alias("match_type"), F.lit("signature").alias("method"),
        F.when(confidence > 0, "MATCH").otherwise("MISMATCH").alias("status"), confidence.alias("confidence"), F.array().cast("array<string>").alias("values"),
    )


def adjudicated(records: DataFrame) -> DataFrame:
    """CMP-16: partial matches of names and addresses go to an adjudicator. The one that needs no model leaves them PARTIAL with 0.5."""
    open_ = (F.col("match_type") == "fuzzy") & (F.col("status") == "PARTIAL")
    return records.withColumn("confidence", F.when(open_, 0.5).otherwise(F.col("confidence"))).withColumn("llm_used", F.lit(False)).withColumn("adjudicated", open_)


#: Fields of a form against the loan's row: field, name in the row, weight, how (CMP-21).
FORM = (
    ("applicant_name", "applicant_name", 3.0, "text"), ("application_no", "loan_id", 1.0, "text"), ("fathers_name", "fathers_name", 1.0, "text"), ("dob", "applicant_dob", 3.0, "date"),
    ("gender", "applicant_gender", 1.0, "text"), ("mobile_no", "applicant_mobile_no", 1.0, "mobile"), ("pan_number", "applicant_pan_number", 3.0, "text"), ("account_no", "applicant_bank_account_no", 2.0, "text"),
    ("type_of_account", "bank_account_type", 1.0, "text"), ("loan_type", "loan_type", 1.0, "text"), ("loan_amount", "loan_amount", 2.0, "number"), ("loan_validity", "tenure", 2.0, "number"),
)


def form_score(los: DataFrame, fields: DataFrame) -> DataFrame:
    """CMP-21: per loan with an application form the weighted share of its fields that agree with the loan's row, in percent.

    Weighed are fields that the row has; one that the form lacks earns nothing. Mobile numbers agree in their last ten digits, dates as
    days, amounts and tenures as numbers, all else if either text holds the other.
    """
    docs = loan_documents(fields.where(F.col("doc_key").isin(*DOCUMENT_ALIASES["application_form"].split())))
    both = latest_rows(los).join(docs, "loan_id")
    bare = lambda c: F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("")))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    earned, total, n, hits = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0)
    for field, row, weight, how in FORM:
        x = F.coalesce(*[F.try_element_at("m", F.lit(f"application_form|{a}")) for a in names_of(field, "")])["value"]
        y = F.col(row).cast("string")
        same = bare(x) == bare(y)
        if how == "mobile":
            same = F.when((F.length(digits(x)) >= 10) & (F.length(digits(y)) >= 10), F.right(digits(x), F.lit(10)) == F.right(digits(y), F.lit(10))).otherwise(same)
        elif how == "date":
            same = fn.normalize_date(x) == fn.normalize_date(y)
        elif how == "number":
            same = F.coalesce(fn.clean_numeric(x), F.lit(0.0)) == F.coalesce(fn.clean_numeric(y), F.lit(0.0))
        else:
            same = same | F.contains(bare(x), bare(y)) | F.contains(bare(y), bare(x))
        hit = F.coalesce(same & y.isNotNull(), F.lit(False)).cast("int")
        earned, total = earned + hit * weight, total + y.isNotNull().cast("int") * weight
        n, hits = n + y.isNotNull().cast("int"), hits + hit
    score = F.when(total > 0, F.round(earned / total * 100, 1)).otherwise(0.0)
    return both.select("loan_id", n.alias("n_fields"), hits.alias("n_matched"), score.alias("match_score"))


#: The subnodes, each of which every loan has a rollup of.
SUBNODES = ("check_kyc", "check_financial", "check_loan_application")


def rollup(records: DataFrame, *by: str) -> DataFrame:
    """AGG-01, AGG-03: per loan (and `by`) the counts by status and the tri-state result; a mismatch outweighs what is missing or partial."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = records.groupBy("loan_id", *by).agg(
        n("MATCH").alias("n_match"), n("PARTIAL").alias("n_partial"), n("MISMATCH").alias("n_mismatch"), n("NOT_FOUND").alias("n_not_found"), F.count(F.lit(1)).alias("n_total")
    )
    state = F.when(F.col("n_mismatch") > 0, "Discrepancy").when(F.col("n_match") < F.col("n_total"), "Indeterminate").otherwise("Verified")
    return counted.withColumn("rollup", state)


def subnode_rollups(records: DataFrame, los: DataFrame) -> DataFrame:
    """AGG-01, AGG-02: a row for each loan and subnode; without any record it is Indeterminate."""
    loans = los.where(F.col("loan_id").isNotNull()).select("loan_id").distinct().select("loan_id", F.explode(F.array(*map(F.lit, SUBNODES))).alias("subnode"))
    known = rollup(records, "subnode").select("loan_id", "subnode", "n_total", "rollup")
    return loans.join(known, ["loan_id", "subnode"], "left").select("loan_id", "subnode", F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("rollup", F.lit("Indeterminate")).alias("rollup"))


def compare_names(los: DataFrame, fields: DataFrame) -> DataFrame:
    """CMP-01: names on pan documents against the loan's, by bands of Jaro-Winkler similarity; one UDF call per distinct pair."""
    card = latest_fields(fields.where((F.col("doc_key") == "pan") & (F.col("field") == "applicant_name")))
    pairs = latest_rows(los).select("loan_id", F.col("applicant_name").alias("a")).join(card.select("loan_id", F.col("value").alias("b")), "loan_id")
    scored = over_distinct(pairs, "a", "b", jaro_winkler, "score")
    s = F.coalesce(F.when((F.trim("a") != "") & (F.trim("b") != ""), F.col("score")), F.lit(0.0))
    band = F.when(s >= MATCH_BAND, "MATCH").when(s >= PARTIAL_BAND, "PARTIAL").otherwise("MISMATCH")
    return scored.select("loan_id", F.round(s, 6).alias("score"), band.alias("status"))


def tolerance(left: DataFrame, right: DataFrame, share: float = 0.10) -> DataFrame:
    """CMP-14, JN-03: two documents' amounts (loan_id, v) of each loan; a full outer join, with status and confidence.

    One missing: NOT_FOUND; both missing: no row; largest amount 0: MATCH; else MATCH within the share of the larger.
    """
    both = left.select("loan_id", F.col("v").alias("a")).join(right.select("loan_id", F.col("v").alias("b")), "loan_id", "full_outer")
    top = F.greatest(F.abs("a"), F.abs("b"))
    confidence = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(top == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("a") - F.col("b")) / top), 4))
    status = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "NOT_FOUND").when(top == 0, "MATCH").when(F.abs(F.col("a") - F.col("b")) / top <= share, "MATCH").otherwise("MISMATCH")
    )
    return both.where(F.col("a").isNotNull() | F.col("b").isNotNull()).select("loan_id", status.alias("status"), confidence.alias("confidence"))


def tier_merge(fields: DataFrame) -> DataFrame:
    """SRC-10: two runs of a document merged: the later run's value, filled from the one before where it is null.

    One full outer join on (loan, document, field) of the last and the last but one value.
    """
    known = fields.where(F.col("loan_id").isNotNull() & F.col("doc_key").isNotNull() & F.col("field").isNotNull())
    order = F.struct("extracted_at", "field_id")
    top = known.groupBy("loan_id", "doc_key", "field").agg(
        F.max_by("value", order).alias("newest"), F.max_by("value", F.when(F.col("value").isNotNull(), order)).alias("filled"), F.count(F.lit(1)).alias("runs")
    )
    return top.select("loan_id", "doc_key", "field", F.coalesce("newest", "filled").alias("value"), "runs")
