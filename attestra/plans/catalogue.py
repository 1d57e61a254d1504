"""All queries of the record-reconciliation operators, each with the same in DuckDB's SQL where SQL can say it.

A query runs over its whole tables. Statements that several queries share are named once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import geometry as geo
from attestra.functions import normalise as fn
from attestra.functions import similarity as sim
from attestra.operators import layout, records, state
from attestra.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- shared SQL -------------------------------------------------------------------------------------------------------

LATEST_LOS = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) rn FROM los WHERE loan_id IS NOT NULL) WHERE rn = 1)"
LATEST_FIELDS = (
    "(SELECT loan_id, doc_key, field, value, kind FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, doc_key, field ORDER BY extracted_at DESC NULLS LAST, field_id DESC) rn "
    "FROM doc_fields WHERE loan_id IS NOT NULL AND doc_key IS NOT NULL AND field IS NOT NULL) WHERE rn = 1)"
)


def _num(x: str) -> str:
    return f"TRY_CAST(regexp_replace(CAST({x} AS VARCHAR), '[^0-9.]', '', 'g') AS DOUBLE)"


def _date(x: str) -> str:
    shapes = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "%d %B %Y"), (r"^\d{8}$", "%d%m%Y"), (r"^\d{8}$", "%Y%m%d"),
    )
    tried = ", ".join(f"CASE WHEN regexp_matches(trim({x}), '{s}') THEN try_strptime(trim({x}), '{f}') END" for s, f in shapes)
    return f"coalesce(strftime(coalesce({tried}), '%Y-%m-%d'), lower(trim({x})))"


def _tenure(x: str) -> str:
    s = f"lower(trim(CAST({x} AS VARCHAR)))"
    years = f"regexp_extract({s}, '^(\\d+(\\.\\d+)?)\\s*(years|year|yrs|yr|ys|y)$', 1)"
    months = f"CASE WHEN {years} <> '' THEN CAST(round_even(TRY_CAST({years} AS DOUBLE) * 12, 0) AS INTEGER) ELSE TRY_CAST(nullif(regexp_extract({s}, '(\\d+)', 1), '') AS INTEGER) END"
    return f"(CASE WHEN ({months}) > 0 THEN ({months}) END)"


def _id(x: str) -> str:
    return f"nullif(upper(regexp_replace({x}, '\\s+', '', 'g')), '')"


def _aadhaar(x: str) -> str:
    return f"upper(regexp_replace({x}, '[\\s\\-_.]', '', 'g'))"


def add(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


# --- functions --------------------------------------------------------------------------------------------------------


@add(f"SELECT field_id, {_num('value')} AS amount FROM doc_fields WHERE field IN ('loan_amount', 'emi', 'disbursal_amount')")
def fn_clean_numeric(spark: SparkSession, d: str) -> DataFrame:
    """FN-01, FN-15."""
    f = table(spark, d, "doc_fields").where(F.col("field").isin("loan_amount", "emi", "disbursal_amount"))
    return f.select("field_id", fn.clean_numeric(F.col("value")).alias("amount"))


@add(f"SELECT row_id, {_id('applicant_pan_number')} AS pan, trim(coalesce(applicant_name, '')) AS name, regexp_replace(lower(applicant_name), '[^a-z0-9]', '', 'g') AS compact FROM los")
def fn_clean_id(spark: SparkSession, d: str) -> DataFrame:
    """FN-02, FN-03, FN-23, SIM-17."""
    name = F.col("applicant_name")
    return table(spark, d, "los").select("row_id", fn.clean_id(F.col("applicant_pan_number")).alias("pan"), fn.clean_string(name).alias("name"), fn.alnum(name).alias("compact"))


@add(f"SELECT row_id, {_date('applicant_dob')} AS dob, {_date('application_date')} AS applied FROM los")
def fn_normalize_date(spark: SparkSession, d: str) -> DataFrame:
    """FN-04, FN-19."""
    return table(spark, d, "los").select("row_id", fn.normalize_date(F.col("applicant_dob")).alias("dob"), fn.normalize_date(F.col("application_date")).alias("applied"))


@add(
    f"SELECT row_id, {_aadhaar('aadhaar_no')} AS clean, regexp_matches(upper(aadhaar_no), '[X*•]') AS masked, "
    "CASE WHEN length(regexp_replace(aadhaar_no, '[^0-9]', '', 'g')) >= 4 THEN 'XXXXXXXX' || right(regexp_replace(aadhaar_no, '[^0-9]', '', 'g'), 4) END AS mask FROM los"
)
def fn_aadhaar(spark: SparkSession, d: str) -> DataFrame:
    """FN-05, FN-06, FN-07."""
    c = F.col("aadhaar_no")
    return table(spark, d, "los").select("row_id", fn.clean_aadhaar(c).alias("clean"), fn.is_masked(c).alias("masked"), fn.mask_aadhaar(c).alias("mask"))


@add(f"SELECT row_id, {_tenure('loan_validity')} AS months FROM los")
def fn_tenure(spark: SparkSession, d: str) -> DataFrame:
    """FN-08."""
    return table(spark, d, "los").select("row_id", fn.tenure_months(F.col("loan_validity")).alias("months"))


@add(
    f"SELECT loan_id, doc_key, coalesce(max(CASE WHEN field = 'application_no' THEN value END), max(CASE WHEN field = 'loan_no' THEN value END), max(CASE WHEN field = 'application_id' THEN value END)) AS application "
    f"FROM {LATEST_FIELDS} GROUP BY loan_id, doc_key"
)
def fn_aliases(spark: SparkSession, d: str) -> DataFrame:
    """FN-09, FN-10, JN-02: a field under the first of its names that has a value."""
    f = records.latest_fields(table(spark, d, "doc_fields"))
    of = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
    return f.groupBy("loan_id", "doc_key").agg(F.coalesce(of("application_no"), of("loan_no"), of("application_id")).alias("application"))


_TYPES = "CASE doc_key WHEN 'kyc_pan' THEN 'pan' WHEN 'kyc_address_proof' THEN 'aadhaar' WHEN 'policy_note' THEN 'other' WHEN 'field_report' THEN 'other' WHEN 'complaint_mail' THEN 'other' ELSE doc_key END"


@add("SELECT row_id, '₹' || format('{:,}', CAST(floor(loan_amount) AS BIGINT)) AS shown FROM los WHERE loan_amount IS NOT NULL")
def fn_rupees(spark: SparkSession, d: str) -> DataFrame:
    """FN-16."""
    return table(spark, d, "los").where("loan_amount IS NOT NULL").select("row_id", fn.rupees(F.floor("loan_amount")).alias("shown"))


@add(
    "SELECT audit_id, lower(strftime(event_ts + INTERVAL 330 MINUTE, '%-I:%M %p')) AS clock, strftime(event_ts + INTERVAL 330 MINUTE, '%d/%m/%Y') AS day, "
    "CASE WHEN s >= 60 THEN printf('%dm %02ds', CAST(floor(s / 60) AS INTEGER), CAST(s % 60 AS INTEGER)) ELSE printf('%ds', CAST(s AS INTEGER)) END AS took "
    "FROM (SELECT *, greatest(0, CAST(epoch(date_trunc('second', ingested_at)) AS BIGINT) - CAST(epoch(date_trunc('second', event_ts)) AS BIGINT)) AS s FROM audit_log) WHERE event_ts IS NOT NULL AND ingested_at IS NOT NULL"
)
def fn_clock(spark: SparkSession, d: str) -> DataFrame:
    """FN-18, FN-19, FN-20, FN-21, FN-22."""
    a = table(spark, d, "audit_log").where("event_ts IS NOT NULL AND ingested_at IS NOT NULL")
    unix = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    s = F.greatest(F.lit(0), unix("ingested_at") - unix("event_ts"))
    day = F.date_format(F.col("event_ts") + F.expr("interval '5:30' hour to minute"), "dd/MM/yyyy")
    return a.select("audit_id", fn.clock_12h(F.col("event_ts")).alias("clock"), day.alias("day"), fn.duration_text(s).alias("took"))


@add("SELECT 'APPL' || lpad(CAST(max(TRY_CAST(nullif(regexp_extract(loan_id, '(\\d+)$', 1), '') AS BIGINT)) + 1 AS VARCHAR), 8, '0') AS next_id FROM los")
def fn_next_id(spark: SparkSession, d: str) -> DataFrame:
    """FN-35."""
    n = F.max(F.regexp_extract("loan_id", r"(\d+)$", 1).try_cast("bigint")) + 1
    return table(spark, d, "los").agg(F.concat(F.lit("APPL"), F.lpad(n.cast("string"), 8, "0")).alias("next_id"))


@add(
    "SELECT extraction_id, line, trim(substr(s, 1, p - 1)) AS key, trim(substr(s, p + 1)) AS value FROM (SELECT extraction_id, CAST(i - 1 AS INTEGER) AS line, a[i] AS s, "
    "CASE WHEN instr(a[i], ':') > 0 THEN instr(a[i], ':') ELSE instr(a[i], '=') END AS p FROM (SELECT extraction_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT extraction_id, string_split(_formatted_text, chr(10)) AS a FROM extractions))) WHERE p > 0"
)
def fn_key_value(spark: SparkSession, d: str) -> DataFrame:
    """FN-37, FLT-13: lines of the form key: value."""
    lines = table(spark, d, "extractions").select("extraction_id", F.posexplode(F.split("_formatted_text", "\n")).alias("line", "s"))
    return lines.select("extraction_id", "line", fn.key_value(F.col("s")).alias("x")).where("x IS NOT NULL").select("extraction_id", "line", "x.key", "x.value")


@add("SELECT audit_id, CASE WHEN confidence <= 1 THEN round(confidence * 100, 1) ELSE round(confidence, 1) END AS percent FROM audit_log WHERE confidence IS NOT NULL")
def fn_confidence(spark: SparkSession, d: str) -> DataFrame:
    """FN-36."""
    c = F.col("confidence")
    return table(spark, d, "audit_log").where(c.isNotNull()).select("audit_id", F.when(c <= 1, F.round(c * 100, 1)).otherwise(F.round(c, 1)).alias("percent"))


# --- similarity -------------------------------------------------------------------------------------------------------

CARD = f"(SELECT loan_id, value FROM {LATEST_FIELDS} WHERE doc_key = 'pan' AND field = 'applicant_name')"
_JW = "coalesce(CASE WHEN trim(l.applicant_name) <> '' AND trim(c.value) <> '' THEN jaro_winkler_similarity(lower(l.applicant_name), lower(c.value)) END, 0)"


@add(f"SELECT l.loan_id, round({_JW}, 6) AS score, CASE WHEN {_JW} >= 0.5 THEN 'MATCH' WHEN {_JW} >= 0.4 THEN 'PARTIAL' ELSE 'MISMATCH' END AS status FROM {LATEST_LOS} l JOIN {CARD} c USING (loan_id)")
def cmp_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """CMP-01, SIM-01."""
    return records.compare_names(table(spark, d, "los"), table(spark, d, "doc_fields"))


_WORDS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_NORM = "list_sum(list_transform(list_distinct({p}), lambda w: pow(len(list_filter({p}, lambda v: v = w)) * CASE WHEN list_contains({q}, w) THEN 1.0 ELSE 1.4054651081081644 END, 2)))"


@add(
    f"SELECT loan_id, round(CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE "
    f"coalesce(list_sum(list_transform(list_intersect(list_distinct(x), list_distinct(y)), lambda w: len(list_filter(x, lambda v: v = w)) * len(list_filter(y, lambda v: v = w)))), 0) / sqrt({_NORM.format(p='x', q='y')} * {_NORM.format(p='y', q='x')}) END, 4) AS score "
    f"FROM (SELECT l.loan_id, l.current_address AS a, c.value AS b, {_WORDS.format(x='l.current_address')} AS x, {_WORDS.format(x='c.value')} AS y FROM {LATEST_LOS} l "
    f"JOIN {LATEST_FIELDS} c ON c.loan_id = l.loan_id AND c.doc_key = 'aadhaar' AND c.field = 'address' WHERE l.current_address IS NOT NULL AND c.value IS NOT NULL)"
)
def cmp_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """CMP-02, SIM-02."""
    f = table(spark, d, "doc_fields")
    card = records.latest_fields(f.where((F.col("doc_key") == "aadhaar") & (F.col("field") == "address"))).select("loan_id", F.col("value").alias("b"))
    pairs = records.latest_rows(table(spark, d, "los")).select("loan_id", F.col("current_address").alias("a")).join(card, "loan_id").where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.select("loan_id", F.round(sim.tfidf_cosine(F.col("a"), F.col("b")), 4).alias("score"))


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "doc_fields")
    card = records.latest_fields(f.where((F.col("doc_key") == "pan") & (F.col("field") == "applicant_name"))).select("loan_id", F.col("value").alias("b"))
    return records.latest_rows(table(spark, d, "los")).select("loan_id", F.col("applicant_name").alias("a")).join(card, "loan_id").where("a IS NOT NULL AND b IS NOT NULL")


_WLIST = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


@add(
    f"SELECT loan_id, CAST(CASE WHEN len(x) = 0 THEN CASE WHEN len(y) > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, levenshtein(p, q) / len(x)) END AS DOUBLE) AS wer FROM (SELECT *, array_to_string(list_transform(x, lambda w: chr(CAST(48 + list_position(u, w) AS INTEGER))), '') AS p, array_to_string(list_transform(y, lambda w: chr(CAST(48 + list_position(u, w) AS INTEGER))), '') AS q FROM ("
    f"SELECT loan_id, x, y, list_distinct(list_concat(x, y)) AS u FROM (SELECT l.loan_id, {_WLIST.format(x='l.applicant_name')} AS x, {_WLIST.format(x='c.value')} AS y FROM {LATEST_LOS} l JOIN {CARD} c USING (loan_id) WHERE l.applicant_name IS NOT NULL AND c.value IS NOT NULL)))"
)
def sim_wer(spark: SparkSession, d: str) -> DataFrame:
    """SIM-05, SIM-06: word error rate, over distinct pairs. In SQL words become single characters."""
    return sim.over_distinct(name_pairs(spark, d), "a", "b", sim.word_error_rate, "wer").select("loan_id", "wer")


@add()
def sim_gestalt(spark: SparkSession, d: str) -> DataFrame:
    """SIM-03: ratio of matching blocks, over distinct pairs."""
    return sim.over_distinct(name_pairs(spark, d), "a", "b", sim.gestalt, "ratio").select("loan_id", "ratio")


_RANGES = {"latin": "A-Za-z", "devanagari": "ऀ-ॿ", "tamil": "஀-௿", "telugu": "ఀ-౿", "kannada": "ಀ-೿"}


@add(f"SELECT doc_id, {', '.join(f'CAST(length(text) - length(regexp_replace(text, {chr(39)}[{r}]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})) AS INTEGER) AS {n}' for n, r in _RANGES.items())} FROM documents")
def sim_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Letters by script."""
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in sim.script_counts(F.col("text")).items()])


# --- record comparison ------------------------------------------------------------------------------------------------

#: The configured checks as a relation of their own: check, subnode, document, field, method, optional, names in the document, names in the loan's row.
_CHECKS = """
('chk_check_kyc_aadhaar_applicant_name_vs_los', 'check_kyc', 'aadhaar', 'applicant_name', 'jaro_winkler', false, 'applicant_name name full_name customer_name', 'applicant_name'),
('chk_check_kyc_aadhaar_fathers_name_vs_los', 'check_kyc', 'aadhaar', 'fathers_name', 'jaro_winkler', true, 'fathers_name father_name', 'fathers_name'),
('chk_check_kyc_aadhaar_gender_vs_los', 'check_kyc', 'aadhaar', 'gender', 'exact_string_ci', true, 'gender applicant_gender', 'applicant_gender'),
('chk_check_kyc_aadhaar_address_vs_los', 'check_kyc', 'aadhaar', 'address', 'tfidf_cosine', false, 'address current_address address_text', 'current_address permanent_address'),
('chk_check_kyc_aadhaar_aadhaar_number_vs_los', 'check_kyc', 'aadhaar', 'aadhaar_number', 'masked_aadhaar', false, 'aadhaar_number aadhaar aadhaar_no uid', 'aadhaar_no'),
('chk_check_kyc_aadhaar_mobile_no_vs_los', 'check_kyc', 'aadhaar', 'mobile_no', 'exact_string', false, 'mobile_no applicant_mobile_no mobile phone', 'applicant_mobile_no'),
('chk_check_kyc_aadhaar_dob_vs_los', 'check_kyc', 'aadhaar', 'dob', 'exact_date', false, 'dob applicant_dob date_of_birth', 'applicant_dob'),
('chk_check_kyc_pan_applicant_name_vs_los', 'check_kyc', 'pan', 'applicant_name', 'jaro_winkler', false, 'applicant_name name full_name customer_name', 'applicant_name'),
('chk_check_kyc_pan_fathers_name_vs_los', 'check_kyc', 'pan', 'fathers_name', 'jaro_winkler', false, 'fathers_name father_name', 'fathers_name'),
('chk_check_kyc_pan_pan_number_vs_los', 'check_kyc', 'pan', 'pan_number', 'exact_id', false, 'pan_number pan applicant_pan_number', 'applicant_pan_number pan'),
('chk_check_kyc_pan_dob_vs_los', 'check_kyc', 'pan', 'dob', 'exact_date', false, 'dob applicant_dob date_of_birth', 'applicant_dob'),
('chk_check_kyc_application_form_applicant_name_vs_los', 'check_kyc', 'application_form', 'applicant_name', 'jaro_winkler', false, 'applicant_name name customer_name full_name', 'applicant_name'),
('chk_check_kyc_application_form_fathers_name_vs_los', 'check_kyc', 'application_form', 'fathers_name', 'jaro_winkler', false, 'fathers_name father_name', 'fathers_name'),
('chk_check_kyc_application_form_dob_vs_los', 'check_kyc', 'application_form', 'dob', 'exact_date', false, 'dob applicant_dob date_of_birth', 'applicant_dob'),
('chk_check_kyc_application_form_mobile_no_vs_los', 'check_kyc', 'application_form', 'mobile_no', 'exact_string', false, 'mobile_no applicant_mobile_no mobile phone', 'applicant_mobile_no'),
('chk_check_kyc_application_form_gender_vs_los', 'check_kyc', 'application_form', 'gender', 'exact_string_ci', false, 'gender applicant_gender', 'applicant_gender'),
('chk_check_kyc_application_form_pan_number_vs_los', 'check_kyc', 'application_form', 'pan_number', 'exact_id', false, 'pan_number pan applicant_pan_number', 'applicant_pan_number pan'),
('chk_aadhaar_xml_aadhaar_no_vs_los', 'check_kyc', 'aadhaar_xml', 'aadhaar_number', 'masked_aadhaar', true, 'aadhaar_number aadhaar uid aadhaar_no', 'aadhaar_no'),
('chk_check_financial_application_form_loan_amount_vs_los', 'check_financial', 'application_form', 'loan_amount', '[exact_numeric]', false, 'loan_amount funding_amount amount sanctioned_amount disbursal_amount', 'loan_amount funding_amount'),
('chk_check_financial_application_form_loan_validity_vs_los', 'check_financial', 'application_form', 'loan_validity', 'tenure_months', false, 'loan_validity tenure tenure_months loan_tenure loan_term term validity', 'loan_validity tenure tenure_months'),
('chk_check_financial_application_form_account_no_vs_los', 'check_financial', 'application_form', 'account_no', 'exact_id', false, 'account_no account_number applicant_bank_account_no bank_account_no', 'applicant_bank_account_no'),
('chk_check_financial_application_form_type_of_account_vs_los', 'check_financial', 'application_form', 'type_of_account', 'exact_string_ci', false, 'type_of_account bank_account_type account_type', 'bank_account_type'),
('chk_check_financial_application_form_loan_type_vs_los', 'check_financial', 'application_form', 'loan_type', 'exact_string_ci', false, 'loan_type', 'loan_type'),
('chk_check_financial_kfs_loan_amount_vs_los', 'check_financial', 'kfs', 'loan_amount', 'exact_numeric', false, 'loan_amount funding_amount amount sanctioned_amount disbursal_amount', 'loan_amount funding_amount'),
('chk_check_financial_kfs_loan_validity_vs_los', 'check_financial', 'kfs', 'loan_validity', 'tenure_months', false, 'loan_validity tenure tenure_months loan_tenure loan_term term validity', 'loan_validity tenure tenure_months'),
('chk_check_financial_kfs_loan_type_vs_los', 'check_financial', 'kfs', 'loan_type', 'exact_string_ci', false, 'loan_type', 'loan_type'),
('chk_check_financial_kfs_irr_percent_vs_los', 'check_financial', 'kfs', 'irr_percent', 'exact_numeric', false, 'irr_percent irr roi interest_rate', 'irr_percent'),
('chk_check_financial_kfs_emi_vs_los', 'check_financial', 'kfs', 'emi', 'exact_numeric', false, 'emi monthly_emi emi_amount', 'emi'),
('chk_check_financial_kfs_bpi_vs_los', 'check_financial', 'kfs', 'bpi', 'exact_numeric', true, 'bpi bpi_charges bpi_charge broken_period_interest BPI', 'bpi_charges'),
('chk_check_financial_kfs_customer_consent_vs_los', 'check_financial', 'kfs', 'customer_consent', 'presence_only', false, 'customer_consent consent is_consented', ''),
('chk_check_financial_disbursal_memo_loan_no_vs_los', 'check_financial', 'disbursal_memo', 'loan_no', 'exact_id', false, 'loan_no loan_id loan_number application_id', 'loan_id application_id'),
('chk_check_financial_disbursal_memo_loan_amount_vs_los', 'check_financial', 'disbursal_memo', 'loan_amount', 'exact_numeric', false, 'loan_amount disbursal_amount amount funding_amount sanctioned_amount', 'loan_amount funding_amount'),
('chk_check_financial_sanction_letter_applicant_name_vs_los', 'check_financial', 'sanction_letter', 'applicant_name', 'jaro_winkler', false, 'applicant_name name customer_name full_name', 'applicant_name'),
('chk_check_financial_sanction_letter_loan_amount_vs_los', 'check_financial', 'sanction_letter', 'loan_amount', 'exact_numeric', false, 'loan_amount funding_amount amount sanctioned_amount disbursal_amount', 'loan_amount funding_amount'),
('chk_check_financial_sanction_letter_loan_validity_vs_los', 'check_financial', 'sanction_letter', 'loan_validity', 'tenure_months', false, 'loan_validity tenure tenure_months loan_tenure loan_term term validity', 'loan_validity tenure tenure_months'),
('chk_check_financial_sanction_letter_irr_percent_vs_los', 'check_financial', 'sanction_letter', 'irr_percent', 'exact_numeric', false, 'irr_percent irr roi interest_rate', 'irr_percent'),
('chk_check_financial_sanction_letter_emi_vs_los', 'check_financial', 'sanction_letter', 'emi', 'exact_numeric', false, 'emi monthly_emi emi_amount', 'emi'),
('chk_check_financial_sanction_letter_loan_type_vs_los', 'check_financial', 'sanction_letter', 'loan_type', 'exact_string_ci', true, 'loan_type', 'loan_type'),
('chk_check_financial_sanction_letter_mobile_no_vs_los', 'check_financial', 'sanction_letter', 'mobile_no', 'exact_string', true, 'mobile_no applicant_mobile_no mobile phone', 'applicant_mobile_no'),
('chk_check_financial_sanction_letter_address_vs_los', 'check_financial', 'sanction_letter', 'address', 'tfidf_cosine', true, 'address current_address address_text', 'current_address permanent_address'),
('chk_check_financial_account_statement_account_no_vs_los', 'check_financial', 'account_statement', 'account_no', 'exact_id', false, 'account_no account_number bank_account_no applicant_bank_account_no', 'applicant_bank_account_no'),
('chk_check_financial_account_statement_applicant_name_vs_los', 'check_financial', 'account_statement', 'applicant_name', 'jaro_winkler', false, 'applicant_name name account_holder_name customer_name full_name', 'applicant_name'),
('chk_check_financial_account_statement_current_address_vs_los', 'check_financial', 'account_statement', 'current_address', 'tfidf_cosine', true, 'current_address address address_text permanent_address', 'current_address permanent_address'),
('chk_check_loan_application_application_form_application_no_vs_los', 'check_loan_application', 'application_form', 'application_no', 'exact_id', false, 'application_no application_id loan_id loan_no', 'loan_id application_id'),
('chk_check_loan_application_kfs_application_no_vs_los', 'check_loan_application', 'kfs', 'application_no', 'exact_id', false, 'application_no application_id loan_id loan_no', 'loan_id application_id'),
('chk_check_loan_application_sanction_letter_application_no_vs_los', 'check_loan_application', 'sanction_letter', 'application_no', 'exact_id', false, 'application_no application_id loan_id loan_no', 'loan_id application_id'),
('chk_check_loan_application_disbursal_memo_loan_no_vs_los', 'check_loan_application', 'disbursal_memo', 'loan_no', 'exact_id', false, 'loan_no loan_id loan_number application_id', 'loan_id application_id')
"""
#: Other names of documents: name, canonical name, rank.
FILED_AS = ", ".join(
    f"('{n}', '{names.split()[0]}', {i})"
    for names in (
        "aadhaar kyc_address_proof aadhaar_card aadhar", "aadhaar_xml aadhaarxml xml_aadhaar", "pan kyc_pan pan_card", "application_form loan_application application appform app_form",
        "account_statement bank_statement bank_account_statement bank_statement_6m", "kfs key_fact_statement key_fact_statement_kfs", "sanction_letter sanction", "loan_agreement agreement",
        "disbursal_memo disbursement_memo memo disbursalmemo", "vkyc vkyc_audit_trail vkyc_audit", "bt_details foreclosure_letter bt",
    )
    for i, n in enumerate(names.split())
)
_DOCS = (
    f"(SELECT loan_id, canon, field, value, kind FROM (SELECT *, min(rank) OVER (PARTITION BY loan_id, canon) AS best FROM (SELECT f.loan_id, coalesce(a.canon, f.doc_key) AS canon, coalesce(a.rank, 0) AS rank, f.field, f.value, f.kind "
    f"FROM {LATEST_FIELDS} f LEFT JOIN (VALUES {FILED_AS}) a(name, canon, rank) ON a.name = f.doc_key)) WHERE rank = best)"
)
_LOS_NAMES = "loan_id applicant_name applicant_mobile_no applicant_dob applicant_pan_number fathers_name applicant_bank_account_no loan_type loan_validity current_address permanent_address aadhaar_no bank_account_type applicant_gender application_id pan tenure_months tenure loan_amount funding_amount irr_percent emi bpi_charges".split()
_LOS_LONG = "(" + " UNION ALL ".join(f"SELECT loan_id, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {LATEST_LOS}" for c in _LOS_NAMES) + ")"
_D, _L = "d", "l"
_X, _Y = _aadhaar(_D), _aadhaar(_L)
_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
_LAST4 = f"(length({_DIGITS.format(x=_X)}) >= 4 AND length({_DIGITS.format(x=_Y)}) >= 4 AND right({_DIGITS.format(x=_X)}, 4) = right({_DIGITS.format(x=_Y)}, 4))"
_MASKED = f"(regexp_matches({_X}, '[X*•]') OR regexp_matches({_Y}, '[X*•]'))"
_SHORT = f"({_LAST4} AND (length({_X}) = 4 OR length({_Y}) = 4) AND NOT (length({_DIGITS.format(x=_X)}) = 12 AND length({_DIGITS.format(x=_Y)}) = 12))"
_BAND = "CASE WHEN {s} >= 0.5 THEN 'MATCH' WHEN {s} >= 0.4 THEN 'PARTIAL' ELSE 'MISMATCH' END"
_FILLED = f"trim({_D}) <> '' AND trim({_L}) <> ''"
_JARO = f"round(CASE WHEN {_FILLED} THEN jaro_winkler_similarity(lower(trim({_D})), lower(trim({_L}))) ELSE 0.0 END, 4)"
_COSINE = (
    f"round(CASE WHEN lower(trim({_L})) = lower(trim({_D})) THEN 1.0 WHEN len(lw) = 0 OR len(dw) = 0 THEN 0.0 ELSE "
    f"coalesce(list_sum(list_transform(list_intersect(list_distinct(lw), list_distinct(dw)), lambda w: len(list_filter(lw, lambda v: v = w)) * len(list_filter(dw, lambda v: v = w)))), 0) / sqrt({_NORM.format(p='lw', q='dw')} * {_NORM.format(p='dw', q='lw')}) END, 4)"
)
_STATUS = (
    f"CASE WHEN NOT filed THEN 'NOT_FOUND' WHEN method = 'presence_only' THEN CASE WHEN coalesce(CASE WHEN kind = 'number' THEN TRY_CAST({_D} AS DOUBLE) > 0 ELSE lower(trim({_D})) IN ('true','1','yes','y','verified','accepted','consented') END, false) THEN 'MATCH' ELSE 'MISMATCH' END "
    f"WHEN {_D} IS NULL OR {_L} IS NULL THEN 'NOT_FOUND' WHEN method = 'exact_numeric' AND ({_num(_D)} IS NULL OR {_num(_L)} IS NULL) THEN 'NOT_FOUND' "
    f"WHEN method = 'jaro_winkler' THEN {_BAND.format(s='jaro')} WHEN method = 'tfidf_cosine' THEN {_BAND.format(s='cosine')} "
    f"WHEN coalesce(CASE method WHEN 'exact_id' THEN {_id(_D)} = {_id(_L)} WHEN 'exact_date' THEN {_date(_D)} = {_date(_L)} AND trim({_D}) <> '' WHEN 'exact_string_ci' THEN lower(trim({_D})) = lower(trim({_L})) AND {_FILLED} "
    f"WHEN 'exact_numeric' THEN abs({_num(_D)} - {_num(_L)}) < 0.01 WHEN 'masked_aadhaar' THEN {_X} <> '' AND {_Y} <> '' AND CASE WHEN {_MASKED} THEN {_LAST4} ELSE {_X} = {_Y} OR {_SHORT} END "
    f"WHEN 'tenure_months' THEN {_tenure(_D)} = {_tenure(_L)} ELSE trim({_D}) = trim({_L}) AND {_FILLED} END, false) THEN 'MATCH' ELSE 'MISMATCH' END"
)
_KIND_OF_MATCH = "CASE method WHEN 'jaro_winkler' THEN 'fuzzy' WHEN 'tfidf_cosine' THEN 'fuzzy' WHEN 'exact_id' THEN 'exact_id' WHEN 'masked_aadhaar' THEN 'masked_id' WHEN 'tenure_months' THEN 'tenure' WHEN 'exact_date' THEN 'exact_date' WHEN 'presence_only' THEN 'presence' ELSE 'exact_string' END"
RECORDS = (
    f"(SELECT loan_id, check_id, subnode, doc_key, field, {_KIND_OF_MATCH} AS match_type, method, status, "
    f"CAST(CASE WHEN status = 'NOT_FOUND' THEN 0.0 WHEN method = 'jaro_winkler' THEN jaro WHEN method = 'tfidf_cosine' THEN cosine WHEN method = 'masked_aadhaar' AND NOT {_MASKED} AND {_X} <> {_Y} AND {_SHORT} THEN 0.95 WHEN status = 'MATCH' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS confidence "
    f"FROM (SELECT *, {_STATUS} AS status FROM (SELECT *, CASE WHEN method = 'jaro_winkler' THEN {_JARO} END AS jaro, CASE WHEN method = 'tfidf_cosine' THEN {_COSINE} END AS cosine FROM ("
    f"SELECT e.*, p.loan_id IS NOT NULL AS filed, dv.value AS d, dv.kind AS kind, lv.value AS l, {_WORDS.format(x='dv.value')} AS dw, {_WORDS.format(x='lv.value')} AS lw "
    f"FROM (SELECT l.loan_id, k.* FROM {LATEST_LOS} l CROSS JOIN (VALUES {_CHECKS}) k(check_id, subnode, doc_key, field, method, optional, doc_names, los_names)) e "
    f"LEFT JOIN (SELECT DISTINCT loan_id, canon FROM {_DOCS}) p ON p.loan_id = e.loan_id AND p.canon = e.doc_key "
    f"LEFT JOIN (SELECT x.loan_id, k.check_id, arg_min(x.value, list_position(string_split(k.doc_names, ' '), x.field)) AS value, arg_min(x.kind, list_position(string_split(k.doc_names, ' '), x.field)) AS kind FROM {_DOCS} x "
    f"JOIN (VALUES {_CHECKS}) k(check_id, subnode, doc_key, field, method, optional, doc_names, los_names) ON k.doc_key = x.canon AND list_contains(string_split(k.doc_names, ' '), x.field) WHERE x.value IS NOT NULL GROUP BY ALL) dv ON dv.loan_id = e.loan_id AND dv.check_id = e.check_id "
    f"LEFT JOIN (SELECT x.loan_id, k.check_id, arg_min(x.value, list_position(string_split(k.los_names, ' '), x.field)) AS value FROM {_LOS_LONG} x "
    f"JOIN (VALUES {_CHECKS}) k(check_id, subnode, doc_key, field, method, optional, doc_names, los_names) ON list_contains(string_split(k.los_names, ' '), x.field) WHERE x.value IS NOT NULL GROUP BY ALL) lv ON lv.loan_id = e.loan_id AND lv.check_id = e.check_id))) "
    f"WHERE NOT (optional AND (NOT filed OR d IS NULL OR l IS NULL)))"
)
COLUMNS = ("loan_id", "check_id", "subnode", "doc_key", "field", "match_type", "method", "status", "confidence")


def all_checks(spark: SparkSession, d: str) -> DataFrame:
    return records.compare(table(spark, d, "los"), table(spark, d, "doc_fields")).select(*COLUMNS)


@add(f"SELECT {', '.join(COLUMNS)} FROM {RECORDS}")
def cmp_records(spark: SparkSession, d: str) -> DataFrame:
    """JN-01, JN-02, CMP-01 to CMP-06, CMP-08 to CMP-13, CMP-17 to CMP-20, SET-02, FN-09, FN-10, FN-34: all configured checks of all loans."""
    return all_checks(spark, d)


_NEAR = f"CASE WHEN a <= 0 OR b <= 0 THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END ELSE least(a, b) / greatest(a, b) END"


@add(
    f"SELECT loan_id, doc_key, CASE WHEN a IS NULL OR b IS NULL THEN 'NOT_FOUND' WHEN {_NEAR} >= 0.90 THEN 'MATCH' ELSE 'MISMATCH' END AS status, CAST(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE round(least(1.0, {_NEAR}), 4) END AS DOUBLE) AS confidence "
    f"FROM (SELECT d.loan_id, d.doc_key, {_num('d.value')} AS a, {_num('l.loan_amount')} AS b FROM {LATEST_FIELDS} d JOIN {LATEST_LOS} l USING (loan_id) WHERE d.field = 'loan_amount' AND d.value IS NOT NULL AND l.loan_amount IS NOT NULL)"
)
def cmp_threshold(spark: SparkSession, d: str) -> DataFrame:
    """CMP-07: amounts of documents within nine tenths of the loan's; with a side of zero or less only equal ones match."""
    docs = records.latest_fields(table(spark, d, "doc_fields").where("field = 'loan_amount'")).where("value IS NOT NULL")
    own = records.latest_rows(table(spark, d, "los")).where("loan_amount IS NOT NULL").select("loan_id", F.col("loan_amount").cast("string").alias("l"))
    v, own_value = F.col("value"), F.col("l")
    near = docs.join(own, "loan_id").withColumn("near", records.likeness(F.lit("threshold_90"), v, own_value))
    judged = near.withColumn("status", records.status_of(F.lit("threshold_90"), v, own_value, F.col("near")))
    return judged.select("loan_id", "doc_key", "status", records.confidence_of(F.lit("threshold_90"), v, own_value, F.col("near"), F.col("status")).alias("confidence"))


def _number_of(doc: str, names: str) -> str:
    return (
        f"(SELECT loan_id, {_num('value')} AS v FROM (SELECT loan_id, arg_min(value, list_position(string_split('{names}', ' '), field)) AS value FROM {_DOCS} "
        f"WHERE canon = '{doc}' AND value IS NOT NULL AND list_contains(string_split('{names}', ' '), field) GROUP BY loan_id))"
    )


_BPI = "bpi_charge broken_period_interest bpi"
BPI = (
    f"(SELECT loan_id, CASE WHEN a IS NULL OR b IS NULL THEN 'NOT_FOUND' WHEN greatest(a, b) = 0 THEN 'MATCH' WHEN abs(a - b) / greatest(a, b) <= 0.10 THEN 'MATCH' ELSE 'MISMATCH' END AS status, "
    f"CAST(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN greatest(a, b) = 0 THEN 1.0 ELSE round(greatest(0.0, 1 - abs(a - b) / greatest(a, b)), 4) END AS DOUBLE) AS confidence "
    f"FROM (SELECT loan_id, k.v AS a, m.v AS b FROM {_number_of('kfs', _BPI)} k FULL OUTER JOIN {_number_of('disbursal_memo', _BPI)} m USING (loan_id)) WHERE a IS NOT NULL OR b IS NOT NULL)"
)


def _bpi(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "doc_fields")
    return records.tolerance(records.document_value(f, "kfs", *_BPI.split()), records.document_value(f, "disbursal_memo", *_BPI.split()))


@add(f"SELECT * FROM {BPI}")
def cmp_bpi(spark: SparkSession, d: str) -> DataFrame:
    """CMP-14, JN-03: interest of the broken period in two documents of a loan, within a tenth; a full outer join."""
    return _bpi(spark, d)


SIGNATURES = (
    f"(SELECT loan_id, CASE WHEN c > 0 THEN 'MATCH' ELSE 'MISMATCH' END AS status, c AS confidence FROM (SELECT loan_id, CAST(CASE WHEN coalesce(i.x.is_acceptable, false) THEN 100.0 WHEN coalesce(i.x.is_signed, false) THEN 0.0 "
    f"WHEN coalesce(g.kind = 'bool' AND lower(g.value) = 'true', false) THEN 85.0 ELSE 0.0 END AS DOUBLE) AS c FROM (SELECT loan_id, pyhanko_inspection AS x FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY inspected_at DESC NULLS LAST, inspection_id DESC) rn "
    f"FROM inspections WHERE loan_id IS NOT NULL AND pyhanko_inspection IS NOT NULL) WHERE rn = 1) i FULL OUTER JOIN (SELECT a.loan_id, f.value, f.kind FROM (SELECT DISTINCT loan_id FROM {_DOCS} WHERE canon = 'loan_agreement') a "
    f"LEFT JOIN (SELECT * FROM {_DOCS} WHERE canon = 'loan_agreement' AND field = 'loan_agreement_signed') f USING (loan_id)) g USING (loan_id)))"
)


@add(f"SELECT * FROM {SIGNATURES}")
def cmp_signature(spark: SparkSession, d: str) -> DataFrame:
    """CMP-15: the signature of each loan's agreement; confidence from 0 to 100."""
    return records.signatures(table(spark, d, "doc_fields"), table(spark, d, "inspections")).select("loan_id", "status", "confidence")


@add(
    f"SELECT loan_id, check_id, subnode, status, confidence FROM {RECORDS} UNION ALL SELECT loan_id, 'chk_check_financial_kfs_vs_disbursal_memo_bpi_charge', 'check_financial', status, confidence FROM {BPI} JOIN (SELECT loan_id FROM {LATEST_LOS}) USING (loan_id) "
    f"UNION ALL SELECT loan_id, 'chk_loan_agreement_digital_signature', 'check_loan_application', status, confidence FROM {SIGNATURES} JOIN (SELECT loan_id FROM {LATEST_LOS}) USING (loan_id)"
)
def cmp_subnodes(spark: SparkSession, d: str) -> DataFrame:
    """CMP-17, CMP-18, CMP-19, SET-02: the records of the three checkers, with those between documents and of the signature."""
    return _all_records(spark, d)


def _all_records(spark: SparkSession, d: str) -> DataFrame:
    loans = table(spark, d, "los").where("loan_id IS NOT NULL").select("loan_id").distinct()
    bpi = _bpi(spark, d).join(loans, "loan_id", "left_semi").select("loan_id", F.lit("chk_check_financial_kfs_vs_disbursal_memo_bpi_charge").alias("check_id"), F.lit("check_financial").alias("subnode"), "status", "confidence")
    signed = records.signatures(table(spark, d, "doc_fields"), table(spark, d, "inspections")).join(loans, "loan_id", "left_semi").select("loan_id", "check_id", "subnode", "status", "confidence")
    return all_checks(spark, d).select("loan_id", "check_id", "subnode", "status", "confidence").unionByName(bpi).unionByName(signed)


@add(f"SELECT loan_id, check_id, status, CAST(CASE WHEN match_type = 'fuzzy' AND status = 'PARTIAL' THEN 0.5 ELSE confidence END AS DOUBLE) AS confidence, match_type = 'fuzzy' AND status = 'PARTIAL' AS adjudicated FROM {RECORDS}")
def cmp_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """CMP-16, UDF-01: records after adjudication of partial matches, by the adjudicator that needs no model."""
    return records.adjudicated(all_checks(spark, d)).select("loan_id", "check_id", "status", "confidence", "adjudicated")


_BARE = "lower(replace(trim({x}), ' ', ''))"
_FORM = """
('applicant_name', 'applicant_name', 3.0, 'text', 'applicant_name customer_name name full_name'), ('application_no', 'loan_id', 1.0, 'text', 'application_no application_id loan_id loan_no'),
('fathers_name', 'fathers_name', 1.0, 'text', 'fathers_name father_name'), ('dob', 'applicant_dob', 3.0, 'date', 'dob applicant_dob date_of_birth'), ('gender', 'applicant_gender', 1.0, 'text', 'gender'),
('mobile_no', 'applicant_mobile_no', 1.0, 'mobile', 'mobile_no applicant_mobile_no mobile phone'), ('pan_number', 'applicant_pan_number', 3.0, 'text', 'pan_number pan applicant_pan_number'),
('account_no', 'applicant_bank_account_no', 2.0, 'text', 'account_no bank_account_no account_number applicant_bank_account_no'), ('type_of_account', 'bank_account_type', 1.0, 'text', 'type_of_account'),
('loan_type', 'loan_type', 1.0, 'text', 'loan_type'), ('loan_amount', 'loan_amount', 2.0, 'number', 'loan_amount funding_amount amount sanctioned_amount disbursal_amount'),
('loan_validity', 'tenure', 2.0, 'number', 'loan_validity tenure tenure_months loan_tenure loan_term term validity')
"""
_SAME = (
    f"coalesce(CASE how WHEN 'mobile' THEN CASE WHEN length({_DIGITS.format(x='x')}) >= 10 AND length({_DIGITS.format(x='y')}) >= 10 THEN right({_DIGITS.format(x='x')}, 10) = right({_DIGITS.format(x='y')}, 10) ELSE {_BARE.format(x='x')} = {_BARE.format(x='y')} END "
    f"WHEN 'date' THEN {_date('x')} = {_date('y')} WHEN 'number' THEN coalesce({_num('x')}, 0) = coalesce({_num('y')}, 0) AND x IS NOT NULL "
    f"ELSE {_BARE.format(x='x')} = {_BARE.format(x='y')} OR contains({_BARE.format(x='x')}, {_BARE.format(x='y')}) OR contains({_BARE.format(x='y')}, {_BARE.format(x='x')}) END, false)"
)


@add(
    f"SELECT loan_id, CAST(count(y) AS INTEGER) AS n_fields, CAST(count(*) FILTER (y IS NOT NULL AND {_SAME}) AS INTEGER) AS n_matched, CAST(coalesce(round(sum(weight) FILTER (y IS NOT NULL AND {_SAME}) / sum(weight) FILTER (y IS NOT NULL) * 100, 1), 0) AS DOUBLE) AS match_score FROM ("
    f"SELECT f.loan_id, k.field, CAST(k.weight AS DOUBLE) AS weight, k.how, v.value AS x, l.value AS y FROM (SELECT DISTINCT loan_id FROM {_DOCS} WHERE canon = 'application_form') f JOIN {LATEST_LOS} o USING (loan_id) CROSS JOIN (VALUES {_FORM}) k(field, row_field, weight, how, names) "
    f"LEFT JOIN (SELECT d.loan_id, k.field, arg_min(d.value, list_position(string_split(k.names, ' '), d.field)) AS value FROM {_DOCS} d JOIN (VALUES {_FORM}) k(field, row_field, weight, how, names) ON list_contains(string_split(k.names, ' '), d.field) "
    f"WHERE d.canon = 'application_form' AND d.value IS NOT NULL GROUP BY ALL) v ON v.loan_id = f.loan_id AND v.field = k.field LEFT JOIN {_LOS_LONG} l ON l.loan_id = f.loan_id AND l.field = k.row_field) GROUP BY loan_id"
)
def cmp_form(spark: SparkSession, d: str) -> DataFrame:
    """CMP-21: the weighted score of a form against the loan's row."""
    return records.form_score(table(spark, d, "los"), table(spark, d, "doc_fields"))


_COUNTS = "count(*) FILTER (status = 'MATCH') AS n_match, count(*) FILTER (status = 'PARTIAL') AS n_partial, count(*) FILTER (status = 'MISMATCH') AS n_mismatch, count(*) FILTER (status = 'NOT_FOUND') AS n_not_found, count(*) AS n_total"
ROLLUP = f"(SELECT *, CASE WHEN n_mismatch > 0 THEN 'Discrepancy' WHEN n_match < n_total THEN 'Indeterminate' ELSE 'Verified' END AS rollup FROM (SELECT loan_id, {_COUNTS} FROM {RECORDS} GROUP BY loan_id))"


@add(f"SELECT * FROM {ROLLUP}")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, AGG-03, SET-06."""
    return records.rollup(all_checks(spark, d))


@add(
    f"SELECT loan_id, subnode, coalesce(n_total, 0) AS n_total, coalesce(rollup, 'Indeterminate') AS rollup FROM (SELECT loan_id, s.subnode FROM {LATEST_LOS} CROSS JOIN (VALUES ('check_kyc'), ('check_financial'), ('check_loan_application')) s(subnode)) LEFT JOIN "
    f"(SELECT loan_id, subnode, count(*) AS n_total, CASE WHEN bool_or(status = 'MISMATCH') THEN 'Discrepancy' WHEN bool_or(status <> 'MATCH') THEN 'Indeterminate' ELSE 'Verified' END AS rollup FROM {RECORDS} GROUP BY loan_id, subnode) USING (loan_id, subnode)"
)
def agg_subnodes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: the tri-state rollup per loan and subnode; an empty one is Indeterminate."""
    return records.subnode_rollups(all_checks(spark, d), table(spark, d, "los"))


@add(
    f"SELECT doc_key, field, {_COUNTS}, round(avg(CASE status WHEN 'MATCH' THEN 1.0 ELSE 0.0 END), 4) AS match_rate FROM {RECORDS} GROUP BY doc_key, field"
)
def agg_check_rates(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, AGG-14, AGG-17: status counts and rate of matches per check."""
    n = lambda s: F.count_if(F.col("status") == s)
    return all_checks(spark, d).groupBy("doc_key", "field").agg(
        n("MATCH").alias("n_match"), n("PARTIAL").alias("n_partial"), n("MISMATCH").alias("n_mismatch"), n("NOT_FOUND").alias("n_not_found"), F.count(F.lit(1)).alias("n_total"),
        F.round(F.avg((F.col("status") == "MATCH").cast("double")), 4).alias("match_rate"),
    )


@add(f"SELECT rollup, count(*) AS loans, CAST(sum(n_match) AS BIGINT) AS matches, round(avg(n_mismatch), 4) AS mean_mismatches FROM {ROLLUP} GROUP BY rollup")
def agg_kpi(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09."""
    r = records.rollup(all_checks(spark, d))
    return r.groupBy("rollup").agg(F.count(F.lit(1)).alias("loans"), F.sum("n_match").alias("matches"), F.round(F.avg("n_mismatch"), 4).alias("mean_mismatches"))


@add(f"SELECT loan_id, check_id, doc_key, field, CASE WHEN method IN ('exact_id', 'masked_aadhaar') THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM {RECORDS} WHERE status = 'MISMATCH'")
def ent_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """ENT-05, FLT-05: the mismatches, by priority."""
    r = all_checks(spark, d).where("status = 'MISMATCH'")
    return r.select("loan_id", "check_id", "doc_key", "field", F.when(F.col("method").isin("exact_id", "masked_aadhaar"), "HIGH").otherwise("MEDIUM").alias("priority"))


# --- scans, joins, set operations -------------------------------------------------------------------------------------


@add(f"SELECT row_id, loan_id, source_id, status FROM {LATEST_LOS}")
def src_latest(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02, SRC-04, DED-02, WIN-17: the newest row per loan."""
    return records.latest_rows(table(spark, d, "los")).select("row_id", "loan_id", "source_id", "status")


@add(
    "SELECT loan_id, doc_key, field, coalesce(max(CASE WHEN rn = 1 THEN value END), max(CASE WHEN fr = 1 AND value IS NOT NULL THEN value END)) AS value, count(*) AS runs FROM (SELECT *, "
    "row_number() OVER (PARTITION BY loan_id, doc_key, field ORDER BY extracted_at DESC NULLS LAST, field_id DESC) rn, "
    "row_number() OVER (PARTITION BY loan_id, doc_key, field, value IS NULL ORDER BY extracted_at DESC NULLS LAST, field_id DESC) fr FROM doc_fields WHERE loan_id IS NOT NULL AND doc_key IS NOT NULL AND field IS NOT NULL) GROUP BY loan_id, doc_key, field"
)
def src_tier_merge(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09, SRC-10, SRC-11: the later run's values, nulls filled from before."""
    return records.tier_merge(table(spark, d, "doc_fields"))


@add("SELECT DISTINCT loan_id FROM (SELECT loan_id FROM los UNION SELECT loan_id FROM doc_fields UNION SELECT loan_id FROM extractions) WHERE loan_id IS NOT NULL")
def set_union_ids(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05, SET-01, SET-05: all loan ids of three sources; each is reduced before they meet."""
    ids = [table(spark, d, t).select("loan_id").distinct() for t in ("los", "doc_fields", "extractions")]
    return ids[0].unionByName(ids[1]).unionByName(ids[2]).where("loan_id IS NOT NULL").distinct()


@add("SELECT DISTINCT loan_id FROM los WHERE loan_id IS NOT NULL EXCEPT SELECT loan_id FROM doc_fields")
def set_missing_docs(spark: SparkSession, d: str) -> DataFrame:
    """SET-04, CMP-12, SRC-25: loans without any document; an anti join."""
    have = table(spark, d, "doc_fields").select("loan_id").distinct()
    return table(spark, d, "los").where("loan_id IS NOT NULL").select("loan_id").distinct().join(have, "loan_id", "left_anti")


@add("SELECT DISTINCT e.loan_id FROM extractions e WHERE e.loan_id IS NOT NULL AND EXISTS (SELECT 1 FROM documents d WHERE d.loan_id = e.loan_id AND contains(d.doc_key, 'agreement'))")
def jn_semi_contains(spark: SparkSession, d: str) -> DataFrame:
    """JN-08, FN-30: loans that have a document of which the name contains a word; a semi join."""
    agreements = table(spark, d, "documents").where(F.col("doc_key").contains("agreement")).select("loan_id").distinct()
    return table(spark, d, "extractions").where("loan_id IS NOT NULL").select("loan_id").distinct().join(agreements, "loan_id", "left_semi")


@add(
    f"SELECT l.loan_id, coalesce(x.n_docs, 0) AS n_docs, coalesce(a.n_events, 0) AS n_events, coalesce(i.signed, false) AS signed FROM {LATEST_LOS} l "
    "LEFT JOIN (SELECT loan_id, count(DISTINCT doc_key) AS n_docs FROM doc_fields GROUP BY loan_id) x USING (loan_id) LEFT JOIN (SELECT loan_id, count(DISTINCT audit_id) AS n_events FROM audit_log GROUP BY loan_id) a USING (loan_id) "
    "LEFT JOIN (SELECT loan_id, bool_or(pyhanko_inspection.is_signed) AS signed FROM inspections GROUP BY loan_id) i USING (loan_id)"
)
def jn_case(spark: SparkSession, d: str) -> DataFrame:
    """JN-09, ENT-03, ENT-08: a loan with what belongs to it; each side is aggregated before it is joined."""
    docs = table(spark, d, "doc_fields").groupBy("loan_id").agg(F.count_distinct("doc_key").alias("n_docs"))
    events = table(spark, d, "audit_log").groupBy("loan_id").agg(F.count_distinct("audit_id").alias("n_events"))
    signed = table(spark, d, "inspections").groupBy("loan_id").agg(F.bool_or("pyhanko_inspection.is_signed").alias("signed"))
    j = records.latest_rows(table(spark, d, "los")).select("loan_id").join(docs, "loan_id", "left").join(events, "loan_id", "left").join(signed, "loan_id", "left")
    return j.select("loan_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("signed", F.lit(False)).alias("signed"))


@add(
    "SELECT inspection_id, coalesce(len(pyhanko_inspection.signatures) > 0 AND len(list_filter(pyhanko_inspection.signatures, lambda s: coalesce(s.intact AND s.valid, false))) = len(pyhanko_inspection.signatures), false) AS accepted FROM inspections"
)
def agg_signatures(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23, SRC-19, CMP-15: accepted if all signatures are intact and valid; none is not accepted."""
    s = F.col("pyhanko_inspection.signatures")
    good = F.forall(s, lambda x: F.coalesce(x["intact"] & x["valid"], F.lit(False)))
    return table(spark, d, "inspections").select("inspection_id", F.coalesce((F.size(s) > 0) & good, F.lit(False)).alias("accepted"))


@add("SELECT doc_id, n_chars, n_chars < 50 AS scanned, CASE WHEN n_chars > 50000 THEN 'reject' ELSE 'accept' END AS guard FROM documents")
def src_guards(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: predicates on size."""
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", "n_chars", (n < 50).alias("scanned"), F.when(n > 50000, "reject").otherwise("accept").alias("guard"))


# --- listing ----------------------------------------------------------------------------------------------------------


@add(f"SELECT loan_id, applicant_name, loan_type FROM {LATEST_LOS} WHERE (contains(lower(loan_id), '77') OR contains(lower(applicant_name), 'kumar')) AND status <> 'ALL' AND loan_amount >= 100000")
def flt_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, FLT-02, FLT-04, FLT-06, FLT-07: search in any of several columns, with filters."""
    newest = records.latest_rows(table(spark, d, "los"))
    hit = F.lower("loan_id").contains("77") | F.lower("applicant_name").contains("kumar")
    return newest.where(hit & (F.col("status") != "ALL") & (F.col("loan_amount") >= 100000)).select("loan_id", "applicant_name", "loan_type")


@add(f"SELECT row_id, {_date('application_date')} AS applied FROM los WHERE {_date('application_date')} BETWEEN '2024-03-01' AND '2024-06-30'")
def flt_dates(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03: a range of days, on normalised dates."""
    return table(spark, d, "los").select("row_id", fn.normalize_date(F.col("application_date")).alias("applied")).where(F.col("applied").between("2024-03-01", "2024-06-30"))


@add("SELECT row_id, emi FROM los ORDER BY emi DESC NULLS FIRST, row_id OFFSET 20 LIMIT 50")
def srt_page(spark: SparkSession, d: str) -> DataFrame:
    """SRT-01, SRT-02: a page of a total order, nulls first where descending."""
    return table(spark, d, "los").select("row_id", "emi").orderBy(F.col("emi").desc_nulls_first(), "row_id").offset(20).limit(50)


@add("SELECT DISTINCT loan_id FROM los WHERE loan_id IS NOT NULL ORDER BY loan_id DESC LIMIT 10")
def srt_recent(spark: SparkSession, d: str) -> DataFrame:
    """SRT-03, SRT-04, SRT-05."""
    return table(spark, d, "los").where("loan_id IS NOT NULL").select("loan_id").distinct().orderBy(F.col("loan_id").desc()).limit(10)


@add("SELECT loan_type, count(*) AS n, count(DISTINCT loan_id) AS loans FROM los WHERE loan_type IS NOT NULL GROUP BY loan_type")
def agg_types(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21."""
    return table(spark, d, "los").where("loan_type IS NOT NULL").groupBy("loan_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("loan_id").alias("loans"))


@add("SELECT loan_id, canon, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, canon ORDER BY created_at NULLS LAST, doc_id) rn FROM (SELECT loan_id, doc_id, created_at, " + _TYPES + " AS canon FROM documents WHERE loan_id IS NOT NULL)) WHERE rn = 1")
def ded_first_of_type(spark: SparkSession, d: str) -> DataFrame:
    """DED-01, DED-03, SRC-24: the first document per loan and canonical type; an aggregate, so a hot loan is combined before the shuffle."""
    dim = {"kyc_pan": "pan", "kyc_address_proof": "aadhaar", "policy_note": "other", "field_report": "other", "complaint_mail": "other"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in dim.items() for x in kv]), F.coalesce("doc_key", F.lit(""))), "doc_key")
    docs = table(spark, d, "documents").where("loan_id IS NOT NULL").select("doc_id", "loan_id", "created_at", kind.alias("canon"))
    first = F.min_by("doc_id", F.struct(F.col("created_at").isNull(), "created_at", "doc_id"))
    return docs.groupBy("loan_id", "canon").agg(first.alias("doc_id"))


@add(
    "SELECT loan_id, kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT loan_id, type AS kind, event_ts AS ts FROM audit_log UNION ALL SELECT loan_id, 'extraction' AS kind, extracted_at AS ts FROM extractions UNION ALL SELECT loan_id, 'inspection' AS kind, inspected_at AS ts FROM inspections) WHERE loan_id IS NOT NULL"
)
def set_events(spark: SparkSession, d: str) -> DataFrame:
    """SET-03: the feed of events of three sources."""
    parts = [table(spark, d, t).select("loan_id", k.alias("kind"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts")) for t, k, ts in
             (("audit_log", F.col("type"), "event_ts"), ("extractions", F.lit("extraction"), "extracted_at"), ("inspections", F.lit("inspection"), "inspected_at"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("loan_id IS NOT NULL")


@add(
    "WITH e AS (SELECT DISTINCT loan_id, event_ts, audit_id, type, error FROM audit_log WHERE loan_id IS NOT NULL AND type IS NOT NULL), r AS (SELECT *, lag(type) OVER (PARTITION BY loan_id ORDER BY event_ts, audit_id, error) AS p FROM e) "
    "SELECT loan_id, arg_max(type, (event_ts, audit_id)) AS current, string_agg(CASE WHEN p IS DISTINCT FROM type THEN type END, '>' ORDER BY event_ts, audit_id) AS history, coalesce(string_agg(DISTINCT error, '|' ORDER BY error), '') AS errors, count(*) AS events FROM r GROUP BY loan_id"
)
def stm_status_fold(spark: SparkSession, d: str) -> DataFrame:
    """STM-02, STM-03, DED-05."""
    return state.fold_status(table(spark, d, "audit_log"))


# --- layout -----------------------------------------------------------------------------------------------------------

_WORD_ROWS = (
    "(SELECT extraction_id, CAST(line // 40 + 1 AS INTEGER) AS page, CAST(line * 1000 + pos AS INTEGER) AS ord, word, pos * 0.05 AS l, (line % 40) * 0.025 AS t, pos * 0.05 + least(length(word) * 0.01, 0.045) AS r, (line % 40) * 0.025 + 0.02 AS b "
    "FROM (SELECT extraction_id, line, j - 1 AS pos, w[j] AS word FROM (SELECT extraction_id, line, w, unnest(range(1, len(w) + 1)) AS j FROM (SELECT extraction_id, i - 1 AS line, string_split(a[i], ' ') AS w FROM "
    "(SELECT extraction_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT extraction_id, string_split(_formatted_text, chr(10)) AS a FROM extractions WHERE _formatted_text IS NOT NULL))))) WHERE word <> '')"
)
TOKENS = f"(SELECT extraction_id, page, ord, word, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r, CAST(b AS DOUBLE) AS b FROM {_WORD_ROWS})"
GRID = f"(SELECT extraction_id, page, c AS cell, (c % 2) * 0.25 AS cl, (c // 2) * 0.25 AS ct, (c % 2) * 0.25 + 0.25 AS cr, (c // 2) * 0.25 + 0.25 AS cb FROM (SELECT DISTINCT extraction_id, page FROM {TOKENS}), range(0, 8) g(c))"
_INTER = "greatest(0.0, least(r, cr) - greatest(l, cl)) * greatest(0.0, least(b, cb) - greatest(t, ct))"
_OVER = f"CASE WHEN (r - l) * (b - t) > 0 THEN {_INTER} / ((r - l) * (b - t)) ELSE 0.0 END"


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of all pages."""
    return layout.tokens(table(spark, d, "extractions"))


def tokens_and_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = pages_of(spark, d)
    return t, layout.cells(t, "extraction_id")


@add(f"SELECT extraction_id, page, count(*) AS n, round(min(l), 4) AS l, round(min(t), 4) AS t, round(max(r), 4) AS r, round(max(b), 4) AS b, count(*) FILTER (length(word) = 1) AS low, count(*) FILTER (length(word) = 1) > 5 AS escalate FROM {TOKENS} GROUP BY extraction_id, page")
def agg_pages(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, GEO-06: per page the tokens, their joint box and the short ones."""
    t, _ = tokens_and_cells(spark, d)
    short = F.count_if(F.length("word") == 1)
    return t.groupBy("extraction_id", "page").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("l"), 4).alias("l"), F.round(F.min("t"), 4).alias("t"), F.round(F.max("r"), 4).alias("r"), F.round(F.max("b"), 4).alias("b"), short.alias("low"), (short > 5).alias("escalate")
    )


@add(
    f"SELECT extraction_id, ord, round(least(1.0, l), 4) AS nl, round({_INTER} / ((r - l) * (b - t) + (cr - cl) * (cb - ct) - {_INTER}), 6) AS iou, round({_OVER}, 6) AS overlap, (r - l <= 1e-4 OR b - t <= 1e-4) AS flat "
    f"FROM {TOKENS} JOIN {GRID} USING (extraction_id, page) WHERE {_INTER} > 0"
)
def geo_boxes(spark: SparkSession, d: str) -> DataFrame:
    """GEO-01, GEO-03, GEO-04, GEO-08: boxes of tokens against the cells they touch."""
    t, g = tokens_and_cells(spark, d)
    a, c = geo.box(), geo.box("c")
    j = t.join(g, ["extraction_id", "page"]).where(geo.intersection(a, c) > 0)
    inside = F.round(geo.normalised(F.col("l"), F.lit(1.0)), 4)
    return j.select("extraction_id", "ord", inside.alias("nl"), F.round(geo.iou(a, c), 6).alias("iou"), F.round(geo.overlap(a, c), 6).alias("overlap"), geo.degenerate(a).alias("flat"))


@add(
    f"SELECT extraction_id, page, cell, string_agg(word, ' ' ORDER BY ord) AS text, count(*) AS n FROM {TOKENS} JOIN {GRID} USING (extraction_id, page) "
    f"WHERE ((l + r) / 2 BETWEEN cl AND cr AND (t + b) / 2 BETWEEN ct AND cb) OR {_OVER} >= 0.40 GROUP BY extraction_id, page, cell"
)
def jn_fuse_cells(spark: SparkSession, d: str) -> DataFrame:
    """JN-10, AGG-20, SNK-10."""
    t, g = tokens_and_cells(spark, d)
    return layout.fuse_cells(t, g, "extraction_id").withColumn("cell", F.col("cell").cast("long"))


@add(f"SELECT extraction_id, page, ord, word FROM {TOKENS} k WHERE NOT EXISTS (SELECT 1 FROM {GRID} g WHERE g.extraction_id = k.extraction_id AND g.page = k.page AND {_OVER} >= 0.60)")
def jn_outside(spark: SparkSession, d: str) -> DataFrame:
    """JN-11, JN-12."""
    t, g = tokens_and_cells(spark, d)
    return layout.outside(t, g, "extraction_id").select("extraction_id", "page", "ord", "word")


@add(f"SELECT extraction_id, page, ord, cell, share FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id, page, ord ORDER BY share DESC, cell) rn FROM (SELECT extraction_id, page, ord, cell, round({_OVER}, 6) AS share FROM {TOKENS} JOIN {GRID} USING (extraction_id, page)) WHERE share > 0) WHERE rn = 1")
def jn_best_cell(spark: SparkSession, d: str) -> DataFrame:
    """JN-15."""
    t, g = tokens_and_cells(spark, d)
    return layout.best_cell(t, g, "extraction_id").withColumn("cell", F.col("cell").cast("long"))


_FRAME = "OVER (PARTITION BY extraction_id, page, t ORDER BY ord ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING)"


@add(
    " UNION ALL ".join(
        f"SELECT extraction_id, page, ord, CAST({k} AS INTEGER) AS k, array_to_string(ws, ' ') AS text, round(r, 4) AS r FROM (SELECT extraction_id, page, ord, list(word) {_FRAME.format(n=k - 1)} AS ws, max(r) {_FRAME.format(n=k - 1)} AS r FROM {TOKENS}) WHERE len(ws) = {k}"
        for k in (2, 3, 4)
    )
)
def win_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06, WIN-11: windows of two to four tokens within a line."""
    return layout.windows(tokens_and_cells(spark, d)[0], "extraction_id").select("extraction_id", "page", "ord", "k", "text", F.round("r", 4).alias("r"))


_AHEAD = "OVER (PARTITION BY extraction_id, page ORDER BY ord ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING)"


@add(
    " UNION ALL ".join(
        f"SELECT extraction_id, page, ord, CAST({k} AS INTEGER) AS k, array_to_string(ws, ' ') AS text, round(l, 4) AS l, round(t, 4) AS t, round(r, 4) AS r, round(b, 4) AS b FROM "
        f"(SELECT extraction_id, page, ord, list(word) {w} AS ws, min(l) {w} AS l, min(t) {w} AS t, max(r) {w} AS r, max(b) {w} AS b, list(t) {w} AS ts, list(b) {w} AS bs FROM {TOKENS}) WHERE len(ws) = {k} "
        f"AND (len(list_filter(range(1, {k}), lambda i: abs(ts[i + 1] - ts[1]) > 0.035)) = 0 OR len(list_filter(range(1, {k}), lambda i: ts[i + 1] - bs[i] > 0.06)) = 0)"
        for k, w in ((k, _AHEAD.format(n=k - 1)) for k in range(2, 8))
    )
)
def win_page_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08: windows of two to seven tokens, also over line ends."""
    out = layout.page_windows(tokens_and_cells(spark, d)[0], "extraction_id")
    return out.select("extraction_id", "page", "ord", "k", "text", *[F.round(c, 4).alias(c) for c in ("l", "t", "r", "b")])


@add(
    f"SELECT extraction_id, page, round(t, 4) AS t, CAST(run AS BIGINT) AS run, count(*) AS n, round(min(l), 4) AS l, round(max(r), 4) AS r FROM (SELECT *, sum(nw) OVER (PARTITION BY extraction_id, page, t ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM "
    f"(SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY extraction_id, page, t ORDER BY ord) > 0.0225 THEN 1 ELSE 0 END AS nw FROM {TOKENS})) GROUP BY extraction_id, page, t, run"
)
def win_islands(spark: SparkSession, d: str) -> DataFrame:
    """WIN-13: lines split where the gap is wide."""
    out = layout.islands(tokens_and_cells(spark, d)[0], "extraction_id", 0.0225)
    return out.select("extraction_id", "page", F.round("t", 4).alias("t"), F.col("run").cast("long").alias("run"), "n", F.round("l", 4).alias("l"), F.round("r", 4).alias("r"))


@add(
    f"SELECT extraction_id, page, round(t, 4) AS t, count(*) AS n, round(stddev_samp(w) / avg(w), 6) AS width_cv, round(stddev_samp(p) / avg(p), 6) AS pitch_cv FROM (SELECT extraction_id, page, t, r - l AS w, l - lag(l) OVER (PARTITION BY extraction_id, page, t ORDER BY ord) AS p FROM {TOKENS}) GROUP BY extraction_id, page, t HAVING count(*) >= 3"
)
def win_uniformity(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05."""
    u = layout.uniformity(tokens_and_cells(spark, d)[0], "extraction_id")
    return u.select("extraction_id", "page", F.round("t", 4).alias("t"), "n", F.round("width_cv", 6).alias("width_cv"), F.round("pitch_cv", 6).alias("pitch_cv"))


@add()
def win_cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01: an ordered fold per page."""
    return layout.cluster_rows(tokens_and_cells(spark, d)[0], "extraction_id")


@add()
def ded_spatial(spark: SparkSession, d: str) -> DataFrame:
    """DED-04: an ordered fold per page."""
    return layout.spatial_dedupe(tokens_and_cells(spark, d)[0], "extraction_id")


@add(
    f"SELECT extraction_id, page, ord, rtrim(word, ':') AS label, value FROM (SELECT *, lead(word) OVER (PARTITION BY extraction_id, page, t ORDER BY ord) AS value, lead(l) OVER (PARTITION BY extraction_id, page, t ORDER BY ord) - r AS dx FROM {TOKENS}) WHERE ends_with(word, ':') AND value IS NOT NULL AND dx <= 0.35"
)
def jn_label_value(spark: SparkSession, d: str) -> DataFrame:
    """JN-13, WIN-21: the value right of a label on its line."""
    return layout.nearest_right(tokens_and_cells(spark, d)[0], "extraction_id")


# --- text quality, tables, weighted groups, adjudication --------------------------------------------------------------

_LINES = "(SELECT extraction_id, CAST(i - 1 AS INTEGER) AS line, a[i] AS s FROM (SELECT extraction_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT extraction_id, string_split(_formatted_text, chr(10)) AS a FROM extractions WHERE _formatted_text IS NOT NULL)))"

def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").where("_formatted_text IS NOT NULL")
    return e.select("extraction_id", F.posexplode(F.split("_formatted_text", "\n")).alias("line", "s"))


@add(
    "SELECT extraction_id, line, CAST(k AS INTEGER) AS pair, c[2 * k + 1 + h] AS field, c[2 * k + 2 + h] AS value FROM (SELECT *, unnest(range(0, (len(c) - h) // 2)) AS k FROM (SELECT *, CASE WHEN regexp_matches(c[1], '^([0-9]{1,3}|[a-zA-Z]|[ivx]+)[.)]?$') OR lower(c[1]) IN ('sr.', 'sr. no.', 'sl no', 'sl. no.', 'no.', 'no') THEN 1 ELSE 0 END AS h "
    f"FROM (SELECT extraction_id, line, list_filter(list_transform(string_split(s, ','), lambda v: trim(v)), lambda v: v <> '') AS c FROM {_LINES}) WHERE len(c) > 0))"
)
def sim_row_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SIM-18: cells of a row read as pairs of field and value, after a leading index cell."""
    cells = F.filter(F.transform(F.split("s", ","), lambda v: F.trim(v)), lambda v: v != "")
    rows = _lines(spark, d).select("extraction_id", "line", cells.alias("c")).where(F.size("c") > 0)
    first = F.col("c")[0]
    head = first.rlike(r"^([0-9]{1,3}|[a-zA-Z]|[ivx]+)[.)]?$") | F.lower(first).isin("sr.", "sr. no.", "sl no", "sl. no.", "no.", "no")
    rows = rows.withColumn("c", F.when(head, F.slice("c", F.lit(2), F.size("c"))).otherwise(F.col("c")))
    pairs = F.filter(F.transform("c", lambda v, i: F.when((i % 2 == 0), F.struct(v.alias("field"), F.try_element_at(F.col("c"), i + 2).alias("value")))), lambda p: p.isNotNull() & p["value"].isNotNull())
    return rows.select("extraction_id", "line", F.posexplode(pairs).alias("pair", "p")).select("extraction_id", "line", "pair", "p.field", "p.value")


_CANDIDATE = r"length(word) <= 4 AND regexp_matches(word, '^[A-Za-z0-9@.,/_#-]+$')"


@add(
    f"SELECT extraction_id, page, n, round(c / n, 6) AS ratio, CASE WHEN n_rows > 1 OR n < 2 THEN 'KEEP' WHEN c / n >= 0.75 THEN 'RECLASSIFY' WHEN c / n >= 0.4 THEN 'AMBIGUOUS' ELSE 'KEEP' END AS shape "
    f"FROM (SELECT extraction_id, page, count(*) AS n, count(DISTINCT t) AS n_rows, count(*) FILTER ({_CANDIDATE}) AS c FROM {TOKENS} GROUP BY extraction_id, page)"
)
def agg_table_shape(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, SIM-19: a page's grid told apart as a table or a row of boxes."""
    t, _ = tokens_and_cells(spark, d)
    short = (F.length("word") <= 4) & F.col("word").rlike("^[A-Za-z0-9@.,/_#-]+$")
    g = t.groupBy("extraction_id", "page").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("n_rows"), F.count_if(short).alias("c"))
    r = F.col("c") / F.col("n")
    shape = F.when((F.col("n_rows") > 1) | (F.col("n") < 2), "KEEP").when(r >= 0.75, "RECLASSIFY").when(r >= 0.4, "AMBIGUOUS").otherwise("KEEP")
    return g.select("extraction_id", "page", "n", F.round(r, 6).alias("ratio"), shape.alias("shape"))


@add(
    "SELECT extraction_id, block, kind, min(line) AS first_line, max(line) AS last_line, count(*) AS n FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY extraction_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM "
    f"(SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY extraction_id ORDER BY line) THEN 1 ELSE 0 END AS nw FROM (SELECT extraction_id, line, CASE WHEN contains(s, ':') THEN 'pairs' WHEN trim(s) = '' THEN 'blank' ELSE 'text' END AS kind FROM {_LINES}))) GROUP BY extraction_id, block, kind"
)
def win_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent lines of one kind merged into blocks; a window within a text."""
    kind = F.when(F.col("s").contains(":"), "pairs").when(F.trim("s") == "", "blank").otherwise("text")
    w = W.partitionBy("extraction_id").orderBy("line")
    marked = _lines(spark, d).select("extraction_id", "line", kind.alias("kind"))
    marked = marked.withColumn("_new", (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")).withColumn("block", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("extraction_id", "block", "kind").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n"))


#: Groups of checks with the weight of each field (a relation; a field that a group does not name weighs nothing).
GROUPS = (
    ("identity", "aadhaar_number", 2.0), ("identity", "pan_number", 2.0), ("identity", "dob", 1.0), ("identity", "mobile_no", 1.0),
    ("terms", "loan_amount", 2.0), ("terms", "emi", 1.0), ("terms", "irr_percent", 1.0), ("terms", "loan_validity", 1.0),
    ("references", "application_no", 1.0), ("references", "loan_no", 1.0), ("references", "account_no", 1.0),
)
_GROUPS = ", ".join(f"('{g}', '{f}', {w})" for g, f, w in GROUPS)


@add(
    f"SELECT loan_id, grp, round(sum(weight * CASE status WHEN 'MATCH' THEN 1.0 ELSE 0.0 END) / sum(weight), 6) AS score, count(*) AS checks FROM "
    f"(SELECT r.*, g.grp, CAST(g.weight AS DOUBLE) AS weight FROM {RECORDS} r JOIN (VALUES {_GROUPS}) g(grp, field, weight) ON g.field = r.field) WHERE status <> 'NOT_FOUND' GROUP BY loan_id, grp"
)
def agg_weighted(spark: SparkSession, d: str) -> DataFrame:
    """JN-04, JN-05, AGG-04, AGG-05, AGG-07: the weighted share of matches per group of fields."""
    spec = spark.createDataFrame(list(GROUPS), "grp string, field string, weight double")
    r = all_checks(spark, d).where("status <> 'NOT_FOUND'").join(F.broadcast(spec), "field")
    score = F.sum(F.col("weight") * (F.col("status") == "MATCH").cast("double")) / F.sum("weight")
    return r.groupBy("loan_id", "grp").agg(F.round(score, 6).alias("score"), F.count(F.lit(1)).alias("checks"))


_VERDICTS = "(SELECT loan_id, field_type AS field, adjudication_status AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, field_type ORDER BY event_ts DESC NULLS LAST, audit_id DESC) rn FROM audit_log WHERE loan_id IS NOT NULL AND field_type IS NOT NULL AND adjudication_status IS NOT NULL) WHERE rn = 1)"


@add(
    f"SELECT loan_id, count(*) FILTER (verdict IS NOT NULL AND verdict <> status) AS changed, count(*) FILTER (coalesce(verdict, status) = 'MISMATCH') AS n_mismatch, CASE WHEN bool_or(coalesce(verdict, status) = 'MISMATCH') THEN 'Discrepancy' WHEN bool_or(coalesce(verdict, status) <> 'MATCH') THEN 'Indeterminate' ELSE 'Verified' END AS rollup "
    f"FROM (SELECT r.loan_id, r.status, v.verdict FROM {RECORDS} r LEFT JOIN {_VERDICTS} v ON v.loan_id = r.loan_id AND v.field = r.field) GROUP BY loan_id"
)
def ent_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """CMP-16, JN-21, ENT-06, AGG-11: the last adjudication of a loan's field replaces its status before the rollup."""
    a = table(spark, d, "audit_log").where("loan_id IS NOT NULL AND field_type IS NOT NULL AND adjudication_status IS NOT NULL")
    last = a.groupBy("loan_id", F.col("field_type").alias("field")).agg(F.max_by("adjudication_status", F.struct("event_ts", "audit_id")).alias("verdict"))
    r = all_checks(spark, d).join(last, ["loan_id", "field"], "left").withColumn("now", F.coalesce("verdict", "status"))
    n = r.groupBy("loan_id").agg(F.count_if(F.col("verdict").isNotNull() & (F.col("verdict") != F.col("status"))).alias("changed"), F.count_if(F.col("now") == "MISMATCH").alias("n_mismatch"), F.count_if(F.col("now") != "MATCH").alias("_open"))
    state_of = F.when(F.col("n_mismatch") > 0, "Discrepancy").when(F.col("_open") > 0, "Indeterminate").otherwise("Verified")
    return n.select("loan_id", "changed", "n_mismatch", state_of.alias("rollup"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
