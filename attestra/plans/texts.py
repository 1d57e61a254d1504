"""Queries of the functions on single values and lines of text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import geometry as geo
from attestra.functions import normalise as fn
from attestra.functions import similarity as sim
from attestra.functions import textquality as quality
from attestra.operators import records
from attestra.plans import catalogue
from attestra.plans.catalogue import LATEST_FIELDS, LATEST_LOS, add, name_pairs, pages_of
from attestra.session import table

#: Lines of extracted texts and of template records' values: the same in SQL.
LINES = "(SELECT extraction_id, CAST(i - 1 AS INTEGER) AS line, a[i] AS s FROM (SELECT extraction_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT extraction_id, string_split(_formatted_text, chr(10)) AS a FROM extractions WHERE _formatted_text IS NOT NULL)))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").where("_formatted_text IS NOT NULL")
    return e.select("extraction_id", F.posexplode(F.split("_formatted_text", "\n")).alias("line", "s"))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- normalisers ------------------------------------------------------------------------------------------------------


@add(
    "SELECT row_id, CASE WHEN s IS NULL OR lower(s) IN ('', 'none', 'null', 'n/a') THEN 'N/A' WHEN contains(lower(s), 'month') THEN trim(regexp_replace(s, '(?i)(\\s*\\bmonths?\\b)+', ' Months', 'g')) ELSE s || ' Months' END AS shown "
    "FROM (SELECT row_id, trim(loan_validity) AS s FROM los)"
)
def fn_tenure_text(spark: SparkSession, d: str) -> DataFrame:
    """FN-17."""
    return table(spark, d, "los").select("row_id", fn.tenure_text(F.col("loan_validity")).alias("shown"))


@add(
    "SELECT loan_id, seconds, CASE WHEN seconds >= 60 THEN printf('%dm %02ds', CAST(seconds // 60 AS INTEGER), CAST(seconds % 60 AS INTEGER)) ELSE printf('%ds', CAST(seconds AS INTEGER)) END AS shown FROM (SELECT loan_id, CASE WHEN d IS NOT NULL AND d >= 0 THEN greatest(1, CAST(round_even(d, 0) AS INTEGER)) ELSE greatest(1, CAST(2 * n AS INTEGER)) END AS seconds "
    "FROM (SELECT loan_id, count(DISTINCT type) AS n, (epoch_us(max(CASE WHEN type = 'human_adjudication' THEN event_ts END)) - epoch_us(min(CASE WHEN type = 'llm_adjudication' THEN event_ts END))) / 1000000.0 AS d FROM audit_log WHERE loan_id IS NOT NULL GROUP BY loan_id))"
)
def fn_duration(spark: SparkSession, d: str) -> DataFrame:
    """FN-22: how long a loan was in work: from its first to its last step, at least a second; two seconds a step where a time is missing."""
    at = lambda f, kind: f(F.when(F.col("type") == kind, F.unix_micros("event_ts")))
    spans = table(spark, d, "audit_log").where("loan_id IS NOT NULL").groupBy("loan_id").agg(
        F.count_distinct("type").alias("n"), ((at(F.max, "human_adjudication") - at(F.min, "llm_adjudication")) / 1000000.0).alias("d")
    )
    seconds = F.when(F.col("d") >= 0, F.greatest(F.lit(1), F.bround("d", 0).cast("int"))).otherwise(F.greatest(F.lit(1), (2 * F.col("n")).cast("int")))
    return spans.select("loan_id", seconds.alias("seconds")).select("loan_id", "seconds", fn.duration_text(F.col("seconds")).alias("shown"))


_MASK = r"regexp_replace(regexp_replace(_formatted_text, '\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?([0-9]{4})\b', 'XXXX-XXXX-\1', 'g'), '\b[A-Z]{5}([0-9]{4}[A-Z])\b', 'XXXXX\1', 'g')"
for _n in range(10, 19):
    _MASK = f"regexp_replace({_MASK}, '\\b[0-9]{{{_n - 4}}}([0-9]{{4}})\\b', '{'X' * (_n - 4)}\\1', 'g')"


@add(f"SELECT extraction_id, {_MASK} AS masked FROM extractions")
def fn_mask_pii(spark: SparkSession, d: str) -> DataFrame:
    """FN-24: identity, tax and account numbers masked, in this order."""
    return table(spark, d, "extractions").select("extraction_id", fn.mask_pii(F.col("_formatted_text")).alias("masked"))


_LOG = "coalesce(reason, '') || ' token = ' || audit_id || ' ' || coalesce(value_a, '') || ' 123412341234 ABCDE1234F'"


@add(
    rf"SELECT audit_id, regexp_replace(regexp_replace(regexp_replace({_LOG}, '\b[0-9]{{4}}\s?[0-9]{{4}}\s?[0-9]{{4}}\b', '[REDACTED-AADHAAR]', 'g'), '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b', '[REDACTED-PAN]', 'g'), "
    rf"'(?i)(api_key|secret|password|token)\s*=\s*[\x22'']?[a-zA-Z0-9_-]+[\x22'']?', '\1=[REDACTED-SECRET]', 'g') AS line FROM audit_log"
)
def fn_redact_log(spark: SparkSession, d: str) -> DataFrame:
    """FN-25: identity and tax numbers and secrets of log lines replaced."""
    none = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(none(F.col("reason")), F.lit(" token = "), F.col("audit_id").cast("string"), F.lit(" "), none(F.col("value_a")), F.lit(" 123412341234 ABCDE1234F"))
    return table(spark, d, "audit_log").select("audit_id", fn.redact_log(line).alias("line"))


_ANSWER = "'<think>' || doc_key || ' {' || '</think> ' || CASE WHEN extraction_id % 3 = 0 THEN 'Here: ```json' || chr(10) || _formatted_text || chr(10) || '``` done' WHEN extraction_id % 3 = 1 THEN 'so ' || _formatted_text || ' ok' ELSE _formatted_text END"


@add(
    f"SELECT extraction_id, CASE WHEN coalesce(a, '') = '' THEN '{{}}' WHEN regexp_extract(s, '(?s)```(?:json)?\\s*(\\{{.*\\}}|\\[.*\\])\\s*```', 1) <> '' THEN trim(regexp_extract(s, '(?s)```(?:json)?\\s*(\\{{.*\\}}|\\[.*\\])\\s*```', 1)) "
    f"WHEN regexp_extract(s, '(?s)(\\{{.*\\}}|\\[.*\\])', 1) <> '' THEN trim(regexp_extract(s, '(?s)(\\{{.*\\}}|\\[.*\\])', 1)) ELSE s END AS json FROM (SELECT extraction_id, a, trim(regexp_replace(trim(a), '(?s)<think>.*?</think>', '', 'g')) AS s FROM (SELECT extraction_id, {_ANSWER} AS a FROM extractions))"
)
def fn_json_response(spark: SparkSession, d: str) -> DataFrame:
    """FN-26: the JSON inside a model's answer."""
    t, n = F.col("_formatted_text"), F.col("extraction_id") % 3
    said = F.when(n == 0, F.concat(F.lit("Here: ```json\n"), t, F.lit("\n``` done"))).when(n == 1, F.concat(F.lit("so "), t, F.lit(" ok"))).otherwise(t)
    answer = F.concat(F.lit("<think>"), "doc_key", F.lit(" {</think> "), said)
    return table(spark, d, "extractions").select("extraction_id", fn.json_response(answer).alias("json"))


@add(
    "SELECT audit_id, CASE WHEN contains(lower(m), 'groq/') AND starts_with(lower(m), 'groq/') THEN 'groq' WHEN starts_with(k, 'sk-or-') THEN 'openrouter' WHEN contains(lower(m), 'gemini') THEN 'gemini' WHEN contains(m, '/') THEN 'openrouter' ELSE 'openai_compatible' END AS provider "
    "FROM (SELECT audit_id, coalesce(model, '') AS m, CASE WHEN audit_id % 5 = 0 THEN 'sk-or-x' ELSE '' END AS k FROM audit_log)"
)
def fn_provider(spark: SparkSession, d: str) -> DataFrame:
    """FN-27."""
    key = F.when(F.col("audit_id") % 5 == 0, "sk-or-x").otherwise("")
    return table(spark, d, "audit_log").select("audit_id", fn.provider(F.col("model"), key, F.lit(None).cast("string")).alias("provider"))


_TEMPLATE = {
    "applicant_name": "applicant_name customer_name borrower_name full_name name", "fathers_name": "fathers_name", "dob": "dob", "mobile_no": "mobile_no", "gender": "gender", "aadhaar_number": "aadhaar_number aadhaar",
    "pan_number": "pan_number pan", "address": "address address_text", "current_address": "current_address", "bank_account_no": "bank_account_no account_no", "type_of_account": "type_of_account",
    "loan_amount": "loan_amount sanctioned_amount funding_amount disbursal_amount requested_loan_amount", "loan_validity": "loan_validity tenure_months tenure tenor tenure_of_loan", "loan_type": "loan_type type_of_loan end_use purpose_of_loan",
    "application_no": "application_no loan_no loan_account_no application_id loan_id appl_no los_id", "application_date": "application_date", "BPI": "BPI bpi broken_period_interest", "irr_percent": "irr_percent roi interest_rate irr", "emi": "emi",
}


def _first_of(names: str) -> str:
    return f"arg_min(value, list_position(string_split('{names}', ' '), field)) FILTER (list_contains(string_split('{names}', ' '), field) AND value IS NOT NULL)"


@add(
    f"SELECT loan_id, doc_key, {', '.join(f'{_first_of(n)} AS {f}' for f, n in _TEMPLATE.items())}, coalesce(lower({_first_of('customer_consent consent is_consented otp_consent borrower_consent customer_acceptance')}) NOT IN ('', 'false', '0', '0.0'), false) AS customer_consent FROM {LATEST_FIELDS} GROUP BY loan_id, doc_key"
)
def fn_template(spark: SparkSession, d: str) -> DataFrame:
    """FN-28, FLT-12, UDTF-02: the fields of each document in the fixed template of twenty."""
    f = records.latest_fields(table(spark, d, "doc_fields"))
    maps = f.groupBy("loan_id", "doc_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    return maps.select("loan_id", "doc_key", *[c.alias(n) for n, c in fn.template(F.col("m")).items()])


_ALIASES = {c: n for c, n in records.DOCUMENT_ALIASES.items()}
_FILE = "CASE doc_id % 6 WHEN 0 THEN source || '/' || doc_key || '.pdf' WHEN 1 THEN lower(coalesce(loan_id, 'loan_7')) || '_' || doc_key || '.v2.pdf' WHEN 2 THEN replace(doc_key, '_', ' ') || ' final.PDF' WHEN 3 THEN 'Aadhaar_' || doc_key || '.xml' WHEN 4 THEN 'bt_' || doc_key ELSE doc_key END"
_ALIAS_SQL = catalogue.FILED_AS
_CANON = (
    "(SELECT x.*, coalesce(a.canon, b.canon, c.canon, CASE WHEN contains(stem, 'xml') AND (contains(stem, 'aadhaar') OR contains(stem, 'aadhar')) THEN 'aadhaar_xml' WHEN contains(stem, 'aadhaar') OR contains(stem, 'aadhar') THEN 'aadhaar' "
    "WHEN contains(stem, 'kfs') OR contains(stem, 'key') AND contains(stem, 'fact') THEN 'kfs' WHEN contains(stem, 'sanction') THEN 'sanction_letter' WHEN contains(stem, 'agreement') THEN 'loan_agreement' WHEN contains(stem, 'memo') OR contains(stem, 'disbursal') THEN 'disbursal_memo' "
    "WHEN contains(stem, 'statement') OR contains(stem, 'bank') THEN 'account_statement' WHEN contains(stem, 'vkyc') THEN 'vkyc' WHEN contains(stem, 'bt') OR contains(stem, 'foreclosure') THEN 'bt_details' WHEN contains(stem, 'pan') THEN 'pan' "
    "WHEN contains(stem, 'application') OR regexp_matches(bare, '(?:^|_)app(?:lication)?(?:_|$)') THEN 'application_form' ELSE stem END) AS canon "
    "FROM (SELECT doc_id, f, stem, regexp_replace(stem, '^(?:appl\\d+|loan_\\d+|[a-z0-9]+)_(.+)$', '\\1') AS bare FROM (SELECT doc_id, f, trim(lower(regexp_replace(regexp_extract(f, '([^/]+)/*$', 1), '(.)\\.[^.]*$', '\\1'))) AS stem "
    f"FROM (SELECT doc_id, {_FILE} AS f FROM documents WHERE doc_key IS NOT NULL))) x LEFT JOIN (VALUES {_ALIAS_SQL}) a(name, canon, rank) ON a.name = stem LEFT JOIN (VALUES {_ALIAS_SQL}) b(name, canon, rank) ON b.name = bare LEFT JOIN (VALUES {_ALIAS_SQL}) c(name, canon, rank) ON c.name = replace(stem, ' ', '_'))"
)
_SHOWN = " ".join(
    f"WHEN '{k}' THEN '{v}'"
    for k, v in (
        ("aadhaar", "Aadhaar"), ("aadhaar_xml", "Aadhaar XML"), ("pan", "PAN Card"), ("application_form", "Application Form"), ("account_statement", "Bank Statement"), ("kfs", "Key Fact Statement (KFS)"),
        ("sanction_letter", "Sanction Letter"), ("loan_agreement", "Loan Agreement"), ("disbursal_memo", "Disbursal Memo"), ("vkyc", "VKYC Audit Trail"), ("bt_details", "BT Foreclosure Details"),
    )
)
_TITLED = "array_to_string(list_transform(string_split(replace(canon, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


def _files(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_key"), F.col("doc_id") % 6
    f = (
        F.when(n == 0, F.concat("source", F.lit("/"), k, F.lit(".pdf"))).when(n == 1, F.concat(F.lower(F.coalesce("loan_id", F.lit("loan_7"))), F.lit("_"), k, F.lit(".v2.pdf")))
        .when(n == 2, F.concat(F.replace(k, F.lit("_"), F.lit(" ")), F.lit(" final.PDF"))).when(n == 3, F.concat(F.lit("Aadhaar_"), k, F.lit(".xml"))).when(n == 4, F.concat(F.lit("bt_"), k)).otherwise(k)
    )
    return table(spark, d, "documents").where(k.isNotNull()).select("doc_id", f.alias("f"))


@add(
    f"SELECT doc_id, canon AS doc_type, CASE canon {_SHOWN} ELSE {_TITLED} END AS shown, canon NOT IN ('aadhaar', 'pan', 'voter_id', 'passport', 'driving_license') AS tabular, contains(lower(f), 'agreement') OR canon = 'loan_agreement' AS agreement, "
    f"CASE WHEN canon IN ('aadhaar', 'pan', 'pan_card', 'dl', 'driving_license', 'voter_id', 'passport') THEN 'identity_document' WHEN canon = 'application_form' THEN CASE WHEN coalesce(scanned, false) THEN 'scanned_character_box_forms' ELSE 'character_box_forms' END "
    f"WHEN scanned THEN 'scanned_documents' WHEN NOT scanned THEN 'digital_pdf' WHEN canon IN ('bank_statement', 'salary_slip') THEN 'scanned_documents' WHEN canon IN ('loan_agreement', 'sanction_letter', 'nach_mandate') THEN 'digital_pdf' ELSE 'mixed_content' END AS profile, "
    f"replace(replace(regexp_replace(regexp_replace(lower(f), '^doc-[a-z0-9_-]+_', ''), '^(aadhaar|aadhar|adhar)[_\\s-]+', ''), 'aadhaar', 'aadhar'), 'adhar', 'aadhar') AS name "
    f"FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS scanned FROM {_CANON})"
)
def fn_document_kind(spark: SparkSession, d: str) -> DataFrame:
    """FN-11, FN-12, FN-13, FN-14, FN-29, FN-30, FN-31: what a file's name says of the document."""
    kind = _files(spark, d).withColumn("doc_type", fn.canonical_type(F.col("f"), _ALIASES))
    scanned = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    c = F.col("doc_type")
    return kind.select(
        "doc_id", "doc_type", fn.display_name(c).alias("shown"), (~c.isin("aadhaar", "pan", "voter_id", "passport", "driving_license")).alias("tabular"),
        (F.lower("f").contains("agreement") | (c == "loan_agreement")).alias("agreement"), fn.layout_profile(c, scanned).alias("profile"), fn.doc_name(F.col("f")).alias("name"),
    )


_FORMS = """
('application_no', 10, 15, '^[A-Z0-9\\-_/]{10,15}$', '\\p{Ll}'), ('bank_account_no', 9, 18, '^[0-9]{9,18}$', '\\p{Lu}|\\p{Ll}|[^\\p{L}\\p{N}]'), ('aadhaar_number', 12, 12, '^[0-9]{12}$', '\\p{Lu}|\\p{Ll}|[^\\p{L}\\p{N}]'),
('pan_number', 10, 10, '^[A-Z]{5}[0-9]{4}[A-Z]$', '\\p{Ll}|[^\\p{L}\\p{N}]'), ('loan_amount', 5, 10, '^[0-9]{5,10}$', '\\p{Lu}|\\p{Ll}|[^\\p{L}\\p{N}]'), ('mobile_no', 10, 10, '^[0-9]{10}$', '\\p{Lu}|\\p{Ll}|[^\\p{L}\\p{N}]'),
('ifsc_code', 11, 11, '^[A-Z]{4}0[A-Z0-9]{6}$', '\\p{Ll}|[^\\p{L}\\p{N}]')
"""


@add(
    f"SELECT field_id, CASE WHEN v = '' THEN false WHEN least_n IS NULL THEN true ELSE c >= 0.5 AND m END AS valid, CAST(round(CASE WHEN v = '' THEN 0.0 WHEN least_n IS NULL THEN 0.8 ELSE c END, 3) AS DOUBLE) AS confidence, "
    f"CASE WHEN v = '' THEN false WHEN least_n IS NULL THEN true WHEN NOT fits OR NOT m THEN false ELSE c >= 0.5 AND m END AS strict_valid, CAST(round(CASE WHEN v = '' THEN 0.0 WHEN least_n IS NULL THEN 0.8 WHEN NOT fits THEN 0.3 WHEN NOT m THEN 0.4 ELSE c END, 3) AS DOUBLE) AS strict_confidence "
    f"FROM (SELECT *, CASE WHEN field_id % 4 = 0 THEN least(1.0, c0 * 1.1) ELSE c0 END AS c FROM (SELECT *, CAST(CASE WHEN fits THEN 1.0 WHEN least_n = most_n THEN 0.6 ELSE 0.7 END AS DOUBLE) * CASE WHEN m THEN 1.0 ELSE 0.5 END * CASE WHEN NOT regexp_matches(v, bad) THEN 1.0 ELSE 0.8 END AS c0 FROM ("
    f"SELECT f.field_id, trim(f.value) AS v, k.least_n, k.most_n, k.bad, length(trim(f.value)) BETWEEN k.least_n AND k.most_n AS fits, regexp_matches(trim(f.value), k.pattern) AS m FROM (SELECT field_id, CASE field WHEN 'account_no' THEN 'bank_account_no' ELSE field END AS field, value FROM doc_fields WHERE value IS NOT NULL) f LEFT JOIN (VALUES {_FORMS}) k(field, least_n, most_n, pattern, bad) USING (field))))"
)
def fn_field_valid(spark: SparkSession, d: str) -> DataFrame:
    """FN-32, AGG-15: form, length and characters of all fields' values, leniently and strictly; every fourth as if read from boxes."""
    f = table(spark, d, "doc_fields").where("value IS NOT NULL")
    name = F.when(F.col("field") == "account_no", "bank_account_no").otherwise(F.col("field"))
    return f.select("field_id", fn.field_form(name, F.col("value"), F.col("field_id") % 4 == 0).alias("x")).select("field_id", "x.*")


# --- similarity and recall --------------------------------------------------------------------------------------------

_ASCII = "trim(regexp_replace(lower(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"


@add(
    f"SELECT loan_id, CAST(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, levenshtein(b, a) / length(a)) END AS DOUBLE) AS cer FROM ("
    f"SELECT l.loan_id, {_ASCII.format(x='l.applicant_name')} AS a, {_ASCII.format(x='c.value')} AS b FROM {LATEST_LOS} l JOIN {catalogue.CARD} c USING (loan_id) WHERE l.applicant_name IS NOT NULL AND c.value IS NOT NULL)"
)
def sim_cer(spark: SparkSession, d: str) -> DataFrame:
    """SIM-04, SIM-06: character error rate of normalised names."""
    return name_pairs(spark, d).select("loan_id", sim.char_error_rate(sim.ascii_normal(F.col("a")), sim.ascii_normal(F.col("b"))).alias("cer"))


_NORMAL = "trim(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'))"


@add(
    f"SELECT field_id, CASE WHEN v = '' OR contains(p, v) THEN 'exact' WHEN contains(replace(p, ' ', ''), replace(v, ' ', '')) THEN 'compact' "
    f"WHEN length(w) > 0 AND len(list_filter(range(0, greatest(1, length(p) - 2 * length(v) + 1)), lambda i: levenshtein({_ASCII.format(x='substr(p, CAST(i + 1 AS BIGINT), length(v) + 8)')}, w) <= 0.25 * length(w))) > 0 THEN 'near' END AS how "
    f"FROM (SELECT field_id, {_NORMAL.format(x='e.t')} AS p, {_NORMAL.format(x='f.value')} AS v, {_ASCII.format(x=_NORMAL.format(x='f.value'))} AS w FROM doc_fields f JOIN (SELECT loan_id, doc_key, max(_formatted_text) AS t FROM extractions WHERE loan_id IS NOT NULL GROUP BY loan_id, doc_key) e USING (loan_id, doc_key) WHERE value IS NOT NULL)"
)
def sim_field_recall(spark: SparkSession, d: str) -> DataFrame:
    """SIM-07, FN-33: how a field's value stands in the document's text: as it is, without blanks, or nearly in a window."""
    e = table(spark, d, "extractions").where("loan_id IS NOT NULL").groupBy("loan_id", "doc_key").agg(F.max("_formatted_text").alias("t"))
    f = table(spark, d, "doc_fields").where("value IS NOT NULL")
    return f.join(e, ["loan_id", "doc_key"]).select("field_id", sim.recalled(F.col("t"), F.col("value")).alias("how"))


_N = {k: f"(length(s) - length(regexp_replace(s, '{r}', '', 'g')))" for k, r in sim.SCRIPTS.items()}
_TOTAL = " + ".join(_N.values())
_SCRIPT = (
    "CASE WHEN s = '' THEN 'unknown' WHEN n = 0 THEN 'latin' WHEN dv > 0 AND la > 0 AND dv / n >= 0.20 AND la / n >= 0.20 THEN 'mixed' WHEN dv > 0 AND la > 0 AND dv > la THEN 'devanagari' WHEN dv > 0 AND la > 0 THEN 'latin' WHEN dv > 0 AND dv / n >= 0.15 THEN 'devanagari' "
    "WHEN ka > 0 OR ha > 0 AND (CASE WHEN ka > 0 THEN ka + ha ELSE 0 END) / n >= 0.20 THEN 'japanese' WHEN ko > 0 THEN 'korean' WHEN ka = 0 AND ha / n >= 0.30 THEN 'chinese' ELSE 'latin' END"
)
_SURE = (
    "CASE WHEN s = '' THEN 1.0 WHEN n = 0 THEN 0.9 ELSE floor(CASE WHEN dv > 0 AND la > 0 THEN CASE WHEN dv / n >= 0.20 AND la / n >= 0.20 THEN greatest(dv / n, la / n) WHEN dv > la THEN dv / n ELSE la / n END WHEN dv > 0 AND dv / n >= 0.15 THEN dv / n "
    "WHEN ka > 0 THEN (ka + ha) / n WHEN ko > 0 THEN ko / n WHEN ka = 0 AND ha / n >= 0.30 THEN ha / n WHEN la > 0 THEN la / n ELSE 0.9 END * 100 + 0.5) / 100 END"
)


@add(
    f"SELECT doc_id, script, CAST({_SURE} AS DOUBLE) AS confidence, dv > 0 AND la > 0 AS mixed, s <> '' AND CASE WHEN e = 'hindi' THEN dv = 0 AND script = 'latin' ELSE dv > 0 END AS mismatch FROM (SELECT *, {_SCRIPT} AS script FROM "
    f"(SELECT doc_id, e, s, {_N['devanagari']} AS dv, {_N['latin']} AS la, {_N['kana']} AS ka, {_N['han']} AS ha, {_N['hangul']} AS ko, {_TOTAL} AS n FROM (SELECT doc_id, trim(text) AS s, CASE WHEN lower(coalesce(lang, '')) LIKE 'hi%' THEN 'hindi' ELSE 'english' END AS e FROM documents WHERE text IS NOT NULL)))"
)
def sim_script(spark: SparkSession, d: str) -> DataFrame:
    """SIM-13, SIM-14: the script of each text, and whether its label leads to expect another."""
    expected = F.when(F.lower(F.coalesce("lang", F.lit(""))).startswith("hi"), "hindi").otherwise("english")
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    out = docs.select("doc_id", sim.script_of(F.col("text")).alias("x"), sim.script_mismatch(expected, F.col("text")).alias("mismatch"))
    return out.select("doc_id", "x.script", "x.confidence", "x.mixed", "mismatch")


_ID = sim.IDENTIFIER
_MIXED = "len(list_filter(regexp_extract_all(s, '[A-Za-z0-9]{6,}'), lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]'))) > 0"


@add(
    f"SELECT extraction_id, line, trim(s) <> '' AND (regexp_matches(s, '{_ID}') OR regexp_matches(s, '[^@\\s]+@[^@\\s]+\\.[A-Za-z]{{2,}}') OR regexp_matches(s, '[0-9]{{5,}}') OR {_MIXED}) AS recoverable, "
    f"regexp_extract(upper(s), '([A-Z0-9]{{10}})', 1) <> '' AND (contains(upper(s), 'PAN') OR contains(upper(s), 'PERMANENT ACCOUNT')) AND NOT regexp_matches(regexp_extract(upper(s), '([A-Z0-9]{{10}})', 1), '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AS ambiguous FROM {LINES}"
)
def sim_recoverable(spark: SparkSession, d: str) -> DataFrame:
    """SIM-15, FN-33, FLT-08: lines with a value worth keeping, and lines with a tax number that is none."""
    s = F.col("s")
    return lines(spark, d).select("extraction_id", "line", sim.recoverable(s).alias("recoverable"), sim.ambiguous_pan(s).alias("ambiguous"))


_W = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
_WORDY = f"(len({_W.format(x='lower(t)')}) >= 2 AND len(list_filter({_W.format(x='lower(t)')}, lambda w: w IN ({_quoted(sim.AMOUNT_WORDS)}))) >= 1 AND 2 * len(list_filter({_W.format(x='lower(t)')}, lambda w: w IN ({_quoted(sim.AMOUNT_WORDS)}))) >= len({_W.format(x='lower(t)')}))"
_HOLDS = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
DEFINITE = f"(regexp_matches(t, '^[0-9,.]+$') OR NOT regexp_matches(t, '\\s') AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') OR {_WORDY} OR {_HOLDS('lower(t)', sim.BANKS)} OR regexp_matches(t, '\\b[0-9]{{1,2}}[-/.](?:[A-Za-z]{{3}}|[0-9]{{1,2}})[-/.][0-9]{{2,4}}\\b'))"
FORM_LABEL = (
    f"(t <> '' AND length(t) <= 55 AND len({_W.format(x='t')}) <= 6 AND NOT {DEFINITE} AND bare NOT IN ({_quoted(sim.SECTION_HEADERS)}) AND NOT {_HOLDS('bare', sim.BRANDING_KEYWORDS)} AND ({_HOLDS('bare', sim.KNOWN_LABELS)} OR ends_with(t, ':') "
    f"OR len({_W.format(x='t')}) <= 4 AND regexp_matches(t, '^\\p{{Lu}}') AND NOT {_HOLDS('lower(t)', sim.NO_LABELS)} AND {_HOLDS('lower(t)', sim.LABEL_INDICATORS)}))"
)
_CELLS = f"(SELECT extraction_id, line, pos, t, trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_\\s/]', '', 'g')) AS bare FROM (SELECT extraction_id, line, CAST(j - 1 AS INTEGER) AS pos, trim(c[j]) AS t FROM (SELECT extraction_id, line, c, unnest(range(1, len(c) + 1)) AS j FROM (SELECT extraction_id, line, regexp_split_to_array(s, '[:;,]') AS c FROM {LINES}))))"
_LETTERS = "length(regexp_replace(t, '[^\\p{L}]', '', 'g'))"


@add(
    f"SELECT extraction_id, line, pos, {DEFINITE} AS definite, {_WORDY} AS amount_words, {FORM_LABEL} AS label, (length(t) > 40 AND NOT contains(t, ' ') OR {_LETTERS} > 20 AND length(regexp_replace(lower(t), '[^aeiou]', '', 'g')) / {_LETTERS} < 0.15) AS gibberish, "
    f"CASE WHEN k = '' THEN 'field' ELSE k END AS key FROM (SELECT *, regexp_replace(lower(trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))), '\\s+', '_', 'g') AS k FROM {_CELLS})"
)
def sim_form_parts(spark: SparkSession, d: str) -> DataFrame:
    """SIM-16: what the parts of a form's lines are: values, amounts in words, labels, noise; and each as a key."""
    cells = lines(spark, d).select("extraction_id", "line", F.posexplode(F.split("s", "[:;,]")).alias("pos", "c")).withColumn("t", F.trim("c"))
    t = F.col("t")
    return cells.select(
        "extraction_id", "line", "pos", sim.definite_value(t).alias("definite"), sim.amount_in_words(t).alias("amount_words"), sim.form_label(t).alias("label"), sim.gibberish(t).alias("gibberish"), sim.label_key(t).alias("key")
    )


_RUNS = f"list_filter(regexp_extract_all(t, '[A-Z0-9]{{4,}}'), lambda r: r <> t AND (length(regexp_replace(r, '[^0-9]', '', 'g')) >= 2 OR NOT regexp_matches(r, '[0-9]') AND r NOT IN ({_quoted(sim.CAPITAL_LABELS)})))"


@add(
    f"SELECT extraction_id, line, array_to_string({_RUNS}, '|') AS runs, length(t) >= 8 AND regexp_matches(t, '[A-Za-z:]') AND length(t) * 0.01 > 0 AND length(t) * 0.01 / 0.02 >= 6.0 AND len({_RUNS}) > 0 AS fused FROM (SELECT extraction_id, line, trim(s) AS t FROM {LINES})"
)
def sim_fused_rows(spark: SparkSession, d: str) -> DataFrame:
    """SIM-20: lines that are rows of character boxes read as one, and the values in them."""
    s = F.col("s")
    width = F.length(F.trim(s)) * 0.01
    return lines(spark, d).select("extraction_id", "line", F.array_join(sim.value_runs(s), "|").alias("runs"), sim.fused_row(s, width, F.lit(0.02)).alias("fused"))


# --- quality of recognised text ---------------------------------------------------------------------------------------

_Q = {k: getattr(quality, k).replace("'", "''") for k in ("FOREIGN_SYMBOLS", "ONLY_SYMBOLS", "REPEATED", "MISREAD_NGRAMS", "MISREAD_TOKENS", "CJK", "CONSONANTS", "SYMBOL", "SCRIPT", "LETTER", "BLOB", "PUNCTUATED")}
_ACRONYMS = _quoted(quality.ACRONYMS)
_LET = "regexp_replace(w, '[^a-zA-Z]', '', 'g')"
NOISY = (
    "CASE WHEN x = '' THEN false WHEN " + " OR ".join(f"regexp_matches(x, '{_Q[k]}')" for k in ("FOREIGN_SYMBOLS", "ONLY_SYMBOLS", "REPEATED", "MISREAD_NGRAMS", "CJK", "MISREAD_TOKENS")) + " THEN true "
    f"WHEN NOT regexp_matches(x, '{_ID}') AND len(list_filter(regexp_extract_all(x, '{_Q['BLOB']}'), lambda b: length(trim(b)) <= 5 AND length(regexp_replace(b, '[^0-9]', '', 'g')) <= 2)) > 0 THEN true WHEN regexp_matches(x, '{_Q['PUNCTUATED']}') THEN true "
    "WHEN regexp_matches(x, '^[A-Z]{1,2}$') THEN true WHEN regexp_matches(x, '^[0-9]+$') THEN false "
    f"WHEN NOT regexp_matches(x, '{_ID}') AND (len(list_filter(regexp_extract_all(x, '{_Q['CONSONANTS']}'), lambda w: upper(w) NOT IN ({_ACRONYMS}))) > 0 "
    f"OR len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: NOT regexp_matches(w, '[0-9]') AND length({_LET}) >= 4 AND upper({_LET}) NOT IN ({_ACRONYMS}) AND length(regexp_replace({_LET}, '[^aeiouyAEIOUY]', '', 'g')) < 0.15 * length({_LET}))) > 0) THEN true "
    f"WHEN NOT regexp_matches(x, '{_Q['SCRIPT']}') THEN true WHEN length(x) > 4 AND regexp_matches(x, '{_Q['LETTER']}') AND length(x) - length(regexp_replace(x, '{_Q['SYMBOL']}', '', 'g')) > 0.40 * length(x) THEN true ELSE false END"
)
_COST = (
    f"list_sum(list_transform(regexp_split_to_array(x, '\\s+'), lambda w: CASE WHEN regexp_matches(w, '{_ID}') OR upper(w) IN ({_ACRONYMS}) THEN 0.0 ELSE CAST(CASE WHEN regexp_matches(w, '[A-Z]+[a-z]+[A-Z]+') THEN 0.18 ELSE 0.0 END AS DOUBLE) + CASE WHEN regexp_matches(w, '[a-z][A-Z]') THEN 0.15 ELSE 0.0 END "
    f"+ CASE WHEN regexp_matches(w, '\\b[bcdfghjklmnpqrstvwxz]{{2}}[a-z]{{3,}}\\b') AND left(lower(w), 2) NOT IN ({_quoted(quality.VALID_INITIALS)}) THEN 0.15 ELSE 0.0 END + CASE WHEN regexp_matches(w, '\\b[A-Za-z]+[0-9]+[A-Za-z]+\\b') THEN 0.12 ELSE 0.0 END + CASE WHEN length(w) > 22 AND NOT regexp_matches(w, '[-_./\\\\@]') THEN 0.10 ELSE 0.0 END END)) "
    "+ CASE WHEN regexp_matches(x, '[,.;:!?_\\-/\\\\|]{2,}') AND NOT contains(x, '--') AND NOT contains(x, '...') THEN 0.08 ELSE 0.0 END + CASE WHEN length(x) = 1 AND NOT regexp_matches(x, '[0-9aAiI]') THEN 0.20 ELSE 0.0 END"
)
_TRUST = (
    f"CASE WHEN x = '' THEN 0.0 WHEN noisy THEN 0.35 ELSE floor(greatest(0.15, least(0.99, CASE WHEN x IN ({_quoted(quality.TITLES)}) OR regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '\\p{{Ll}}') AND len(regexp_split_to_array(x, '\\s+')) BETWEEN 2 AND 5 AND cost = 0 THEN 0.98 ELSE 0.96 END - cost)) * 10000 + 0.5) / 10000 END"
)
TRUSTED = f"(SELECT extraction_id, line, noisy, CAST({_TRUST} AS DOUBLE) AS trust FROM (SELECT *, {NOISY} AS noisy, {_COST} AS cost FROM (SELECT extraction_id, line, trim(s) AS x FROM {LINES})))"


@add(f"SELECT extraction_id, line, noisy FROM {TRUSTED}")
def sim_noisy(spark: SparkSession, d: str) -> DataFrame:
    """SIM-11, FLT-10: lines that are noise."""
    return lines(spark, d).select("extraction_id", "line", quality.noisy(F.col("s")).alias("noisy"))


@add(f"SELECT extraction_id, line, trust, trust < 0.70 AS doubtful FROM {TRUSTED}")
def sim_line_trust(spark: SparkSession, d: str) -> DataFrame:
    """SIM-12, FLT-10: how far each line may be trusted, and whether it needs another look."""
    return lines(spark, d).select("extraction_id", "line", quality.trust(F.col("s")).alias("trust")).withColumn("doubtful", F.col("trust") < 0.70)


@add(f"SELECT extraction_id, round(avg(trust), 6) AS trust, round(avg(CASE WHEN trust = 0.35 THEN 1.0 ELSE 0.0 END), 6) AS noisy_share FROM {TRUSTED} GROUP BY extraction_id")
def sim_trust(spark: SparkSession, d: str) -> DataFrame:
    """SIM-12, AGG-16: mean trust per text, with the share of noisy lines."""
    t = lines(spark, d).select("extraction_id", quality.trust(F.col("s")).alias("trust"))
    return t.groupBy("extraction_id").agg(F.round(F.avg("trust"), 6).alias("trust"), F.round(F.avg((F.col("trust") == 0.35).cast("double")), 6).alias("noisy_share"))


@add(
    f"SELECT extraction_id, page, count(*) AS n, count(*) FILTER (trust < 0.80) AS low, round(avg(trust), 6) AS trust, count(*) FILTER (trust < 0.80) > 0 OR avg(trust) < 0.80 AS escalate FROM (SELECT extraction_id, CAST(line // 40 + 1 AS INTEGER) AS page, trust FROM {TRUSTED} WHERE trust > 0) GROUP BY extraction_id, page"
)
def agg_page_trust(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, FLT-08, FLT-09: per page its lines, those below the threshold, the mean trust, and whether it goes to another reader."""
    t = lines(spark, d).select("extraction_id", (F.floor(F.col("line") / 40) + 1).cast("int").alias("page"), quality.trust(F.col("s")).alias("trust")).where("trust > 0")
    low = F.count_if(F.col("trust") < 0.80)
    return t.groupBy("extraction_id", "page").agg(F.count(F.lit(1)).alias("n"), low.alias("low"), F.round(F.avg("trust"), 6).alias("trust"), ((low > 0) | (F.avg("trust") < 0.80)).alias("escalate"))


def _sanitizing() -> str:
    """The stages of sanitising a line as nested SQL: characters, labels, tokens, structure, judgement."""
    replace = lambda x, pattern, by="", how=", 'g'": f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}'{how})"
    s = replace(replace("s", quality.CJK), quality.FOREIGN_SYMBOLS)
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        s = replace(s, f"{c}{{5,}}", c * 2)
    # No look-ahead here: what must follow is captured and put back.
    for pattern, by in ((r"^[fF](ua)?\s*/\s*([A-Z])", "\\2"), (r"^[aA]\s*/\s*([A-Z][a-z]{2,})", "\\1"), (r"^[a-z]\s+([A-Z][a-z]{2,})", "\\1")):
        s = replace(s, pattern, by, "")
    kept = f"SELECT extraction_id, line, s AS raw, array_to_string(list_filter(regexp_split_to_array(trim({s}), '\\s+'), lambda w: NOT regexp_matches(w, '{quality.GARBAGE_TOKENS}') OR upper(w) IN ({_quoted(quality.PROTECTED_ACRONYMS)})), ' ') AS s FROM {LINES}"
    cut = f"SELECT extraction_id, line, raw, {replace('s', r'^[0-9]{1,3}[A-Z]{2,4}\s+([A-Z][a-z])', chr(92) + '1', '')} AS s FROM ({kept})"
    bare = "s"
    for pattern in (r"^[A-Z]\s+$", r"^\d{1,3}\s*$", r",\s*,+", r"^\s*,\s*", r"\s*,\s*$"):
        bare = replace(bare, pattern)
    whole = replace("trim(" + replace(bare, r"\s+", " ") + ")", r"\s*,\s*", ", ")
    shaped = f"SELECT extraction_id, line, raw, CASE WHEN regexp_matches(s, '{quality.PROTECTED}') THEN s ELSE {whole} END AS s FROM ({cut})"
    latin = "length(regexp_replace(t, '[^a-zA-Z]', '', 'g'))"
    few = f"regexp_matches(t, '[a-zA-Z]{{5,}}') AND length(regexp_replace(t, '[^aeiouyAEIOUY]', '', 'g')) < 0.10 * {latin}"
    plain = f"1.0 - CASE WHEN length(t) = 1 THEN 0.3 WHEN length(t) = 2 THEN 0.1 ELSE 0.0 END - CASE WHEN {few} THEN 0.3 ELSE 0.0 END"
    score = f"CASE WHEN upper(t) IN ({_quoted(quality.PROTECTED_ACRONYMS)}) OR regexp_matches(t, '{quality.PROTECTED}') THEN least(1.0, {plain} + 0.2) ELSE {plain} END"
    judged = f"SELECT *, CAST(CASE WHEN t = '' OR regexp_matches(t, '{_Q['ONLY_SYMBOLS']}') OR NOT regexp_matches(t, '{_Q['SCRIPT']}') THEN 0.0 ELSE round({score}, 3) END AS DOUBLE) AS sc FROM (SELECT *, trim(s) AS t FROM ({shaped}))"
    text = "trim(regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), '^[^\\p{L}\\p{N}_\\s]+|[^\\p{L}\\p{N}_\\s]+$', '', 'g'))"
    return f"SELECT extraction_id, line, CASE WHEN trim(raw) = '' THEN '' ELSE {text} END AS text, CASE WHEN trim(raw) = '' THEN 0.0 ELSE sc END AS score, trim(raw) <> '' AND sc >= 0.4 AS valid FROM ({judged})"


@add(_sanitizing())
def sim_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """SIM-08, SIM-09: lines cleaned, with score and judgement."""
    return lines(spark, d).select("extraction_id", "line", quality.sanitized(F.col("s")).alias("x")).select("extraction_id", "line", "x.text", "x.score", "x.valid")


@add()
def sim_label_noise(spark: SparkSession, d: str) -> DataFrame:
    """SIM-10: lines without what misread labels leave behind. Its rules look around a match, which the SQL at hand cannot; see the tests."""
    return lines(spark, d).select("extraction_id", "line", quality.label_noise(F.col("s")).alias("text"))


# --- geometry ---------------------------------------------------------------------------------------------------------

_B2 = (
    "(SELECT extraction_id, ord, w, h, least(x1, x2) AS l, least(y1, y2) AS t, greatest(x1, x2) AS r, greatest(y1, y2) AS b FROM (SELECT extraction_id, ord, CASE WHEN ord % 4 < 2 THEN 0.0 ELSE 612.0 END AS w, CASE WHEN ord % 4 < 2 THEN 0.0 ELSE 792.0 END AS h, "
    f"CASE WHEN ord % 2 = 0 THEN l ELSE r * 700 END AS x1, CASE WHEN ord % 2 = 0 THEN r ELSE l * 700 END AS x2, CASE WHEN ord % 2 = 0 THEN t ELSE b * 900 END AS y1, CASE WHEN ord % 2 = 0 THEN b ELSE t * 900 END AS y2 FROM {catalogue.TOKENS}))"
)
_SHARES = "(r <= 1.05 AND b <= 1.05)"


def _both(c: str, size: str, plain: str, page: str, most: str) -> str:
    extent = f"(CASE WHEN {page} > 0 THEN {page} WHEN {_SHARES} THEN 1000.0 ELSE greatest({most}, {plain}) END)"
    return (
        f"CASE WHEN {_SHARES} THEN greatest(0.0, least(1.0, {c})) ELSE floor(greatest(0.0, least(1.0, {c} / {extent})) * 10000 + 0.5) / 10000 END AS {c}n, "
        f"CASE WHEN {_SHARES} THEN floor(greatest(0.0, least(1.0, {c})) * {extent} * 10 + 0.5) / 10 ELSE floor({c} * 10 + 0.5) / 10 END AS {c}p"
    )


@add(
    f"SELECT extraction_id, ord, round(ln, 6) AS l, round(tn, 6) AS t, round(rn, 6) AS r, round(bn, 6) AS b, lp AS pl, tp AS pt, rp AS pr, bp AS pb FROM (SELECT extraction_id, ord, {_both('l', 'w', '595.0', 'w', 'r')}, {_both('t', 'h', '842.0', 'h', 'b')}, {_both('r', 'w', '595.0', 'w', 'r')}, {_both('b', 'h', '842.0', 'h', 'b')} FROM {_B2})"
)
def geo_both_boxes(spark: SparkSession, d: str) -> DataFrame:
    """GEO-01, GEO-02: boxes of tokens in shares and in pixels; half of them come in pixels and with inverted corners, half without a page size."""
    t = pages_of(spark, d)
    odd = F.col("ord") % 2 == 1
    at = lambda a, b, k: F.when(odd, F.col(b) * k).otherwise(F.col(a))
    size = lambda v: F.when(F.col("ord") % 4 < 2, 0.0).otherwise(v)
    x = geo.both_boxes((at("l", "r", 700), at("t", "b", 900), at("r", "l", 700), at("b", "t", 900)), size(612.0), size(792.0))
    return t.select("extraction_id", "ord", x.alias("x")).select("extraction_id", "ord", *[F.round(f"x.{c}", 6).alias(c) for c in "ltrb"], *[f"x.p{c}" for c in "ltrb"])


@add(
    f"SELECT extraction_id, ord, round(greatest(0.0, least(r, cr) - greatest(l, cl)) * greatest(0.0, least(b, cb) - greatest(t, ct)) / ((r - l) * (b - t)), 6) AS covered, round(0.5 - t, 6) AS up_top, round(0.5 - b, 6) AS up_bottom, floor(greatest(0.0, least(1.0, r / 0.5)) * 10000 + 0.5) / 10000 AS corner "
    f"FROM {catalogue.TOKENS} JOIN {catalogue.GRID} USING (extraction_id, page) WHERE cell = 0 AND (r - l) * (b - t) > 0"
)
def geo_containment(spark: SparkSession, d: str) -> DataFrame:
    """GEO-05, GEO-07, GEO-10: how far a cell covers a token, the token from the bottom left, and a corner in shares of a half page."""
    t, g = catalogue.tokens_and_cells(spark, d)
    j = t.join(g.where("cell = 0"), ["extraction_id", "page"])
    a, c = geo.box(), geo.box("c")
    up = geo.from_bottom(a, F.lit(0.5))
    return j.where(geo.area(a) > 0).select(
        "extraction_id", "ord", F.round(geo.containment(c, a), 6).alias("covered"), F.round(up[3], 6).alias("up_top"), F.round(up[1], 6).alias("up_bottom"), geo.scaled_corners(a, F.lit(0.5), F.lit(0.5))[1][0].alias("corner")
    )
