"""Queries of sources by precedence, the registry of documents, entities, streams and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import normalise as fn
from attestra.operators import records, registry, state
from attestra.plans import catalogue
from attestra.plans.catalogue import LATEST_FIELDS, RECORDS, TOKENS, add, pages_of
from attestra.plans.texts import LINES, lines
from attestra.session import shared_folder, table
from attestra.sources import files
from attestra.streaming import audit


def _canonical(c):
    return fn.canonical_type(c, records.DOCUMENT_ALIASES)


def _canon(x: str) -> str:
    """The canonical kind of a document key that may be an alias, else by words in it, for names without extension and prefix."""
    looked = f"(SELECT min(canon) FROM (VALUES {catalogue.FILED_AS}) a(name, canon, rank) WHERE a.name = {x})"
    return (
        f"coalesce({looked}, CASE WHEN contains({x}, 'kfs') THEN 'kfs' WHEN contains({x}, 'sanction') THEN 'sanction_letter' WHEN contains({x}, 'agreement') THEN 'loan_agreement' WHEN contains({x}, 'memo') OR contains({x}, 'disbursal') THEN 'disbursal_memo' "
        f"WHEN contains({x}, 'statement') OR contains({x}, 'bank') THEN 'account_statement' WHEN contains({x}, 'pan') THEN 'pan' WHEN contains({x}, 'application') THEN 'application_form' ELSE {x} END)"
    )


# --- sources by precedence --------------------------------------------------------------------------------------------


def _newest(where: str) -> str:
    return f"SELECT loan_id, row_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY loaded_at DESC NULLS LAST, row_id DESC) rn FROM los WHERE loan_id IS NOT NULL AND {where}) WHERE rn = 1"


def _ranked(*order: str) -> str:
    where = {"folder": "funding_amount IS NOT NULL", "staged": "tenure IS NOT NULL", "database": "true"}
    every = " UNION ALL ".join(f"SELECT *, '{o}' AS origin, {i} AS rank FROM ({_newest(where[o])})" for i, o in enumerate(order))
    return f"SELECT loan_id, row_id, source_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY rank) rn FROM ({every})) WHERE rn = 1"


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    los = table(spark, d, "los")
    of = lambda where: records.latest_rows(los.where(where)).select("loan_id", "row_id", "source_id")
    return {"folder": of("funding_amount IS NOT NULL"), "staged": of("tenure IS NOT NULL"), "database": of("true")}


@add(_ranked("folder", "staged", "database"))
def src_precedence(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02: a loan's row from its folder, else as staged, else from the database."""
    return registry.by_precedence(_sources(spark, d), "loan_id")


@add(_ranked("staged", "folder", "database"))
def src_staged_first(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04: the same with what is staged first."""
    s = _sources(spark, d)
    return registry.by_precedence({k: s[k] for k in ("staged", "folder", "database")}, "loan_id")


@add("SELECT row_id, loan_id, status FROM los WHERE loan_id = 'APPL00000001' OR row_id = 1")
def src_point(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, SRC-09: a point lookup; the predicate reaches the scan."""
    return table(spark, d, "los").where("loan_id = 'APPL00000001' OR row_id = 1").select("row_id", "loan_id", "status")


_NAME = "CASE doc_id % 10 WHEN 0 THEN 'face_embeddings.json' WHEN 1 THEN 'DMS_status.json' WHEN 2 THEN 'loan_agreement_otp_audit.json' WHEN 3 THEN lower(loan_id) || '.json' WHEN 4 THEN doc_key || '_metadata.json' WHEN 5 THEN doc_key || '.json' WHEN 6 THEN doc_key || '.PDF' WHEN 7 THEN 'scan.' || doc_id || '.tiff' WHEN 8 THEN 'uid.xml' ELSE doc_key || '.docx' END"
_EXT = "lower(regexp_extract(name, '\\.([^./]+)$', 1))"
_KIND = f"CASE {_EXT} WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'tif' THEN 'image' WHEN 'tiff' THEN 'image' WHEN 'bmp' THEN 'image' WHEN 'xml' THEN 'xml' ELSE 'unsupported' END"


@add(
    f"SELECT doc_id, CASE WHEN lower(name) = 'face_embeddings.json' THEN 'faces' WHEN lower(name) = 'dms_status.json' THEN 'status' WHEN lower(name) = 'loan_agreement_otp_audit.json' THEN 'otp' WHEN ends_with(lower(name), '.json') AND upper(regexp_replace(name, '\\.[^.]*$', '')) = upper(loan_id) THEN 'skipped' "
    f"WHEN ends_with(lower(name), '.json') AND contains(lower(name), 'metadata') THEN 'skipped' WHEN ends_with(lower(name), '.json') THEN 'document' END AS route, category, CASE {_EXT} WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'bmp' THEN 'image/bmp' WHEN 'xml' THEN 'application/xml' END AS mime, "
    f"CASE WHEN category = 'unsupported' OR size > 52428800 THEN 'rejected' WHEN category = 'pdf' THEN 'inspect_pdf' WHEN category = 'image' THEN 'inspect_image' ELSE 'read_xml' END AS reader FROM (SELECT *, {_KIND} AS category FROM (SELECT doc_id, loan_id, {_NAME} AS name, n_chars * 1000 AS size FROM documents WHERE loan_id IS NOT NULL AND doc_key IS NOT NULL))"
)
def src_route(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, SRC-07, SRC-08, SRC-13, SRC-14, SRC-17: where each file of a case's package goes and who reads it."""
    n, k = F.col("doc_id") % 10, F.col("doc_key")
    said = ["face_embeddings.json", "DMS_status.json", "loan_agreement_otp_audit.json"]
    name = (
        F.when(n < 3, F.get(F.array(*map(F.lit, said)), n.cast("int"))).when(n == 3, F.concat(F.lower("loan_id"), F.lit(".json"))).when(n == 4, F.concat(k, F.lit("_metadata.json"))).when(n == 5, F.concat(k, F.lit(".json")))
        .when(n == 6, F.concat(k, F.lit(".PDF"))).when(n == 7, F.concat(F.lit("scan."), F.col("doc_id").cast("string"), F.lit(".tiff"))).when(n == 8, "uid.xml").otherwise(F.concat(k, F.lit(".docx")))
    )
    docs = table(spark, d, "documents").where("loan_id IS NOT NULL AND doc_key IS NOT NULL").select("doc_id", "loan_id", name.alias("name"), (F.col("n_chars") * 1000).alias("size"))
    return docs.select("doc_id", registry.file_route(F.col("name"), F.col("loan_id")).alias("route"), registry.file_type(F.col("name"), F.col("size")).alias("x")).select("doc_id", "route", "x.*")


@add(f"SELECT extraction_id, count(*) AS pages, avg(n) < 50 AS scanned FROM (SELECT extraction_id, line // 40 AS page, length(trim(string_agg(s, chr(10) ORDER BY line))) AS n FROM {LINES} GROUP BY extraction_id, line // 40) GROUP BY extraction_id")
def src_scanned(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15: pages of a document, and whether it is a scan: fewer than fifty characters of text a page on average."""
    page = F.floor(F.col("line") / 40).alias("page")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n")
    pages = lines(spark, d).groupBy("extraction_id", page).agg(F.length(F.trim(body)).alias("n"))
    return pages.groupBy("extraction_id").agg(F.count(F.lit(1)).alias("pages"), (F.avg("n") < 50).alias("scanned"))


@add(
    "SELECT d.doc_id, coalesce(max(e.arrived_at) >= any_value(d.created_at), false) AS hit FROM (SELECT doc_id, loan_id, doc_key, created_at FROM documents WHERE loan_id IS NOT NULL AND doc_key IS NOT NULL) d LEFT JOIN (SELECT * FROM extractions WHERE length(_formatted_text) > 0) e ON e.loan_id = d.loan_id AND e.doc_key = d.doc_key GROUP BY d.doc_id"
)
def src_cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """SRC-28: whether a document has a filled extraction that is no older; those without are to be read."""
    docs = table(spark, d, "documents").where("loan_id IS NOT NULL AND doc_key IS NOT NULL").select("doc_id", "loan_id", "doc_key", F.col("created_at").alias("changed"))
    cache = table(spark, d, "extractions").select("loan_id", "doc_key", F.col("arrived_at").alias("written"), F.length("_formatted_text").alias("size"))
    return registry.fresh(docs, cache).select("doc_id", "hit")


@add(
    f"SELECT loan_id, name, found, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, name ORDER BY rank, found) rn FROM (SELECT n.loan_id, n.name, e.found, CASE WHEN n.name = e.found THEN 0 WHEN {_canon('n.name')} = {_canon('e.found')} THEN 1 WHEN contains(n.name, e.found) OR contains(e.found, n.name) THEN 2 END AS rank "
    f"FROM (SELECT DISTINCT loan_id, CASE WHEN doc_id % 2 = 0 THEN doc_key ELSE doc_key || ' copy' END AS name FROM documents WHERE loan_id IS NOT NULL AND doc_key IS NOT NULL) n JOIN (SELECT DISTINCT loan_id, doc_key AS found FROM extractions WHERE loan_id IS NOT NULL) e USING (loan_id)) WHERE rank IS NOT NULL) WHERE rn = 1"
)
def src_companion(spark: SparkSession, d: str) -> DataFrame:
    """SRC-26: the extraction that belongs to a document, by name, by kind, or by one name holding the other."""
    name = F.when(F.col("doc_id") % 2 == 0, F.col("doc_key")).otherwise(F.concat("doc_key", F.lit(" copy")))
    wanted = table(spark, d, "documents").where("loan_id IS NOT NULL AND doc_key IS NOT NULL").select("loan_id", name.alias("name"))
    known = table(spark, d, "extractions").where("loan_id IS NOT NULL").select("loan_id", F.col("doc_key").alias("name"))
    return registry.companions(wanted, known, _canonical)


@add(
    "SELECT loan_id, name, origin FROM (SELECT *, min(rank) OVER (PARTITION BY loan_id) AS best FROM (SELECT DISTINCT loan_id, doc_key AS name, 'raw' AS origin, 0 AS rank FROM documents UNION ALL SELECT DISTINCT loan_id, doc_key, 'dms', 1 FROM extractions UNION ALL SELECT DISTINCT loan_id, doc_key, 'extracted', 2 FROM doc_fields) WHERE loan_id IS NOT NULL) WHERE rank = best"
)
def src_candidates(spark: SparkSession, d: str) -> DataFrame:
    """SRC-24, SRC-25: the documents of a loan as received, else as stored, else the names of what was extracted."""
    of = lambda t: table(spark, d, t).select("loan_id", F.col("doc_key").alias("name")).distinct()
    return registry.fallback({"raw": of("documents"), "dms": of("extractions"), "extracted": of("doc_fields")}, "loan_id")


@add(
    "SELECT doc_id, nullif(regexp_extract(text, '(LOAN_[0-9]+|HDB-[A-Za-z0-9-]+|APPL[0-9]+)', 1), '') AS said, l.loan_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT loan_id FROM los WHERE loan_id IS NOT NULL) l ON l.loan_id = regexp_extract(d.text, '(LOAN_[0-9]+|HDB-[A-Za-z0-9-]+|APPL[0-9]+)', 1)"
)
def src_case_of(spark: SparkSession, d: str) -> DataFrame:
    """SRC-27: the case that a document names first, and whether there is one."""
    said = table(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "(LOAN_[0-9]+|HDB-[A-Za-z0-9-]+|APPL[0-9]+)", 1), F.lit("")).alias("said"))
    cases = table(spark, d, "los").where("loan_id IS NOT NULL").select(F.col("loan_id").alias("said"), F.lit(True).alias("known")).distinct()
    return said.join(cases, "said", "left").select("doc_id", "said", F.coalesce("known", F.lit(False)).alias("known"))


@add("SELECT loan_id, doc_key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, doc_key, field ORDER BY run_no DESC NULLS LAST, field_id DESC) rn FROM doc_fields WHERE loan_id IS NOT NULL AND doc_key IS NOT NULL AND field IS NOT NULL) WHERE rn = 1")
def src_last_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: the last file's values, nulls and all: no filling from before."""
    known = table(spark, d, "doc_fields").where("loan_id IS NOT NULL AND doc_key IS NOT NULL AND field IS NOT NULL")
    return known.groupBy("loan_id", "doc_key", "field").agg(F.max_by("value", F.struct("run_no", "field_id")).alias("value"))


# --- lookups and registry ---------------------------------------------------------------------------------------------

_WANTED = {
    "amount": (("chk_check_financial_kfs_loan_amount_vs_los", "chk_check_financial_sanction_letter_loan_amount_vs_los"), "loan_amount"),
    "tenure": (("chk_unknown", "chk_check_financial_kfs_loan_validity_vs_los"), "loan_validity"),
    "consent": (("chk_check_financial_kfs_customer_consent_vs_los",), "customer_consent"),
    "address": ((), "address"),
}
_WANTED_SQL = ", ".join(f"('{n}', {list(ids)!r}::VARCHAR[], '{f}')" for n, (ids, f) in _WANTED.items())


@add(
    f"SELECT loan_id, name, check_id, status FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, name ORDER BY rank, check_id) rn FROM (SELECT r.loan_id, w.name, r.check_id, r.status, CASE WHEN list_contains(w.ids, r.check_id) THEN list_position(w.ids, r.check_id) WHEN r.field = w.field THEN 1000 END AS rank FROM {RECORDS} r CROSS JOIN (VALUES {_WANTED_SQL}) w(name, ids, field)) WHERE rank IS NOT NULL) WHERE rn = 1"
)
def jn_check_record(spark: SparkSession, d: str) -> DataFrame:
    """JN-06, WIN-17: the record of a loan by candidate checks in order, else the first of a field."""
    r = catalogue.all_checks(spark, d).withColumn("ord", F.col("check_id"))
    relation = r.select("loan_id", "check_id", "field", "status", F.dense_rank().over(W.partitionBy("loan_id").orderBy("check_id")).alias("ord"))
    return registry.first_record(relation, _WANTED)


_NAMES = ("kfs", "sanction_letter", "loan_agreement")


@add(f"SELECT loan_id, arg_min(doc_key, list_position(['kfs', 'sanction_letter', 'loan_agreement'], doc_key)) AS doc_key FROM {LATEST_FIELDS} WHERE doc_key IN {_NAMES} GROUP BY loan_id")
def jn_document(spark: SparkSession, d: str) -> DataFrame:
    """JN-07: the first of several documents that a loan has."""
    names = F.array(*map(F.lit, _NAMES))
    f = table(spark, d, "doc_fields").where(F.col("loan_id").isNotNull() & F.col("doc_key").isin(*_NAMES) & F.col("field").isNotNull())
    return f.groupBy("loan_id").agg(F.min_by("doc_key", F.array_position(names, F.col("doc_key"))).alias("doc_key"))


_DOC_ID = "'doc-' || coalesce(loan_id, '') || '-' || CASE WHEN audit_id % 3 = 0 THEN 'sanction' WHEN audit_id % 3 = 1 THEN 'kfs' ELSE 'report' END"


@add(
    f"SELECT id, CAST(doc_id AS BIGINT) AS doc_id FROM (SELECT i.id, d.doc_id, row_number() OVER (PARTITION BY i.id ORDER BY d.doc_id) rn FROM (SELECT DISTINCT {_DOC_ID} AS id, upper(loan_id) AS c, CASE WHEN audit_id % 3 = 0 THEN 'sanction' WHEN audit_id % 3 = 1 THEN 'kfs' ELSE 'report' END AS slug FROM audit_log WHERE loan_id IS NOT NULL AND NOT contains(loan_id, '-')) i "
    f"JOIN documents d ON upper(d.loan_id) = i.c WHERE d.doc_key IS NOT NULL AND ({_canon('d.doc_key')} = {_canon('i.slug')} OR contains(d.doc_key, i.slug))) WHERE rn = 1"
)
def jn_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """JN-17, JN-18: made-up document ids resolved to documents."""
    n = F.col("audit_id") % 3
    slug = F.when(n == 0, "sanction").when(n == 1, "kfs").otherwise("report")
    ids = table(spark, d, "audit_log").where("loan_id IS NOT NULL AND NOT contains(loan_id, '-')").select(F.concat(F.lit("doc-"), "loan_id", F.lit("-"), slug).alias("id")).distinct()
    docs = table(spark, d, "documents").where("loan_id IS NOT NULL AND doc_key IS NOT NULL").select(F.col("loan_id").alias("case"), "doc_id", F.col("doc_key").alias("name"), F.col("doc_key").alias("type"), F.col("doc_id").alias("ord"))
    return registry.synthetic(ids, docs, _canonical)


_SHOWN = "CASE doc_key WHEN 'kfs' THEN 'KFS' WHEN 'sanction_letter' THEN 'Sanction Letter' WHEN 'loan_agreement' THEN 'Loan Agreement' WHEN 'application_form' THEN 'Application Form' ELSE doc_key END"
_NORM = "replace(replace(regexp_replace(regexp_replace(lower({x}), '^doc-[a-z0-9_-]+_', ''), '^(aadhaar|aadhar|adhar)[_\\s-]+', ''), 'aadhaar', 'aadhar'), 'adhar', 'aadhar')"
_REG = f"SELECT loan_id AS c, CAST(doc_id AS VARCHAR) AS id, doc_key || CASE WHEN doc_id % 3 = 0 THEN ' v2' ELSE '' END AS name, {_SHOWN} AS type, created_at AS ts, doc_id AS ord FROM documents WHERE doc_key IS NOT NULL"
_KEY = f"CASE WHEN type IN ('Application Form', 'Aadhaar', 'PAN', 'Sanction Letter', 'Loan Agreement', 'Disbursal Memo', 'KFS', 'Aadhaar XML') AND c IS NOT NULL AND c <> 'GENERAL' THEN type ELSE {_NORM.format(x='name')} END"


@add(
    f"WITH u AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY ord DESC) rn FROM ({_REG} AND doc_id % 4 = 0)) WHERE rn = 1), k AS (SELECT c, {_KEY} AS key FROM u UNION SELECT c, id FROM u), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, key ORDER BY ord) rn FROM (SELECT *, {_KEY} AS key FROM ({_REG} AND doc_id % 4 <> 0))) WHERE rn = 1) "
    f"SELECT c AS \"case\", id, name, type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, true AS upload FROM u UNION ALL SELECT c, id, name, type, strftime(ts, '%Y-%m-%d %H:%M:%S'), false FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.c IS NOT DISTINCT FROM f.c AND k.key = f.key)"
)
def ded_registry(spark: SparkSession, d: str) -> DataFrame:
    """DED-01: uploads and case documents in one registry without doubles."""
    k = F.col("doc_key")
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("kfs", "KFS", "sanction_letter", "Sanction Letter", "loan_agreement", "Loan Agreement", "application_form", "Application Form")]), k), k)
    docs = table(spark, d, "documents").where(k.isNotNull()).select(
        F.col("loan_id").alias("case"), F.col("doc_id").cast("string").alias("id"), F.concat(k, F.when(F.col("doc_id") % 3 == 0, " v2").otherwise("")).alias("name"), shown.alias("type"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("doc_id").alias("ord"),
    )
    return registry.registered(docs.where("ord % 4 = 0"), docs.where("ord % 4 <> 0"), fn.doc_name)


@add("SELECT doc_id, loan_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS ts FROM documents ORDER BY created_at DESC NULLS LAST, doc_id DESC LIMIT 40")
def srt_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRT-04: the newest documents first."""
    docs = table(spark, d, "documents").orderBy(F.desc_nulls_last("created_at"), F.desc("doc_id")).limit(40)
    return docs.select("doc_id", "loan_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@add("SELECT audit_id, loan_id FROM (SELECT DISTINCT audit_id, loan_id, event_ts FROM audit_log) ORDER BY loan_id DESC NULLS LAST, event_ts DESC NULLS LAST, audit_id DESC LIMIT 40")
def srt_audit(spark: SparkSession, d: str) -> DataFrame:
    """SRT-05: events by case and time, both descending."""
    a = table(spark, d, "audit_log").select("audit_id", "loan_id", "event_ts").distinct()
    return a.orderBy(F.desc_nulls_last("loan_id"), F.desc_nulls_last("event_ts"), F.desc("audit_id")).limit(40).select("audit_id", "loan_id")


_FIX = f"(SELECT extraction_id, line, s AS text, 0.6 AS confidence FROM {LINES} WHERE trim(s) <> '')"
_MOCK = (
    "CASE WHEN t = '' THEN 'Verified Entry' WHEN contains(t, 'HRTRR') OR contains(t, 'RROR') OR contains(t, 'HRAR') OR contains(t, 'HTT') OR contains(t, 'RHR') OR contains(t, '3T9T3πT&T') OR contains(t, 'mąhil') OR contains(t, '3QRR') THEN CASE WHEN contains(t, 'Government') OR contains(t, 'HRTRR') OR contains(t, 'HRAR') THEN 'भारत सरकार Government of India' "
    "WHEN contains(t, '3T9T3πT&T') OR contains(t, 'Aadhaar') OR contains(t, 'mąhil') THEN 'मेरा आधार, मेरी पहचान' ELSE 'भारत सरकार' END WHEN starts_with(t, '~') OR starts_with(t, '`') THEN 'Corrected Value' ELSE t END"
)
_SPOILED = "CASE WHEN line % 5 = 0 THEN '~' || text WHEN line % 7 = 0 THEN text || ' HRTRR' ELSE text END"


@add(
    f"SELECT e.extraction_id, e.line, coalesce(c.x, e.text) AS text, CAST(CASE WHEN c.x IS NOT NULL THEN 0.95 ELSE 0.6 END AS DOUBLE) AS confidence, CASE WHEN c.x IS NOT NULL THEN e.text END AS original FROM {_FIX} e LEFT JOIN (SELECT extraction_id, line, {_MOCK} AS x FROM (SELECT extraction_id, line, trim({_SPOILED}) AS t FROM {_FIX} WHERE line % 3 = 0)) c USING (extraction_id, line)"
)
def jn_corrections(spark: SparkSession, d: str) -> DataFrame:
    """JN-16, UDF-03: lines with the readings of the model's stand-in in place."""
    e = lines(spark, d).where(F.trim("s") != "").select("extraction_id", "line", F.col("s").alias("text"), F.lit(0.6).alias("confidence"))
    spoiled = F.when(F.col("line") % 5 == 0, F.concat(F.lit("~"), "text")).when(F.col("line") % 7 == 0, F.concat("text", F.lit(" HRTRR"))).otherwise(F.col("text"))
    c = e.where("line % 3 = 0").select("extraction_id", "line", registry.mock_reading(spoiled).alias("text"), F.lit(0.95).alias("confidence"))
    return registry.corrected(e, c, "extraction_id", "line")


_MERGED = f"(SELECT extraction_id, min(ord) AS id, list(ord) AS parts FROM {TOKENS} WHERE length(word) <= 3 GROUP BY extraction_id, page, t HAVING count(*) > 1)"


@add(
    f"SELECT extraction_id, ord, kind FROM (SELECT m.extraction_id, min(t.ord) AS ord, 'merged' AS kind FROM (SELECT extraction_id, id, unnest(parts) AS part FROM {_MERGED}) m JOIN {TOKENS} t ON t.extraction_id = m.extraction_id AND t.ord = m.part GROUP BY m.extraction_id, m.id UNION ALL SELECT extraction_id, ord, 'single' FROM {TOKENS} t WHERE NOT EXISTS (SELECT 1 FROM (SELECT extraction_id, unnest(parts) AS part FROM {_MERGED}) x WHERE x.extraction_id = t.extraction_id AND x.part = t.ord))"
)
def jn_constituents(spark: SparkSession, d: str) -> DataFrame:
    """JN-20, SET-04: merged tokens at the place of their first part, and the tokens that are part of none."""
    t = pages_of(spark, d)
    merged = t.where("length(word) <= 3").groupBy("extraction_id", "page", "t").agg(F.collect_list("ord").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select("extraction_id", F.array_min("of").alias("id"), "of")
    elements = t.select("extraction_id", F.col("ord").alias("id"), "ord")
    one = registry.merged_order(merged, elements, "extraction_id").select("extraction_id", "ord", F.lit("merged").alias("kind"))
    return one.unionByName(registry.without_parts(merged, elements, "extraction_id").select("extraction_id", "ord", F.lit("single").alias("kind")))


# --- entities and steps -----------------------------------------------------------------------------------------------


@add(
    f"SELECT loan_id, round(coalesce(r, a, d), 1) AS confidence FROM (SELECT l.loan_id, max(CASE WHEN x.confidence <= 1 THEN x.confidence * 100 ELSE x.confidence END) AS r, any_value(a.c) AS a, any_value(v.c) AS d FROM {catalogue.LATEST_LOS} l LEFT JOIN (SELECT * FROM {RECORDS} WHERE doc_key = 'pan' AND field = 'pan_number' AND status <> 'NOT_FOUND') x USING (loan_id) "
    f"LEFT JOIN (SELECT loan_id, max(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END) AS c FROM audit_log GROUP BY loan_id) a USING (loan_id) LEFT JOIN (SELECT loan_id, 90.0 AS c FROM {LATEST_FIELDS} WHERE doc_key = 'pan' GROUP BY loan_id) v USING (loan_id) GROUP BY l.loan_id)"
)
def ent_confidence(spark: SparkSession, d: str) -> DataFrame:
    """ENT-02, FN-36: how sure a field is: by its record, else by adjudication, else by its document."""
    hundred = lambda c: F.when(c <= 1, c * 100).otherwise(c)
    loans = records.latest_rows(table(spark, d, "los")).select("loan_id")
    r = catalogue.all_checks(spark, d).where("doc_key = 'pan' AND field = 'pan_number' AND status <> 'NOT_FOUND'").groupBy("loan_id").agg(F.max(hundred(F.col("confidence"))).alias("r"))
    a = table(spark, d, "audit_log").groupBy("loan_id").agg(F.max(hundred(F.col("confidence"))).alias("a"))
    v = table(spark, d, "doc_fields").where("doc_key = 'pan' AND field IS NOT NULL").select("loan_id").distinct().withColumn("v", F.lit(90.0))
    j = loans.join(r, "loan_id", "left").join(a, "loan_id", "left").join(v, "loan_id", "left")
    return j.select("loan_id", F.round(F.coalesce("r", "a", "v"), 1).alias("confidence"))


_STEPS = ("fetch_los", "fetch_dms", "idp_scan", "llm_structure", "check_parallel", "compile_report", "generate_scorecard", "push_results")
_AT = "lower(strftime({x} + INTERVAL 330 MINUTE, '%-I:%M %p'))"


@add(
    f"SELECT loan_id, CAST(i - 1 AS INTEGER) AS step, {list(_STEPS)!r}[i] AS node, {_AT.format(x='(ts - to_seconds((9 - i) * 3))')} AS started, {_AT.format(x='(ts - to_seconds((8 - i) * 3))')} AS ended, strftime(ts - to_seconds((n - 1 - least(i - 1, n - 1)) * 2), '%H:%M:%S') AS seen "
    "FROM (SELECT loan_id, max(event_ts) AS ts, count(DISTINCT audit_id) AS n FROM audit_log WHERE loan_id IS NOT NULL AND event_ts IS NOT NULL GROUP BY loan_id), range(1, 9) r(i)"
)
def win_steps(spark: SparkSession, d: str) -> DataFrame:
    """WIN-23, WIN-24, FN-21: the steps of a case with times counted back from its last event."""
    last = table(spark, d, "audit_log").where("loan_id IS NOT NULL AND event_ts IS NOT NULL").groupBy("loan_id").agg(F.max("event_ts").alias("ts"), F.count_distinct("audit_id").alias("n"))
    each = last.select("loan_id", "ts", "n", F.posexplode(F.array(*map(F.lit, _STEPS))).alias("step", "node"))
    back = lambda s: F.col("ts") - F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    i = F.col("step")
    return each.select(
        "loan_id", "step", "node", fn.clock_12h(back((8 - i) * 3)).alias("started"), fn.clock_12h(back((7 - i) * 3)).alias("ended"),
        F.date_format(back((F.col("n") - 1 - F.least(i, F.col("n") - 1)) * 2), "HH:mm:ss").alias("seen"),
    )


@add(
    "SELECT loan_type FROM (SELECT DISTINCT loan_type FROM los WHERE loan_type IS NOT NULL UNION SELECT unnest(['Personal Loan', 'Business Loan', 'Gold Loan'])) ORDER BY loan_type"
)
def agg_type_list(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21, SET-05: the kinds of loans that occur, with the standard ones, in order."""
    standard = spark.sql("SELECT explode(array('Personal Loan', 'Business Loan', 'Gold Loan')) AS loan_type")
    return table(spark, d, "los").where("loan_type IS NOT NULL").select("loan_type").distinct().unionByName(standard).distinct().orderBy("loan_type")


@add(
    f"SELECT extraction_id, page, CAST(row_number() OVER (PARTITION BY extraction_id, page ORDER BY t, l, ord) - 1 AS INTEGER) AS reading, word FROM {TOKENS} WHERE length(word) <= 4 AND regexp_matches(word, '^[\\p{{L}}\\p{{N}}@.,/_#-]+$')"
)
def win_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """WIN-22, SIM-19: the cells of a page that may be character boxes, as elements in reading order."""
    t = pages_of(spark, d).where(F.length("word").between(1, 4) & F.col("word").rlike(r"^[\p{L}\p{N}@.,/_#-]+$"))
    return t.select("extraction_id", "page", (F.row_number().over(W.partitionBy("extraction_id", "page").orderBy("t", "l", "ord")) - 1).alias("reading"), "word")


# --- streams and sinks, there and back --------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/attestra-{spark.sparkContext.applicationId}/{name}"


def _emptied(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return path


@add(catalogue.oracle_sql()["stm_status_fold"])
def stm_stream_status(spark: SparkSession, d: str) -> DataFrame:
    """STM-02, STM-03, STM-04, STM-07, SNK-03, SNK-04: case states from the audit log as a stream; the same as the batch fold."""
    a = table(spark, d, "audit_log").select("loan_id", "event_ts", "audit_id", "type", "error")
    base = _emptied(spark, _folder(spark, "stream"))
    a.repartition(3, "audit_id").write.parquet(f"{base}/in")
    audit.run_status(audit.audit_stream(spark, f"{base}/in", a.schema, files=1), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return state.newest_first(spark.read.parquet(f"{base}/out/status"))


@add(
    "SELECT loan_id, CAST(step AS INTEGER) AS step, stage, status FROM (SELECT loan_id, row_number() OVER (PARTITION BY loan_id ORDER BY event_ts NULLS FIRST, audit_id) AS step, type AS stage, 'completed' AS status FROM (SELECT DISTINCT loan_id, event_ts, audit_id, type FROM audit_log WHERE loan_id IS NOT NULL AND type IS NOT NULL) "
    "UNION ALL SELECT DISTINCT loan_id, 0, 'start', 'started' FROM audit_log WHERE loan_id IS NOT NULL AND type IS NOT NULL UNION ALL SELECT loan_id, count(DISTINCT (event_ts, audit_id, type)) + 1, 'finish', 'done' FROM audit_log WHERE loan_id IS NOT NULL AND type IS NOT NULL GROUP BY loan_id)"
)
def stm_progress(spark: SparkSession, d: str) -> DataFrame:
    """STM-01: the progress of each loan, from start to finish."""
    return audit.progress(table(spark, d, "audit_log"))


@add(f"SELECT loan_id, doc_key, field, value FROM {LATEST_FIELDS} WHERE loan_id NOT IN (SELECT loan_id FROM los WHERE status = 'REJECTED' AND loan_id IS NOT NULL) AND NOT (doc_key = 'kfs' AND field = 'emi') UNION ALL SELECT loan_id, doc_key, field, 'rewritten' FROM {LATEST_FIELDS} WHERE loan_id NOT IN (SELECT loan_id FROM los WHERE status = 'REJECTED' AND loan_id IS NOT NULL) AND doc_key = 'kfs' AND field = 'emi'")
def snk_tier(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, SNK-02, SNK-05, SNK-06, SNK-07, SNK-08, SNK-11: a tier written, one of its partitions replaced, loans deleted from it, and read back."""
    base = _emptied(spark, _folder(spark, "tier"))
    f = records.latest_fields(table(spark, d, "doc_fields")).select("loan_id", "doc_key", "field", "value")
    files.write_tier(f, base)
    changed = f.where("doc_key = 'kfs'").withColumn("value", F.when(F.col("field") == "emi", "rewritten").otherwise(F.col("value")))
    files.write_tier(changed, base)
    gone = table(spark, d, "los").where("status = 'REJECTED'").select("loan_id")
    return files.without(spark.read.schema(f.schema).parquet(base), gone).select("loan_id", "doc_key", "field", "value")


@add(f"SELECT loan_id, doc_key, field AS tag, trim(value) AS value FROM {LATEST_FIELDS} WHERE value IS NOT NULL AND trim(value) <> ''")
def udtf_xml(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12, UDTF-01: documents as XML read node by node; the SQL are the fields that they were written from."""
    f = records.latest_fields(table(spark, d, "doc_fields")).where("value IS NOT NULL AND trim(value) <> ''")
    escaped = F.replace(F.replace(F.replace("value", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    node = F.concat(F.lit("<"), "field", F.lit(">"), escaped, F.lit("</"), "field", F.lit(">"))
    docs = f.groupBy("loan_id", "doc_key").agg(F.concat(F.lit('<d xmlns="urn:x">'), F.array_join(F.collect_list(node), ""), F.lit("</d>")).alias("text"))
    keyed = docs.withColumn("path", F.to_json(F.struct("loan_id", "doc_key")))
    out = files.xml_lines(keyed.select("path", "text"))
    return out.select(F.get_json_object("path", "$.loan_id").alias("loan_id"), F.get_json_object("path", "$.doc_key").alias("doc_key"), "tag", F.trim("value").alias("value"))


@add(
    "SELECT loan_id, nullif(trim(applicant_name), '') AS name, nullif(trim(current_address), '') AS address, coalesce(balance_transfer, 0) AS bt FROM los WHERE coalesce(loan_id, nullif(trim(applicant_name), ''), nullif(trim(current_address), ''), CAST(balance_transfer AS VARCHAR)) IS NOT NULL"
)
def src_seed(spark: SparkSession, d: str) -> DataFrame:
    """SRC-22: a CSV with quoted commas and line ends written and read as a seed; blanks are null, the flag is 0 where blank."""
    base = _emptied(spark, _folder(spark, "seed"))
    c = table(spark, d, "los").select(F.col("loan_id").alias("Application No"), F.col("applicant_name").alias("Customer Name"), F.col("current_address").alias("Address"), F.col("balance_transfer").cast("string").alias("Balance Transfer"))
    c.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(base)
    return files.read_seed(spark, base, {"Application No": "loan_id", "Customer Name": "name", "Address": "address", "Balance Transfer": "bt"}, flag="bt")


@add("SELECT CAST(run_id AS VARCHAR) AS run, engine FROM bench_runs")
def src_json(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01: documents of JSON read under one schema; members that it lacks are left out."""
    base = _emptied(spark, _folder(spark, "json"))
    table(spark, d, "bench_runs").select(F.col("run_id").cast("string").alias("run"), "engine", F.lit("more").alias("surplus")).write.json(base)
    return spark.read.schema("run string, engine string").json(base)


@add("SELECT DISTINCT loan_id, CAST(audit_id AS VARCHAR) AS check_id, type AS status FROM audit_log WHERE loan_id IS NOT NULL AND type IS NOT NULL")
def src_results(spark: SparkSession, d: str) -> DataFrame:
    """SRC-23: results read in whatever shape they were filed; the SQL are the rows that they were filed from."""
    a = table(spark, d, "audit_log").where("loan_id IS NOT NULL AND type IS NOT NULL").select("loan_id", F.col("audit_id").cast("string").alias("check_id"), F.col("type").alias("status")).distinct()
    one = F.to_json(F.struct("check_id", "status"))
    by_name = F.concat(F.lit('"'), "check_id", F.lit('":'), F.to_json(F.struct("status")))
    rows = a.groupBy("loan_id").agg(F.array_join(F.collect_list(one), ",").alias("a"), F.array_join(F.collect_list(by_name), ",").alias("b"), (F.count(F.lit(1)) % 4).alias("n"))
    text = (
        F.when(F.col("n") == 0, F.concat(F.lit("["), "a", F.lit("]"))).when(F.col("n") == 1, F.concat(F.lit('{"results":['), "a", F.lit("]}")))
        .when(F.col("n") == 2, F.concat(F.lit('{"checks":['), "a", F.lit("]}"))).otherwise(F.concat(F.lit("{"), "b", F.lit("}")))
    )
    return files.read_results(rows.select("loan_id", text.alias("text")), "loan_id")


@add(
    "SELECT d.doc_id, coalesce(nullif(trim(d.text), ''), e.t, 'Document Name: ' || d.doc_key) AS raw_text, greatest(1, CAST(round(d.n_chars / 1024.0) AS INTEGER)) AS size_kb, CASE WHEN e.t IS NOT NULL THEN 97.5::DOUBLE ELSE 96.5::DOUBLE END AS confidence, coalesce(e.pages, 1) AS pages FROM documents d "
    "LEFT JOIN (SELECT loan_id, doc_key, max(_formatted_text) AS t, max(pages) AS pages FROM extractions WHERE loan_id IS NOT NULL GROUP BY loan_id, doc_key) e ON e.loan_id = d.loan_id AND e.doc_key = d.doc_key"
)
def flt_documents(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14, FLT-15, ENT-04: documents as uniform records, filled from their extractions."""
    e = table(spark, d, "extractions").where("loan_id IS NOT NULL").groupBy("loan_id", "doc_key").agg(F.max("_formatted_text").alias("t"), F.max("pages").alias("pages"))
    j = table(spark, d, "documents").select("doc_id", "loan_id", "doc_key", "text", "n_chars").join(e, ["loan_id", "doc_key"], "left")
    return j.select(
        "doc_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "t", F.concat(F.lit("Document Name: "), "doc_key")).alias("raw_text"), F.greatest(F.lit(1), F.round(F.col("n_chars") / 1024.0).cast("int")).alias("size_kb"),
        F.when(F.col("t").isNotNull(), 97.5).otherwise(96.5).alias("confidence"), F.coalesce("pages", F.lit(1)).alias("pages"),
    )
