"""Queries of the general training-data operators (problems 1, 2 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import drift, nested, units
from attestra.session import split, table

DURATIONS = ("loan_validity", "tenure_months", "tenure")


def _durations(spark: SparkSession, d: str) -> DataFrame:
    months = units.annuity_months(F.col("loan_amount"), F.col("irr_percent"), F.col("emi"))
    return units.reconcile_durations(split(table(spark, d, "los")), table(spark, d, "source_notes"), "row_id", DURATIONS, months)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Recorded durations that were not given in months, in months."""
    return units.converted(_durations(spark, d)).select("row_id", "field", F.col("months_rounded").cast("long").alias("months"))


def p1_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded duration in months, with the unit, how it was found and whether it is the only one that fits."""
    return _durations(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of top-level fields between the files of each feed."""
    return drift.schema_changes(table(spark, d, "raw_records"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """All lines in one table with a typed column per concept."""
    return drift.typed_table(table(spark, d, "raw_records"))


def p2_concepts(spark: SparkSession, d: str) -> DataFrame:
    """All lines with one map of values and one of types, by the names of concepts."""
    return drift.unified_table(table(spark, d, "raw_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The children of inspections and benchmark runs."""
    return nested.child_rows(table(spark, d, "inspections"), split(table(spark, d, "bench_runs").select("run_id", "ocr_bench_report")))


def p6_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of signatures."""
    at = nested.struct_tables(table(spark, d, "inspections"), "inspection_id", "pyhanko_inspection")["signatures"]
    return at.select("inspection_id", F.col("dewey").cast("long").alias("pos"), "sig_type", "intact", "valid", "trusted", "signer_common_name")


def p6_inspections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of inspections with all their members."""
    return nested.struct_tables(table(spark, d, "inspections"), "inspection_id", "pyhanko_inspection")[""]


def p6_signature_members(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of signatures with all their members."""
    return nested.struct_tables(table(spark, d, "inspections"), "inspection_id", "pyhanko_inspection")["signatures"]


def _bench(part: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.bench_tables(table(spark, d, "bench_runs"))[part]

    query.__doc__ = f"The flat table of the {part} of benchmark reports."
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (p1_found, p1_reconciled, p2_found, p2_unified, p2_concepts, p6_found, p6_signatures, p6_inspections, p6_signature_members)}
    return out | {f"p6_{part}": _bench(part) for part in ("reports", "documents", "pages", "fields", "missing", "nodes")}


#: The documents, pages, entries and missing fields of reports of any layout.
_REPORTS = """
    WITH u AS (SELECT run_id, CASE WHEN json_type(j -> 'ocr_bench_report') = 'OBJECT' THEN j -> 'ocr_bench_report' ELSE j END AS j
               FROM (SELECT run_id, CASE WHEN json_valid(ocr_bench_report) THEN CAST(ocr_bench_report AS JSON) END AS j FROM bench_runs)),
    b AS (SELECT run_id, CASE WHEN json_type(j -> 'benchmark_results') = 'ARRAY' THEN j -> 'benchmark_results' WHEN json_type(j -> 'benchmark_results') = 'OBJECT' THEN json_array(j -> 'benchmark_results')
                 WHEN (j -> 'benchmark_results') IS NULL AND coalesce(j -> 'document', j -> 'summary', j -> 'pages') IS NOT NULL THEN json_array(j) END AS a FROM u),
    d AS (SELECT run_id, i AS d, json_extract(a, '$[' || i || ']') AS doc FROM (SELECT run_id, a, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS i FROM b WHERE a IS NOT NULL)),
    p AS (SELECT run_id, d, i AS p, json_extract(a, '$[' || i || ']') AS page FROM (SELECT run_id, d, a, unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS i FROM
          (SELECT run_id, d, CASE json_type(doc -> 'pages') WHEN 'ARRAY' THEN doc -> 'pages' WHEN 'OBJECT' THEN json_array(doc -> 'pages') END AS a FROM d) WHERE a IS NOT NULL)),
    c AS (SELECT run_id, d, p, page -> 'per_field_containment' AS f, page -> 'missing_fields' AS m FROM p),
    f AS (SELECT run_id, d, p, name, f ->> name AS v FROM (SELECT *, unnest(json_keys(f)) AS name FROM c WHERE json_type(f) = 'OBJECT')
          UNION ALL SELECT run_id, d, p, json_extract_string(f, '$[' || i || '].field') AS name, json_extract_string(f, '$[' || i || '].containment') AS v FROM (SELECT run_id, d, p, f, unnest(range(0, CAST(json_array_length(f) AS BIGINT))) AS i FROM c WHERE json_type(f) = 'ARRAY')),
    m AS (SELECT run_id, d, p, i AS m, json_extract_string(m, '$[' || i || ']') AS name FROM (SELECT run_id, d, p, m, unnest(range(0, CAST(json_array_length(m) AS BIGINT))) AS i FROM c WHERE json_type(m) = 'ARRAY'))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _REPORTS
        + """
            SELECT 'inspection' AS record_kind, inspection_id AS record_id, 'signature' AS child_kind, CAST(i AS VARCHAR) AS child_key FROM (SELECT inspection_id, unnest(range(0, len(pyhanko_inspection.signatures))) AS i FROM inspections)
            UNION ALL SELECT 'bench_run', run_id, 'document', CAST(d AS VARCHAR) FROM d UNION ALL SELECT 'bench_run', run_id, 'page', d || '.' || p FROM p
            UNION ALL SELECT 'bench_run', run_id, 'field', d || '.' || p || '.' || name FROM f UNION ALL SELECT 'bench_run', run_id, 'missing', d || '.' || p || '.' || m FROM m
        """,
        "p6_missing": _REPORTS + "SELECT run_id, d || '.' || p || '.' || m AS dewey, d || '.' || p AS parent, name AS field FROM m",
        "p6_fields": _REPORTS + "SELECT run_id, d || '.' || p AS parent, name AS field, TRY_CAST(v AS DOUBLE) AS containment FROM f",
        "p6_pages": _REPORTS
        + """
            SELECT run_id, d || '.' || p AS dewey, CAST(d AS VARCHAR) AS parent, TRY_CAST(page ->> 'page' AS BIGINT) AS page, TRY_CAST(page ->> 'field_recall' AS DOUBLE) AS field_recall,
                   TRY_CAST(page ->> 'fields_found' AS BIGINT) AS fields_found, TRY_CAST(page ->> 'fields_total' AS BIGINT) AS fields_total, TRY_CAST(page ->> 'mean_containment' AS DOUBLE) AS mean_containment FROM p
        """,
        "p6_documents": _REPORTS
        + """
            SELECT run_id, CAST(d AS VARCHAR) AS dewey, '' AS parent, doc ->> 'document' AS document, TRY_CAST(doc -> 'summary' ->> 'doc_cer' AS DOUBLE) AS doc_cer, TRY_CAST(doc -> 'summary' ->> 'doc_wer' AS DOUBLE) AS doc_wer,
                   TRY_CAST(doc -> 'summary' ->> 'avg_field_recall' AS DOUBLE) AS avg_field_recall, TRY_CAST(doc -> 'summary' ->> 'total_elements_extracted' AS BIGINT) AS total_elements_extracted FROM d
        """,
        "p6_signatures": """
            SELECT inspection_id, CAST(i - 1 AS BIGINT) AS pos, s.sig_type AS sig_type, s.intact AS intact, s.valid AS valid,
                   s.trusted AS trusted, s.signer.common_name AS signer_common_name
            FROM (SELECT inspection_id, pyhanko_inspection.signatures AS a, unnest(range(1, len(pyhanko_inspection.signatures) + 1)) AS i
                  FROM inspections WHERE len(pyhanko_inspection.signatures) > 0) t, LATERAL (SELECT a[i] AS s) u
        """
    }
