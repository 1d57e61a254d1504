"""Queries of the operators in this package. None of them can be said in SQL over whole tables; tests/llm holds brute-force versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import address, language, leakage, names, packing, pii
from attestra.session import split, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Loans whose applicant's, father's or card holder's names mean the same person."""
    return names.linked(table(spark, d, "los"), table(spark, d, "doc_fields"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of personal information in the extracted texts."""
    rows = table(spark, d, "extractions")
    return pii.occurrences(pii.find(split(rows.select("extraction_id", "_formatted_text")), pii.fitted(rows)))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The extracted texts with placeholders in place of personal information."""
    rows = table(spark, d, "extractions")
    found = pii.find(split(rows.select("extraction_id", "_formatted_text")), pii.fitted(rows))
    return found.select("extraction_id", "redacted", F.size("spans").cast("long").alias("n_spans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Address records of the same place."""
    return address.linked(address.address_records(table(spark, d, "los"), table(spark, d, "doc_fields")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where each piece of each document lies, for each capacity."""
    return packing.pack(split(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "pack_limits"))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share of each capacity."""
    return packing.usage(p7_containers(spark, d))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(split(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items of which they take over eighteen or more words in one stretch."""
    found = _leaked(spark, d).where("kind = 'literal'")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id")).distinct()


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with evaluation items taken over literally or with other values in their slots."""
    return _leaked(spark, d)


def _classified(spark: SparkSession, d: str, rest: bool = False) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.classify(split(documents.select("doc_id", "text", "lang")), language.fitted(documents), label="lang", rest=rest)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents that their labels do not name."""
    return language.unnamed(_classified(spark, d))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of each document, with a confidence."""
    return language.labels(_classified(spark, d, rest=True))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of mixed documents, each with its language and confidence."""
    each = _classified(spark, d, rest=True).where(F.size("segments") > 1).select("doc_id", F.posexplode("segments").alias("segment", "x"))
    return each.select("doc_id", "segment", "x.lang", "x.start_pos", "x.end_pos", "x.sentences", "x.confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p3_found, p4_found, p4_redacted, p5_found, p7_containers, p7_usage, p8_found, p8_templates, p9_found, p9_languages, p9_segments)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {}
