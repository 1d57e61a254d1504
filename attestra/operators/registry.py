"""Sources by precedence, companions of documents, and the registry of documents: unions with ranks, anti joins and first-wins aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of documents of which a case has one.
SINGLETONS = ("Application Form", "Aadhaar", "PAN", "Sanction Letter", "Loan Agreement", "Disbursal Memo", "KFS", "Aadhaar XML")


def by_precedence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """SRC-02, SRC-04: one row per key from the first of the sources (in their order) that has it, with `origin`. Keys are unique in a source."""
    ranked = [df.withColumns({"origin": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    every = reduce(lambda a, b: a.unionByName(b), ranked).where(F.col(key).isNotNull())
    rest = [c for c in every.columns if c not in (key, "_rank")]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("x")).select(key, "x.*")


def fallback(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """SRC-25: all rows of a key from the first source that has any, with `origin`."""
    ranked = [df.withColumns({"origin": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    every = reduce(lambda a, b: a.unionByName(b), ranked).where(F.col(key).isNotNull())
    best = every.groupBy(key).agg(F.min("_rank").alias("_best"))
    return every.join(best, key).where(F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def file_route(name: Column, case: Column) -> Column:
    """SRC-07: where a file of a case's package goes, by its name; null for what is read as a document image."""
    low = F.lower(name)
    json = low.endswith(".json")
    return (
        F.when(low == "face_embeddings.json", "faces").when(low == "dms_status.json", "status").when(low == "loan_agreement_otp_audit.json", "otp")
        .when(json & (F.upper(F.regexp_replace(name, r"\.[^.]*$", "")) == F.upper(case)), "skipped").when(json & low.contains("metadata"), "skipped").when(json, "document")
    )


#: Extensions that are read, with their category and media type.
FILE_TYPES = {
    "pdf": ("pdf", "application/pdf"), "png": ("image", "image/png"), "jpg": ("image", "image/jpeg"), "jpeg": ("image", "image/jpeg"), "tif": ("image", "image/tiff"), "tiff": ("image", "image/tiff"),
    "bmp": ("image", "image/bmp"), "xml": ("xml", "application/xml"),
}
#: The largest file that is read.
FILE_BYTES = 50 * 1024 * 1024


def file_type(name: Column, size: Column) -> Column:
    """SRC-08, SRC-13, SRC-14, SRC-17: struct<category, mime, reader> of a file: category "unsupported" and reader "rejected" for unknown kinds, "rejected" for ones too large."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    types = F.create_map(*[x for e, (c, m) in FILE_TYPES.items() for x in (F.lit(e), F.struct(F.lit(c).alias("category"), F.lit(m).alias("mime")))])
    kind = F.try_element_at(types, ext)
    category = F.coalesce(kind["category"], F.lit("unsupported"))
    reader = F.when(kind.isNull() | (size > FILE_BYTES), "rejected").when(category == "pdf", "inspect_pdf").when(category == "image", "inspect_image").otherwise("read_xml")
    return F.struct(category.alias("category"), kind["mime"].alias("mime"), reader.alias("reader"))


def companions(wanted: DataFrame, known: DataFrame, canonical) -> DataFrame:
    """SRC-26: for each (loan_id, name) wanted the extraction of the loan that belongs to it: loan_id, name, found, rank.

    The same name counts before one of the same canonical kind, and that before one that holds the name or is held by it; ties by name.
    """
    names = wanted.select("loan_id", "name").distinct().join(known.select("loan_id", F.col("name").alias("found")).distinct(), "loan_id")
    rank = F.when(F.col("name") == F.col("found"), 0).when(canonical(F.col("name")) == canonical(F.col("found")), 1).when(F.contains("name", "found") | F.contains("found", "name"), 2)
    return names.withColumn("rank", rank).where(F.col("rank").isNotNull()).groupBy("loan_id", "name").agg(F.min(F.struct("rank", "found")).alias("x")).select("loan_id", "name", "x.found", "x.rank")


def fresh(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """SRC-28: sources (id, loan_id, doc_key, changed) with `hit`: whether a filled cache entry (loan_id, doc_key, written, size) is no older."""
    best = cache.where("size > 0").groupBy("loan_id", "doc_key").agg(F.max("written").alias("written"))
    return sources.join(best, ["loan_id", "doc_key"], "left").withColumn("hit", F.coalesce(F.col("written") >= F.col("changed"), F.lit(False))).drop("written")


def registered(uploads: DataFrame, cases: DataFrame, norm) -> DataFrame:
    """DED-01: uploads and case documents merged: case, id, name, type, ts, upload.

    Both have case, id, name, type, ts and ord. Of uploads of one (case, id) the last one stays. A case document goes if an upload, or a
    case document before it, has claimed its key: (case, type) for kinds of which a case has one, else (case, normalised name).
    """
    single = F.col("type").isin(*SINGLETONS) & F.col("case").isNotNull() & (F.col("case") != "GENERAL")
    key = F.when(single, F.col("type")).otherwise(norm(F.col("name")))
    latest = uploads.withColumn("_n", F.row_number().over(W.partitionBy("case", "id").orderBy(F.desc("ord")))).where("_n = 1").drop("_n")
    claimed = latest.select("case", key.alias("_key")).unionByName(latest.select("case", F.col("id").alias("_key"))).distinct()
    rest = cases.withColumn("_key", key)
    first = rest.withColumn("_n", F.row_number().over(W.partitionBy("case", "_key").orderBy("ord"))).where("_n = 1").drop("_n")
    kept = first.alias("c").join(claimed.alias("u"), F.col("c.case").eqNullSafe(F.col("u.case")) & (F.col("c._key") == F.col("u._key")), "left_anti")
    out = ["case", "id", "name", "type", "ts"]
    return latest.select(*out, F.lit(True).alias("upload")).unionByName(kept.select(*out, F.lit(False).alias("upload")))


def first_record(records: DataFrame, wanted: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """JN-06: for each loan and name in `wanted` (candidate check ids in order, then a field) the first record: loan_id, name, check_id, status.

    records: loan_id, check_id, field, status and ord, their order.
    """
    relation = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ids)).alias("ids"), F.lit(f).alias("field")) for n, (ids, f) in wanted.items()])
    each = records.withColumn("w", F.explode(relation))
    at = F.array_position("w.ids", F.col("check_id"))
    rank = F.when(at > 0, at).when(F.col("field") == F.col("w.field"), 1000)
    # By id the last record of it counts, by field the first one.
    order = F.struct(rank.alias("rank"), F.when(at > 0, -F.col("ord")).otherwise(F.col("ord")).alias("ord"))
    return each.where(rank.isNotNull()).groupBy("loan_id", F.col("w.name").alias("name")).agg(F.min_by(F.struct("check_id", "status"), order).alias("x")).select("loan_id", "name", "x.check_id", "x.status")


def synthetic(ids: DataFrame, docs: DataFrame, canonical) -> DataFrame:
    """JN-17: ids of the form doc-{case}-{slug} resolved: id, doc_id. docs: case, doc_id, name, type, ord.

    Of the case's documents the first one of the slug's canonical kind, or whose name or type holds the slug.
    """
    parsed = ids.where(F.col("id").startswith("doc-")).withColumn("_p", F.split("id", "-", 3)).where(F.size("_p") == 3)
    wanted = parsed.select("id", F.upper(F.trim(F.col("_p")[1])).alias("case"), F.trim(F.lower(F.col("_p")[2])).alias("slug"))
    known = docs.select(F.upper("case").alias("case"), "doc_id", "ord", F.lower("name").alias("name"), F.replace(F.lower("type"), F.lit(" "), F.lit("_")).alias("kind"), canonical(F.coalesce("name", "type")).alias("canon"))
    target = canonical(F.col("slug"))
    hit = (target != "miscellaneous") & (F.col("canon") == target) | F.contains("name", "slug") | F.contains("kind", "slug")
    return wanted.join(known, "case").where(hit).groupBy("id").agg(F.min_by("doc_id", "ord").alias("doc_id"))


def corrected(elements: DataFrame, corrections: DataFrame, *key: str) -> DataFrame:
    """JN-16, UDF-03: elements with the corrected text where there is one, its confidence, and the text as it was."""
    c = corrections.select(*key, F.col("text").alias("_text"), F.col("confidence").alias("_sure"))
    j = elements.join(c, list(key), "left")
    has = F.col("_text").isNotNull()
    return j.withColumns({"original": F.when(has, F.col("text")), "text": F.coalesce("_text", "text"), "confidence": F.coalesce("_sure", "confidence")}).drop("_text", "_sure")


def merged_order(merged: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """JN-20: merged tokens (key, id, of: ids of their parts) at the place of their earliest part: key, id, ord."""
    parts = merged.select(key, "id", F.explode("of").alias("part"))
    return parts.join(elements.select(key, F.col("id").alias("part"), "ord"), [key, "part"]).groupBy(key, "id").agg(F.min("ord").alias("ord"))


def without_parts(merged: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """SET-04: elements (key, id, ...) that are part of no merged token."""
    return elements.join(merged.select(key, F.explode("of").alias("id")).distinct(), [key, "id"], "left_anti")


#: What a line is taken for where a model for reading regions is absent: marks of misreading, and what they stand for.
MOCK_MARKS = ("HRTRR", "RROR", "HRAR", "HTT", "RHR", "3T9T3πT&T", "mąhil", "3QRR")
MOCK_TEXTS = ("भारत सरकार Government of India", "मेरा आधार, मेरी पहचान", "भारत सरकार", "Corrected Value")


def mock_reading(c: Column) -> Column:
    """UDF-03: the deterministic reading of a line by the model's stand-in; its confidence is 0.95."""
    t = F.trim(c)
    has = lambda *ws: F.greatest(*[t.contains(w) for w in ws], F.lit(False))
    misread = F.when(has("Government", "HRTRR", "HRAR"), MOCK_TEXTS[0]).when(has("3T9T3πT&T", "Aadhaar", "mąhil"), MOCK_TEXTS[1]).otherwise(MOCK_TEXTS[2])
    out = F.when(has(*MOCK_MARKS), misread).when(t.startswith("~") | t.startswith("`"), MOCK_TEXTS[3]).otherwise(t)
    return F.when(out == "", "Verified Entry").otherwise(out)
