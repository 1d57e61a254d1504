"""Readers of files and writers of tables. Formats are Spark's own; what is here is the contract of each source."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-01: whole-file JSON documents under one schema, with the file each comes from. Members that the schema lacks are left out."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def read_seed(spark: SparkSession, path: str, columns: dict[str, str], flag: str | None = None) -> DataFrame:
    """SRC-22: a CSV of records. columns: header to name; a missing one is an error. Blanks are null, wholly blank rows are dropped, the flag is 0 where blank."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [h for h in columns if h not in raw.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    named = raw.select(*[F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(n) for h, n in columns.items()])
    named = named.where(F.coalesce(*named.columns).isNotNull())
    return named.withColumn(flag, F.coalesce(F.col(flag).try_cast("int"), F.lit(0))) if flag else named


def list_files(spark: SparkSession, path: str, limit: int = 50 * 1024 * 1024) -> DataFrame:
    """SRC-06, SRC-08, SRC-13, SRC-14: files below a folder with extension, category and whether they are small enough; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp"), "image").when(ext == "xml", "xml").when(ext == "json", "sidecar").otherwise("unsupported")
    return files.withColumns({"extension": ext, "category": kind, "accepted": (kind != "unsupported") & (F.col("length") <= limit)})


def xml_lines(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """SRC-12, UDTF-01: (key, ord, tag, value, line) of the nodes with text, depth first, without namespaces. Null gives nothing, broken XML one row with tag "error"."""

    def walk(source: str) -> Iterator[tuple[str, str]]:
        try:
            root = ET.fromstring(source)
        except ET.ParseError as e:
            yield "error", str(e)
            return
        for node in root.iter():
            value = (node.text or "").strip()
            if value:
                yield node.tag.rpartition("}")[2], value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, tag, v, f"{tag}: {v}") for k, t in zip(pdf[key], pdf[text]) if isinstance(t, str) for i, (tag, v) in enumerate(walk(t))]
            yield pd.DataFrame(rows, columns=[key, "ord", "tag", "value", "line"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, ord int, tag string, value string, line string")


def write_tier(df: DataFrame, path: str, by: str = "doc_key") -> None:
    """SNK-01, SNK-02, SNK-05, SNK-06: a tier partitioned by `by`; only the partitions that df has are replaced, each at once by the commit protocol."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without(df: DataFrame, gone: DataFrame, key: str = "loan_id") -> DataFrame:
    """SNK-07, SNK-08: what is left after a cascade delete; rows without a key stay."""
    return df.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def table_text(cells: DataFrame, key: str) -> DataFrame:
    """SNK-09, SNK-10, AGG-20: (key, text) of tables (key, row, col, text): rows as "a | b", in order, below a [TABLE] line."""
    rows = cells.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " | ").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit("[TABLE]\n"), body).alias("text"))


def read_results(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """SRC-23: (key, check_id, status) of results in any of their shapes: a list, a list under `results` or `checks`, or an object of objects by check.

    Null, broken and other JSON gives nothing.
    """
    v = documents.select(key, F.expr(f"try_parse_json({text})").alias("_v"))
    shape = F.expr("schema_of_variant(_v)")
    under = lambda p: F.expr(f"try_variant_get(_v, '{p}', 'array<variant>')")
    listed = F.when(shape.startswith("ARRAY"), under("$")).otherwise(F.coalesce(under("$.results"), under("$.checks")))
    rows = v.select(key, "_v", listed.alias("_l"))
    get = lambda e, p: F.expr(f"try_variant_get({e}, '{p}', 'string')")
    many = rows.where(F.col("_l").isNotNull()).select(key, F.explode("_l").alias("_e")).select(key, get("_e", "$.check_id").alias("check_id"), get("_e", "$.status").alias("status"))
    named = rows.where(F.col("_l").isNull() & shape.startswith("OBJECT")).select(key, F.explode(F.expr("try_variant_get(_v, '$', 'map<string,variant>')")).alias("check_id", "_e")).select(key, "check_id", get("_e", "$.status").alias("status"))
    return many.unionByName(named).where(F.col("check_id").isNotNull())
