"""Problem 6: deeply nested records turned into related flat tables by Dewey labels.

Every node of a record has an ordinal path, its Dewey label ("2.0.5": sixth entry in the first item in the third).
The label of a node's parent is the label cut by one component, so parent-child links need no join to be derived.
Nodes are grouped by schema path into tables.

Two readers give the same labels: `struct_tables` walks the type of a STRUCT column and stays in the JVM,
`json_nodes` reads JSON text whose layout varies from record to record (depth unknown, so it needs Python).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parent_label(label: Column) -> Column:
    """The Dewey label of the parent: the label without its last component ('' for a root's child)."""
    return F.when(F.instr(label, ".") > 0, F.regexp_replace(label, r"\.[^.]*$", "")).otherwise(F.lit(""))


def struct_tables(rows: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Flat tables of a STRUCT column, by schema path ("" is the record itself).

    Each has key, dewey, parent and the scalar members (nested structs are flattened with "_"). Arrays of structs and
    of scalars become tables of their own at their path; scalars have the column `value`. A null record gives a row
    without values in table "" and no children; null and empty arrays give no children; a null element gives a row
    with null members, since it takes a position. A member that clashes with key, dewey or parent gets the suffix "_".
    """
    out: dict[str, DataFrame] = {}

    def members(ref: str, kind: T.StructType, prefix: str = "") -> tuple[list[Column], list[tuple[str, str, T.ArrayType]]]:
        scalars, arrays = [], []
        for f in kind.fields:
            name, at = f"{prefix}{f.name}", f"{ref}.`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                s, a = members(at, f.dataType, f"{name}_")
                scalars, arrays = scalars + s, arrays + a
            elif isinstance(f.dataType, T.ArrayType):
                arrays.append((name, at, f.dataType))
            else:
                scalars.append(F.col(at).alias(f"{name}_" if name in (key, "dewey", "parent") else name))
        return scalars, arrays

    def walk(df: DataFrame, kind: T.StructType, path: str) -> None:
        scalars, arrays = members("_node", kind)
        out[path] = df.select(key, "dewey", parent_label(F.col("dewey")).alias("parent"), *scalars)
        for name, at, typ in arrays:
            below = df.select(key, F.col("dewey").alias("_up"), F.posexplode(F.col(at)).alias("_pos", "_node")).select(
                key, F.concat_ws(".", F.nullif(F.col("_up"), F.lit("")), F.col("_pos").cast("string")).alias("dewey"), "_node"
            )
            child = f"{path}.{name}".lstrip(".")
            if isinstance(typ.elementType, T.StructType):
                walk(below, typ.elementType, child)
            else:
                out[child] = below.select(key, "dewey", parent_label(F.col("dewey")).alias("parent"), F.col("_node").alias("value"))

    walk(rows.select(key, F.lit("").alias("dewey"), F.col(column).alias("_node")), rows.schema[column].dataType, "")
    return out


@dataclass
class Layout:
    """How the layouts of one kind of JSON record differ.

    wrappers: members that may hold the whole record. root: the path of the items where the record may itself be the only item.
    repeats: paths whose values are arrays, where one value without an array counts as position 0.
    keyed: paths of maps that may be written as arrays of entries instead, with the names of an entry's key and value.
    """

    wrappers: tuple[str, ...] = ()
    root: str = ""
    root_marks: tuple[str, ...] = ()
    repeats: tuple[str, ...] = ()
    keyed: dict[str, tuple[str, str]] = field(default_factory=dict)


def shred(text: str | None, layout: Layout) -> list[tuple[str, str, str | None, str, str | None]]:
    """(path, dewey, name, kind, value) of all nodes of one record. An unreadable one gives a single node of kind error."""
    if text is None:
        return []
    try:
        record = json.loads(text)
    except ValueError as e:
        return [("", "", None, "error", str(e)[:200])]
    beside: dict = {}
    for _ in range(len(layout.wrappers) + 1):
        for w in layout.wrappers:
            if isinstance(record, dict) and w in record:
                beside |= {k: v for k, v in record.items() if k != w}
                record = json.loads(record[w]) if isinstance(record[w], str) else record[w]
    if layout.root and isinstance(record, list):
        record = {layout.root: record}
    if layout.root and isinstance(record, dict) and layout.root not in record and any(m in record for m in layout.root_marks):
        record = {layout.root: record}
    # What stands beside the wrapped record is the record's too.
    if isinstance(record, dict):
        record = {**beside, **record}
    out: list[tuple[str, str, str | None, str, str | None]] = []
    stack = [("", "", None, record)]
    while stack:
        path, label, name, node = stack.pop()
        if path in layout.keyed and isinstance(node, list):
            k, v = layout.keyed[path]
            node = {str(e[k]): e.get(v) for e in node if isinstance(e, dict) and e.get(k) is not None}
        if path in layout.repeats and node is not None and not isinstance(node, list):
            node = [node]
        if isinstance(node, list):
            stack += [(path + "[]", f"{label}.{i}".lstrip("."), None, x) for i, x in enumerate(node)]
            continue
        if isinstance(node, dict):
            out.append((path, label, name, "object", None))
            below = path.removesuffix("[]") if path.endswith("[]") else path
            for member, x in node.items():
                where = f"{path}{{}}" if path in layout.keyed else f"{below}.{member}".lstrip(".")
                stack.append((where, label, member, x))
            continue
        kind = "null" if node is None else "bool" if isinstance(node, bool) else "number" if isinstance(node, int | float) else "string"
        out.append((path, label, name, kind, None if node is None else node if isinstance(node, str) else json.dumps(node)))
    return out


NODE = "path string, dewey string, name string, kind string, value string"


def json_nodes(rows: DataFrame, key: str, column: str, layout: Layout) -> DataFrame:
    """One row (key, path, dewey, name, kind, value) per node of a JSON column.

    dewey holds the positions in arrays on the way to the node, so the parent's label is the label cut by one. Members
    of one object share its label and differ by name. Null and empty records give no row, unreadable ones a row of kind error.
    """
    names = ["path", "dewey", "name", "kind", "value"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows_out = [(k, *n) for k, t in zip(pdf[key], pdf[column]) for n in shred(t if isinstance(t, str) and t.strip() else None, layout)]
            yield pd.DataFrame(rows_out, columns=[key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, column).mapInPandas(read, f"{key} {kind}, {NODE}")


#: The layouts in which benchmark reports come.
BENCH_LAYOUT = Layout(
    wrappers=("ocr_bench_report",),
    root="benchmark_results",
    root_marks=("document", "summary", "pages"),
    repeats=("benchmark_results", "benchmark_results.pages", "benchmark_results.pages.missing_fields"),
    keyed={"benchmark_results.pages.per_field_containment": ("field", "containment")},
)


def bench_tables(rows: DataFrame, key: str = "run_id", column: str = "ocr_bench_report") -> dict[str, DataFrame]:
    """reports, documents, pages, fields and missing fields of benchmark reports, with keys to their parents.

    reports has a row per report that is no null, also without documents: `members` has what it says outside of its
    documents by path (items of arrays also by label), `error` why it could not be read. nodes has every node of every path.
    """
    nodes = json_nodes(rows, key, column, BENCH_LAYOUT)
    base = "benchmark_results"
    number = F.expr("try_cast(value as double)")

    def members(path: str, kinds: dict[str, str]) -> DataFrame:
        """The objects at path with their scalar members; one aggregation over the nodes of that path."""
        at = path + "[]"
        own = nodes.where((F.col("path") == at) | F.col("path").isin([f"{path}.{m}" for m in kinds] + [f"{path}.summary.{m}" for m in kinds]))
        cols = [F.max(F.when(F.col("name") == m, F.expr(f"try_cast(value as {t})"))).alias(m) for m, t in kinds.items()]
        return own.groupBy(key, "dewey").agg(*cols).withColumn("parent", parent_label(F.col("dewey")))

    doc = {"document": "string", "doc_cer": "double", "doc_wer": "double", "avg_field_recall": "double", "total_elements_extracted": "bigint"}
    page = {"page": "bigint", "field_recall": "double", "fields_found": "bigint", "fields_total": "bigint", "mean_containment": "double"}
    where = f"{base}.pages.per_field_containment{{}}"
    about = nodes.where(~F.col("path").startswith(base))
    place = F.when(F.col("dewey") == "", F.col("path")).otherwise(F.concat_ws(" ", "path", "dewey"))
    member = F.when(~F.col("kind").isin("object", "error"), F.struct(place.alias("path"), F.col("value").alias("value")))
    reports = about.groupBy(key).agg(F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"), F.map_from_entries(F.array_sort(F.collect_set(member))).alias("members"))
    return {
        "nodes": nodes,
        "reports": reports.select(key, F.lit("").alias("dewey"), "error", "members"),
        "documents": members(base, doc),
        "pages": members(f"{base}.pages", page),
        "fields": nodes.where(F.col("path") == where).select(key, F.col("dewey").alias("parent"), F.col("name").alias("field"), number.alias("containment")),
        "missing": nodes.where(F.col("path") == f"{base}.pages.missing_fields[]").select(
            key, "dewey", parent_label(F.col("dewey")).alias("parent"), F.col("value").alias("field")
        ),
    }


def child_rows(inspections: DataFrame, runs: DataFrame) -> DataFrame:
    """Every child row of inspections and benchmark runs: (record_kind, record_id, child_kind, child_key)."""
    signatures = struct_tables(inspections, "inspection_id", "pyhanko_inspection")["signatures"].select(
        F.lit("inspection").alias("record_kind"), F.col("inspection_id").alias("record_id"), F.lit("signature").alias("child_kind"), F.col("dewey").alias("child_key")
    )
    nodes = json_nodes(runs, "run_id", "ocr_bench_report", BENCH_LAYOUT)
    path, base = F.col("path"), "benchmark_results"
    kind = (
        F.when(path == f"{base}[]", "document")
        .when(path == f"{base}.pages[]", "page")
        .when(path == f"{base}.pages.per_field_containment{{}}", "field")
        .when(path == f"{base}.pages.missing_fields[]", "missing")
    )
    children = nodes.select(
        F.lit("bench_run").alias("record_kind"),
        F.col("run_id").alias("record_id"),
        kind.alias("child_kind"),
        F.when(kind == "field", F.concat_ws(".", "dewey", "name")).otherwise(F.col("dewey")).alias("child_key"),
    ).where(F.col("child_kind").isNotNull())
    return signatures.unionByName(children)
