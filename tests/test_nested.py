from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.operators import nested


def rebuild(nodes):
    """The leaves of a record as {path with positions: value}, from its nodes."""
    return {(p, d, n): v for p, d, n, k, v in nodes if k != "object"}


def leaves(x, path="", label="", name=None):
    if isinstance(x, dict):
        out = {}
        for k, v in x.items():
            out |= leaves(v, f"{path.removesuffix('[]') if path.endswith('[]') else path}.{k}".lstrip("."), label, k)
        return out
    if isinstance(x, list):
        out = {}
        for i, v in enumerate(x):
            out |= leaves(v, path + "[]", f"{label}.{i}".lstrip("."))
        return out
    return {(path, label, name): None if x is None else x if isinstance(x, str) else json.dumps(x)}


value = st.recursive(st.none() | st.integers(0, 9) | st.text("ab", max_size=2), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b"]), c, max_size=2), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["x", "y"]), value, max_size=2))
def test_no_leaf_is_lost(record):
    assert rebuild(nested.shred(json.dumps(record), nested.Layout())) == leaves(record)


REPORTS = [
    (1, json.dumps({"benchmark_results": [{"document": "a", "pages": [{"page": 7, "per_field_containment": {"Pin": None}, "missing_fields": ["Pin", "Sex"]}]}]})),
    (2, json.dumps({"ocr_bench_report": {"document": "b", "pages": [{"per_field_containment": [{"field": "PAN", "containment": 0.5}]}]}})),
    (3, json.dumps({"benchmark_results": {"document": "c", "pages": None}})),
    (4, None), (5, "{broken"), (6, ""), (7, "{}"),
]


def test_layouts_give_the_same_keys(spark):
    runs = spark.createDataFrame([(*r, "clash") for r in REPORTS], "run_id bigint, ocr_bench_report string, dewey string")
    inspections = spark.createDataFrame(
        [(1, ([{"index": 5, "dewey": "d"}, None],)), (2, ([],)), (3, (None,)), (4, None)],
        "inspection_id bigint, pyhanko_inspection struct<signatures: array<struct<index: int, dewey: string>>>",
    )
    got = {(r[0], r[1], r[2], r[3]) for r in nested.child_rows(inspections, runs).collect()}
    assert got == {
        ("inspection", 1, "signature", "0"), ("inspection", 1, "signature", "1"),
        ("bench_run", 1, "document", "0"), ("bench_run", 1, "page", "0.0"), ("bench_run", 1, "field", "0.0.Pin"), ("bench_run", 1, "missing", "0.0.0"), ("bench_run", 1, "missing", "0.0.1"),
        ("bench_run", 2, "document", "0"), ("bench_run", 2, "page", "0.0"), ("bench_run", 2, "field", "0.0.PAN"), ("bench_run", 3, "document", "0"),
    }
    assert "dewey_" in nested.struct_tables(inspections, "inspection_id", "pyhanko_inspection")["signatures"].columns


def test_flat_tables(spark):
    runs = spark.createDataFrame(REPORTS, "run_id bigint, ocr_bench_report string")
    tables = nested.bench_tables(runs)
    assert {(r["run_id"], r["dewey"], r["document"]) for r in tables["documents"].collect()} == {(1, "0", "a"), (2, "0", "b"), (3, "0", "c")}
    assert [(r["page"], r["parent"]) for r in tables["pages"].where("run_id = 1").collect()] == [(7, "0")]
    assert tables["nodes"].where("kind = 'error'").count() == 1
    assert nested.child_rows(
        spark.createDataFrame([], "inspection_id bigint, pyhanko_inspection struct<signatures: array<struct<index: int>>>"), runs.limit(0)
    ).count() == 0


def test_reports_without_documents_and_their_members(spark):
    reports = [(1, '{"ocr_bench_report": {"benchmark_results": []}, "tool": {"name": "bench", "build": 7}}'), (2, '{"benchmark_results": null}'), (3, None), (4, "{broken")]
    got = {r["run_id"]: r for r in nested.bench_tables(spark.createDataFrame(reports, "run_id bigint, ocr_bench_report string"))["reports"].collect()}
    assert set(got) == {1, 2, 4} and got[1]["members"] == {"tool.name": "bench", "tool.build": "7"} and got[4]["error"]


def test_all_members_have_a_table(spark, small):
    import __spark_entry__ as contract

    queries = contract.queries()
    columns = queries["p6_signature_members"](spark, small).columns
    assert {"coverage", "summary", "signing_time", "validation_error", "signer_issuer_dn"} <= set(columns)
    assert queries["p6_inspections"](spark, small).count() == queries["p6_inspections"](spark, small).select("inspection_id").distinct().count() > 0
    assert {r["path"] for r in queries["p6_nodes"](spark, small).select("path").distinct().collect()} >= {"tool.name"}
