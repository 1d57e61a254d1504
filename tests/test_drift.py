from __future__ import annotations

import datetime as dt
import json

from attestra.operators import drift

LINES = "raw_id bigint, feed string, file_no int, file_name string, line_no int, received_at timestamp, payload string, field string"


def lines(spark, files):
    out = []
    for no, records in files.items():
        for r in records:
            out.append((len(out), "f", no, "n", len(out), dt.datetime(2024, 1, 1), r if isinstance(r, str) or r is None else json.dumps(r), "clash"))
    return spark.createDataFrame(out, LINES)


def people(n, **make):
    return [{"loan_id": f"L{i}", **{k: f(i) for k, f in make.items()}} for i in range(n)]


def changes(spark, files):
    return {tuple(r) for r in drift.schema_changes(lines(spark, files)).collect()}


def test_all_kinds_of_change(spark):
    files = {
        1: people(8, pan=lambda i: f"PAN{i:04d}", tenure=lambda i: 12 + i, gone=lambda i: f"g{i}", flag=lambda i: i % 2),
        4: people(8, applicant_pan=lambda i: {"value": f"PAN{i:04d}"}, tenure=lambda i: str(12 + i), new=lambda i: f"n{i}", is_bt=lambda i: bool(i % 2)),
    }
    assert changes(spark, files) == {
        ("f", 4, "pan", "renamed", "applicant_pan"), ("f", 4, "applicant_pan", "type_changed", ""), ("f", 4, "tenure", "type_changed", ""),
        ("f", 4, "gone", "removed", ""), ("f", 4, "new", "added", ""), ("f", 4, "flag", "renamed", "is_bt"), ("f", 4, "is_bt", "type_changed", ""),
    }


def test_nothing_changes_by_order_repeats_nulls_and_broken_lines(spark):
    a = people(5, x=lambda i: i, y=lambda i: None)
    assert changes(spark, {2: [*a, *a, "{broken", "[1]", None, ""], 1: a[::-1]}) == set()
    assert changes(spark, {}) == set()


def test_all_null_has_no_type(spark):
    assert changes(spark, {1: people(4, x=lambda i: None), 2: people(4, x=lambda i: "s")}) == set()


def test_unrelated_fields_are_no_rename(spark):
    got = changes(spark, {1: people(9, branch=lambda i: f"b{i}"), 2: people(9, consent=lambda i: True)})
    assert got == {("f", 2, "branch", "removed", ""), ("f", 2, "consent", "added", "")}


def test_flooding_prefers_the_same_content():
    pairs = [("a", "x", "string", "string", 9, 9), ("a", "y", "string", "string", 9, 1), ("b", "x", "string", "string", 9, 1), ("b", "y", "string", "number", 9, 8)]
    assert {(o, n) for o, n, _ in drift.flood(graph(pairs))} == {("a", "x"), ("b", "y")}


def graph(pairs, nested=("", "")):
    return [drift.Pair(o, n, p, q, *nested, k, e, 0.1) for o, n, p, q, k, e in pairs]


def test_the_flooded_score_decides():
    """Middling contents are a rename if types, names and members speak for it, and none if they speak against."""
    same = drift.flood(graph([("address_text", "address", "object", "object", 10, 5)], ("OBJECT<line: STRING, pin: STRING>",) * 2))
    other = drift.flood(graph([("address_text", "mobile", "object", "number", 10, 5)], ("OBJECT<line: STRING>", None)))
    assert [x[:2] for x in same] == [("address_text", "address")] and other == []
    # Members that agree raise a score, names without a shared record decide by themselves.
    plain = drift.flood(graph([("a", "b", "array", "object", 10, 8)]))[0][2]
    assert drift.flood(graph([("a", "b", "array", "object", 10, 8)], ("ARRAY<OBJECT<x: STRING>>", "OBJECT<x: STRING>")))[0][2] > plain
    assert drift.flood(graph([("pan_no", "panNo", "string", "string", 0, 0), ("branch", "consent", "string", "string", 0, 0)])) [0][:2] == ("pan_no", "panNo")


def test_unified_names(spark):
    files = {n: people(6, **{name: lambda i: f"PAN{i:04d}"}) for n, name in enumerate(("pan", "panNo", "pan", "panNo"))}
    out = drift.unified_table(lines(spark, files)).collect()
    assert len(out) == 24 and len({k for r in out for k in r["fields"] if k != "loan_id"}) == 1


def test_typed_columns(spark):
    make = {"amount": lambda i: 1000.5 + i, "ok": lambda i: i % 2 == 0, "tags": lambda i: [f"a{i}"], "card": lambda i: {"value": f"C{i}"}, "Feed": lambda i: "clash", "note": lambda i: None}
    files = {0: people(6, pan=lambda i: f"PAN{i:04d}", **make), 1: people(6, panNo=lambda i: f"PAN{i:04d}", **{**make, "amount": lambda i: str(1000.5 + i)})}
    out = drift.typed_table(lines(spark, files))
    kinds = dict(out.dtypes)
    assert kinds["amount"] == "double" and kinds["ok"] == "boolean" and kinds["tags"] == "array<string>" and kinds["card"] == "map<string,string>" and kinds["Feed_2"] == "string"
    assert len({"pan", "panNo"} & set(kinds)) == 1 and out.count() == 12 and {r["amount"] for r in out.collect()} == {1000.5 + i for i in range(6)}
    assert drift.typed_table(lines(spark, {})).count() == 0


def test_one_rename_unites_and_recorded_values_stay(spark):
    extra = {"tenure": lambda i: f"{i + 2} {'years' if i % 2 else 'months'}", "tags": lambda i: [f"a{i}", f"b{i}"], "card": lambda i: {"value": f"C{i}", "checked": i % 2 == 0}, "amount": lambda i: 1000.0 + i}
    files = {0: people(6, pan=lambda i: f"PAN{i:04d}", **extra), 1: people(6, panNo=lambda i: f"PAN{i:04d}", **extra)}
    out = [r.asDict() for r in drift.unified_table(lines(spark, files)).collect()]
    assert len({k for r in out for k in r["fields"]} & {"pan", "panNo"}) == 1
    fields, types = out[0]["fields"], out[0]["types"]
    assert {r["fields"]["tenure"] for r in out} >= {"2 months", "3 years"} and types["tenure"] == "string"
    assert len(json.loads(fields["tags"])) == 2 and types["tags"] == "array" and set(json.loads(fields["card"])) == {"value", "checked"} and types["card"] == "object"
    assert fields["amount"].startswith("100") and "." not in fields["amount"] and types["amount"] == "number"


def test_two_fields_of_one_concept_in_a_line_both_stay(spark):
    files = {n: people(6, **{name: lambda i: f"PAN{i:04d}"}) for n, name in enumerate(("pan", "panNo"))}
    stray = [{"loan_id": "stray", "pan": "PAN9998", "panNo": "PAN9999"}]
    out = drift.unified_table(lines(spark, {**files, 2: people(6, panNo=lambda i: f"PAN{i:04d}") + stray})).collect()
    got = [r["fields"] for r in out if r["fields"].get("loan_id") == "stray"]
    assert len(got) == 1 and {got[0].get("pan"), got[0].get("panNo")} == {"PAN9998", "PAN9999"}
