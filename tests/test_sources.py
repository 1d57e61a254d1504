from __future__ import annotations

import json

import pytest

from attestra.sources import files


def test_json_and_listing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"loan_id": "L1", "extra": 1}, indent=1))
    (tmp_path / "b.pdf").write_bytes(b"x" * 10)
    (tmp_path / "c.exe").write_bytes(b"x")
    rows = files.read_json(spark, str(tmp_path / "*.json"), "loan_id string, missing int").collect()
    assert [(r["loan_id"], r["missing"], r["file"]) for r in rows] == [("L1", None, "a.json")]
    kinds = {r["extension"]: (r["category"], r["accepted"]) for r in files.list_files(spark, str(tmp_path), limit=50).collect()}
    assert kinds["pdf"] == ("pdf", True) and kinds["exe"] == ("unsupported", False) and kinds["json"][0] == "sidecar"


def test_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text('No,Name,BT\n1,"Rao, A",\n,,\n2, ,1\n')
    rows = files.read_seed(spark, str(tmp_path / "s.csv"), {"No": "id", "Name": "name", "BT": "bt"}, flag="bt").collect()
    assert [tuple(r) for r in rows] == [("1", "Rao, A", 0), ("2", None, 1)]
    with pytest.raises(ValueError):
        files.read_seed(spark, str(tmp_path / "s.csv"), {"Age": "age"})


def test_xml(spark):
    docs = spark.createDataFrame([("a", '<r xmlns="u"><x>1</x><y><z> two </z></y></r>'), ("b", "<broken"), ("c", None)], "path string, text string")
    assert [(r["path"], r["ord"], r["line"]) for r in files.xml_lines(docs).where("tag <> 'error'").collect()] == [("a", 0, "x: 1"), ("a", 1, "z: two")]
    assert files.xml_lines(docs).where("tag = 'error'").count() == 1


def test_tiers(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_tier(spark.createDataFrame([("L1", "kfs", 1), ("L1", "pan", 1)], "loan_id string, doc_key string, v int"), path)
    files.write_tier(spark.createDataFrame([("L1", "kfs", 2)], "loan_id string, doc_key string, v int"), path)
    now = spark.read.parquet(path)
    assert {(r["doc_key"], r["v"]) for r in now.collect()} == {("kfs", 2), ("pan", 1)}
    gone = spark.createDataFrame([("L1",), (None,)], "loan_id string")
    more = now.unionByName(spark.createDataFrame([(None, 3, "pan")], "loan_id string, v int, doc_key string"))
    assert [r["v"] for r in files.without(more, gone).collect()] == [3]


def test_table_text(spark):
    cells = spark.createDataFrame([(1, 1, 0, "c"), (1, 0, 1, None), (1, 0, 0, "a"), (1, 1, 1, "d")], "id int, row int, col int, text string")
    assert files.table_text(cells, "id").collect()[0]["text"] == "[TABLE]\na | \nc | d"
