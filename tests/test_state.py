"""The batch fold, the stream and a plain loop give the same states."""

from __future__ import annotations

import datetime as dt
import random

from attestra.operators import state
from attestra.streaming.audit import audit_stream, progress, run_status

SCHEMA = "loan_id string, event_ts timestamp, audit_id bigint, type string, error string"


def plain(rows):
    out = {}
    for loan, _, _, kind, error in sorted({r for r in rows if r[0] and r[3]}, key=lambda r: (r[1], r[2])):
        s = out.setdefault(loan, ["", [], set(), 0])
        s[0], s[3] = kind, s[3] + 1
        if not s[1] or s[1][-1] != kind:
            s[1].append(kind)
        if error:
            s[2].add(error)
    return {k: (c, ">".join(h), "|".join(sorted(e)), n) for k, (c, h, e, n) in out.items()}


def events(n=120, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["A", "B", None]), start + dt.timedelta(hours=3 * i), i, rng.choice(["x", "y", None]), rng.choice([None, "e1", "e2"])) for i in range(n)]
    return rows


def test_batch_fold(spark):
    rows = events()
    got = {r["loan_id"]: (r["current"], r["history"], r["errors"], r["events"]) for r in state.fold_status(spark.createDataFrame(rows + rows[:20], SCHEMA)).collect()}
    assert got == plain(rows)
    assert state.fold_status(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch_with_repeats_and_late_events(spark, tmp_path):
    rows = events()
    random.Random(5).shuffle(rows)  # late ones among them
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40] + rows[:7], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    query = run_status(audit_stream(spark, str(tmp_path / "in"), source.schema, files=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(180)
    states = spark.read.parquet(str(tmp_path / "out" / "status"))
    got = {r["loan_id"]: (r["current"], r["history"], r["errors"], r["events"]) for r in state.newest_first(states).collect()}
    assert got == plain(rows) and states.select("batch").distinct().count() == 3


def test_progress(spark):
    got = [tuple(r) for r in progress(spark.createDataFrame(events(8), SCHEMA)).where("loan_id = 'A'").orderBy("step").collect()]
    assert got[0] == ("A", 0, "start", "started") and got[-1][2:] == ("finish", "done") and all(r[3] == "completed" for r in got[1:-1])
