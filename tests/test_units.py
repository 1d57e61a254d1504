from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestra.operators import units
from attestra.plans import training

COLUMNS = ("loan_validity", "tenure_months", "tenure")
LOS = "row_id bigint, source_id string, loaded_at timestamp, loan_validity string, tenure_months int, tenure int, loan_amount double, irr_percent double, emi double, months string, _n int"
DAY = dt.datetime(2024, 5, 1)


def emi(amount, rate, n):
    r = rate / 1200
    return round(amount * r * (1 + r) ** n / ((1 + r) ** n - 1), 2)


def reconcile(spark, rows, notes):
    los = spark.createDataFrame([(i, s, DAY, v, tm, t, a, r, e, "x", 1) for i, (s, v, tm, t, a, r, e) in enumerate(rows)], LOS)
    table = spark.createDataFrame(notes, "source_id string, note string")
    months = units.annuity_months(F.col("loan_amount"), F.col("irr_percent"), F.col("emi"))
    return {(x["row_id"], x["field"]): x for x in units.reconcile_durations(los, table, "row_id", COLUMNS, months).collect()}


def test_written_units(spark):
    texts = {
        "2.5 years": (30, "year"), "P3Y6M": (42, "mixed"), "4 qtrs": (12, "quarter"), "39W": (9, "week"), "730 Days": (24, "day"), "20 half-years": (120, "half_year"), "forty eight mths": (48, "month"),
        "yrs 8": (96, "year"), "९ महीने": (9, "month"), "three year term": (36, "year"), "2 y + 6 m": (30, "mixed"), "26 fortnights": (12, "fortnight"),
    }
    got = reconcile(spark, [("S", t, None, None, None, None, None) for t in texts], [("S", None)])
    for i, (months, unit) in enumerate(texts.values()):
        assert (got[i, "loan_validity"]["months_rounded"], got[i, "loan_validity"]["unit"]) == (months, unit)


def test_values_without_duration_give_nothing(spark):
    assert reconcile(spark, [("S", v, None, None, None, None, None) for v in ("", "NA", "-", "as per KFS", None, "0")], [("S", "months")]) == {}


def test_note_and_identity(spark):
    notes = [("Q", "The clerk keys the tenor as a plain figure that counts quarters of a year."), ("M", "Monthly figures only.")]
    rows = [
        ("Q", "6", None, 6, 100000.0, 12.0, emi(100000, 12, 18)),  # agrees with the note
        ("M", None, None, 3, 100000.0, 12.0, emi(100000, 12, 36)),  # contradicted: years
        ("M", None, None, 24, 100000.0, 12.0, emi(100000, 12, 24)),
        ("M", None, None, 5, 100000.0, 12.0, emi(100000, 12, 37)),  # no unit agrees
        (None, None, 7, None, None, None, None),  # unknown source: months
    ]
    got = reconcile(spark, rows, notes)
    assert got[0, "tenure"]["months_rounded"] == 18 and got[0, "tenure"]["basis"] == "note"
    assert got[1, "tenure"]["unit"] == "year" and got[1, "tenure"]["months_rounded"] == 36 and got[1, "tenure"]["basis"] == "identity"
    assert got[2, "tenure"]["unit"] == "month" and got[2, "tenure"]["unique"]
    assert got[3, "tenure"]["months_rounded"] == 5 and not got[3, "tenure"]["unique"]
    assert got[4, "tenure_months"]["basis"] == "default"


@pytest.mark.parametrize(
    "note, expected",
    [
        ("Dealer network; tenure keyed in years until 30 June 2024, in months from 1 July 2024 by load day.", {("tenure", "year", None, dt.date(2024, 6, 30)), ("tenure", "month", dt.date(2024, 7, 1), None)}),
        ("Column tenure_months was wired to the weekly counter and holds weeks; validity text is typed.", {("tenure_months", "week", None, None)}),
        ("Reviewed last year.", set()),
        (None, set()),
    ],
)
def test_note_rules(note, expected):
    assert set(units.note_rules(note, COLUMNS)) == expected


def test_empty_and_repeated(spark):
    assert reconcile(spark, [], [("S", None)]) == {}
    los = spark.createDataFrame([(1, "S", DAY, "2 yrs", None, None, None, None, None, "x", 1)] * 2, LOS)
    out = units.reconcile_durations(los, spark.createDataFrame([], "source_id string, note string"), "row_id", COLUMNS, F.lit(None).cast("double"))
    assert units.converted(out).count() == 2


def test_whole_table(spark, small):
    found = training.p1_found(spark, small)
    assert found.columns == ["row_id", "field", "months"] and found.count() == found.distinct().count() > 0


def test_combinations_that_solve_a_row_are_counted(spark):
    rows = [
        ("Q", None, 12, None, None, None, None),  # nothing tells: any of seven units
        ("Q", "3 years", None, 36, None, None, None),  # the written unit leaves 36 one choice: months
        ("Q", "3 years", None, 50, None, None, None),  # no combination agrees
        ("Q", None, 36, 3, 100000.0, 12.0, emi(100000, 12, 36)),  # the identity solves for both at once
        ("Q", None, 36, 3, None, None, None),  # 36 months and 3 years agree, as do other pairs
    ]
    got = reconcile(spark, rows, [("Q", None)])
    assert got[0, "tenure_months"]["solutions"] == 7 and not got[0, "tenure_months"]["unique"] and got[0, "tenure_months"]["months_rounded"] == 12
    assert got[1, "tenure"]["unique"] and got[1, "loan_validity"]["unique"]
    assert got[2, "tenure"]["solutions"] == 0 and not got[2, "tenure"]["unique"]
    assert [(got[3, f]["months_rounded"], got[3, f]["unique"]) for f in ("tenure_months", "tenure")] == [(36, True), (36, True)] and got[3, "tenure"]["row_residual"] < 0.01
    assert got[4, "tenure"]["solutions"] > 1 and not got[4, "tenure"]["unique"]


def test_number_words_against_a_plain_reading(spark):
    ones = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = {"twenty": 20, "thirty": 30, "forty": 40, "ninety": 90}
    texts = {f"{w} months": n for n, w in enumerate(ones, 1)} | {f"{t} months": n for t, n in tens.items()} | {f"{t}{sep}{w} months": n + k for t, n in tens.items() for k, w in enumerate(ones[:9], 1) for sep in ("-", " ")}
    df = spark.createDataFrame(list(texts.items()), "t string, n int")
    assert df.where(units.parse_duration(F.col("t"))["months"] != F.col("n")).count() == 0 and df.where(units.parse_duration(F.col("t"))["months"].isNull()).count() == 0
    halves = {"half a year": 6.0, "half year": 6.0, "two half-years": 12.0, "half-yearly 3": 18.0}
    df = spark.createDataFrame(list(halves.items()), "t string, n double")
    assert df.where(~units.parse_duration(F.col("t"))["months"].eqNullSafe(F.col("n"))).count() == 0
