from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra.functions import normalise as fn
from attestra.functions import similarity as sim
from attestra.functions import textquality as quality


def value(spark, expr, *args):
    cols = [f"a{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{c} string" for c in cols))
    return df.select(expr(*[F.col(c) for c in cols])).first()[0]


@pytest.mark.parametrize("text, expected", [("₹ 1,234.50", 1234.5), ("-5", 5.0), ("1.2.3", None), (".", None), ("", None), (None, None)])
def test_clean_numeric(spark, text, expected):
    assert value(spark, fn.clean_numeric, text) == expected


@pytest.mark.parametrize("text, expected", [("1/2/2024", "2024-02-01"), ("2024-1-9", "2024-01-09"), ("5 Mar 2024", "2024-03-05"), ("21/10/96", "21/10/96"), ("Not Known", "not known"), ("31/02/2024", "31/02/2024"), (None, None)])
def test_normalize_date(spark, text, expected):
    assert value(spark, fn.normalize_date, text) == expected


@pytest.mark.parametrize("text, expected", [("2.5 years", 30), ("18 months", 18), ("3 yrs", 36), ("0", None), ("soon", None), (None, None)])
def test_tenure(spark, text, expected):
    assert value(spark, fn.tenure_months, text) == expected


@pytest.mark.parametrize("a, b, expected", [("martha", "marhta", 0.9611), ("mohd rizwan", "mohammad rizwan", 0.8741), ("", "x", 0.0), ("abc", "ABC", 1.0)])
def test_jaro_winkler(spark, a, b, expected):
    assert value(spark, sim.jaro_winkler, a, b) == pytest.approx(expected, abs=1e-4)


def test_word_error_rate_against_its_bound(spark):
    assert value(spark, sim.word_error_rate, "a b c d", "a x c") == 0.5
    assert value(spark, sim.word_error_rate, "", "") == 0.0 and value(spark, sim.word_error_rate, "a", "b c d e") == 1.0


def test_tfidf_of_equal_and_disjoint(spark):
    assert value(spark, sim.tfidf_cosine, "Mill Road", "mill road ") == 1.0
    assert value(spark, sim.tfidf_cosine, "Mill Road", "Temple Street") == 0.0
    assert value(spark, sim.tfidf_cosine, "", "x") == 0.0 and value(spark, sim.tfidf_cosine, None, "x") is None


@pytest.mark.parametrize("text, noise", [("HRTRR", True), ("~~##", True), ("aaaaab", True), ("KYC PAN LTD", False), ("12345", False), ("Applicant name", False), ("आवेदक का नाम", False), ("R", True), ("", False), (None, False)])
def test_noise(spark, text, noise):
    assert value(spark, quality.noisy, text) is noise


def test_trust(spark):
    assert value(spark, quality.trust, "Applicant name") == 0.96
    assert value(spark, quality.trust, "NAMeS") < 0.85 and value(spark, quality.trust, "HRTRR") == 0.35 and value(spark, quality.trust, " ") == 0.0


@pytest.mark.parametrize(
    "text, clean, score, valid",
    [
        ("fua/Name of Employee", "Name of Employee", 1.0, True), ("a /Date of birth", "Date of birth", 1.0, True), ("Nane Rao", "Rao", 1.0, True), ("aaaaaab", "aab", 1.0, True), ("3TET Name", "Name", 1.0, True),
        ("12 Mill Road, , Jalkhed,", "12 Mill Road Jalkhed", 1.0, True), ("ABCDE1234F,", "ABCDE1234F", 1.0, True), ("7", "", 0.0, False), ("##~~", "", 0.0, False), ("R", "R", 0.7, True), ("", "", 0.0, False), (None, "", 0.0, False),
    ],
)
def test_sanitized(spark, text, clean, score, valid):
    got = value(spark, quality.sanitized, text)
    assert (got["text"], got["score"], got["valid"]) == (clean, score, valid)
