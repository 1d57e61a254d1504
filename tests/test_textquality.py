"""Rules over lines that SQL cannot say, against a plain reading of the rules with callbacks."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from attestra.functions import similarity as sim
from attestra.functions import textquality as quality
from attestra.session import table

PLAIN_STEPS = (
    r"^[fF](ua)?\s*/\s*", r"^[aA]\s*/\s*(?=[Dd]ate|[sS]ignature|[dD][oO][bB])", r"^[aA][tT]&?\s*/\s*", r"^GR@\s*/?\s*", r"(?i)\b(FarHToT|3RRTO|HRAHRR|PA ROR)\b", r"^[a-z]\s+(?=[A-Z])",
    r"\b(TE|RAA|HOTRT|Signralid|HAR|Hin|Wuy|Nane|Empioyee|OSV)\b", "[一-鿿㐀-䶿豈-﫿＀-￯]",
)


def plain_label_noise(text: str) -> str:
    s = text.strip()
    for step in PLAIN_STEPS:
        s = re.sub(step, "", s, flags=re.ASCII)
    short = lambda m: "" if len(m[0].strip()) <= 5 and sum(c.isdigit() for c in m[0]) <= 2 else m[0]
    s = re.sub(r"\b\d+[A-Z]{2,}\d*\b", short, s, flags=re.ASCII)
    s = re.sub(r"\b[A-Z]{2,}\d+\s?\d*\b", short, s, flags=re.ASCII)
    words = s.split()
    if not (len(words) >= 2 and sum(len(w) <= 2 for w in words) / len(words) >= 0.6):
        near = lambda m: m[0] if (b := s[: m.start()].rstrip()) and b[-1].isalnum() or (a := s[m.end() :].lstrip()) and a[0].isalnum() else ""  # noqa: E731, F841
        s = re.sub(r"\b[A-Z]\b(?!\w)", near, s, flags=re.ASCII)
    for step in (r"\b[a-z]{1,2}\s*[,)(]\s*[a-z0-9\s,)(]{5,}\b", r"^[A-Za-z]*\d+/(?=[A-Za-z])", r"\b[A-Z]{1,2}\s+\d[A-Z]+\b", r"^\s*/\s*"):
        s = re.sub(step, "", s, flags=re.ASCII)
    s = re.sub(r"\s+", " ", s).strip(" ")
    return re.sub(r"^[^\w\s(\[{#$]+|[^\w\s)}\].,:\-%]+$", "", s)


HARD = [
    "fua/Father's Name", "a/Date of Birth", "aT&/Signature", "GR@/DOB", "s Brihan", "3TET", "TT3T", "TT3 4", "TT3 45", "TT3", "3QRR 12", "APPL00343265", "KA 04", "R", "Name / P", "DOB : X", "A VEERANNA", "RAJESH K SHARMA",
    "V A N A J A K S H A M M A", "ee , a fr ) s4 h4", "9/MALE", "Paf4/DOB", "12/04/1990", "RT 3HTET", "HAR 7", "  ", "", "TE", "ABCDE1234F", "HDFC0001234 TT3", "/ name", "'quoted'", "50% off", "中文 text", "B4 5 6", "X Y", "no noise at all.",
]


def test_label_noise_against_a_plain_reading(spark, small):
    rng = random.Random(9)
    parts = ["TT3", "3TET", "45", "A", "K", "name", "/", "DOB", "x", ",", "(", ")", "fr", "Ravi", "HAR", "12AB", "AB12", "AB1", "7", "KA"]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(1500)]
    table_lines = [x for r in table(spark, small, "extractions").select("_formatted_text").limit(40).collect() if r[0] for x in r[0].split("\n") if x.isascii()]
    lines = HARD + made + table_lines
    got = spark.createDataFrame(list(enumerate(lines)), "i int, s string").select("i", quality.label_noise(F.col("s")).alias("t")).collect()
    wrong = [(lines[r["i"]], r["t"], plain_label_noise(lines[r["i"]])) for r in got if lines[r["i"]].strip() and r["t"] != plain_label_noise(lines[r["i"]])]
    assert wrong == []
    assert spark.range(1).select(quality.label_noise(F.lit(None).cast("string"))).first()[0] is None


def test_recall_in_windows_against_all_windows(spark):
    """The bound that spares windows loses none: against each window of the text."""

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")
    rng = random.Random(2)
    rows = []
    for _ in range(250):
        value = "".join(rng.choice("abc de") for _ in range(rng.choice([3, 8, 20, 24, 28, 36, 60]))).strip() or "a"
        damaged = "".join(c if rng.random() > 0.12 else rng.choice("xyz") for c in value)
        text = rng.choice(["", "some text before it "]) + rng.choice([damaged, value[::-1], value]) + rng.choice(["", " and more text that goes on after it"])
        rows.append((len(rows), text, value))
    got = {r["i"]: r["how"] for r in spark.createDataFrame(rows, "i int, t string, v string").select("i", sim.recalled(F.col("t"), F.col("v")).alias("how")).collect()}
    for i, t, v in rows:
        p, w = norm(t), norm(v)
        near = any(lev(norm(p[a : a + len(w) + 8]), w) <= 0.25 * len(w) for a in range(max(1, len(p) - 2 * len(w) + 1)))
        expected = "exact" if w in p else "compact" if w.replace(" ", "") in p.replace(" ", "") else "near" if near else None
        assert got[i] == expected, (t, v)


def test_scripts(spark):
    cases = {
        "": ("unknown", False, 1.0), "12 !": ("latin", False, 0.9), "नमस्ते": ("devanagari", False, 1.0), "नमस्ते hello world": ("mixed", True, 0.63), "こんにちは漢字": ("japanese", False, 1.0),
        "漢字漢字": ("chinese", False, 1.0), "안녕하세요": ("korean", False, 1.0), "漢字 latin text here": ("latin", False, 0.87),
    }
    rows = spark.createDataFrame([(t,) for t in (*cases, None)], "t string").select("t", sim.script_of(F.col("t")).alias("x"), sim.script_mismatch(F.lit("hindi"), F.col("t")).alias("m")).collect()
    assert {r["t"]: tuple(r["x"]) for r in rows if r["t"] is not None} == cases
    assert {r["t"] for r in rows if r["m"]} == {"12 !", "漢字 latin text here"} and [tuple(r["x"]) for r in rows if r["t"] is None] == [("unknown", False, 1.0)]
