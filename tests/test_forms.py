"""Form-level operators on small pages: character boxes read back, uneven ones refused, pairs against a plain loop, edges."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from attestra.operators import forms

TOKEN = "doc string, ord int, word string, l double, t double, r double, b double, text string"


def boxes(word, x=0.1, y=0.1, pitch=0.02, jitter=0.0, rng=None):
    out = []
    for i, c in enumerate(word):
        if c != " ":
            dx = rng.uniform(-jitter, jitter) if rng else 0.0
            out.append((c, x + i * pitch + dx, y, x + i * pitch + dx + 0.012, y + 0.02))
    return out


def page(spark, *words):
    rows = [("d", i, *b, "clash") for i, b in enumerate(b for w in words for b in w)]
    return spark.createDataFrame(rows, TOKEN)


def found(df):
    return sorted(r["text"] for r in forms.comb_boxes(df, "doc").collect())


def test_boxes_are_read_back(spark):
    rng = random.Random(3)
    assert found(page(spark, boxes("ABCDE1234F"), boxes("9876543210", y=0.2))) == ["9876543210", "ABCDE1234F"]
    assert found(page(spark, boxes("RAVI KUMAR"))) == ["RAVI KUMAR"]
    assert found(page(spark, boxes("APPL00343265", jitter=0.002, rng=rng))) == ["APPL00343265"]
    # Two fields on a line, far apart.
    assert found(page(spark, boxes("1234"), boxes("5678", x=0.6))) == ["1234", "5678"]


def test_what_is_no_row_of_boxes(spark):
    assert found(page(spark, boxes("A"))) == []
    steps = [("1", 0.1, 0.1, 0.112, 0.12), ("2", 0.1, 0.5, 0.112, 0.52)]
    assert found(page(spark, steps)) == []
    assert forms.comb_boxes(spark.createDataFrame([], TOKEN), "doc").count() == 0
    null = spark.createDataFrame([("d", 1, None, 0.1, 0.1, 0.2, 0.2, "x"), ("d", 2, "A", None, 0.1, 0.2, 0.2, "x"), ("d", 3, "longer than a box", 0.1, 0.1, 0.2, 0.2, "x")], TOKEN)
    assert forms.comb_boxes(null, "doc").count() == 0


def test_evenness_and_clean_runs():
    even = np.array([(0.1 + 0.02 * i, 0.1, 0.112 + 0.02 * i, 0.12) for i in range(6)])
    ones = np.ones(6)
    assert forms.evenness(even, ones) == (True, 1.0) or forms.evenness(even, ones)[1] > 0.999
    broken = even.copy()
    broken[3:, 1] += 0.05
    broken[3:, 3] += 0.05
    assert forms.evenness(broken, ones) == (False, 0.0) and not forms.evenness(even[:1], ones[:1])[0]
    assert forms.clean_run(even) and not forms.clean_run(even[:3])
    wide = even.copy()
    wide[::2, 2] += 0.03
    assert not forms.clean_run(wide)
    split = np.insert(even, 3, [0.1485, 0.1, 0.149, 0.12], axis=0)
    assert len(forms.joined_cells(np.array(sorted(map(tuple, split))), 6)) == 6 and len(forms.joined_cells(even, 6)) == 6


def test_rows_by_band_do_not_chain():
    rows = np.array([(0.1 * i, 0.1 + 0.003 * i, 0.1 * i + 0.05, 0.12 + 0.003 * i) for i in range(4)] + [(0.1 * i, 0.15, 0.1 * i + 0.05, 0.17) for i in range(4)])
    assert sorted(map(len, forms.rows_by_band(rows))) == [4, 4]


ELEMENT = "doc string, ord int, text string, class string, confidence double, l double, t double, r double, b double, label string"


def plain_pairs(rows, score):
    """Label by label in reading order, each value once."""
    labels = sorted((r for r in rows if r[3] == "label"), key=lambda r: (r[6], r[5], r[1]))
    values, taken, out = [r for r in rows if r[3] == "value"], set(), set()
    mid = lambda r: (r[6] + r[8]) / 2
    for a in labels:
        best = None
        for v in values:
            dx = v[5] - a[7]
            same = abs(mid(a) - mid(v)) <= 0.022 or max(0, min(a[8], v[8]) - max(a[6], v[6])) / max(0.01, a[8] - a[6]) >= 0.4
            parted = any(o[1] != a[1] and a[7] < o[5] < v[5] and abs(mid(o) - mid(a)) <= 0.022 for o in labels)
            if v[1] not in taken and same and -0.02 <= dx <= 0.35 and not parted:
                s = score[a[2], v[2]] + 0.75 - max(0, dx) / 0.35 * 0.15
                if best is None or s > best[0]:
                    best = (s, v, "right_of_label")
        if best is None:
            for v in values:
                dy = v[6] - a[8]
                if v[1] not in taken and 0 <= dy <= 0.045 and (min(a[7], v[7]) - max(a[5], v[5]) > 0 or abs(a[5] - v[5]) <= 0.06):
                    s = score[a[2], v[2]] + 0.65 - dy / 0.045 * 0.15
                    if best is None or s > best[0]:
                        best = (s, v, "below_label")
        if best and best[0] >= 0.70 and min(a[4], best[1][4]) >= 0.72:
            taken.add(best[1][1])
            out.add((a[2], best[1][2], best[2]))
    return out


def test_label_values_against_a_plain_loop(spark):
    rng = random.Random(7)
    labels, values = ("Loan Amount", "Due Date", "Bank Code", "PAN Number", "Amount in words"), ("5,00,000", "12/04/2024", "HDFC0001", "ABCDE1234F", "fifty thousand only", "monthly 5")
    pairs = spark.createDataFrame([(a, v) for a in labels for v in values], "a string, v string").select("a", "v", forms.fits(F.col("a"), F.col("v")).alias("s")).collect()
    score = {(r["a"], r["v"]): r["s"] for r in pairs}
    assert score["Loan Amount", "5,00,000"] > 0 > score["Due Date", "monthly 5"]
    for _ in range(6):
        rows = []
        for i in range(24):
            kind = rng.choice(["label", "value"])
            x, y = round(rng.uniform(0, 0.7), 4), round(0.03 * rng.randrange(8), 4)
            rows.append(("d", i, rng.choice(labels if kind == "label" else values), kind, rng.choice([0.9, 0.9, 0.6]), x, y, x + 0.1, y + 0.02, "clash"))
        got = {(r["label"], r["value"], r["relation"]) for r in forms.label_values(spark.createDataFrame(rows, ELEMENT), "doc").collect()}
        assert got == plain_pairs(rows, score)
    assert forms.label_values(spark.createDataFrame([], ELEMENT), "doc").count() == 0


def test_segments_of_a_table(spark):
    cells = [["Loan Details"], ["1", "Amount", "500"], ["Rate", "12"], ["Sr", "Due Date", "Principal"], ["1", "01/02", "70"], ["TOTAL", "70"], ["", " "], ["Charges Breakdown"], ["x"], ["Fee", "Other"], None]
    rows = spark.createDataFrame([("d", i, c) for i, c in enumerate(cells)], "doc string, row int, cells array<string>")
    marked = forms.segmented(forms.row_kinds(rows), "doc")
    assert [r["kind"] for r in marked.orderBy("row").collect()] == ["title", "pairs", "pairs", "header", "pairs", "total", "title", "data", "pairs"]
    got = [(r["title"], r["block"], r["n_rows"], r["n_totals"]) for r in forms.blocks(marked, "doc").orderBy("first_row").collect()]
    assert got == [("Loan Details", "pairs", 2, 0), ("Loan Details", "table", 1, 1), ("Charges Breakdown", "pairs", 1, 0)]
    text = {(r["section"], r["block"]): r["text"] for r in forms.block_text(marked, "doc").collect()}
    assert text[1, "table"] == "### Loan Details\n[TABLE]\nSr | Due Date | Principal\n1 | 01/02 | 70\nTOTAL | 70\n[/TABLE]"
    assert text[1, "pairs"] == "### Loan Details\n[TABLE]\nField | Value\nAmount | 500\nRate | 12\n[/TABLE]"


WORD = "doc string, page int, ord int, word string, l double, t double, b double, confidence double"


def plain_places(rows, fields, most=5):
    """Every window of every page against every field."""
    out, low_alnum = {}, lambda s: re.sub("[^a-z0-9]", "", s.lower())
    date = lambda s: re.sub(r"[/.\s-]", "", s)
    for doc, field, v in fields:
        a, places = low_alnum(v), []
        for page_no in sorted({r[1] for r in rows if r[0] == doc}):
            ws = sorted((r for r in rows if r[:2] == (doc, page_no)), key=lambda r: (r[5], r[4], r[2]))
            for p, k in ((p, k) for p in range(len(ws)) for k in range(1, min(7, len(ws) - p) + 1)):
                w = ws[p : p + k]
                if not (all(abs(x[5] - w[0][5]) <= 0.035 for x in w) or all(y[5] - x[6] <= 0.06 for x, y in zip(w, w[1:]))):
                    continue
                text = " ".join(x[3] for x in w)
                o, score = low_alnum(text), None
                over = min(len(a), len(o)) / max(len(a), len(o), 1)
                if text.lower() == v.lower():
                    score, way = (1.0, 0.97)[k > 1], "exact"
                elif a and a == o:
                    score, way = (0.98, 0.95)[k > 1], "alphanumeric"
                elif forms.number_in(v) and forms.number_in(v) == forms.number_in(text):
                    score, way = (0.95, 0.93)[k > 1], "numeric"
                elif k == 1 and re.search("[/.-]", v) and date(v) and date(v) == date(text):
                    score, way = 0.95, "date"
                elif k == 1 and len(a) >= 5 and a in o:
                    score, way = 0.85 + 0.10 * (len(a) / len(o)), "containment"
                elif k > 1 and len(a) >= 8 and o and (a in o or o in a) and over >= 0.70:
                    score, way = round(0.82 + 0.12 * over, 3), "containment"
                if score:
                    rank = round(score * 0.7 + sum(x[7] for x in w) / k * 0.2 + 0.05 * (page_no == 1), 9)
                    places.append((-rank, page_no, k, p + 1, text, round(score, 9), way))
        out |= {(doc, field, n): x[1:] for n, x in enumerate(sorted(places)[:most], 1)}
    return out


def test_places_against_all_windows(spark):
    rng = random.Random(11)
    words = ["Ravi", "ravi", "Kumar", "KUMAR-", "ABCDE1234F", "xABCDE1234Fy", "12", "₹5,00,000", "500000.00", "-", "--", "रवि", "12/04/2024", "12042024", "no.", "12345678", "1234", "5678", "90", "Σας"]
    values = ["Ravi Kumar", "ravi", "ABCDE1234F", "5,00,000", "12-04-2024", "- -", "-", "रवि", "1234 5678 90", "345678", "12", "Kumar Ravi Kumar", "no. 12", "kumarravi12", "1234 5678 9012", "90 1234567812", "Σας", "रवि/", "absent"]
    rows, fields = [], []
    for d in range(12):
        for page_no in (1, 2):
            for i in range(40):
                rows.append((f"d{d}", page_no, i, rng.choice(words), 0.05 * (i % 8), 0.03 * (i // 8) * (1 + d % 3), 0.03 * (i // 8) * (1 + d % 3) + 0.02, rng.choice([0.8, 0.9, 0.93])))
        fields += [(f"d{d}", f"f{n}", v) for n, v in enumerate(values)]
    toks, sought = spark.createDataFrame(rows, WORD), spark.createDataFrame([*fields, (None, "f", "ravi"), ("d1", "g", " "), ("other", "g", "12")], "doc string, field string, value string")
    found = forms.located(sought, toks, "doc")
    got = {(r["doc"], r["field"], r["place"]): (r["page"], r["k"], r["pos"], r["text"], round(r["score"], 9), r["strategy"]) for r in found.collect()}
    assert got == plain_places(rows, fields) and {x[-1] for x in got.values()} == {"exact", "alphanumeric", "numeric", "date", "containment"}
    assert forms.located(sought, toks.limit(0), "doc").count() == forms.located(sought.limit(0), toks, "doc").count() == 0


def test_places_are_found_without_rows_of_windows(spark, small):
    """Exploded tokens look small to the optimiser, which sent all windows through the driver; windows must be no rows, and tokens not broadcast."""
    from attestra.plans import forms as plans
    from attestra.plans.catalogue import pages_of

    toks = pages_of(spark, small).withColumn("confidence", F.lit(0.9))
    plan = forms.located(plans._fields_of(spark, small), toks, "extraction_id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("SortMergeJoin") >= 1
    assert "BroadcastExchange" not in plan


def test_pages_are_read_together(spark, monkeypatch):
    """Every page was a call of its own; pages of a batch are grouped at once, with what each gives alone."""
    rng, rows = random.Random(4), []
    for d in range(30):
        lines = [boxes("".join(rng.choice("ABC123   ") for _ in range(rng.randrange(1, 22))), x=rng.uniform(0, 0.4), y=0.1 + 0.04 * i + rng.uniform(-0.004, 0.004), pitch=rng.choice([0.02, 0.03]), jitter=0.004, rng=rng) for i in range(rng.randrange(1, 5))]
        lines.append([(w, x + 0.5, y, r + 0.5 + 0.01 * (len(w) > 1), b) for w, x, y, r, b in boxes("12", y=0.1)] + [("AB", 0.9, 0.1, 0.93, 0.12)])
        rows += [(None if d == 7 else f"d{d}", i, *b, "clash") for i, b in enumerate(b for line in lines for b in line)]
    many = forms.comb_boxes(spark.createDataFrame(rows, TOKEN), "doc")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    exact = lambda r: (r["doc"], r["text"], r["n"], round(r["l"], 9), round(r["b"], 9), round(r["score"], 9), r["clean"])
    together = sorted(map(exact, many.collect()), key=repr)
    monkeypatch.setattr(forms, "BOXES_AT_ONCE", 1)
    alone = sorted(map(exact, forms.comb_boxes(spark.createDataFrame(rows, TOKEN), "doc").collect()), key=repr)
    own = []
    for doc in {r[0] for r in rows}:
        page_rows = [r for r in rows if r[0] == doc]
        xs = np.array([r[3:7] for r in page_rows])
        for row in forms.rows_by_band(xs):
            row = sorted(row, key=lambda i: xs[i, 0])
            chars = np.array([len(page_rows[i][2]) for i in row])
            gap = lambda i: xs[row[i], 0] - xs[row[i - 1], 2] > max(4 * np.median((xs[row, 2] - xs[row, 0]) / chars), 2 * np.median(xs[row, 3] - xs[row, 1]), 0.065)
            run = [0]
            for i in range(1, len(row) + 1):
                if i == len(row) or gap(i) or not forms.evenness(xs[row][[*run, i]], chars[[*run, i]])[0]:
                    if len(run) > 1:
                        at = [row[j] for j in run]
                        own.append((doc, len(at), round(xs[at, 0].min(), 9), round(xs[at, 3].max(), 9), round(forms.evenness(xs[at], chars[run])[1], 9), forms.clean_run(xs[at])))
                    run = []
                run.append(i)
    assert together == alone and len(together) > 40 and sorted(((r[0], *r[2:]) for r in together), key=repr) == sorted(own, key=repr)
