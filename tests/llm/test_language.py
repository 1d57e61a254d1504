from __future__ import annotations

import numpy as np
import pytest

from attestra.llm import language as lang
from attestra.llm.text import sentences
from attestra.session import table

EN, HI, MR = "The applicant must submit the papers before Monday.", "आवेदक को सोमवार से पहले कागज़ जमा करने होंगे।", "अर्जदाराने सोमवारी कागदपत्रे जमा केली आहेत."


def test_whole_sentences():
    text = "REF-1\n\nPaid Rs. 500 to Mr. Rao on time. Thank you"
    assert [text[a:b] for a, b in sentences(text)] == ["Paid Rs. 500 to Mr. Rao on time."]
    assert sentences(None) == sentences("") == sentences("REF-25 01/04/2025 11 72951.40") == []


def test_presence_is_the_set_of_ngrams():
    row, col = lang.presence(["abab", "", "xyz"])
    assert [int((row == i).sum()) for i in range(3)] == [2 + 2 + 2 + 1, 0, 3 + 2 + 1]
    assert len(set(zip(row.tolist(), col.tolist()))) == len(row)


def test_scores_are_the_kernel_expansion():
    texts = [f"{s} {w}" for s in ("the loan is paid", "ye karz chuka hai") for w in ("today", "aaj", "now", "abhi")]
    w = lang.fit(texts, ["en"] * 4 + ["hi"] * 4, rounds=1)
    sets = [{c for c in lang.presence([t])[1].tolist()} for t in texts]
    gram = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.where(np.arange(8)[:, None] // 4 == np.arange(2), 1.0, -1.0)
    values, vectors = np.linalg.eigh(gram)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    phi = gram @ root
    fitted = phi @ np.linalg.solve(phi.T @ phi * (8 / 6 / 4) + lang.RIDGE * np.eye(phi.shape[1]), phi.T @ target * (8 / 6 / 4))
    assert np.allclose(lang.score(texts, w)[:, :2], fitted, atol=0.05)


@pytest.mark.parametrize("label, names", [("en-IN", {"en"}), ("Tamil", {"ta"}), ("EN", {"en"}), ("und", set()), (None, set()), ("", set()), ("hi/en", {"hi", "en"})])
def test_labels(label, names):
    assert lang.named(label) == names


def test_held_out_accuracy_by_script(spark, small):
    """Of sentences in a script of one language, nearly all must get it; labels are not used."""
    docs = table(spark, small.replace("sf0.001", "sf0.01"), "documents")
    w = lang.fitted(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1").toPandas()
    total = right = 0
    for t in rest["text"].dropna():
        for a, b in sentences(t):
            own = {code for code, (lo, hi) in {"ta": (0xB80, 0xBFF), "te": (0xC00, 0xC7F), "kn": (0xC80, 0xCFF)}.items() if sum(lo <= ord(c) <= hi for c in t[a:b]) > 0.6 * (b - a)}
            if own:
                total += 1
                right += lang.LANGUAGES[int(lang.score([lang.canonical(t[a:b])], w).argmax())] in own
    assert total > 50 and right / total > 0.98


def test_rows_and_edges(spark, small):
    w = lang.fitted(table(spark, small.replace("sf0.001", "sf0.01"), "documents"))
    rows = [(1, f"{EN} {EN} {HI} {HI}", "en", 0), (2, None, "en", 1), (3, "", None, 2), (4, EN, "fr", 3), (5, f"{EN} {EN} {HI}", "EN", 4), (5, f"{EN} {EN} {HI}", "EN", 4), (6, "x " * 200_000, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, segments int")
    got = sorted((r["doc_id"], r["lang"]) for r in lang.unnamed(lang.classify(df, w, label="lang")).collect())
    assert got == [(1, "hi"), (4, "en")]
    runs = {r["doc_id"]: r["segments"] for r in lang.classify(df, w, label="lang").collect()}
    assert [(s["lang"], s["sentences"], s["start_pos"]) for s in runs[1]] == [("en", 2, 1), ("hi", 2, 2 * len(EN) + 3)]
    assert lang.unnamed(lang.classify(df.limit(0), w, label="lang")).count() == 0


def test_what_lies_outside_of_sentences_has_a_language_too(spark, small):
    w = lang.fitted(table(spark, small.replace("sf0.001", "sf0.01"), "documents"))
    rows = [(1, "Papers of the applicant without any mark", None), (2, f"SANCTION LETTER OF THE BRANCH\n\n{HI} {HI}\n\nyours faithfully for the branch", None), (3, "12/3 4711", None), (4, "", None), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in lang.labels(lang.classify(df, w, rest=True)).collect()}
    assert got[1]["lang"] == "en" and 0 < got[1]["confidence"] <= 1 and got[2]["lang"] == "hi" and not got[2]["mixed"]
    assert [got[k]["lang"] for k in (3, 4, 5)] == [None] * 3
    segments = {r["doc_id"]: r["segments"] for r in lang.classify(df, w, rest=True).collect()}[2]
    assert [(s["lang"], s["sentences"]) for s in segments] == [("en", 0), ("hi", 2), ("en", 0)] and segments[-1]["end_pos"] == len(rows[1][1])
    # The rest adds no language to what is found by sentences.
    assert lang.unnamed(lang.classify(df, w, label="lang", rest=True)).collect() == lang.unnamed(lang.classify(df, w, label="lang")).collect()
