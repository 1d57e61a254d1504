from __future__ import annotations

import inspect
import itertools
import math
import random
import re

import pytest

from attestra.llm import pii
from attestra.session import table


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = table(spark, small.replace("sf0.001", "sf0.1"), "extractions").where("_formatted_text is not null").orderBy("extraction_id").limit(2000).toPandas()
    return rows["_formatted_text"].drop_duplicates().tolist()


@pytest.fixture(scope="module")
def model(texts):
    return pii.fit(texts[: len(texts) * 3 // 4])


def share(model, labelled):
    """(recall, precision) of labelled texts, by begin and type."""
    right = wrong = lost = 0
    for text, spans in labelled:
        got, gold = {(a, k) for a, _, k in model.spans(text)}, {(a, k) for a, _, k in spans}
        right, wrong, lost = right + len(got & gold), wrong + len(got - gold), lost + len(gold - got)
    return right / max(1, right + lost), right / max(1, right + wrong)


def held_out(texts):
    return [(t[: f[1]], f[0]) for t in texts[len(texts) * 3 // 4 :] if (f := pii.record_spans(t))]


def test_held_out_records(texts, model):
    recall, precision = share(model, held_out(texts))
    assert recall > 0.95 and precision > 0.95


#: Notes of kinds that no text of the table has; {n} name, {a} address, {p} phone, {i} identity number, {e} e-mail.
KINDS = (
    "Please ring {n} ({p}) tomorrow morning.", "We visited {a} and found the gate shut.", "Her card reads {i}, the copy is clear.", "Write to {e} if the form is late.",
    "Our agent saw {n} there; number given: {p}.", "This morning {n} brought the papers to the counter.", "Parcel for {a} went back.", "Both {n} and {n} signed.",
    "Answer came from {e} within the hour.", "Invoice 20394 over 11500 was settled on 03/04/2024, reported {n}.", "Nobody picks up {p} in the evening.", "Number {i} belongs to {n}.",
)


def test_kinds_of_notes_never_seen(texts, model):
    rng = random.Random(4)
    values: dict[str, list[str]] = {"email": ["r.menon@mail.example", "office.desk7@example.org", "k_rao (at) example dot net"]}
    for text, spans in held_out(texts):
        for a, b, kind in spans:
            values.setdefault(kind, []).append(text[a:b])
    letter = {"n": "name", "a": "address", "p": "phone", "i": "id_number", "e": "email"}
    made = []
    for _ in range(20):
        for frame in KINDS:
            text, spans = "", []
            for part in re.split(r"(\{\w\})", frame):
                if part[:1] == "{":
                    v = rng.choice(values[letter[part[1]]])
                    spans.append((len(text), len(text) + len(v), letter[part[1]]))
                    part = v
                text += part
            made.append((text, spans))
    recall, precision = share(model, made)
    print(f"notes of kinds never seen: recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.85 and precision > 0.85


def test_no_sentence_of_the_table_is_in_the_code(texts):
    code = " ".join(inspect.getsource(pii).split())
    assert not [s for t in texts for s in re.findall(r"[A-Z][a-z]+(?: [A-Za-z]+){3,}", t) if s in code]


def every_segmentation(segments, scores):
    """Brute force: all sets of disjoint candidate spans, with their scores."""
    for r in range(4):
        for c in itertools.combinations(range(len(segments)), r):
            if all(segments[p][1] <= segments[q][0] or segments[q][1] <= segments[p][0] for p, q in itertools.combinations(c, 2)):
                yield sum(scores[i] for i in c), set(c)


def test_decoding_and_likelihood_against_brute_force(model):
    x = pii.Lattice("Call Ganvini Belurpally at 9000140405.", model.lexicon)
    learner, rng = pii.Learner(True), random.Random(1)
    n, segments = learner.prepared(x, set())
    learner.w = [rng.uniform(-1, 1) for _ in learner.w]
    scores = [sum(learner.w[i] for i in s[2]) for s in segments]
    all_of = list(every_segmentation(segments, scores))
    best = max(all_of, key=lambda s: s[0])[1]
    spans = [(a, kind, b) for b in range(1, x.n + 1) for a, kind, _ in x.into[b]]
    decoded = pii.decode(x, pii.Weights({k: learner.w[i] for k, i in learner.number.items()}, True))
    assert {(a, k, b) for a, b, k in decoded} == {spans[i] for i in best}
    total, probabilities = learner.marginals(n, segments)
    whole = sum(math.exp(s) for s, _ in all_of)
    assert total == pytest.approx(math.log(whole), abs=1e-6)
    for i, p in enumerate(probabilities):
        assert p == pytest.approx(sum(math.exp(s) for s, c in all_of if i in c) / whole, abs=1e-6)


def test_rows_and_edges(spark, model):
    text = "Guarantor Ganvini Belurpally (id 090261952851) signed. Account 98221542493618 stays."
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here " * 20_000, "x"), (1, text, "x")]
    df = spark.createDataFrame(rows, "extraction_id bigint, _formatted_text string, redacted string")
    got = {r["extraction_id"]: r for r in pii.find(df, model).collect()}
    assert got[2]["redacted"] is None and got[2]["spans"] == [] and got[3]["redacted"] == ""
    assert "[ID_NUMBER]" in got[1]["redacted"] and "98221542493618" in got[1]["redacted"] and got[4]["redacted"] == rows[3][1]
    assert pii.occurrences(pii.find(df, model)).count() == 2 * len(got[1]["spans"])
    assert pii.find(df.limit(0), model).count() == 0


def test_no_records_to_fit_on(spark):
    empty = spark.createDataFrame([], "extraction_id bigint, _formatted_text string")
    assert pii.fitted(empty).spans("Call 9000140405") in ([], [(5, 15, "phone")])


def test_an_address_late_in_a_long_run_is_found(model):
    home = "Flat No 12, 45/7, Temple Street, Rajwade, 411045"
    early = [f"{100 + i} 98{i:02d}" for i in range(40)]
    for calls in (6, 12, 40):
        text = f"Log {', '.join(early[:calls])}, {home} - door locked."
        x, at = pii.Lattice(text, model.lexicon), text.index(home)
        held = {(x.starts[a], x.ends[b - 1]) for b in range(1, x.n + 1) for a, kind, _ in x.into[b] if kind == "address"}
        assert (at, at + len(home)) in held, calls
        # An early address keeps its right end, however many stops follow.
        text = f"{home}\n{chr(10).join(early[:calls])}\n"
        x = pii.Lattice(text, model.lexicon)
        held = {(x.starts[a], x.ends[b - 1]) for b in range(1, x.n + 1) for a, kind, _ in x.into[b] if kind == "address"}
        assert (0, len(home)) in held, calls
