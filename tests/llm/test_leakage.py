from __future__ import annotations

import random

from attestra.llm import leakage

WORDS = "clause says the beekeeper pledges every gold facility despite favourable remarks while consent is withheld and stamps differ by three rupees under one floating annuity quoted before insurers reply to notice".split()


def passage(rng, n=60):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", " 48213", " Rs. 1,234"])) for _ in range(n)) + "."


def brute(doc, item):
    """Longest run of equal words, without any tolerance."""
    d, p = leakage.words(doc), leakage.words(item)
    best = 0
    for i in range(len(d)):
        for j in range(len(p)):
            k = 0
            while i + k < len(d) and j + k < len(p) and d[i + k] == p[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_every_exact_stretch_is_found():
    rng = random.Random(4)
    items = [passage(rng) for _ in range(12)]
    index = leakage.Index(list(range(12)), items)
    for _ in range(60):
        n = rng.randrange(12)
        ws = items[n].split()
        a, k = rng.randrange(20), rng.randrange(12, 30)
        text = f"filler text goes here first. {' '.join(ws[a : a + k])} afterwards nothing else of note."
        found = {i for i, kind, _, _ in index.leaks(text) if kind == "literal"}
        for i, item in enumerate(items):
            if brute(text, item) >= leakage.LEAST:
                assert i in found


def test_alterations_do_not_end_a_stretch():
    rng = random.Random(8)
    item = passage(rng, 40)
    index = leakage.Index([7], [item])
    ws = item.split()
    variants = {
        "case": item.upper(), "spacing": item.replace(" ", "   "), "breaks": item.replace(" ", "\n"), "punctuation": item.replace(" ", ", "),
        "misread": " ".join(w[:-1] + "q" if i % 7 == 3 and len(w) > 4 else w for i, w in enumerate(ws)), "altered": " ".join("zebra" if i % 8 == 5 else w for i, w in enumerate(ws)),
        "split": " ".join(w[:2] + " " + w[2:] if i % 9 == 4 and len(w) > 5 else w for i, w in enumerate(ws)), "heading": " ".join(ws[:12]) + "\n\nPage 3 of 5 Annexure\n\n" + " ".join(ws[12:]),
        "hyphens": " ".join(w[:3] + "-\n" + w[3:] if i % 9 == 4 and len(w) > 6 else w for i, w in enumerate(ws)),
    }
    for name, text in variants.items():
        assert index.leaks(f"Before it. {text} After it."), name


ITEM = "Clause 565716 says the surveyor Gadagappa consolidates every wedding advance until arrears are certified; Khas differs by 726442 rupees. One elderly beekeeper named Gadagappa rejects the tractor credit of Rs. 123606 at Kot."


def test_same_template_with_other_words_is_no_leak():
    other = "Clause 33465 says the welder Beluria postpones every seed facility before insurers reply; Jalkhed differs by 938328. One minor potter named Mandapan appeals the dairy float of Rs. 556276 at Ambegiri."
    assert leakage.Index([1], [ITEM]).leaks(other) == []


def test_reparameterised_item_is_found():
    index = leakage.Index([1], [ITEM])
    slots = {"565716": "881", "Gadagappa": "Beluria", "Khas": "Jalkhed", "726442": "938,328", "rupees": "dollars", "123606": "556276", "Kot": "Ambegiri"}
    text = ITEM
    for old, new in slots.items():
        text = text.replace(old, new)
    # The template goes on over every slot.
    got = index.leaks(f"Seen before. {text} And so on.")
    assert got and got[0][0] == 1
    short = "Sum 5 metres, Anand, 6 metres, Bela, 7 metres, Chitra, 8 metres, Devi; then weigh 9 metres, Esha, 11 metres, Fatima."
    index = leakage.Index([2], ["Sum the lots: then weigh. " + short])
    numbers = short.replace("5", "51").replace("6", "62").replace("7", "73").replace("8", "84").replace("9", "95").replace("Anand", "Ravi").replace("Bela", "Sita")
    assert [(i, kind) for i, kind, _, _ in index.leaks("It says: the lots: then weigh. " + numbers)] in ([(2, "re-parameterised")], [(2, "literal")])


def test_slots_must_be_consistent():
    item = "pay 5 rupees to Anand and then 5 rupees to Bela".split()
    assert leakage.consistent(item, "pay 7 rupees to Ravi and then 7 rupees to Sita".split())
    assert not leakage.consistent(item, "pay 7 rupees to Ravi and then 8 rupees to Sita".split())
    assert not leakage.consistent(item, "pay 7 rupees to Ravi and then 7 rupees to Ravi".split())
    assert not leakage.consistent(item, item)


def test_placeholders_are_typed():
    index = leakage.Index([1], ["The lender charges 12 rupees. The lender meets Anand within 3 months."])
    code = dict(zip(("lender", "12", "rupees", "months", "anand", "unheard"), index.coded(["lender", "12", "rupees", "months", "anand", "unheard"]).tolist()))
    assert code["12"] == leakage.NUMBER and code["rupees"] == code["months"] == leakage.UNIT and code["anand"] == code["unheard"] == leakage.NAME and code["lender"] > leakage.NAME


def test_rows_and_edges(spark):
    item = passage(random.Random(2), 40)
    docs = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 60_000 + item, "x"), (1, item, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "too short")], "item_id bigint, passage string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, items).collect())
    assert got == [(1, 9), (1, 9), (4, 9)]
    assert leakage.leaked(docs.limit(0), items).count() == leakage.leaked(docs, items.limit(0)).count() == 0


def test_joined_way_gives_the_same_rows(spark):
    rng = random.Random(6)
    ps = [passage(random.Random(k), 40) for k in range(5)]
    texts = ps + [f"Start. {' '.join(ps[k % 5].split()[3:30])} end." for k in range(6)] + [passage(rng, 30), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([*enumerate(ps), (77, None), (78, "")], "item_id bigint, passage string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    held, joined = rows(leakage.leaked(docs, items)), rows(leakage.leaked(docs, items, item_bytes=0))
    assert held == joined and {(r[0], r[1]) for r in held} >= {(k, k) for k in range(5)}
    assert leakage.leaked(docs.limit(0), items, item_bytes=0).count() == 0


def test_one_altered_slot_near_the_limit():
    item = "Clause 565716 says the surveyor Gadagappa consolidates every wedding advance until arrears are certified; later that Gadagappa differs by 726442 from the quoted annuity under review."
    index = leakage.Index([1], [item])
    ws = item.split()[1:21]
    assert len(leakage.words(" ".join(ws))) == 20
    for at, other in ((4, "Mandapan"), (19, "33465"), (15, "Belurekar")):
        text = " ".join(["Earlier", "notes", "end.", *ws[:at], other, *ws[at + 1 :], "Nothing", "more."])
        assert [(i, kind, k >= 18) for i, kind, k, _ in index.leaks(text)] == [(1, "literal", True)], other


def test_windows_whose_slots_all_differ_start_a_stretch():
    ordinary = [w for w in dict.fromkeys(WORDS) if len(w) > 2][:24]
    fill = lambda base: " ".join(f"{w} {base + i}" if i % 3 == 2 else w for i, w in enumerate(ordinary))
    index = leakage.Index([3], [fill(1000)])
    assert [(i, kind, k) for i, kind, k, _ in index.leaks(fill(77000))] == [(3, "literal", 24)]
