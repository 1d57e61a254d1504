from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attestra.llm import address, names
from attestra.session import table

SAME = [("Madhita Bai Dharanan", "Smt. Madhita Dharanan"), ("Lokhan Hosaknath", "L. Hosaknath"), ("HOSAKKAR, AINMALA", "Airnmala Hosakkar"), ("Sidhjit Vadavnath", "SidhjitVadabnath"), ("Shivesh Palagkar", "Shivya Palagkar"),
        ("Gopalvel Ramnagkar", "Gopalwel Rmanagkar"), ("Ganvi L", "Ganvi Lingamwar")]
OTHER = [("Harkraj Chitavan", "Sahnvati Chitavan"), ("Rudrit Belurkar", "Tarvappa Palagreddi"), ("S. Palagan", "M. Koratwal")]


@pytest.mark.parametrize("a, b", SAME)
def test_variants_of_a_name(a, b):
    assert names.same_name(a, b) > 0 and names.same_name(b, a) > 0


@pytest.mark.parametrize("a, b", OTHER)
def test_other_names(a, b):
    assert names.same_name(a, b) == 0


def test_longest_common_subsequence_ratio():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b))

    for a, b in (("kadav", "kadvar"), ("ramnag", "rangam"), ("abc", "xyz"), ("belurmurthi", "belurmurti")):
        assert names.ratio(a, b) == pytest.approx(slow(a, b))
    assert names.ratio("gopal", "gpoal") > slow("gopal", "gpoal")


LOS = "row_id bigint, loan_id string, loaded_at timestamp, applicant_name string, fathers_name string, applicant_dob string, applicant_pan_number string, aadhaar_no string, applicant_mobile_no string, current_address string, permanent_address string, homes string, field string"
FIELDS = "field_id bigint, loan_id string, doc_key string, field string, value string, run_no bigint, extracted_at timestamp"


def los(spark, rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, loan, day, a, f, dob, pan, aad, mob, cur, per, "clash", "clash") for i, (loan, a, f, dob, pan, aad, mob, cur, per) in enumerate(rows)], LOS)


ROWS = [
    ("L1", "Lokhan Hosaknath", "Manikraj Hosaknath", "16/04/1991", "CJKXS6836K", "XXXXXXXX 4261", "9000540165", "413-2, Clg Rood, Brijpura, Pincode: 643022", None),
    ("L2", "L. Hosaknath", "Mr M Hosaknath", "1991-04-16", "XXXXXX836K", None, "+91 9000540165", None, None),
    ("L2", "L. Hosaknath", "Mr M Hosaknath", "1991-04-16", "XXXXXX836K", None, "+91 9000540165", None, None),
    ("L3", "Lokhan Hosaknath", "Vasudit Hosaknath", "02/01/1975", "AAKXS1111K", "XXXXXXXX 0001", "7000000000", "9/9, Mill Road, Jalkhed", None),
    ("L4", None, "", None, None, None, None, None, None), ("L5", "", None, "", "", "", "", "", ""), (None, "Lokhan Hosaknath", None, "16/04/1991", None, None, None, None, None),
]


def test_linked_names(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert {tuple(r) for r in names.linked(los(spark, ROWS), empty).collect()} == {("applicant_name", "L1", "L2"), ("fathers_name", "L1", "L2")}
    assert names.linked(los(spark, []), empty).count() == 0


def test_candidates_keep_every_close_pair(spark, small):
    """Against all pairs of a small table, each field on its own: what compares as the same person is not missed by the index."""
    base = names.entries(names.mentions(table(spark, small, "los"), table(spark, small, "doc_fields"))).toPandas()
    own = base[base["field"] == "los"].astype(object).where(lambda d: d.notna(), None).to_dict("records")
    found = {(r["field"], r["loan_a"], r["loan_b"]) for r in names.linked(table(spark, small, "los"), table(spark, small, "doc_fields")).collect()}
    about = ("dob", "pan", "aad", "mob", "homes")
    missed, total = {"applicant_name": 0, "fathers_name": 0}, {"applicant_name": 0, "fathers_name": 0}
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if a["loan_id"] == b["loan_id"]:
                continue
            pair = (min(a["loan_id"], b["loan_id"]), max(a["loan_id"], b["loan_id"]))
            s = names.same_name(a["name"], b["name"]) if a["name"] and b["name"] else 0.0
            related = names.same_name(a["other"], b["other"]) if a["other"] and b["other"] else None
            e = names.evidence(*(a[c] for c in about), *(b[c] for c in about))
            house = bool(set((a["homes"] or "").split("|")) & set((b["homes"] or "").split("|")) - {""})
            same = {"applicant_name": a["name"] != b["name"] and names.same_bearer(s, e, related)}
            same["fathers_name"] = bool(related) and a["other"] != b["other"] and (s > 0 and names.same_father(related, e, s) or house and related >= 0.55)
            for field in same:
                total[field] += same[field]
                missed[field] += same[field] and (field, *pair) not in found
    for field, n in total.items():
        print(f"{field}: {n - missed[field]} of {n} pairs found by the index")
        assert n > 0 and missed[field] <= 0.05 * n


PLACES = [
    ("#325/2,Tank Bund Rd.,Beside Ration Shop,Mkt Area,Amegiri,- 305071", "Tank Bund Road No. 325/2 Mkt Area Ambegiri 305071"),
    ("FLAT NO 701, MEGHDOOT TOWERS, NO 512, SECTOR NINE, FOURTH CROSS, BHIMAVARIPET, TELANGIRI, 565036", "Back side of Dairy\nFlt-701\nMeghdoot Tower\n512\nSec Nine\nIV X\nBhimavaripet\n565036"),
    ("#501, Palm Heights, No 265, Station Road, Sai Enclave, Dwarkapur, Gujravati, 812127", "Flat no.501, Palm Heights, Plot 265, Station Rd, Sai Enclave, Dwarkapur, 812127"),
]
APART = [
    ("413-2, clg rood, brijpura, ud, pincode: 643022", "431-2, clg rood, brijpura, ud, pincode: 643022"),
    ("Flat 701, 512, Fourth Cross, Bhimavaripet 565036", "Flat 702, 512, Fourth Cross, Bhimavaripet 565036"),
    ("12/3, 7th Cross, Hill View, Jalkhed 383120", "12/3, 8th Cross, Hill View, Jalkhed 383120"),
    ("12/3, Mill Road, Hill View, Jalkhed 383120", "12/3, Mill Road, Hill View, Himgarh 617120"),
]


def linked(spark, pairs):
    rows = [(f"r{n}{s}", a) for n, p in enumerate(pairs) for s, a in zip("ab", p)]
    return {tuple(r) for r in address.linked(spark.createDataFrame(rows, "record string, address string")).collect()}


def test_places(spark):
    assert linked(spark, PLACES) == {(f"r{n}a", f"r{n}b") for n in range(len(PLACES))}
    assert linked(spark, APART) == set()


def test_address_edges(spark):
    rows = [("a", None), ("b", ""), ("c", "nowhere"), ("d", "x " * 50_000), ("e", PLACES[0][0]), ("f", PLACES[0][0]), ("g", PLACES[0][1]), ("g", PLACES[0][1])]
    records = spark.createDataFrame(rows, "record string, address string").where("address is not null")
    assert {tuple(r) for r in address.linked(records).collect()} == {("e", "g"), ("f", "g")}
    assert address.linked(records.limit(0)).count() == 0


def test_swaps_count_as_one_edit():
    assert address.distance("hanuman", "hanumna") == 1 and address.distance("road", "rod") == 1 and address.distance("", "abc") == 3


def test_neighbours_on_both_sides_of_a_block_of_ties(spark):
    # Rows are (sid, house, flat, pin, roads, areas, rest). 1 and 2 tie in no pass; between them lies a block of ties of another place.
    one = (1, "12/3", "", "", ["temple street"], [], ["tajwade"])
    two = (2, "12/3", "", "", ["demple street"], [], ["rajwade"])
    block = [(10 + i, "12/3", "", "", ["mill road"], [], ["sajwadi"]) for i in range(9)]
    places = spark.createDataFrame([one, two, *block], f"sid bigint, {address.PARSED}")
    parse = lambda x: (*x[1:4], *map(tuple, x[4:]))
    assert address.same_place(parse(one), parse(two))
    assert (1, 2) in {tuple(r) for r in address.same_spellings(places).collect()}


def test_a_hot_town_is_no_region(spark):
    states = [("maharatna", [("jalkhed", "383"), ("panchgad", "344"), ("shirwadi", "331")]), ("telangiri", [("nalgopet", "526"), ("warigudem", "513"), ("kothaluru", "591")])]
    rows = []
    for state, towns in states:
        for town, code in towns:
            for i in range(300 if town == "jalkhed" else 60):
                rows.append((f"{town}{i}", f"{i + 1}/7, Mill Road, Shanti Nagar, {town}{', ' + state if i % 3 == 0 else ''}, {code}{i % 900:03d}"))
    rows += [("x", "5001/3, Temple Street, Jalkhed"), ("y", "5001/3, Temple Strete, Jalkhed, Maharatna"), ("z", "5001/3, Temple Street, Panchgad, Maharatna")]
    records = spark.createDataFrame(rows, "record string, address string")
    got = {tuple(r) for r in address.linked(records.where("record in ('x', 'y', 'z') or record rlike '[0-9]'")).collect()}
    assert ("x", "y") in got and not {("x", "z"), ("y", "z")} & got


def test_a_hot_day_of_birth_keeps_its_pairs(spark):
    rows = [("A", "Lokhan Hosaknath", None, "16/04/1991", None, None, None, None, None), ("B", "Lokhan Hosakmath", None, "16/04/1991", None, None, None, None, None)]
    rows += [(f"H{i}", f"Zubin{chr(97 + i % 26)}{chr(97 + i // 26)} Perathath", None, "16/04/1991", None, None, None, None, None) for i in range(100)]
    base = names.entries(names.mentions(los(spark, [*rows]), spark.createDataFrame([], FIELDS))).selectExpr("*", "xxhash64(loan_id) as id")
    ids = {r["id"]: r["loan_id"] for r in base.collect()}
    assert {"A", "B"} in [{ids[r["a"]], ids[r["b"]]} for r in names.candidates(base).collect()]


def test_all_words_of_both_names_are_indexed_with_all_fields(spark):
    rows = [("A", "Venkatesh Hosaknath Gopal", "Manikraj Belurkar", "16/04/1991", "CJKXS6836K", "XXXXXXXX 4261", "9000540165", "413-2, Clg Rood, Brijpura, Pincode: 643022", None)]
    keys = names.entries(names.mentions(los(spark, rows), spark.createDataFrame([], FIELDS))).first()["keys"]
    suffixes, fields = {k.split("|")[0] for k in keys}, {k.split("|")[1] for k in keys}
    assert {"pal", "ath", "raj", "kar"} <= suffixes and {"d1991-04-16", "p836K", "a4261", "m9000540165"} <= fields and any(f[0] == "h" for f in fields)
    assert len(keys) == len(suffixes) * len(fields)


def test_fathers_meet_without_a_house(spark):
    rows = [("A", "Lokhan Hosaknath", "Manikraj Belurkar", "16/04/1991", None, None, "9000540165", None, None), ("B", "L. H.", "Manikrj Belurkar", "16/04/1991", None, None, "9000540165", None, None)]
    rows += [("C", None, "Manikraj Belurkar", None, None, None, None, "12/3, Mill Road, Jalkhed 383120", None), ("D", "Rudrit B", "Manikraj Belurkr", None, None, None, None, "No. 12/3, Mill Rd, Jalkhed 383120", None)]
    assert {("fathers_name", "A", "B"), ("fathers_name", "C", "D")} <= {tuple(r) for r in names.linked(los(spark, rows), spark.createDataFrame([], FIELDS)).collect()}


def test_copies_are_one_class_in_the_index(spark):
    copy = ("Lokhan Hosaknath", "Manikraj Hosaknath", "16/04/1991", "CJKXS6836K", None, "9000540165", None, None)
    rows = [(f"C{i}", *copy) for i in range(40)] + [("V", "Lokhn Hosaknath", "Manikraj Hosaknath", *copy[2:])]
    got = {tuple(r) for r in names.linked(los(spark, rows), spark.createDataFrame([], FIELDS)).collect()}
    assert got == {("applicant_name", f"C{i}", "V") for i in range(40)}


def test_roads_that_contradict_are_never_alike(spark):
    rng = random.Random(8)
    base = ["mill road", "temple street", "ord7 cross", "ord8 cross", "station road", "court road", "colege road", "x lane", "elephant gate street", "water tank road"]
    slip = lambda s: "".join(c if rng.random() > 0.12 else rng.choice(["", "a", "k", c + c]) for c in s)
    names = [*base, *["|".join(rng.sample(base, 2)) for _ in range(4)], "", *[slip(rng.choice(base)) for _ in range(60)]]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", address.roads_contradict(F.col("a"), F.col("b")).alias("c")).collect()
    assert any(r["c"] for r in pairs)
    assert not [(r["a"], r["b"]) for r in pairs if r["c"] and address._agree(address._names(r["a"]), address._names(r["b"])) >= 0]
