"""Problem 5: address records that denote the same place, however they are written.

Addresses are parsed into components and sorted several times, each time with another component leading: the post code,
the town, the street, the locality, always within one house and flat number, which must agree strictly. In each pass a
record is compared with all records that tie with it on the leading component (an equi-join, so a hot key is split by
the optimiser rather than drawn into one task) and with all records of the next WINDOW different leading components in
sorted order, which catches slips in the leading component itself. A comparison weighs the components: edit distance with transpositions within words,
agreement of ordinals and post codes exactly. Equal spellings are collapsed to one representative before anything is
compared and expanded at the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different leading components before its own, in sorted order, with whose records a record is compared besides its ties.
WINDOW = 4
#: A region stands after the town in at least this share of the addresses of at least so many post-code districts of different towns.
REGION, REGION_TOWNS = 0.1, 3

#: Abbreviations and what they stand for.
_FULL = {
    "rd": "road", "rood": "road", "roads": "road", "st": "street", "str": "street", "ln": "lane", "ave": "avenue", "av": "avenue", "aveue": "avenue",
    "col": "colony", "clny": "colony", "coly": "colony", "colny": "colony", "ngr": "nagar", "nagara": "nagar", "nagr": "nagar", "extn": "extension", "ext": "extension", "exten": "extension",
    "lyt": "layout", "lay": "layout", "mkt": "market", "sec": "sector", "stn": "station", "tmpl": "temple", "mandir": "temple", "clg": "college", "indl": "industrial", "ind": "industrial",
    "crs": "cross", "cr": "cross", "x": "cross", "mn": "main", "mg": "marg", "apts": "apartment", "apt": "apartment", "appts": "apartment", "apartments": "apartment", "twr": "tower", "twrs": "tower", "towers": "tower",
    "blk": "block", "rsdcy": "residency", "resi": "residency", "res": "residency", "encl": "enclave", "bazar": "bazaar", "opposite": "opp", "nr": "near", "qtr": "quarter", "qtrs": "quarter", "est": "estate", "pk": "park", "hts": "heights",
}
_ORDINALS = {w: i for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split(), 1)}
_NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
_ROMANS = {w: i for i, w in enumerate("i ii iii iv v vi vii viii ix xi xii xiii xiv xv".split(), 1)} | {"x1": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15}
_ROADS = {"road", "street", "lane", "avenue", "cross", "marg", "path"}
_AREAS = {"colony", "nagar", "layout", "extension", "enclave", "vihar", "park", "estate", "area", "lines", "quarter", "view", "bazaar", "puram", "phase"}
_BUILDINGS = {"block", "tower", "apartment", "heights", "residency", "mansion", "complex", "villa", "court"}
_TYPES = sorted((_ROADS | _AREAS | _BUILDINGS | {"mandir", "temple"}) - {"path", "park", "area", "view", "court", "lines", "phase"})
_NEAR = {"opp", "near", "beside", "behind", "adjacent", "next", "back"}
_FLAT = re.compile(r"\b(?:flat|flt|unit|apartment|apt|f)\b[\s.,:-]*(?:no\b)?[\s.:#-]*(\d+[a-z]?)\b")
_DOUBLE = re.compile(r"(\d+)\s*[/-]\s*(\d+)(?![\d/])")
_PIN = re.compile(r"(?:\bpin\s*code|\bpin)?[\s:.,-]*\b(\d{3})\s?(\d{3})\b(?!\s*/)")
_NUM = re.compile(r"(#|\b(?:house|h|d|door|plot|no|nos)\b[\s.:#-]*(?:no\b)?[\s.:#-]*)?\s*\b(\d+(?:/\d+)?)(?![\w/])")
_HEAD = re.compile(r"^\s*(?:add(?:ress)?\s*[:.-]+|[swdc]/o\b\s*(?:self)?)[\s,:.-]*")


class Place:
    """The components of an address."""

    __slots__ = ("house", "flat", "pin", "roads", "areas", "buildings", "rest")

    def __init__(self, text: str) -> None:
        s = unicodedata.normalize("NFKC", text).lower().replace("\n", ", ").replace("lay out", "layout").replace("l/o", "layout")
        s = _HEAD.sub("", s)
        self.pin = ""
        for m in _PIN.finditer(s):
            if m.start(1) > 2 or "pin" in m[0]:
                self.pin, cut = m[1] + m[2], m.span()
        if self.pin:
            s = f"{s[: cut[0]]} , {s[cut[1] :]}"
        s = _DOUBLE.sub(r"\1/\2", s)
        # A bare number between letters and digits of an ordinal is none of a house: "7 th", "9th".
        s = re.sub(r"\b(\d+)\s?(?:st|nd|rd|th)\b(?!\s*[.,]?\s*(?:\d|$))", r" ord\1 ", s)
        flat = _FLAT.search(s)
        self.flat = ""
        if flat:
            self.flat = flat[1]
            s = f"{s[: flat.start()]} , {s[flat.end() :]}"
        nums = [(m[1] or "", m[2], m.start(), m.end()) for m in _NUM.finditer(s)]
        if not self.flat and len(nums) > 1 and not any("/" in n[1] for n in nums):
            first = next((n for n in nums if n[0] == "#"), nums[0])
            self.flat = first[1]
            nums.remove(first)
        self.house = next((n[1] for n in nums if "/" in n[1]), nums[0][1] if nums else "")
        for m in sorted(_NUM.finditer(s), key=lambda m: -m.start()):
            s = f"{s[: m.start()]} , {s[m.end() :]}"
        self.roads, self.areas, self.buildings, self.rest = [], [], [], []
        for part in re.split(r"[,;]", s):
            self._part(re.findall(r"[^\W_]+", re.sub(r"['’]", "", part)))

    def _part(self, words: list[str]) -> None:
        words = [_word(w) for w in words]
        held: list[str] = []
        i = 0
        while i < len(words):
            w = words[i]
            if w in _NEAR:
                # A landmark is no part of the place. Without commas it is two words long, "back side of" one.
                self.rest += held
                held = []
                back = words[i : i + 3] == ["back", "side", "of"]
                i += 4 if back else 3
                if i < len(words) and words[i] in ("gate", "stand", "tank", "clinic", "school", "shop", "temple"):
                    i += 1
                continue
            if w in ("no", "house", "door", "plot", "flat", "unit", "pin", "code", "pincode", "state", "dist", "h", "d", "f", "self", "of"):
                i += 1
                continue
            if w == "sector" and i + 1 < len(words):
                self.rest += held
                held = []
                self.areas.append(f"sector {words[i + 1]}")
                i += 2
                continue
            held.append(w)
            nxt = words[i + 1] if i + 1 < len(words) else ""
            if w in _ROADS and not (w == "cross" and nxt in _ROADS) and len(held) > 1 and not (w == "street" and nxt == "road"):
                name = self._tail(held)
                self.roads.append(name)
                held = []
            elif w in _AREAS and len(held) > 1 and nxt not in _ROADS:
                self.areas.append(self._tail(held))
                held = []
            elif w in _BUILDINGS and len(held) > 1 and nxt not in _ROADS:
                self.buildings.append(self._tail(held))
                held = []
            i += 1
        self.rest += held

    def _tail(self, held: list[str]) -> str:
        """The name that ends with a type word; an ordinal starts it ("main road" without one is a name's end)."""
        at = max((k for k, w in enumerate(held) if w.startswith("ord")), default=0)
        if at and held[-1] in _ROADS:
            self.rest += held[:at]
            held = held[at:]
        return " ".join(held)


@lru_cache(maxsize=200_000)
def _word(w: str) -> str:
    if w in _FULL:
        return _FULL[w]
    if w in _ORDINALS:
        return f"ord{_ORDINALS[w]}"
    if w in _NUMBERS:
        return f"ord{_NUMBERS[w]}"
    m = re.fullmatch(r"([ivx]+)(?:st|nd|rd|th)?", w)
    if m and m[1] in _ROMANS and w != "x":
        return f"ord{_ROMANS[m[1]]}"
    m = re.fullmatch(r"(\d+)(?:st|nd|rd|th)?", w)
    if m:
        return f"ord{m[1]}"
    for known, n in _ORDINALS.items():  # a typed ordinal with a slip
        if len(w) >= 4 and abs(len(w) - len(known)) <= 1 and w[-1] in "htd" and distance(w, known) == 1:
            return f"ord{n}"
    for known in _TYPES:  # likewise a type word
        if len(w) >= 4 and len(known) >= 5 and abs(len(w) - len(known)) <= 1 and distance(w, known) == 1:
            return _FULL.get(known, known)
    return w


@lru_cache(maxsize=500_000)
def distance(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one edit (optimal string alignment)."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    two, one = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            c = one[j - 1] + (a[i - 1] != b[j - 1])
            if one[j] + 1 < c:
                c = one[j] + 1
            if row[j - 1] + 1 < c:
                c = row[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and two[j - 2] + 1 < c:
                c = two[j - 2] + 1
            row[j] = c
        two, one = one, row
    return one[m]


def alike(a: str, b: str) -> bool:
    """Whether two component names are one with slips: the same ordinals, few edits for their length."""
    if a == b:
        return True
    if re.findall(r"ord\d+", a) != re.findall(r"ord\d+", b):
        return False
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if abs(len(x) - len(y)) > 3:
        return False
    return distance(x, y) <= max(1, min(len(x), len(y)) // 4)


@lru_cache(maxsize=300_000)
def _agree(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """1: some name in common; -1: both have names but none in common; 0: one has none."""
    if not a or not b:
        return 0
    return 1 if any(alike(x, y) or _ends(x, y) for x in a for y in b) else -1


def _ends(a: str, b: str) -> bool:
    """Whether the longer name ends with the shorter one of two or more words: a locality of one word may stand before a street."""
    x, y = a.split(), b.split()
    n = min(len(x), len(y))
    return len(x) != len(y) and n >= 2 and alike(" ".join(x[-n:]), " ".join(y[-n:]))


def same_place(a: tuple, b: tuple) -> bool:
    """Whether two parsed addresses (house, flat, pin, roads, areas, towns) denote the same place.

    House and flat must be equal. Town or post code must agree; a post code that differs is a contradiction unless all
    else agrees and one digit is off. Two of street, locality, town and post code must agree and none of street and
    locality contradict, but that one contradiction is outweighed by three agreements.
    """
    if a[0] != b[0] or a[1] != b[1] or not (a[0] or a[1]):
        return False
    road, area, town = _agree(a[3], b[3]), _agree(a[4], b[4]), _agree(a[5], b[5])
    pin = 0
    if a[2] and b[2]:
        pin = 1 if a[2] == b[2] else -1
        if pin < 0 and (sum(x != y for x, y in zip(a[2], b[2])) > 1 and sorted(a[2]) != sorted(b[2]) or not (road > 0 and town > 0)):
            return False
    if road < 0 or pin <= 0 and town <= 0:
        return False
    if town < 0 and not (pin > 0 and road > 0):
        return False
    if area < 0 and not (road > 0 and (pin > 0 or town > 0)):
        return False
    return (road > 0) + (area > 0) + (town > 0) + (pin > 0) >= 2


def roads_contradict(x: Column, y: Column) -> Column:
    """Whether two joined lists of roads are one name each, of as many words, too many edits apart to be alike: such addresses are never of one place.

    A swap of neighbours is two plain edits, so twice the edits that `alike` allows are waited for. Decided before anything goes to Python.
    """
    words = lambda c: F.size(F.split(c, " "))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    one = (x != "") & (y != "") & ~x.contains("|") & ~y.contains("|") & (words(x) == words(y))
    allowed = F.greatest(F.lit(1), F.floor(F.least(F.length(bare(x)), F.length(bare(y))) / 4))
    return one & (F.levenshtein(bare(x), bare(y)) > 2 * allowed)


PARSED = "house string, flat string, pin string, roads array<string>, areas array<string>, rest array<string>"


def parsed(spellings: DataFrame, key: str, text: str) -> DataFrame:
    """The components of each spelling: key and PARSED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                p = Place(t)
                rows.append((k, p.house, p.flat, p.pin, p.roads, p.areas, [w for w in p.rest if len(w) > 2 and not w.startswith("ord")]))
            yield pd.DataFrame(rows, columns=[key, "house", "flat", "pin", "roads", "areas", "rest"])

    kind = spellings.schema[key].dataType.simpleString()
    return spellings.select(key, text).mapInPandas(run, f"{key} {kind}, {PARSED}")


def regions(seen: DataFrame, districts: DataFrame) -> list[str]:
    """Words that name a region: they stand after the towns of several post-code districts, whose own words they are not.

    seen: d, w, n, first (addresses of district d with the word w, and those that start with it); districts: d, all. How
    many addresses a word has does not count, so a town of very many stays a town.
    """
    own = seen.groupBy("d").agg(F.max_by("w", F.struct("n", "first", "w")).alias("own"))
    beside = seen.join(own, "d").join(districts, "d").where((F.col("n") > 2) & (F.col("w") != F.col("own")) & (F.col("n") >= REGION * F.col("all")))
    many = beside.groupBy("w").agg(F.count_distinct("own").alias("towns"), F.sum("n").alias("n"), F.sum("first").alias("first"))
    return [r["w"] for r in many.where((F.col("towns") >= REGION_TOWNS) & (2 * F.col("first") < F.col("n"))).collect()]


def same_spellings(places: DataFrame, key: str = "sid") -> DataFrame:
    """(a, b) with a < b: spellings of the same place among parsed ones (key, PARSED)."""
    # How many addresses of a post-code district hold a word, and how many start with it. The districts are a thousand at most.
    coded = places.where(F.length("pin") == 6).select(F.substring("pin", 1, 3).alias("d"), F.array_distinct("rest").alias("ws"))
    seen = coded.select("d", F.posexplode("ws").alias("i", "w")).groupBy("d", "w").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("i") == 0).cast("long")).alias("first")).persist()
    common = regions(seen, coded.groupBy("d").agg(F.count(F.lit(1)).alias("all")))
    towns = F.filter("rest", lambda w: ~w.isin(common)) if common else F.col("rest")
    has = (F.col("house") != "") | (F.col("flat") != "")
    base = places.where(has).select(key, "house", "flat", "pin", "roads", "areas", towns.alias("towns"))
    # The district digits of a post code stand for the town where that is left out. There are at most a thousand of them.
    of = {r["d"]: r["w"] for r in seen.where(~F.col("w").isin(common)).groupBy("d").agg(F.max_by("w", F.struct("n", "w")).alias("w")).limit(1000).collect()}
    seen.unpersist()
    if of:
        known = F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.substring("pin", 1, 3))
        base = base.withColumn("towns", F.when((F.size("towns") == 0) & known.isNotNull(), F.array(known)).otherwise(F.col("towns")))
    # A leading component by its frame: first letters and length class survive most slips.
    skeleton = lambda c: F.regexp_replace(F.regexp_replace(c, "[aeiou ]", ""), r"(.)\1+", "$1")
    leads = F.array_compact(
        F.array(
            F.when(F.col("pin") != "", F.concat(F.lit("1"), F.col("pin"))),
            F.when(F.size("towns") > 0, F.concat(F.lit("2"), skeleton(F.array_sort("towns")[0]))),
            F.when(F.size("roads") > 0, F.concat(F.lit("3"), skeleton(F.array_sort("roads")[0]))),
            F.when(F.size("areas") > 0, F.concat(F.lit("4"), skeleton(F.array_sort("areas")[0]))),
        )
    )
    parts = ["pin", "roads", "areas", "towns"]
    flat = base.select(key, "house", "flat", "pin", *[F.array_join(c, "|").alias(c) for c in parts[1:]], leads.alias("leads"))
    keyed = flat.select("*", F.explode("leads").alias("lead"))
    # Ties: an equi-join on house, flat and leading component. A pair that ties in several passes is compared in the first.
    left = keyed.select("house", "flat", "lead", F.col(key).alias("a"), F.col("leads").alias("xl"), *[F.col(c).alias(f"x{c}") for c in parts])
    right = keyed.select("house", "flat", "lead", F.col(key).alias("b"), F.col("leads").alias("yl"), *[F.col(c).alias(f"y{c}") for c in parts])
    tied = left.join(right, ["house", "flat", "lead"]).where((F.col("a") < F.col("b")) & (F.array_min(F.array_intersect("xl", "yl")) == F.col("lead"))).drop("lead", "xl", "yl")
    pair = [f"{s}{c}" for s in "xy" for c in parts]
    tied = tied.where(~roads_contradict(F.col("xroads"), F.col("yroads")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, h, f, p, r, l, t, q, s, m, u in zip(pdf["a"], pdf["b"], pdf["house"], pdf["flat"], *(pdf[c] for c in pair)):
                if same_place((h, f, p, _names(r), _names(l), _names(t)), (h, f, q, _names(s), _names(m), _names(u))):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    # Neighbours: within a house, flat and pass sorted by leading component, each against all of the next few that do not tie with it.
    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple = ()
        lead = None
        blocks: list[list[tuple]] = []
        for pdf in batches:
            out = []
            for k, h, f, now, p, r, l, t in zip(pdf[key], pdf["house"], pdf["flat"], pdf["lead"], *(pdf[c] for c in parts)):
                if at != (h, f, now[0]):
                    at, lead, blocks = (h, f, now[0]), now, [[]]
                elif now != lead:
                    lead, blocks = now, [*blocks[-WINDOW:], []]
                me = (h, f, p, _names(r), _names(l), _names(t))
                for block in blocks[:-1]:
                    out += [(min(j, k), max(j, k)) for j, other in block if j != k and same_place(other, me)]
                blocks[-1].append((k, me))
            yield pd.DataFrame(out, columns=["a", "b"])

    kind = places.schema[key].dataType.simpleString()
    # Neighbours never lie in different groups, so whole groups to a task leave no boundary between them.
    group = ["house", "flat", F.substring("lead", 1, 1)]
    near = keyed.drop("leads").repartition(*group).sortWithinPartitions("house", "flat", "lead", key).mapInPandas(slide, f"a {kind}, b {kind}")
    return tied.select("a", "b", "house", "flat", *pair).mapInPandas(compare, f"a {kind}, b {kind}").unionByName(near).distinct()


@lru_cache(maxsize=100_000)
def _names(joined: str) -> tuple[str, ...]:
    return tuple(joined.split("|")) if joined else ()


def address_records(los: DataFrame, fields: DataFrame) -> DataFrame:
    """(record, address): the address records of loans and of aadhaar documents; nulls and blanks are none."""
    current = los.select(F.concat("loan_id", F.lit(":current_address")).alias("record"), F.col("current_address").alias("address"))
    permanent = los.select(F.concat("loan_id", F.lit(":permanent_address")).alias("record"), F.col("permanent_address").alias("address"))
    card = fields.where((F.col("doc_key") == "aadhaar") & (F.col("field") == "address")).select(
        F.concat("loan_id", F.lit(":aadhaar_address")).alias("record"), F.col("value").alias("address")
    )
    return current.unionByName(permanent).unionByName(card).where(F.col("record").isNotNull() & (F.trim("address") != "")).distinct()


def linked(records: DataFrame) -> DataFrame:
    """(address_a, address_b): pairs of records of the same place whose strings differ, the smaller key first.

    Copies of a spelling are one representative until the end. Null, blank and unparsable addresses link to nothing;
    records without house and flat number link to nothing; repeated rows count once; extra columns are ignored.
    """
    named = records.select("record", "address", F.xxhash64("address").alias("sid"))
    spellings = named.groupBy("sid").agg(F.first("address").alias("address"))
    pairs = same_spellings(parsed(spellings, "sid", "address").persist())
    left = pairs.join(named.select(F.col("sid").alias("a"), F.col("record").alias("p")), "a")
    both = left.join(named.select(F.col("sid").alias("b"), F.col("record").alias("q")), "b").where(F.col("p") != F.col("q"))
    return both.select(F.least("p", "q").alias("address_a"), F.greatest("p", "q").alias("address_b")).distinct()
