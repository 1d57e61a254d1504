"""Problem 3: variant spellings of the names of one person, linked.

Suffix blocking: each name is indexed by the suffixes of its tokens. Short suffixes are common ("-murthy" ends a tenth
of all surnames), so an entry is a suffix of minimum length refined with another field of the record: day of birth,
last characters of an identity number, phone, house. A record stands under the suffixes of the applicant's and of the
father's words alike, all of them. All mentions of an entry meet, also of a common one; nothing is discarded, and there
is no way to a candidate but a suffix. Candidate pairs are compared by the longest-common-subsequence ratio of their
tokens, with initials, nicknames and lost or reordered parts allowed for, and linked if the other fields do not
contradict and say enough that the bearer is the same.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.address import Place

#: The suffix that is indexed.
SUFFIX = 3
#: Smallest longest-common-subsequence ratio of two tokens that are the same word, and evidence that links.
RATIO, ENOUGH = 0.75, 2.5

#: What is said of a person and is no part of the name.
_TITLES = frozenset("mr mrs ms miss smt shri sri shree dr kum kumari late ji prof md adv capt col maj er".split())
#: Middle words that come and go.
_FILLERS = frozenset("kumar lal bai devi rao bhai ben begum singh kaur".split())
_NICK = re.compile(r"(?:ya|ia|u|y|i)$")


def tokens(name: str) -> list[str]:
    """Lower-case words and initials of a name without titles; words run together at a capital are parted."""
    s = unicodedata.normalize("NFKC", name)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    s = re.sub(r"\bM\s*/\s*s\b|\b[SDWC]\s*/\s*[Oo]\b", " ", s, flags=re.IGNORECASE)
    return [w for w in re.findall(r"[^\W\d_]+", s.lower()) if w not in _TITLES]


@lru_cache(maxsize=300_000)
def frame(w: str) -> str:
    """A word with spellings that sound alike made equal."""
    w = w.replace("ee", "i").replace("oo", "u").replace("w", "v").replace("z", "j").replace("ph", "f")
    return re.sub(r"(.)\1+", r"\1", w[:-1] + "i" if w.endswith("y") else w)


@lru_cache(maxsize=500_000)
def ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the total length; a swap of neighbours costs half of it."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    row = [0] * (m + 1)
    for x in a:
        last = 0
        for j in range(m):
            keep = row[j + 1]
            if x == b[j]:
                row[j + 1] = last + 1
            elif row[j] > row[j + 1]:
                row[j + 1] = row[j]
            last = keep
    best = 2.0 * row[m] / (n + m)
    if n == m and best < 1.0:
        i = next(k for k in range(n) if a[k] != b[k])
        if i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]:
            best = max(best, 1.0 - 0.5 / n)
    return best


@lru_cache(maxsize=500_000)
def same_word(a: str, b: str) -> float:
    """How far two tokens may be one word: 1 to RATIO for spellings, 0.7 for a nickname, 0.5 for an initial, else 0."""
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    x, y = frame(a), frame(b)
    r = ratio(x, y)
    if r >= RATIO and x[0] == y[0] or r >= 0.85:
        return r
    for p, q in ((x, y), (y, x)):
        stem = _NICK.sub("", p)
        if len(stem) >= 3 and len(stem) < len(p) and len(q) > len(stem) and (q.startswith(stem) or ratio(stem, q[: len(stem)]) >= 0.8 and len(stem) >= 4):
            return 0.7
    return 0.0


def same_name(a: str, b: str) -> float:
    """How far two full names may be one: 0 where they contradict, below 0.6 where initials carry most of it, up to 1.

    Parts may be reordered, dropped or cut to initials. Every part of the shorter name must have its own counterpart in the longer one,
    middle words and single letters excepted. Names that share no word of three letters beyond initials get 0.4 at most.
    """
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return 0.0
    if "".join(x) == "".join(y) or sorted(x) == sorted(y):
        return 1.0
    p, q = [w for w in x if w not in _FILLERS or len(x) == 1], [w for w in y if w not in _FILLERS or len(y) == 1]
    p, q = (p or x), (q or y)
    joined = max(ratio(frame("".join(p)), frame("".join(q))), ratio(frame("".join(sorted(p))), frame("".join(sorted(q)))))
    short, long = (p, q) if len(p) <= len(q) else (q, p)
    left, total, spelled, count = list(long), 0.0, 0, 0
    for w in sorted(short, key=len, reverse=True):
        best = max(left, key=lambda v: (same_word(w, v), len(v)), default=None)
        s = same_word(w, best) if best is not None else 0.0
        if s == 0.0:
            if len(w) == 1 and count >= 1:
                continue
            return joined if joined >= 0.9 else 0.0
        left.remove(best)
        total, count = total + s, count + 1
        spelled += s >= 0.7 and min(len(w), len(best)) >= 3
    if not spelled:
        return 0.4 if len(long) >= 2 and count >= 2 else 0.0
    # What is left over may only be middle words and initials if both names have their two main parts.
    over = [w for w in left if len(w) > 2]
    if len(short) == 1 and over:
        return 0.45
    if over and len(short) >= 2:
        total -= 0.3
    return max(0.0, total / max(1, count)) if spelled >= 2 else min(0.58, total / max(1, count))


# --- fields of a record, brought to one notation (Column expressions) ---


def day_of(c: Column) -> Column:
    """ISO day of a date in the notations that occur; two-digit years are of the last hundred years before 2010."""
    s = F.regexp_replace(c, r"\s", "")
    iso = F.regexp_extract(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 0)
    d, m, y = (F.regexp_extract(s, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$", i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 4, y).when(y > "10", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    return F.when(iso != "", F.translate(iso, "/.", "--")).when(d != "", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def _tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.substring(c, -n, n))


def pan_of(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", "")), F.lit(""))


def digits_of(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit(""))


ABOUT = ["dob", "pan", "aad", "mob"]
#: A mention: a record of the loan ("los": its applicant `name` and the father `other`) or a card ("pan_applicant_name").
MENTION = ["field", "loan_id", "name", *ABOUT, "other", "homes"]


def with_homes(person: DataFrame) -> DataFrame:
    """Two addresses of a row reduced to house keys, hashes of house, flat and road."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = zip(pdf["address"], pdf["address2"])
            pdf["homes"] = ["|".join(sorted({h for a in ab if isinstance(a, str) and (h := _home(a))})) for ab in both]
            yield pdf.drop(columns=["address", "address2"])

    kept = [f for f in person.schema if f.name not in ("address", "address2")]
    return person.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", homes string")


def mentions(los: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per (record, loan, spellings) with what the record says of the person. Null and blank names give none."""
    norm = los.select(
        "loan_id", "applicant_name", "fathers_name",
        day_of(F.col("applicant_dob")).alias("dob"), pan_of(F.col("applicant_pan_number")).alias("pan"),
        digits_of(F.col("aadhaar_no")).alias("aad"), _tail(digits_of(F.col("applicant_mobile_no")), 10).alias("mob"),
        F.col("current_address").alias("address"), F.col("permanent_address").alias("address2"),
    ).where(F.col("loan_id").isNotNull())
    grouped = norm.groupBy("loan_id", "applicant_name", "fathers_name").agg(*[F.max(c).alias(c) for c in (*ABOUT, "address", "address2")])
    person = with_homes(grouped).persist()
    none = [F.lit(None).cast("string").alias(c) for c in ("_applicant", "_dob", "_pan")]
    own = person.select(F.lit("los").alias("field"), "loan_id", F.col("applicant_name").alias("name"), *ABOUT, F.col("fathers_name").alias("other"), "homes", *none)
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    cards = (
        fields.where((F.col("doc_key") == "pan") & F.col("loan_id").isNotNull() & F.col("field").isin("applicant_name", "dob", "pan_number", "fathers_name"))
        .groupBy("loan_id", "run_no")
        .agg(value("applicant_name").alias("name"), value("dob").alias("d"), value("pan_number").alias("p"), value("fathers_name").alias("f"))
        .where(F.col("name").isNotNull())
        .groupBy("loan_id", "name")
        .agg(F.max(day_of(F.col("d"))).alias("d"), F.max(pan_of(F.col("p"))).alias("p"), F.max("f").alias("f"))
    )
    # The loan's own record tells more of the person on the card, unless the card was filed under a wrong loan.
    one = person.groupBy("loan_id").agg(*[F.max(c).alias(c) for c in ("applicant_name", *ABOUT, "homes")])
    card = cards.join(one, "loan_id", "left").select(
        F.lit("pan_applicant_name").alias("field"), "loan_id", "name", F.col("d").alias("dob"), F.col("p").alias("pan"), "aad", "mob", F.col("f").alias("other"),
        "homes", F.col("applicant_name").alias("_applicant"), F.col("dob").alias("_dob"), F.col("pan").alias("_pan"),
    )
    return own.unionByName(card).where((F.trim("name") != "") | (F.col("field") == "los") & (F.trim("other") != ""))


#: The columns that are compared, and what parts them in one string. Mentions that agree in all of them are one class.
BODY, SEPARATOR = ["name", "dob", "pan", "aad", "mob", "other", "homes"], "\x1f"
ENTRY = ", ".join(f"{c} string" for c in MENTION) + ", keys array<string>"


def suffixes(name: str | None) -> set[str]:
    """The indexed suffixes of a name's words of three letters and more."""
    return {frame(w)[-SUFFIX:] for w in tokens(name) if len(w) >= 3 and w not in _FILLERS} if name else set()


def entries(named: DataFrame) -> DataFrame:
    """Mentions with their entries in the suffix index: keys, each a suffix and a refining field, as "suffix|refinement".

    A record stands under the suffixes of both its names. Those of the applicant are refined with each field of the record, those of
    the father with the house and the child's day of birth, phone and numbers: where one name lost its suffix to a slip or
    an initial, the other's finds the record.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for field, loan, name, dob, pan, aad, mob, other, homes, x_name, x_dob, x_pan in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                if field == "pan_applicant_name":
                    if x_name and same_name(name, x_name) > 0 and not (dob and x_dob and dob != x_dob):
                        dob, pan = dob or x_dob, pan or x_pan
                    else:
                        aad = mob = homes = None
                refine = [x for x in (dob and "d" + dob, pan and len(pan) >= 4 and "p" + pan[-4:], aad and len(aad) >= 4 and "a" + aad[-4:], mob and "m" + mob) if x]
                refine += ["h" + h for h in homes.split("|")] if homes else []
                keys = {f"{s}|{x}" for s in suffixes(name) | suffixes(other) for x in refine}
                out.append((field, loan, name, dob, pan, aad, mob, other, homes, list(keys)))
            yield pd.DataFrame(out, columns=[*MENTION, "keys"])

    return named.mapInPandas(run, ENTRY)


@lru_cache(maxsize=100_000)
def _home(address: str) -> str | None:
    p = Place(address)
    if not (p.house or p.flat):
        return None
    road = re.sub(r"[aeiou ]", "", min(p.roads)) if p.roads else p.pin
    return format(zlib.crc32(f"{p.house}#{p.flat}#{road}".encode()), "x")


def evidence(dob_a, pan_a, aad_a, mob_a, homes_a, dob_b, pan_b, aad_b, mob_b, homes_b) -> float:
    """What the fields beside the name say for (positive) or against two records being of one person."""
    e = 0.0
    if dob_a and dob_b:
        e += 3.0 if dob_a == dob_b else -5.0
    if pan_a and pan_b and len(pan_a) >= 4 and len(pan_b) >= 4:
        masked = "XXX" in pan_a or "XXX" in pan_b
        if pan_a == pan_b or pan_a[-4:] == pan_b[-4:] and masked:
            e += 3.0
        elif masked:
            e -= 2.0 if sum(x != y for x, y in zip(pan_a[-4:], pan_b[-4:])) > 2 else 0.0
        else:
            e += 2.5 if ratio(pan_a, pan_b) >= 0.75 else -3.0
    if aad_a and aad_b:
        e += (4.0 if len(aad_a) == len(aad_b) == 12 and aad_a == aad_b else 2.2) if aad_a[-4:] == aad_b[-4:] else -3.0
    if mob_a and mob_a == mob_b:
        e += 3.0
    if homes_a and homes_b:
        shared = len(set(homes_a.split("|")) & set(homes_b.split("|")))
        e += (0.0, 1.5, 2.2)[min(shared, 2)]
    return e


def same_bearer(s: float, e: float, related: float | None) -> bool:
    """Whether names alike by s, with evidence e and related names alike by `related` (None: unknown), are of one person."""
    if s <= 0:
        return False
    if related is not None:
        e += 0.8 if related > 0 else -1.5
    return e >= ENOUGH + (2.5 if s <= 0.4 else 0.5 if s < 0.6 else -0.4 if s >= 0.9 else 0.0)


def same_father(s: float, e: float, child: float | None) -> bool:
    """Whether fathers' names alike by s are of one man: his child is the same by evidence e, and the child's names do not contradict."""
    return s > 0 and child != 0 and e + (0.5 if child else 0.0) >= ENOUGH + (2.0 if s <= 0.4 else 0.0)


def candidates(mentions_in: DataFrame) -> DataFrame:
    """(a, b): ids of mentions (or classes of copies) that share an entry of the suffix index. mentions_in: id, field, keys."""
    # All mentions of an entry meet, however many: a hot entry is a skewed key of the join, which the optimiser splits.
    final = mentions_in.select("id", "field", F.explode("keys").alias("k")).select("id", F.xxhash64("field", "k").alias("e"))
    return final.alias("x").join(final.alias("y"), "e").where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def linked(los: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, loan_a, loan_b): different loans whose names in a field mean the same person, spelled differently.

    Repeated rows and restatements of a loan count once; null and blank names are no cases; a name without any word of three letters
    and a record without any refining field link to nothing; extra columns are ignored.
    """
    # What is compared travels as one string: ten short columns would weigh twice as much in the two joins.
    body = F.array_join(F.array(*[F.translate(F.coalesce(c, F.lit("")), SEPARATOR, "") for c in BODY]), SEPARATOR)
    base = entries(mentions(los, fields)).select("loan_id", "field", body.alias("body"), "keys").withColumn("id", F.xxhash64("field", "body")).persist()
    # Copies are one class in the index, however many loans they are of, and are told apart again at the end.
    classes = base.groupBy("id").agg(*[F.first(c).alias(c) for c in ("field", "body", "keys")]).persist()
    pairs = candidates(classes)
    left = classes.select(F.col("id").alias("a"), "field", F.col("body").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("body").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "field", "x", "y")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, f, x, y in zip(pdf["a"], pdf["b"], pdf["field"], pdf["x"], pdf["y"]):
                n1, d1, p1, a1, m1, o1, h1 = x.split(SEPARATOR)
                n2, d2, p2, a2, m2, o2, h2 = y.split(SEPARATOR)
                if n1 == n2 and o1 == o2:
                    continue
                other_day = bool(d1 and d2 and d1 != d2)
                if f == "los" and o1 != o2 and o1 and o2 and h1 and h2 and not set(h1.split("|")).isdisjoint(h2.split("|")) and same_name(o1, o2) >= 0.55:
                    # Fathers of one house; the children may be different.
                    out.append(("fathers_name", a, b))
                if other_day:
                    continue  # another day of birth is another person
                s = same_name(n1, n2)
                if s <= 0:
                    continue
                e = evidence(d1, p1, a1, m1, h1, d2, p2, a2, m2, h2)
                related = same_name(o1, o2) if o1 and o2 else None
                if n1 != n2 and same_bearer(s, e, related):
                    out.append(("applicant_name" if f == "los" else f, a, b))
                if f == "los" and related and o1 != o2 and same_father(related, e, s):
                    out.append(("fathers_name", a, b))
            yield pd.DataFrame(out, columns=["field", "a", "b"])

    same = both.mapInPandas(compare, "field string, a bigint, b bigint")
    of = lambda side, loan: base.select(F.col("id").alias(side), F.col("loan_id").alias(loan))
    loans = same.join(of("a", "p"), "a").join(of("b", "q"), "b").where(F.col("p") != F.col("q"))
    return loans.select("field", F.least("p", "q").alias("loan_a"), F.greatest("p", "q").alias("loan_b")).distinct()
