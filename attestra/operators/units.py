"""Problem 1: one measured quantity recorded in different units, brought to common units.

A duration may be recorded in several columns of a row. All of them together with the identity among the row's columns
(the instalment of an annuity fixes its number of months from amount and rate) form one system: a combination of a unit for
each value solves it if all lengths agree within a tolerance, and the sum of log residuals says how well. What is known of the
units, in order of weight:

1. the identity: where it contradicts the stated unit of a value, the unit with the smallest log residual replaces it, if
   that is the only one which fits;
2. the unit written in the text itself;
3. what is known of the source, from a free-text note, possibly bounded by load day;
4. months.

The number of combinations that solve a row's system is counted: where it is not one, the solution is not unique and rests on
the note or the default; such rows are flagged. Everything is a Column expression: one pass over the rows, one broadcast of
the (counted) note rules, no shuffle.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.normalise import let
from attestra.session import small

#: Months in one of each unit.
MONTHS_PER = {
    "year": 12.0,
    "half_year": 6.0,
    "quarter": 3.0,
    "month": 1.0,
    "fortnight": 12.0 / 26.0,
    "week": 12.0 / 52.0,
    "day": 12.0 / 365.0,
}
#: How a unit is written, in lower case. The order matters: the longer notation is tried first.
UNIT_WORDS = {
    "half_year": r"half[\s-]*year(?:ly|s|\(s\))?|h\.?\s?yrs?|छमाही|chhamahi",
    "year": r"year(?:ly|s|\(s\))?|yrs?|y|annual(?:ly)?|saal|sal|varsh|वर्षे|वर्ष|साल",
    "quarter": r"quarter(?:ly|s|\(s\))?|qtrs?|qrs?|q|timahi|तिमाही|तिमाहियाँ",
    "month": r"month(?:ly|s|\(s\))?|mths?|mnths?|mons?|mos?|mahine|mahina|maah|m|महीनों|महीने|महीना|माह|महिने",
    "fortnight": r"fortnight(?:ly|s|\(s\))?|fn|pakhwad[ae]|पखवाड़े|पखवाड़ा",
    "week": r"week(?:ly|s|\(s\))?|wks?|w|haft[ae]|saptah|हफ़्ते|हफ्ते|सप्ताह|आठवडे",
    "day": r"days?|day\(s\)|daily|d|din|दिनों|दिन|दिवस",
}
_TENS = {"twenty": 2, "thirty": 3, "forty": 4, "fourty": 4, "fifty": 5, "sixty": 6, "seventy": 7, "eighty": 8, "ninety": 9}
_ONES = {
    w: i
    for i, w in enumerate(
        "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 1
    )
}
_ANY_UNIT = "|".join(UNIT_WORDS.values())
#: A component such as "3 years", "6-month", "2.5Y". A letter must not follow the unit word.
_COMPONENT = rf"(\d+(?:\.\d+)?)\s*-?\s*({_ANY_UNIT})(?![\p{{L}}\p{{M}}])"
_LEADING = rf"(?<![\p{{L}}\p{{M}}])(?:{_ANY_UNIT})\.?\s*:?\s*(\d+(?:\.\d+)?)(?!\s*-?\s*(?:{_ANY_UNIT})(?![\p{{L}}\p{{M}}]))"
_LEADING_UNIT = rf"(?<![\p{{L}}\p{{M}}])({_ANY_UNIT})\.?\s*:?\s*\d"
#: Relative distance (as |ln|) within which a recorded duration agrees with the identity.
TOLERANCE = 0.12


_DIGITS = ("०१२३४५६७८९౦౧౨౩౪౫౬౭౮౯೦೧೨೩೪೫೬೭೮೯௦௧௨௩௪௫௬௭௮௯", "0123456789" * 4)
_SPELLED = {w: 10 * n for w, n in _TENS.items()} | _ONES


def _folded(s: Column) -> Column:
    """A text with its number words as digits: a tens word takes a ones word after it along. Hyphens become blanks."""
    numbers = F.create_map(*[F.lit(x) for kv in _SPELLED.items() for x in kv])
    flush = lambda a: F.when(a["n"].isNull(), a["out"]).otherwise(F.concat_ws(" ", F.nullif(a["out"], F.lit("")), a["n"].cast("string")))
    none = F.lit(None).cast("int")

    def step(a: Column, w: Column) -> Column:
        n = F.try_element_at(numbers, w)
        joins = (a["n"] >= 20) & (a["n"] % 10 == 0) & (n < 10)
        return (
            F.when(n.isNull(), F.struct(F.concat_ws(" ", F.nullif(flush(a), F.lit("")), w).alias("out"), none.alias("n")))
            .when(joins, F.struct(a["out"].alias("out"), (a["n"] + n).alias("n")))
            .otherwise(F.struct(flush(a).alias("out"), n.alias("n")))
        )

    half = F.regexp_replace(s, r"\bhalf(?:\s+a)?\s+year\b(?!ly)", "1 half-year")
    return F.aggregate(F.split(F.trim(F.translate(half, "-", " ")), r"\s+"), F.struct(F.lit("").alias("out"), none.alias("n")), step, flush)


def _spelled(c: Column) -> Column:
    """Lower case, ASCII digits, and number words as digits where a text has any."""
    words = "|".join([*_SPELLED, r"half\s"])
    return let(F.lower(F.translate(c.cast("string"), *_DIGITS)), lambda s: F.when(s.rlike(rf"\b(?:{words})"), _folded(s)).otherwise(F.trim(s)))


def _unit_of(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(UNIT_WORDS.items()):
        out = F.when(word.rlike(rf"^(?:{pattern})$"), F.lit(unit)).otherwise(out)
    return out


def _factor(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, months in MONTHS_PER.items():
        out = F.when(unit == name, F.lit(months)).otherwise(out)
    return out


def parse_duration(c: Column) -> Column:
    """A struct<bare DOUBLE, months DOUBLE, unit STRING> of a recorded duration.

    bare: the number, where no unit is written. months: the length, where units are written; several components add
    up ("3Y6M"). unit: the unit written, "mixed" for several different ones. All null: no duration. Null, empty text,
    text without a number and a number of 0 or less give no duration.
    """

    def read(s: Column) -> Column:
        counts, words = (F.regexp_extract_all(s, F.lit(_COMPONENT), i) for i in (1, 2))
        lead = lambda pattern: F.array_compact(F.array(F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))))
        return F.struct(F.regexp_extract(s, r"^\+?(\d+(?:\.\d+)?)$", 1).try_cast("double").alias("number"), counts.alias("n"), words.alias("w"), lead(_LEADING).alias("ln"), lead(_LEADING_UNIT).alias("lw"))

    def parts(x: Column) -> Column:
        ahead = (F.size(x["n"]) == 0) & (F.size(x["ln"]) > 0)
        counts, words = F.when(ahead, x["ln"]).otherwise(x["n"]), F.when(ahead, x["lw"]).otherwise(x["w"])
        return F.struct(F.when(x["number"] > 0, x["number"]).alias("bare"), F.transform(F.arrays_zip(counts.alias("n"), words.alias("w")), lambda c: F.struct(c["n"].cast("double").alias("n"), _unit_of(c["w"]).alias("u"))).alias("parts"))

    def summed(x: Column) -> Column:
        months = F.aggregate(x["parts"], F.lit(0.0), lambda a, c: a + c["n"] * _factor(c["u"]))
        return F.struct(x["bare"].alias("bare"), F.when(x["bare"].isNull() & (months > 0), months).alias("months"), F.array_distinct(F.transform(x["parts"], lambda c: c["u"])).alias("units"))

    def named(x: Column) -> Column:
        unit = F.when(x["months"].isNotNull(), F.when(F.size(x["units"]) == 1, F.get(x["units"], F.lit(0))).otherwise("mixed"))
        return F.struct(x["bare"].alias("bare"), x["months"].alias("months"), unit.alias("unit"))

    return let(let(let(let(_spelled(c), read), parts), summed), named)


# --- what is known of the sources ------------------------------------------------------------------------------------

_NOTE_UNITS = {
    "half_year": r"half[\s-]?year\w*",
    "year": r"(?<!half )(?<!half-)(?<!of a )(?<!last )(?<!this )\byears?\b|(?<!half-)(?<!half )\byearly|annual\w*",
    "quarter": r"quarter\w*",
    "month": r"month\w*",
    "fortnight": r"fortnight\w*",
    "week": r"week\w*",
    "day": r"(?<!load )(?<!working )days?\b|daily",
}
#: Last parts of column names that are units themselves and so do not name a column.
MONTHS_PLURAL = {"months", "years", "days", "weeks"}
_MONTH_NO = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DAY = re.compile(r"(?:(\d{1,2})(?:st|nd|rd|th)?|(end) of)\s+([a-z]{3,9})\.?\s+(\d{4})", re.I)


def _day(m: re.Match) -> dt.date:
    month, year = _MONTH_NO[m[3][:3].lower()], int(m[4])
    if m[2]:
        return dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return dt.date(year, month, int(m[1]))


def note_rules(note: str | None, columns: Iterable[str]) -> list[tuple[str, str, dt.date | None, dt.date | None]]:
    """(column, unit, first load day, last load day) as stated by a note; nothing where it states nothing.

    A clause that names a column (or its first word, or "validity") holds for that column, one that names none for all
    columns that no clause names. `until D` bounds a statement above, `from D` or `since then` below.
    """
    columns = list(columns)
    if not note:
        return []
    named: dict[str, list] = {}
    general: list = []
    last_until: dt.date | None = None
    for sentence in re.split(r"\.(?:\s+|$)", note):
        subject: list[str] = []
        for clause in re.split(r"[;,:]\s+|\s+and\s+", sentence.lower()):
            about = _columns_named(clause, columns)
            if about:
                subject = about
            elif re.search(r"\b(?:tenors?|durations?|feed)\b", clause):
                subject = []
            lower = upper = None
            until, since = re.search(r"until\s+(.*)", clause), re.search(r"(?:from|since)\s+(.*)", clause)
            if until and (d := _DAY.search(until[1])):
                upper = last_until = _day(d)
            elif since and (d := _DAY.search(since[1])):
                lower = _day(d)
            elif "since then" in clause and last_until:
                lower = last_until + dt.timedelta(days=1)
            for c in columns:
                clause = clause.replace(c, " ") if "_" in c else clause
            clause = _DAY.sub(" ", clause)
            found = {u: m.start() for u, p in _NOTE_UNITS.items() if (m := re.search(p, clause))}
            if not found:
                continue
            rule = (min(found, key=found.get), lower, upper)
            for c in subject or [None]:
                into = named.setdefault(c, []) if c else general
                if rule not in into:
                    into.append(rule)
    out = [(c, *r) for c, rules in named.items() for r in rules]
    return out + [(c, *r) for c in columns if c not in named for r in general]


def _columns_named(clause: str, columns: list[str]) -> list[str]:
    """Columns that a clause names in full or, where that says which, by the last part of their name ("validity")."""
    full = [c for c in columns if re.search(rf"(?<!\w){re.escape(c)}(?!\w)", clause)]
    for c in full:
        clause = re.sub(rf"(?<!\w){re.escape(c)}(?!\w)", " ", clause)
    parts = [c for c in columns if c not in full and (p := c.split("_")[-1]) not in MONTHS_PLURAL and re.search(rf"\b{p}\b", clause)]
    return full + parts


def source_rules(notes: DataFrame, columns: Iterable[str], source: str = "source_id", note: str = "note") -> DataFrame:
    """The rules of all notes as rows (source, field, unit, from_day, to_day)."""
    columns = list(columns)

    def parse(batches):
        for pdf in batches:
            rows = [(s, *r) for s, n in zip(pdf[source], pdf[note]) for r in note_rules(n if isinstance(n, str) else None, columns)]
            yield pd.DataFrame(rows, columns=[source, "field", "unit", "from_day", "to_day"])

    return notes.select(source, note).mapInPandas(parse, f"{source} string, field string, unit string, from_day date, to_day date")


# --- the operator ----------------------------------------------------------------------------------------------------


def annuity_months(amount: Column, yearly_percent: Column, instalment: Column) -> Column:
    """The number of monthly instalments that the annuity identity gives; null where it has no solution."""
    r = yearly_percent / 1200.0
    interest = amount * r
    n = F.when(r > 0, F.ln(instalment / (instalment - interest)) / F.ln(1 + r)).otherwise(amount / instalment)
    return F.when((amount > 0) & (instalment > 0) & (r >= 0) & (instalment > interest), n)


def reconcile_durations(
    rows: DataFrame,
    notes: DataFrame,
    key: str,
    fields: Iterable[str],
    identity: Column,
    source: str = "source_id",
    loaded_at: str = "loaded_at",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per (key, field) that records a duration: its length in months and how the unit was found.

    Columns: key, field, recorded (text), months DOUBLE, months_rounded BIGINT, unit (of the recorded value), basis (text, note, default or
    identity), residual (|ln| against the identity, null without one), row_residual (sum over the row's values, against the first one
    without an identity), solutions (combinations of units for which all values of the row agree), unique (just one does).
    Null, empty and wordless values give no row; repeated rows give a row each; extra columns are ignored; an empty
    table gives an empty result. If the identity contradicts the stated unit and exactly one other unit agrees with it
    within the tolerance, that one is taken; if none or several agree, the stated one is kept.
    """
    fields = list(fields)
    rules = (
        source_rules(notes, fields, source)
        .groupBy(F.col(source).alias("_source"), "field").agg(F.collect_list(F.struct("unit", "from_day", "to_day")).alias("rules"))
        .groupBy("_source").agg(F.map_from_entries(F.collect_list(F.struct("field", "rules"))).alias("_rules"))
    )
    base = rows.select(
        F.col(key), F.col(source).alias("_source"), F.to_date(F.col(loaded_at)).alias("_day"), identity.alias("_n"),
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("recorded")) for f in fields]).alias("_x"),
    ).join(small(rules), "_source", "left")
    n, day = F.col("_n"), F.col("_day")
    parsed = F.transform(F.filter("_x", lambda x: x["recorded"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), x["recorded"].alias("recorded"), parse_duration(x["recorded"]).alias("p")))
    known = base.withColumn("_v", parsed).withColumn("_v", F.filter("_v", lambda x: x["p"]["bare"].isNotNull() | x["p"]["months"].isNotNull())).where(F.size("_v") > 0)

    def told(x: Column) -> Column:
        """A value with its stated unit, where that comes from, and its count of units."""
        fits = F.filter(F.try_element_at("_rules", x["field"]), lambda r: (r["from_day"].isNull() | (day >= r["from_day"])) & (r["to_day"].isNull() | (day <= r["to_day"])))
        stated = F.coalesce(x["p"]["unit"], F.get(fits, F.lit(0))["unit"])
        basis = F.when(x["p"]["unit"].isNotNull(), "text").when(stated.isNotNull(), "note").otherwise("default")
        head = let(F.struct(x.alias("x"), F.coalesce(stated, F.lit("month")).alias("unit"), basis.alias("basis")), lambda y: F.struct(
            y["x"]["field"].alias("field"), y["x"]["recorded"].alias("recorded"), y["unit"].alias("unit"), y["basis"].alias("basis"), y["x"]["p"].alias("p"), _factor(y["unit"]).alias("factor")))
        return let(head, lambda y: F.struct(
            y["field"].alias("field"), y["recorded"].alias("recorded"), y["unit"].alias("unit"), y["basis"].alias("basis"), F.coalesce(y["p"]["months"], y["p"]["bare"] * y["factor"]).alias("months"),
            F.coalesce(y["p"]["bare"], F.when(y["unit"] != "mixed", y["p"]["months"] / y["factor"])).alias("count")))

    per_unit = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(m).alias("m")) for u, m in MONTHS_PER.items()])
    off = lambda a, b: F.abs(F.ln(a / b))

    def placed(v: Column) -> Column:
        """A value in the unit that the identity leaves it: of all units the one with the least residual, if the stated one does not fit and no other does."""
        fitting = F.filter(F.transform(per_unit, lambda u: F.struct(off(v["count"] * u["m"], n).alias("res"), u["unit"].alias("unit"), (v["count"] * u["m"]).alias("months"))), lambda r: r["res"] <= tolerance)
        best = F.when((off(v["months"], n) > tolerance) & (F.size(fitting) == 1), F.get(fitting, F.lit(0)))
        return let(F.struct(v.alias("v"), best.alias("best")), lambda y: F.struct(
            y["v"]["field"].alias("field"), y["v"]["recorded"].alias("recorded"), F.coalesce(y["best"]["months"], y["v"]["months"]).alias("months"), F.coalesce(y["best"]["unit"], y["v"]["unit"]).alias("unit"),
            F.when(y["best"].isNotNull(), F.lit("identity")).otherwise(y["v"]["basis"]).alias("basis"),
            # The lengths that the value may have: with an identity in any unit, without one in the written unit or, if none is written, in any.
            F.when(y["v"]["count"].isNull() | n.isNull() & (y["v"]["basis"] == "text"), F.array(y["v"]["months"])).otherwise(F.transform(per_unit, lambda u: y["v"]["count"] * u["m"])).alias("options"),
        ))

    agreeing = lambda v, length: F.size(F.filter(v["options"], lambda m: off(m, length) <= tolerance))
    ways = lambda length: F.aggregate("_v", F.lit(1), lambda a, v: a * agreeing(v, length))
    # Combinations that solve the row: around the identity, or around each length that its first value may have.
    solutions = F.when(n.isNotNull(), ways(n)).otherwise(F.aggregate(F.get("_v", F.lit(0))["options"], F.lit(0), lambda a, length: a + ways(length)))
    middle = F.coalesce(n, F.get("_v", F.lit(0))["months"])
    row_residual = F.aggregate("_v", F.lit(0.0), lambda a, v: a + off(v["months"], middle))
    solved = known.withColumn("_v", F.transform("_v", told)).withColumn("_v", F.transform("_v", placed)).select(key, "_n", "_v", solutions.alias("_solutions"), row_residual.alias("_row"))
    return solved.select(key, "_n", "_solutions", "_row", F.explode("_v").alias("v")).select(
        key, "v.field", "v.recorded", "v.months", F.floor(F.col("v.months") + 0.5).alias("months_rounded"), "v.unit", "v.basis", off(F.col("v.months"), n).alias("residual"),
        F.col("_row").alias("row_residual"), F.col("_solutions").alias("solutions"), (F.col("_solutions") == 1).alias("unique"),
    )


def converted(reconciled: DataFrame) -> DataFrame:
    """The durations that were not already given in months alone."""
    return reconciled.where(F.col("unit") != "month")
