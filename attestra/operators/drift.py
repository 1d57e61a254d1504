"""Problem 2: schemas that drift between the files of a feed.

Files are compared with the feed's previous present file. Which fields a file has, and of which type, is counted by one
keyed aggregation. Renames are found by similarity flooding: the fields that vanish and the fields that appear at one
file form a pairwise connectivity graph with their types, name parts and nested members; scores flow along its edges to a
fixpoint, and the flooded scores alone decide which consistent correspondences are taken. The flooded graphs hold fields,
not rows, so a group is as large as a schema is wide. What the graph needs of the rows (how often the contents of two
fields agree for the same record) is aggregated by Spark before.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestra.session import checkpointed

#: Share of a node's score that flows in from its neighbours, and flooded score from which a pair is a rename.
FLOW, ACCEPT = 0.3, 0.5
#: Rounds after which flooding is stopped if it has not converged before.
ROUNDS = 50
#: Concepts up to which the unified table has a typed column for each.
COLUMNS = 2000
TYPES = ("array", "boolean", "number", "object", "string")

#: A number with what may be written around it: a currency before, a unit after.
_MEASURE = r"(?i)^(?:rs\.?|inr|₹)?\s*(-?\d[\d,]*(?:\.\d+)?)\s*(?:/-)?\s*(?:%|percent|p\.?a\.?|months?|mths?|years?|yrs?|days?|rupees)?$"


def explode_fields(lines: DataFrame, keep: list[str], payload: str = "payload", record: str = "loan_id", recorded: bool = False) -> DataFrame:
    """One row per top-level field of each JSON line: keep..., _record, field, type (JSON type, null for null), nested and content.

    _record identifies the record within its feed. nested is the schema of an array or object. content is the scalar that a value holds,
    however it is wrapped: a one-element array and an object with a member `value` count as what they hold, 9.0 as 9. Lines that are no
    JSON objects give no rows. recorded: also `text`, the value as it was recorded, arrays and objects whole as JSON.
    """
    spark = lines.sparkSession
    parsed = lines.select(*keep, F.expr(f"try_parse_json({payload})").alias("_v")).where(F.expr("schema_of_variant(_v) LIKE 'OBJECT%'"))
    each = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(
        *keep, F.expr(f"try_variant_get(_v, '$.{record}', 'string')").alias("_record"), F.col("key").alias("field"), F.col("value").alias("_x"), F.expr("schema_of_variant(value)").alias("_s")
    )
    shape = F.col("_s")
    kind = (
        F.when(shape.isNull() | (shape == "VOID"), None)
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    # By the shape first: a value is asked for what it can hold only.
    inner = F.expr(
        "CASE WHEN _s LIKE 'OBJECT%' THEN try_variant_get(_x, '$.value', 'string') "
        "WHEN _s LIKE 'ARRAY%' THEN coalesce(try_variant_get(_x, '$[0].value', 'string'), array_join(try_variant_get(_x, '$', 'array<string>'), ', ')) "
        "WHEN _s <> 'VOID' THEN try_variant_get(_x, '$', 'string') END"
    )
    nested = F.when(shape.startswith("ARRAY") | shape.startswith("OBJECT"), shape)
    text = [F.expr("if(_s LIKE 'ARRAY%' OR _s LIKE 'OBJECT%', to_json(_x), try_variant_get(_x, '$', 'string'))").alias("text")] if recorded else []
    return each.withColumn("_c", F.trim(inner)).select(*keep, "_record", "field", kind.alias("type"), nested.alias("nested"), _canonical(F.col("_c")).alias("content"), *text)


def _canonical(c: Column) -> Column:
    """The content without its notation: 12, 12.0, "12", "12 months", "12%" and "Rs. 12.00/-" are the same content."""
    number = F.regexp_replace(F.regexp_extract(c, _MEASURE, 1), ",", "")
    number = F.when(number.contains("."), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)
    # Most texts are no measures: only what begins and ends as one can is parsed. The longest measure has fewer characters.
    may = (F.length(c) <= 40) & c.rlike(r"^(?:[-0-9]|(?i:rs|inr|₹))") & c.rlike(r"\d")
    return F.when(c == "", None).when(F.lower(c) == "true", "1").when(F.lower(c) == "false", "0").when(may, F.coalesce(F.nullif(number, F.lit("")), c)).otherwise(c)


def file_fields(fields: DataFrame, *keys: str) -> DataFrame:
    """(feed, file_no, field, type, nested): a field is in a file if any line has its key; its type is that of most of its
    non-null values there (ties: the first by name), null if all are null. One aggregation, combined before the shuffle."""
    counts = [F.count_if(F.col("type") == t).alias(f"_{t}") for t in TYPES]
    counted = fields.groupBy("feed", "file_no", "field").agg(*counts, F.max("nested").alias("nested"))
    most = F.array_min(F.array(*[F.when(F.col(f"_{t}") > 0, F.struct((-F.col(f"_{t}")).alias("n"), F.lit(t).alias("type"))) for t in TYPES]))
    return counted.select("feed", "file_no", "field", most["type"].alias("type"), "nested")


def file_order(lines: DataFrame) -> DataFrame:
    """(feed, file_no, prev_no, next_no) of the files that are present; a feed's files are few."""
    files = lines.select("feed", "file_no").where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).distinct()
    w = W.partitionBy("feed").orderBy("file_no")
    return files.withColumn("prev_no", F.lag("file_no").over(w)).withColumn("next_no", F.lead("file_no").over(w))


def transitions(types: DataFrame, order: DataFrame) -> DataFrame:
    """(feed, file_no, prev_no, field, old_type, type, old_nested, nested, then, now): each field before and at each file but a feed's first."""
    known = types.join(order, ["feed", "file_no"])
    none = F.lit(None).cast("string")
    now = known.where(F.col("prev_no").isNotNull()).select(
        "feed", "file_no", "prev_no", "field", none.alias("old_type"), "type", none.alias("old_nested"), "nested", F.lit(False).alias("then"), F.lit(True).alias("now")
    )
    before = known.where(F.col("next_no").isNotNull()).select(
        "feed", F.col("next_no").alias("file_no"), F.col("file_no").alias("prev_no"), "field", F.col("type").alias("old_type"), none.alias("type"), F.col("nested").alias("old_nested"), none.alias("nested"),
        F.lit(True).alias("then"), F.lit(False).alias("now"),
    )
    return now.unionByName(before).groupBy("feed", "file_no", "prev_no", "field").agg(*[F.max(c).alias(c) for c in ("old_type", "type", "old_nested", "nested")], F.bool_or("then").alias("then"), F.bool_or("now").alias("now"))


def _parts(name: str) -> set[str]:
    return {p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if p}


def name_similarity(a: str, b: str) -> float:
    """Of two field names: shared parts and shared letters, whichever is more."""
    x, y = _parts(a), _parts(b)
    shared = len(x & y) / max(1, min(len(x), len(y)))
    return max(0.9 * shared, difflib.SequenceMatcher(None, "".join(sorted(x)), "".join(sorted(y))).ratio())


class Pair(NamedTuple):
    """A vanished and an appeared field: aligned records have both, equal ones with equal contents, of which a share of `chance`
    is expected from the contents' frequencies alone; recoded: the contents differ but map one to one."""

    old: str
    new: str
    old_type: str | None
    new_type: str | None
    old_nested: str | None
    new_nested: str | None
    aligned: int = 0
    equal: int = 0
    chance: float = 0.0
    recoded: bool = False


_MEMBER = re.compile(r"(\w+): ([A-Z]+)")


def flood(pairs: list[Pair]) -> list[tuple[str, str, float]]:
    """Similarity flooding over one file's vanished and appeared fields.

    Nodes are pairs: of fields, of types, of equal name parts, of nested members of one name. A pair of fields is joined to its pair of types, the pairs of its
    name parts and those of its members. Each round a node's score becomes its own start and, by FLOW, the mean of its
    neighbours' scores, which converges. A pair of fields starts from its contents, or from its names where fewer than two records tell.
    Returns consistent correspondences (old, new, score): a stable matching of the flooded scores from ACCEPT on.
    """
    near: dict[tuple, list[tuple]] = {}
    start: dict[tuple, float] = {}

    def join(a: tuple, b: tuple, s: float) -> None:
        start[b] = s
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    for p in pairs:
        node = ("field", p.old, p.new)
        start[node] = _content(p) if p.aligned >= 2 else max(_content(p), name_similarity(p.old, p.new) - (0.0 if p.old_type == p.new_type else 0.1))
        join(node, ("type", p.old_type, p.new_type), 1.0 if p.old_type == p.new_type else 0.3)
        for x in _parts(p.old) & _parts(p.new):
            join(node, ("part", x, x), 1.0)
        old, new = (dict(_MEMBER.findall(n)) if isinstance(n, str) else {} for n in (p.old_nested, p.new_nested))
        for m in old.keys() & new.keys():
            join(node, ("member", m, old[m], new[m]), 1.0 if old[m] == new[m] else 0.5)
    score = dict(start)
    for _ in range(ROUNDS):
        flown = {n: (1 - FLOW) * start[n] + FLOW * sum(score[m] for m in near[n]) / len(near[n]) for n in score}
        change = max((abs(flown[n] - score[n]) for n in flown), default=0.0)
        score = flown
        if change < 1e-4:
            break
    taken_old, taken_new, out = set(), set(), []
    for p in sorted(pairs, key=lambda p: (-score["field", p.old, p.new], p.old, p.new)):
        s = score["field", p.old, p.new]
        if s >= ACCEPT and p.old not in taken_old and p.new not in taken_new:
            taken_old.add(p.old)
            taken_new.add(p.new)
            out.append((p.old, p.new, float(s)))
    return out


def _content(p) -> float:
    """The share of equal contents, less what is equal by chance (a flag agrees in half of all records anyhow)."""
    if not p.aligned:
        return 0.0
    share = p.equal / p.aligned
    alike = max(0.0, share - p.chance) / (1 - p.chance) if p.chance < 1 else share
    return max(alike, 0.8 if p.recoded else 0.0)


def renames(lines: DataFrame, moved: DataFrame, record: str = "loan_id") -> DataFrame:
    """(feed, file_no, old_name, new_name, old_type, new_type, score) of fields whose content goes on under another name.

    moved: the transitions in which a field vanishes or appears. Contents are compared record by record between the two
    files, as 64-bit hashes; records that only one of them has do not count, repeated lines count once.
    """
    key = ["feed", "file_no"]
    gone = F.collect_list(F.when(~F.col("now"), F.struct(F.col("field").alias("old"), "old_type", "old_nested")))
    come = F.collect_list(F.when(~F.col("then"), F.struct(F.col("field").alias("new"), F.col("type").alias("new_type"), F.col("nested").alias("new_nested"))))
    sides = moved.groupBy(*key, "prev_no").agg(gone.alias("gone"), come.alias("come")).where((F.size("gone") > 0) & (F.size("come") > 0))
    # Which file's values of which field are needed: few, so the second reading of the lines keeps little.
    wanted = sides.select(
        "feed", F.col("file_no").alias("at"),
        F.explode(F.concat(F.transform("gone", lambda x: F.struct(F.col("prev_no").alias("file_no"), x["old"].alias("field"), F.lit(True).alias("was"))),
                           F.transform("come", lambda x: F.struct(F.col("file_no").alias("file_no"), x["new"].alias("field"), F.lit(False).alias("was"))))).alias("x"),
    ).select("feed", "at", "x.*")
    # Nulls are left to the aggregation: a filter on the contents would compute them twice.
    hashed = F.when(F.col("content").isNotNull(), F.xxhash64("content"))
    values = explode_fields(lines, key, record=record).select(*key, "field", "_record", hashed.alias("c"))
    # One content per record, file and field; then the vanished and the appeared fields of a record meet.
    single = values.join(wanted, [*key, "field"]).groupBy("feed", "at", "_record", "was", "field").agg(F.min("c").alias("c")).where(F.col("_record").isNotNull() & F.col("c").isNotNull())
    side = lambda was: F.collect_list(F.when(F.col("was") == was, F.struct("field", "c")))
    both = single.groupBy("feed", "at", "_record").agg(side(True).alias("old"), side(False).alias("new")).where((F.size("old") > 0) & (F.size("new") > 0))
    each = both.select("feed", "at", F.explode("old").alias("o"), "new").select("feed", "at", "o", F.explode("new").alias("n"))
    pair = ["feed", "at", "old", "new"]
    ways = each.groupBy("feed", "at", F.col("o.field").alias("old"), F.col("n.field").alias("new"), F.col("o.c").alias("a"), F.col("n.c").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # By chance, as many contents agree as the products of their frequencies on both sides say. A code list in place of
    # another: each old content has one new one and the reverse, and both recur.
    told = F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"), F.col("n").alias("aligned"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("equal"), F.lit(1).alias("ways")),
        F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), F.lit(0).cast("long").alias("aligned"), F.lit(0).cast("long").alias("equal"), F.lit(0).alias("ways")),
    ))
    by_value = ways.select(*pair, told.alias("x")).select(*pair, "x.*").groupBy(*pair, "v").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "aligned", "equal", "ways")])
    agreed = by_value.groupBy(*pair).agg(
        F.sum("aligned").alias("aligned"), F.sum("equal").alias("equal"), F.sum("ways").alias("ways"), F.sum(F.col("na") * F.col("nb")).alias("hits"),
        F.count_if(F.col("na") > 0).alias("olds"), F.count_if(F.col("nb") > 0).alias("news"),
    )
    recoded = (F.col("ways") == F.col("olds")) & (F.col("ways") == F.col("news")) & (F.col("ways") >= 2) & (F.col("aligned") >= 2 * F.col("ways"))
    measured = agreed.groupBy("feed", F.col("at").alias("file_no")).agg(
        F.collect_list(F.struct("old", "new", "aligned", "equal", (F.col("hits") / (F.col("aligned") * F.col("aligned"))).alias("chance"), recoded.alias("recoded"))).alias("measured")
    )
    graphs = sides.join(measured, key, "left").select(*key, "gone", "come", "measured")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for feed, no, old, new, told in zip(pdf["feed"], pdf["file_no"], pdf["gone"], pdf["come"], pdf["measured"]):
                known = {(m["old"], m["new"]): (m["aligned"], m["equal"], m["chance"], m["recoded"]) for m in told} if told is not None else {}
                pairs = [Pair(o["old"], n["new"], o["old_type"], n["new_type"], o["old_nested"], n["new_nested"], *known.get((o["old"], n["new"]), ())) for o in old for n in new]
                types = {(p.old, p.new): (p.old_type, p.new_type) for p in pairs}
                found += [(feed, no, a, b, *types[a, b], s) for a, b, s in flood(pairs)]
            yield pd.DataFrame(found, columns=[*key, "old_name", "new_name", "old_type", "new_type", "score"])

    kind = dict(moved.dtypes)
    return graphs.mapInPandas(run, f"feed {kind['feed']}, file_no {kind['file_no']}, old_name string, new_name string, old_type string, new_type string, score double")


def schema_changes(lines: DataFrame, record: str = "loan_id") -> DataFrame:
    """The report (feed, file_no, field, change, new_name) of all changes between each file and the feed's previous one.

    change: added, removed, renamed or type_changed. A renamed field is not listed as removed and added. type_changed
    carries the later name; a type is only compared where both files have non-null values. Null payloads and lines that are no
    objects are ignored; repeated lines change nothing; an empty table gives an empty report.
    """
    # The lines are read twice, for the types and for the contents of what moved: at scale that is less than keeping all fields.
    steps = transitions(file_fields(explode_fields(lines, ["feed", "file_no"], record=record)), file_order(lines)).persist()
    moves = renames(lines, steps.where(~F.col("then") | ~F.col("now")), record)
    key, none = ["feed", "file_no"], F.lit("")
    item = lambda cond, field, change, new: F.when(cond, F.struct(field.alias("field"), F.lit(change).alias("change"), new.alias("new_name")))
    differ = lambda a, b: F.col(a) != F.col(b)
    # A moved field's row and its rename meet under (file, field); a rename speaks at its old name and silences the new one.
    told = moves.select(*key, F.explode(F.array(
        F.struct(F.col("old_name").alias("field"), F.col("new_name").alias("new_name"), F.coalesce(differ("old_type", "new_type"), F.lit(False)).alias("changed")),
        F.struct(F.col("new_name").alias("field"), F.lit(None).cast("string").alias("new_name"), F.lit(False).alias("changed")),
    )).alias("x")).select(*key, "x.*", F.lit(True).alias("moved"))
    both = steps.join(told, [*key, "field"], "left")
    still = F.col("moved").isNull()
    found = F.array(
        item(still & ~F.col("then"), F.col("field"), "added", none),
        item(still & ~F.col("now"), F.col("field"), "removed", none),
        item(F.col("new_name").isNotNull(), F.col("field"), "renamed", F.col("new_name")),
        item(still & F.col("then") & F.col("now") & differ("old_type", "type"), F.col("field"), "type_changed", none),
        item(F.col("new_name").isNotNull() & F.col("changed"), F.col("new_name"), "type_changed", none),
    )
    return both.select("feed", F.col("file_no").cast("long").alias("file_no"), F.explode(F.array_compact(found)).alias("x")).select("feed", "file_no", "x.*")


#: A number in text that is the same when written as a number.
_PLAIN = r"^-?(0|[1-9]\d*)(\.\d+)?$"


def unified_table(lines: DataFrame, key: str = "raw_id", record: str = "loan_id") -> DataFrame:
    """One row per line: key, feed, file_no, `fields`, a map from one consistent name per concept to the recorded value, and
    `types`, a map from the same names to the common type of the concept.

    Fields that a feed's renames connect are one concept there, named as in all feeds by the name that most files use (ties:
    the first by name). The common type is number, boolean, array or object where all values are of it (plain numbers in
    text are numbers), else string: scalars as they are, arrays and objects as JSON. Of several fields of one concept in a
    line, that of the concept's name or else the most frequent holds it and the others keep their own names. Lines that are
    no objects keep their row with null maps.
    """
    fields = explode_fields(lines, [key, "feed", "file_no"], record=record, recorded=True)
    types = checkpointed(file_fields(fields))
    steps = transitions(types, file_order(lines))
    moves = checkpointed(renames(lines, steps.where(~F.col("then") | ~F.col("now")), record).select("feed", "old_name", "new_name").distinct())
    # Checkpoints, as the plans of the rounds would otherwise carry those of the renames.
    names = checkpointed(concepts(checkpointed(types.groupBy("feed", "field").agg(F.count(F.lit(1)).alias("files"))), moves))
    held = fields.where(F.col("text").isNotNull()).withColumn("feed", F.coalesce("feed", F.lit(""))).join(names, ["feed", "field"])
    first = F.row_number().over(W.partitionBy(key, "concept").orderBy((F.col("field") != F.col("concept")).cast("int"), F.desc("files"), "field")) == 1
    named = held.withColumn("name", F.when(first, F.col("concept")).otherwise(F.col("field")))
    entries = named.groupBy(key, "name").agg(F.min_by(F.struct("type", "text"), "text").alias("v")).select(key, "name", "v.*")
    all_of = lambda c: F.min(c.cast("int")) == 1
    number = (F.col("type") == "number") | (F.col("type") == "string") & F.col("text").rlike(_PLAIN)
    common = entries.groupBy("name").agg(
        F.when(all_of(number), "number").when(F.count_distinct("type") == 1, F.max("type")).otherwise("string").alias("common")
    )
    # A number has one notation: 12.0 is 12.
    value = F.when((F.col("common") == "number") & F.col("text").rlike(r"^-?\d+\.0+$"), F.regexp_replace("text", r"\.0+$", "")).otherwise(F.col("text"))
    sorted_map = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", v.alias("v")))))
    maps = entries.join(common, "name").groupBy(key).agg(sorted_map(value).alias("fields"), sorted_map(F.col("common")).alias("types"))
    return lines.select(key, "feed", "file_no").join(maps, key, "left")


def typed_table(lines: DataFrame, key: str = "raw_id", record: str = "loan_id") -> DataFrame:
    """One row per line: key, feed, file_no and a column per concept, cast to its common type.

    number is DOUBLE, boolean BOOLEAN, array ARRAY<STRING>, object MAP<STRING, STRING>, all else STRING. Columns whose names differ
    in case only, or clash with key, feed or file_no, get a number. More than COLUMNS concepts stay in the maps of unified_table.
    """
    unified = checkpointed(unified_table(lines, key, record))
    kinds = unified.select(F.explode("types").alias("name", "type")).distinct().orderBy("name").limit(COLUMNS + 1).collect()
    if len(kinds) > COLUMNS:
        return unified
    cast = {
        "number": lambda c: c.try_cast("double"), "boolean": lambda c: c.try_cast("boolean"), "string": lambda c: c,
        "array": lambda c: F.from_json(c, "array<string>"), "object": lambda c: F.from_json(c, "map<string,string>"),
    }
    taken, columns = {key.lower(), "feed", "file_no"}, []
    for r in kinds:
        name, n = r["name"], 1
        while name.lower() in taken:
            n += 1
            name = f"{r['name']}_{n}"
        taken.add(name.lower())
        columns.append(cast[r["type"]](F.try_element_at("fields", F.lit(r["name"]))).alias(name))
    return unified.select(key, "feed", "file_no", *columns)


def concepts(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(feed, field, files, concept). names: feed, field, files; edges: feed, old_name, new_name. A null feed counts as ''.

    Fields are one concept in a feed if its own renames connect them. All feeds' renames together give each concept its
    name, but where they connect what stands apart in a feed, it stays apart there under its own names.
    """
    feed = F.coalesce("feed", F.lit("")).alias("feed")
    names = names.select(feed, "field", "files").groupBy("feed", "field").agg(F.sum("files").alias("files"))
    total = names.groupBy("field").agg(F.sum("files").alias("rank"))
    nodes = names.join(total, "field")
    local = components(nodes.select("feed", "field", "rank"), edges).withColumnRenamed("concept", "_own")
    overall = components(total.select(F.lit("").alias("feed"), "field", "rank"), edges.withColumn("feed", F.lit(""))).select("field", F.col("concept").alias("_all"))
    both = local.join(overall, "field").join(names, ["feed", "field"])
    alone = F.size(F.collect_set("_own").over(W.partitionBy("feed", "_all"))) == 1
    return both.select("feed", "field", "files", F.when(alone, F.col("_all")).otherwise(F.col("_own")).alias("concept"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feed, field, concept) by the connected components of each feed's names (feed, field, rank) under its renames.

    The graph has a node per distinct field name of a feed, so its size is that of the vocabulary; the best label is
    spread by joins, one checkpoint a round, until nothing changes.
    """
    links = edges.select("feed", F.col("old_name").alias("a"), F.col("new_name").alias("b"))
    links = checkpointed(links.unionByName(links.select("feed", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(nodes.select("feed", "field", F.struct((-F.col("rank")).alias("rank"), F.col("field").alias("concept")).alias("best")))
    while True:
        near = links.join(label.withColumnRenamed("field", "b"), ["feed", "b"]).select("feed", F.col("a").alias("field"), "best")
        spread_on = checkpointed(label.unionByName(near).groupBy("feed", "field").agg(F.min("best").alias("best")))
        moved = spread_on.join(label.withColumnRenamed("best", "was"), ["feed", "field"]).where(F.col("best") != F.col("was")).limit(1).count()
        label = spread_on
        if not moved:
            return label.select("feed", "field", F.col("best.concept").alias("concept"))
