"""Queries of the form- and table-level operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import similarity as sim
from attestra.functions import textquality as quality
from attestra.operators import forms, layout, records
from attestra.plans.catalogue import GRID, LATEST_FIELDS, TOKENS, add, pages_of, tokens_and_cells
from attestra.plans.texts import DEFINITE, FORM_LABEL, LINES, NOISY, lines
from attestra.session import table


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- character boxes --------------------------------------------------------------------------------------------------

_BOXED = "('pan_number', 'aadhaar_number', 'mobile_no', 'account_no')"


def boxed_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of numbers, written on a page per document: a character a box, a line a field."""
    f = records.latest_fields(table(spark, d, "doc_fields")).where(F.col("field").isin("pan_number", "aadhaar_number", "mobile_no", "account_no") & F.col("value").rlike("^[A-Za-z0-9 -]{3,}$"))
    line = F.element_at(F.create_map(F.lit("pan_number"), F.lit(0), F.lit("aadhaar_number"), F.lit(1), F.lit("mobile_no"), F.lit(2), F.lit("account_no"), F.lit(3)), F.col("field"))
    chars = f.select("loan_id", "doc_key", line.alias("line"), F.posexplode(F.split(F.trim("value"), "")).alias("pos", "word")).where("word NOT IN ('', ' ')")
    x, y = 0.05 + F.col("pos") * 0.022, 0.1 + F.col("line") * 0.05
    return chars.select("loan_id", "doc_key", (F.col("line") * 100 + F.col("pos")).alias("ord"), "word", x.alias("l"), y.alias("t"), (x + 0.012).alias("r"), (y + 0.02).alias("b"))


@add(
    f"SELECT loan_id, doc_key, text, CAST(len(cells) AS INTEGER) AS n, 1.0::DOUBLE AS score, len(cells) >= 4 AND list_aggregate(steps, 'stddev_pop') / list_avg(steps) <= 0.28 AS clean FROM (SELECT *, list_transform(range(1, len(cells)), lambda i: cells[i + 1] - cells[i]) AS steps FROM ("
    f"SELECT loan_id, doc_key, regexp_replace(trim(value), ' +', ' ', 'g') AS text, list_filter(range(1, length(trim(value)) + 1), lambda i: substr(trim(value), i, 1) <> ' ') AS cells FROM {LATEST_FIELDS} WHERE field IN {_BOXED} AND regexp_matches(value, '^[A-Za-z0-9 -]{{3,}}$'))) WHERE len(cells) >= 2"
)
def win_comb_boxes(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02 to WIN-07, WIN-18, SIM-19: values read back from character boxes; the SQL are the values themselves, and the evenness of their steps."""
    found = forms.comb_boxes(boxed_values(spark, d), "loan_id", "doc_key")
    return found.withColumn("score", F.round("score", 6)).select("loan_id", "doc_key", "text", "n", "score", "clean")


# --- logical tables ---------------------------------------------------------------------------------------------------

_C = "list_filter(list_transform(string_split(s, ','), lambda v: trim(v)), lambda v: v <> '')"
_LEAD = f"(regexp_matches(c[1], '{forms.INDEX}') OR lower(c[1]) IN ({_quoted(forms.INDEXES)}))"
_HEADER = (
    f"(len(c) >= 2 AND len(list_filter(c, lambda v: regexp_matches(v, '{forms.NUMBER}') OR lower(v) IN ({_quoted(forms.VALUES)}))) = 0 AND (len(c) <> 2 OR lower(c[1]) IN ({_quoted(forms.TWO_LEFT)}) AND lower(c[2]) IN ({_quoted(forms.TWO_RIGHT)})) "
    f"AND len(list_filter(c, lambda v: {' OR '.join(f'''contains(lower(v), '{h}')''' for h in forms.HEADINGS)})) > 0)"
)
KINDS = (
    f"(SELECT extraction_id, line AS row, c AS cells, CASE WHEN len(c) = 1 AND length(c[1]) > 2 AND NOT regexp_matches(c[1], '^[0-9]+$') THEN 'title' WHEN starts_with(upper(c[1]), 'TOTAL') THEN 'total' WHEN {_HEADER} THEN 'header' "
    f"WHEN len(c) - CASE WHEN {_LEAD} THEN 1 ELSE 0 END >= 2 THEN 'pairs' ELSE 'data' END AS kind FROM (SELECT extraction_id, line, {_C} AS c FROM {LINES}) WHERE len(c) > 0)"
)
SEGMENTS = (
    f"(SELECT *, CASE WHEN kind = 'title' THEN NULL WHEN coalesce(bool_or(opens) OVER w, false) THEN 'table' WHEN kind = 'pairs' THEN 'pairs' END AS block, last_value(CASE WHEN kind = 'header' THEN cells END IGNORE NULLS) OVER w AS headings FROM ("
    f"SELECT *, kind = 'header' OR kind = 'data' AND len(cells) >= 2 AND count(*) FILTER (kind = 'pairs') OVER (PARTITION BY extraction_id, section ORDER BY row ROWS UNBOUNDED PRECEDING) = 0 AS opens FROM ("
    f"SELECT *, count(*) FILTER (kind = 'title') OVER v AS section, last_value(CASE WHEN kind = 'title' THEN cells[1] END IGNORE NULLS) OVER v AS title FROM {KINDS} WINDOW v AS (PARTITION BY extraction_id ORDER BY row ROWS UNBOUNDED PRECEDING))) "
    f"WINDOW w AS (PARTITION BY extraction_id, section ORDER BY row ROWS UNBOUNDED PRECEDING))"
)
BLOCKS = (
    f"(SELECT extraction_id, section, title, block, min(row) AS first_row, max(row) AS last_row, count(*) FILTER (kind NOT IN ('header', 'total')) AS n_rows, count(*) FILTER (kind = 'total') AS n_totals, CAST(coalesce(max(len(headings)), 0) AS INTEGER) AS n_headings, "
    f"CAST(coalesce(max(len(list_filter(headings, lambda h: regexp_matches(h, '^[0-9]{{4,}}$')))), 0) AS INTEGER) AS suspicious FROM {SEGMENTS} WHERE block IS NOT NULL GROUP BY extraction_id, section, title, block)"
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("extraction_id", F.col("line").alias("row"), F.split("s", ",").alias("cells"))
    return forms.segmented(forms.row_kinds(rows), "extraction_id")


@add(f"SELECT extraction_id, row, kind, array_to_string(cells, '|') AS cells FROM {KINDS}")
def win_row_kinds(spark: SparkSession, d: str) -> DataFrame:
    """SIM-18, WIN-13: what each row of a table is."""
    rows = lines(spark, d).select("extraction_id", F.col("line").alias("row"), F.split("s", ",").alias("cells"))
    return forms.row_kinds(rows).select("extraction_id", "row", "kind", F.array_join("cells", "|").alias("cells"))


@add(f"SELECT * FROM {BLOCKS}")
def win_segments(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12, WIN-15, WIN-16: logical blocks of tables, with their warnings."""
    return forms.blocks(_segments(spark, d), "extraction_id")


@add(
    f"SELECT extraction_id, grp, arg_min(title, first_row) AS title, any_value(block) AS block, count(*) AS n_blocks, CAST(sum(n_rows) AS BIGINT) AS n_rows, min(first_row) AS first_row, max(last_row) AS last_row FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY extraction_id ORDER BY first_row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM "
    f"(SELECT *, CASE WHEN coalesce(lag(block) OVER w = block AND lower(trim(lag(title) OVER w)) = lower(trim(title)) AND trim(title) <> '', false) THEN 0 ELSE 1 END AS nw FROM {BLOCKS} WINDOW w AS (PARTITION BY extraction_id ORDER BY first_row))) GROUP BY extraction_id, grp"
)
def win_continued(spark: SparkSession, d: str) -> DataFrame:
    """WIN-14: blocks of one kind and title that follow each other, merged."""
    return forms.continued(forms.blocks(_segments(spark, d), "extraction_id"), "extraction_id")


_REST = f"(CASE WHEN {_LEAD.replace('c[1]', 'cells[1]')} THEN cells[2:] ELSE cells END)"
_PADDED = "CASE WHEN len(headings) > 0 THEN list_resize(cells, len(headings), '') ELSE cells END"


@add(
    f"SELECT extraction_id, section, block, concat_ws(chr(10), CASE WHEN title IS NOT NULL THEN '### ' || title END, '[TABLE]', CASE WHEN block = 'pairs' THEN 'Field | Value' ELSE head END, nullif(body, ''), '[/TABLE]') AS text FROM ("
    f"SELECT extraction_id, section, title, block, arg_max(array_to_string(cells, ' | '), row) FILTER (kind = 'header') AS head, coalesce(string_agg(line, chr(10) ORDER BY kind = 'total', row), '') AS body FROM (SELECT *, CASE WHEN kind = 'header' THEN NULL WHEN kind = 'total' THEN array_to_string(cells, ' | ') "
    f"WHEN block = 'table' THEN array_to_string({_PADDED}, ' | ') ELSE array_to_string(list_transform(range(0, len({_REST}) // 2), lambda i: {_REST}[2 * i + 1] || ' | ' || {_REST}[2 * i + 2]), chr(10)) END AS line FROM {SEGMENTS} WHERE block IS NOT NULL) GROUP BY extraction_id, section, title, block)"
)
def snk_block_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK-09, AGG-20: logical blocks as text."""
    return forms.block_text(_segments(spark, d), "extraction_id")


# --- where fields stand -----------------------------------------------------------------------------------------------

_CONF = "(0.80 + 0.01 * (length(word) % 15))"
_TOK = f"(SELECT *, CAST({_CONF} AS DOUBLE) AS confidence FROM {TOKENS})"


def _sure(spark: SparkSession, d: str) -> DataFrame:
    return pages_of(spark, d).withColumn("confidence", 0.80 + 0.01 * (F.length("word") % 15))


_SLIDE = "OVER (PARTITION BY extraction_id, page ORDER BY t, l, ord ROWS BETWEEN CURRENT ROW AND {n} FOLLOWING)"
_WINS = " UNION ALL ".join(
    f"SELECT extraction_id, page, pos, {k} AS k, array_to_string(ws, ' ') AS text, c / {k} AS confidence FROM (SELECT extraction_id, page, row_number() OVER (PARTITION BY extraction_id, page ORDER BY t, l, ord) AS pos, list(word) {w} AS ws, list_sum(list(confidence) {w}) AS c, list(t) {w} AS ts, list(b) {w} AS bs FROM {_TOK}) "
    f"WHERE len(ws) = {k} AND (len(list_filter(range(1, {k}), lambda i: abs(ts[i + 1] - ts[1]) > 0.035)) = 0 OR len(list_filter(range(1, {k}), lambda i: ts[i + 1] - bs[i] > 0.06)) = 0)"
    for k, w in ((k, _SLIDE.format(n=k - 1)) for k in range(1, 8))
)
_NUM = "regexp_extract(regexp_replace({x}, '[₹$€£,]', '', 'g'), '([0-9]+(?:\\.[0-9]+)?)', 1)"
_CUT = "regexp_replace(regexp_replace({x}, '\\.00$', ''), '\\.0$', '')"
_FIELDS_OF = f"(SELECT e.extraction_id, f.field, f.value FROM (SELECT extraction_id, loan_id, doc_key FROM extractions WHERE loan_id IS NOT NULL AND _formatted_text IS NOT NULL) e JOIN {LATEST_FIELDS} f USING (loan_id, doc_key) WHERE f.value IS NOT NULL AND f.kind <> 'bool')"
_TARGETS = (
    f"(SELECT extraction_id, field, lower(v) AS low, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS alnum, {_CUT.format(x=_NUM.format(x='v'))} AS num, CASE WHEN regexp_matches(v, '[/.-]') THEN regexp_replace(v, '[/.\\s-]', '', 'g') ELSE '' END AS dat "
    f"FROM (SELECT extraction_id, field, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v FROM {_FIELDS_OF}) WHERE v <> '')"
)
_SEEN = f"(SELECT *, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS alnum, {_CUT.format(x=_NUM.format(x='text'))} AS num, CASE WHEN k = 1 THEN regexp_replace(text, '[/.\\s-]', '', 'g') ELSE '' END AS dat FROM ({_WINS}))"
_WAY = "CASE WHEN a.low = w.low THEN 0 WHEN a.alnum <> '' AND a.alnum = w.alnum THEN 1 WHEN a.num <> '' AND a.num = w.num THEN 2 WHEN w.k = 1 AND a.dat <> '' AND a.dat = w.dat THEN 3 WHEN w.k = 1 AND length(a.alnum) >= 5 AND contains(w.alnum, a.alnum) THEN 4 WHEN w.k > 1 AND length(a.alnum) >= 8 AND length(w.alnum) > 0 AND (contains(w.alnum, a.alnum) OR contains(a.alnum, w.alnum)) AND least(length(a.alnum), length(w.alnum)) / greatest(length(a.alnum), length(w.alnum)) >= 0.70 THEN 5 END"


def _located_sql(most: int) -> str:
    return (
        f"SELECT extraction_id, field, CAST(place AS INTEGER) AS place, page, CAST(pos AS INTEGER) AS pos, k, text, round(score, 6) AS score, strategy FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id, field ORDER BY round(score * 0.7 + confidence * 0.2 + CASE WHEN page = 1 THEN 0.05 ELSE 0.0 END, 9) DESC, page, k, pos) AS place FROM ("
        f"SELECT extraction_id, field, page, pos, k, text, confidence, CAST(CASE way WHEN 4 THEN 0.85 + 0.10 * ratio WHEN 5 THEN round(0.82 + 0.12 * over, 3) ELSE CASE WHEN k = 1 THEN [1.0, 0.98, 0.95, 0.95][way + 1] ELSE [0.97, 0.95, 0.93, 0.0][way + 1] END END AS DOUBLE) AS score, "
        f"['exact', 'alphanumeric', 'numeric', 'date', 'containment', 'containment'][way + 1] AS strategy FROM (SELECT a.extraction_id, a.field, w.page, w.pos, w.k, w.text, w.confidence, {_WAY} AS way, length(a.alnum) / length(w.alnum) AS ratio, least(length(a.alnum), length(w.alnum)) / greatest(length(a.alnum), length(w.alnum)) AS over "
        f"FROM {_TARGETS} a JOIN {_SEEN} w USING (extraction_id)) WHERE way IS NOT NULL)) WHERE place <= {most}"
    )


def _fields_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extractions").where("loan_id IS NOT NULL AND _formatted_text IS NOT NULL").select("extraction_id", "loan_id", "doc_key")
    f = records.latest_fields(table(spark, d, "doc_fields")).where("value IS NOT NULL AND kind <> 'bool'")
    # Its three columns look small beside the text; there are as many rows as documents, so they are not sent through the driver.
    return f.join(e.hint("merge"), ["loan_id", "doc_key"]).select("extraction_id", "field", "value")


@add(_located_sql(5))
def win_located(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08 to WIN-11, SRT-07, SIM-17, JN-19: the five best places of each field's value in its document."""
    found = forms.located(_fields_of(spark, d), _sure(spark, d), "extraction_id")
    return found.withColumn("score", F.round("score", 6))


@add(
    f"SELECT extraction_id, field, page, anchor, ord, word FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id, field, page, anchor ORDER BY dist, ord) AS rn FROM (SELECT a.extraction_id, a.field, a.page, a.anchor, n.ord, n.word, round(sqrt((n.l - a.r) * (n.l - a.r) + (n.t - a.t) * (n.t - a.t)), 9) AS dist "
    f"FROM (SELECT DISTINCT t.extraction_id, f.field, t.page, t.ord AS anchor, t.l, t.t, t.r, t.b FROM {TOKENS} t JOIN (SELECT DISTINCT extraction_id, field, unnest(list_filter(string_split(lower(field), '_'), lambda w: length(w) >= 3)) AS part FROM {_FIELDS_OF}) f ON f.extraction_id = t.extraction_id AND contains(lower(t.word), f.part)) a "
    f"JOIN {TOKENS} n ON n.extraction_id = a.extraction_id AND n.page = a.page AND n.ord <> a.anchor WHERE n.l >= a.l AND abs(n.t - a.t) <= 0.04 OR n.t >= a.b AND n.t - a.b <= 0.08 AND abs(n.l - a.l) <= 0.20)) WHERE rn = 1"
)
def jn_anchor(spark: SparkSession, d: str) -> DataFrame:
    """JN-14: the nearest token right of or below one that names a field."""
    return forms.beside_anchor(pages_of(spark, d), _fields_of(spark, d), "extraction_id")


# --- regions, classes, checkboxes, whole texts ------------------------------------------------------------------------

_CELL_TEXT = f"(SELECT extraction_id, page, CAST(cell % 2 AS INTEGER) AS region, string_agg(word, ' ' ORDER BY ord) AS text FROM {TOKENS} JOIN {GRID} USING (extraction_id, page) WHERE cell % 4 < 2 AND (l + r) / 2 BETWEEN cl AND cr AND (t + b) / 2 BETWEEN ct AND cb GROUP BY extraction_id, page, cell)"
_REGIONS = f"(SELECT DISTINCT extraction_id, page, x AS region, x * 0.25 AS cl, 0.0 AS ct, x * 0.25 + 0.25 AS cr, 0.75 AS cb FROM {TOKENS}, range(0, 2) g(x))"
_GAP = "(cr - cl) * 0.02"
_IN = (
    f"((l + r) / 2 BETWEEN cl AND cr AND (t + b) / 2 BETWEEN ct AND cb OR l >= cl - {_GAP} AND t >= ct - (cb - ct) * 0.02 AND r <= cr + {_GAP} AND b <= cb + (cb - ct) * 0.02 OR CASE WHEN (r - l) * (b - t) > 0 THEN greatest(0.0, least(r, cr) - greatest(l, cl)) * greatest(0.0, least(b, cb) - greatest(t, ct)) / ((r - l) * (b - t)) ELSE 0.0 END >= 0.40)"
)
_HIT = "CASE WHEN length(w) < 4 OR length(x) < 4 THEN w = x ELSE contains(x, w) OR contains(w, x) END"


@add(
    f"SELECT t.extraction_id, t.page, t.ord, CASE WHEN j.ord IS NULL THEN 'outside' WHEN j.cells AND NOT j.hit THEN 'kept' ELSE 'captured' END AS fate FROM {TOKENS} t LEFT JOIN (SELECT extraction_id, page, ord, bool_or(x IS NOT NULL) AS cells, bool_or(coalesce({_HIT}, false)) AS hit FROM (SELECT f.extraction_id, f.page, f.ord, lower(f.word) AS w, lower(c.text) AS x FROM "
    f"(SELECT extraction_id, page, ord, word, min(region) AS region FROM {TOKENS} JOIN {_REGIONS} USING (extraction_id, page) WHERE {_IN} GROUP BY extraction_id, page, ord, word) f LEFT JOIN {_CELL_TEXT} c USING (extraction_id, page, region)) GROUP BY extraction_id, page, ord) j USING (extraction_id, page, ord)"
)
def jn_region_gate(spark: SparkSession, d: str) -> DataFrame:
    """JN-11, AGG-19: tokens outside of table regions, captured by a cell of one, or kept as no cell has them."""
    t, g = tokens_and_cells(spark, d)
    texts = layout.fuse_cells(t, g.where("cell % 4 < 2"), "extraction_id", 2.0).select("extraction_id", "page", (F.col("cell") % 2).cast("int").alias("region"), "text")
    x = F.col("region")
    regions = t.select("extraction_id", "page").distinct().select("extraction_id", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("region")).select("extraction_id", "page", "region", (x * 0.25).alias("cl"), F.lit(0.0).alias("ct"), (x * 0.25 + 0.25).alias("cr"), F.lit(0.75).alias("cb"))
    return forms.region_gate(t, regions, texts, "extraction_id", "page").select("extraction_id", "page", "ord", "fate")


_OPTS = ", ".join(f"('{g}', '{forms.MEANT.get(o, o.replace(' ', '_'))}', '{forms.option_pattern(o)}', {i})" for i, (g, o) in enumerate((g, o) for g, os in forms.OPTIONS.items() for o in os))
_DOC_LINES = "(SELECT doc_id, i AS line, a[i] AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)))"


@add(
    f"SELECT doc_id, grp, option, checked FROM (SELECT doc_id, grp, option, {' OR '.join(f'''contains(t, '{m}')''' for m in forms.CHECKED)} AS checked, row_number() OVER (PARTITION BY doc_id, grp, option ORDER BY line DESC, i DESC) AS rn FROM "
    f"(SELECT doc_id, line, lower(trim(s)) AS t FROM {_DOC_LINES} WHERE NOT contains(trim(s), ':')) JOIN (VALUES {_OPTS}) o(grp, option, pattern, i) ON regexp_matches(t, o.pattern)) WHERE rn = 1"
)
def win_checkboxes(spark: SparkSession, d: str) -> DataFrame:
    """WIN-20: the options that lines of documents name, and whether they are checked."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return forms.checkboxes(docs, "doc_id", "line", "s")


_OPTION_WORDS = "|".join(o.replace("-", r"\-") for os in forms.OPTIONS.values() for o in os)


@add(
    f"SELECT extraction_id, line, CASE WHEN conf < 0.50 OR gib THEN 'noise' WHEN bare IN ({_quoted(sim.SECTION_HEADERS)}) THEN 'section_header' WHEN {' OR '.join(f'''contains(bare, '{b}')''' for b in sim.BRANDING_KEYWORDS)} THEN 'branding' WHEN bottom < 0.16 AND (contains(bare, 'bank') OR contains(bare, 'services') OR contains(bare, 'financial')) THEN 'branding' "
    f"WHEN regexp_matches(bare, '(?i)\\b({_OPTION_WORDS})\\b') THEN 'checkbox_label' WHEN contains(t, ':') OR contains(t, '=') THEN 'label' WHEN {DEFINITE} THEN 'value' WHEN {FORM_LABEL} THEN 'label' ELSE 'paragraph' END AS class FROM ("
    f"SELECT extraction_id, line, trim(s) AS t, trim(regexp_replace(lower(trim(s)), '[^\\p{{L}}\\p{{N}}_\\s/]', '', 'g')) AS bare, (line % 40) * 0.025 + 0.02 AS bottom, CASE WHEN line % 10 = 9 THEN 0.4 ELSE 0.9 END AS conf, "
    f"length(trim(s)) > 40 AND NOT contains(trim(s), ' ') OR length(regexp_replace(trim(s), '[^\\p{{L}}]', '', 'g')) > 20 AND length(regexp_replace(lower(trim(s)), '[^aeiou]', '', 'g')) / length(regexp_replace(trim(s), '[^\\p{{L}}]', '', 'g')) < 0.15 AS gib FROM {LINES} WHERE trim(s) <> '')"
)
def win_classes(spark: SparkSession, d: str) -> DataFrame:
    """WIN-19: what each line of a form is."""
    ls = lines(spark, d).where(F.trim("s") != "")
    bottom, conf = (F.col("line") % 40) * 0.025 + 0.02, F.when(F.col("line") % 10 == 9, 0.4).otherwise(0.9)
    return ls.select("extraction_id", "line", forms.element_class(F.col("s"), bottom, conf).alias("class"))


@add(
    f"SELECT extraction_id, string_agg('--- PAGE ' || page || ' ---' || chr(10) || body, chr(10) ORDER BY page) AS text FROM (SELECT extraction_id, line // 40 + 1 AS page, string_agg(x, chr(10) ORDER BY round((line % 40) * 0.025, 2), line) AS body FROM (SELECT extraction_id, line, x, {NOISY} AS noisy FROM (SELECT extraction_id, line, trim(s) AS x FROM {LINES})) WHERE x <> '' AND NOT noisy GROUP BY extraction_id, line // 40) GROUP BY extraction_id"
)
def snk_full_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10, FLT-11, SRT-06: the text of a document by pages, without noise, in reading order."""
    ls = lines(spark, d).select("extraction_id", "line", F.trim("s").alias("x")).where((F.col("x") != "") & ~quality.noisy(F.col("x")))
    top = F.round((F.col("line") % 40) * 0.025, 2)
    page = (F.floor(F.col("line") / 40) + 1).alias("page")
    joined = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda v: v["x"]), "\n")
    pages = ls.groupBy("extraction_id", page).agg(joined(F.struct(top.alias("top"), "line", "x")).alias("body"))
    head = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), "body")
    return pages.groupBy("extraction_id").agg(joined(F.struct("page", head.alias("x"))).alias("text"))


# --- containers, pairs of labels and values, flat fields --------------------------------------------------------------

_ELEMENTS = (
    f"(SELECT extraction_id, line // 40 AS page, line AS ord, trim(s) AS x, CASE line % 6 WHEN 0 THEN 'Text Block' WHEN 1 THEN 'Figure' ELSE 'paragraph' END AS label, CASE WHEN line % 4 = 0 THEN 'layout' ELSE 'rapidocr' END AS source, 0.05::DOUBLE AS l, ((line % 40) * 0.025)::DOUBLE AS t, "
    f"(0.05 + CASE WHEN line % 9 = 5 THEN 0.9 ELSE least(length(trim(s)) * 0.008, 0.9) END)::DOUBLE AS r, ((line % 40) * 0.025 + CASE WHEN line % 9 = 5 THEN 0.12 ELSE 0.02 END)::DOUBLE AS b FROM {LINES})"
)
_W, _H = "abs(r - l)", "abs(b - t)"
_UP = sorted({x.upper() for x in forms.REGION_LABELS})
_CONTAINER = (
    f"(NOT ({_W} <= 1e-4 OR {_H} <= 1e-4) AND (x = '' OR upper(x) IN ({_quoted(_UP)}) OR label <> '' AND x = label) OR x <> '' AND ({_H} > 0.1 AND {_W} > length(x) * {_H} * 0.45 * 3.0 OR {_H} > 0 AND {_W} / {_H} > 15 AND length(x) / {_H} < 0.5) "
    f"OR label <> '' AND ({' OR '.join(f'''contains(upper(label), '{u}') OR contains('{u}', upper(label))''' for u in _UP)}) AND source NOT IN ('rapidocr', 'ocr', 'docling_ocr'))"
)


def _elements(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("line")
    x = F.trim("s")
    kind = F.when(n % 6 == 0, "Text Block").when(n % 6 == 1, "Figure").otherwise("paragraph")
    top = (n % 40) * 0.025
    return lines(spark, d).select(
        "extraction_id", F.floor(n / 40).cast("int").alias("page"), n.alias("ord"), x.alias("x"), kind.alias("label"), F.when(n % 4 == 0, "layout").otherwise("rapidocr").alias("source"), F.lit(0.05).alias("l"), top.alias("t"),
        (F.lit(0.05) + F.when(n % 9 == 5, 0.9).otherwise(F.least(F.length(x) * 0.008, F.lit(0.9)))).alias("r"), (top + F.when(n % 9 == 5, 0.12).otherwise(0.02)).alias("b"),
    )


@add(f"SELECT extraction_id, ord, {_CONTAINER} AS container FROM {_ELEMENTS}")
def geo_containers(spark: SparkSession, d: str) -> DataFrame:
    """GEO-09: elements that are regions of the layout rather than texts."""
    e = _elements(spark, d)
    return e.select("extraction_id", "ord", forms.is_container(F.col("x"), F.col("label"), F.col("source"), tuple(F.col(c) for c in "ltrb")).alias("container"))


@add(
    f"WITH e AS (SELECT *, {_CONTAINER} AS container FROM {_ELEMENTS}) SELECT c.extraction_id, c.page, c.ord, count(x.ord) AS n, round(coalesce(min(x.l), any_value(c.l)), 6) AS l, round(coalesce(min(x.t), any_value(c.t)), 6) AS t, round(coalesce(max(x.r), any_value(c.r)), 6) AS r, round(coalesce(max(x.b), any_value(c.b)), 6) AS b FROM (SELECT * FROM e WHERE container AND abs(b - t) > 0) c "
    f"LEFT JOIN (SELECT * FROM e WHERE NOT container AND NOT (r - l <= 1e-4 OR b - t <= 1e-4)) x ON x.extraction_id = c.extraction_id AND x.page = c.page AND x.l >= c.l - abs(c.b - c.t) * 0.6 AND x.r <= c.r + abs(c.b - c.t) * 0.6 AND x.t >= c.t - abs(c.b - c.t) * 0.6 AND x.b <= c.b + abs(c.b - c.t) * 0.6 GROUP BY c.extraction_id, c.page, c.ord"
)
def agg_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22: the boxes of layout regions from the texts within them."""
    e = _elements(spark, d)
    marked = e.withColumn("container", forms.is_container(F.col("x"), F.col("label"), F.col("source"), tuple(F.col(c) for c in "ltrb")))
    return forms.boxes_from_neighbours(marked, "extraction_id", "page").select("extraction_id", "page", "ord", "n", *[F.round(c, 6).alias(c) for c in "ltrb"])


@add()
def jn_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-13, WIN-21: labels with their values by place and sense, each value once; parts of lines as elements. See the tests for a plain loop."""
    parts = lines(spark, d).select("extraction_id", "line", F.posexplode(F.split("s", "[:;,]")).alias("pos", "c")).withColumn("x", F.trim("c")).where("x <> ''")
    top = (F.col("line") % 40) * 0.025
    e = parts.select(
        "extraction_id", F.floor(F.col("line") / 40).cast("int").alias("page"), (F.col("line") * 100 + F.col("pos")).alias("ord"), F.col("x").alias("text"), forms.element_class(F.col("x"), F.lit(1.0), F.lit(0.9)).alias("class"), F.lit(0.9).alias("confidence"),
        (F.col("pos") * 0.2).alias("l"), top.alias("t"), (F.col("pos") * 0.2 + F.least(F.length("x") * 0.008, F.lit(0.19))).alias("r"), (top + 0.02).alias("b"),
    )
    return forms.label_values(e, "extraction_id", "page")


@add(
    f"SELECT extraction_id, name, value, kind FROM (SELECT e.extraction_id, array_to_string(list_transform(string_split(replace(f.field, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name, f.value, 'template' AS kind FROM (SELECT extraction_id, loan_id, doc_key FROM extractions WHERE loan_id IS NOT NULL) e JOIN {LATEST_FIELDS} f USING (loan_id, doc_key) WHERE f.value IS NOT NULL "
    f"UNION ALL SELECT extraction_id, CASE WHEN p > 0 AND trim(substr(x, 1, p - 1)) <> '' AND trim(substr(x, p + 1)) <> '' THEN trim(substr(x, 1, p - 1)) ELSE 'Text Block' END, CASE WHEN p > 0 AND trim(substr(x, 1, p - 1)) <> '' AND trim(substr(x, p + 1)) <> '' THEN trim(substr(x, p + 1)) ELSE x END, 'element' "
    f"FROM (SELECT extraction_id, trim(s) AS x, CASE WHEN instr(trim(s), ':') > 0 THEN instr(trim(s), ':') ELSE instr(trim(s), '=') END AS p FROM {LINES} WHERE trim(s) <> ''))"
)
def flt_flat_fields(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, UDTF-02: template fields and elements of a document as uniform rows."""
    e = table(spark, d, "extractions").where("loan_id IS NOT NULL").select("extraction_id", "loan_id", "doc_key")
    f = records.latest_fields(table(spark, d, "doc_fields")).where("value IS NOT NULL")
    named = e.join(f, ["loan_id", "doc_key"]).select("extraction_id", F.initcap(F.replace("field", F.lit("_"), F.lit(" "))).alias("name"), "value", F.lit("template").alias("kind"))
    x = F.trim("s")
    p = F.when(F.instr(x, ":") > 0, F.instr(x, ":")).otherwise(F.instr(x, "="))
    k, v = F.trim(F.substr(x, F.lit(1), p - 1)), F.trim(F.substr(x, p + 1))
    pair = (p > 0) & (k != "") & (v != "")
    parts = lines(spark, d).where(x != "").select("extraction_id", F.when(pair, k).otherwise("Text Block").alias("name"), F.when(pair, v).otherwise(x).alias("value"), F.lit("element").alias("kind"))
    return named.unionByName(parts)
