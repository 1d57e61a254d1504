"""Form- and table-level operators over tokens and rows: character boxes, logical tables, where a field stands on a page, checkboxes.

What a row or a token is, is decided by Column expressions; windows carry titles, headers and candidates along. The grouping of
character boxes is an ordered fold over many pages at once, and a field's places are searched for in the letters of a page, without its windows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import geometry as geo
from attestra.functions import similarity as sim

# --- character boxes --------------------------------------------------------------------------------------------------

#: Overlap of a box with a row's band, and distance of the centres in heights, from which it may be of the row.
BAND, DRIFT = 0.35, 0.65
#: Largest variation of pitches or gaps, and of widths; longest text of a box.
EVEN_STEPS, EVEN_WIDTHS, BOX_TEXT = 0.45, 0.50, 4
#: Variation of pitches and of widths (of the whole population) up to which a run of at least so many cells is clean.
CLEAN_STEPS, CLEAN_WIDTHS, CLEAN_CELLS = 0.28, 0.45, 4


def bands(boxes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows_by_band for many pages at once: a number for the row of each box, and the place of each box in its page's order from the top.

    boxes (l, t, r, b) stand page by page, `sizes` has how many each page has. The pages advance together, a box of each at a time.
    """
    centre, height = (boxes[:, 1] + boxes[:, 3]) / 2, np.maximum(1e-4, boxes[:, 3] - boxes[:, 1])
    page = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((boxes[:, 0], centre, page))
    place = np.empty(len(boxes), np.int64)
    place[order] = np.arange(len(boxes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # The longest pages first: those that still have boxes are always the first ones.
    by_size = np.argsort(-sizes, kind="stable")
    starts, longest = (np.cumsum(sizes) - sizes)[by_size], sizes[by_size]
    rows, own = np.zeros(len(sizes), np.int64), np.empty(len(boxes), np.int64)
    known = {k: np.zeros((len(sizes), 4)) for k in ("top", "bottom", "centres", "heights", "count")}
    for step in range(int(longest[0]) if len(sizes) else 0):
        live = np.searchsorted(-longest, -step, "left")
        i, r = order[starts[:live] + step], int(rows[:live].max())
        if r == known["top"].shape[1]:
            known = {k: np.concatenate([x, np.zeros_like(x)], axis=1) for k, x in known.items()}
        top, bottom, centres, heights, count = (x[:live, :r] for x in known.values())
        box, c, h = boxes[i], centre[i, None], height[i, None]
        there = np.arange(r) < rows[:live, None]
        over = np.maximum(0.0, np.minimum(box[:, 3:4], bottom) - np.maximum(box[:, 1:2], top)) / h
        n = np.maximum(count, 1)
        near = there & (np.abs(c - centres / n) <= DRIFT * np.maximum(h, heights / n))
        fit = np.where(there & ((over >= BAND) | near) & (over > 0), over, np.where(near, 0.0, -1.0))
        at, best = (fit.argmax(axis=1), fit.max(axis=1)) if r else (np.zeros(live, np.int64), np.full(live, -1.0))
        new = ~(best >= 0)
        at, p = np.where(new, rows[:live], at), np.arange(live)
        known["top"][p, at] = np.where(new, box[:, 1], np.minimum(known["top"][p, at], box[:, 1]))
        known["bottom"][p, at] = np.where(new, box[:, 3], np.maximum(known["bottom"][p, at], box[:, 3]))
        for k, x in (("centres", c[:, 0]), ("heights", box[:, 3] - box[:, 1]), ("count", 1)):
            known[k][p, at] += x
        rows[:live] += new
        own[i] = at
    first = np.empty(len(sizes), np.int64)
    first[by_size] = np.cumsum(rows) - rows
    return first[page] + own, place


def rows_by_band(boxes: np.ndarray) -> list[list[int]]:
    """WIN-02: boxes (l, t, r, b) of a page grouped into rows, from the top. A box joins the row whose band it overlaps most, or else the
    first whose mean centre is near enough; the row's band, centre and height follow its boxes, so lines do not chain."""
    own, place = bands(boxes, np.array([len(boxes)]))
    rows: dict[int, list[int]] = {}
    for i in np.argsort(place):
        rows.setdefault(int(own[i]), []).append(int(i))
    centre = (boxes[:, 1] + boxes[:, 3]) / 2
    return sorted(rows.values(), key=lambda r: centre[r].mean())


def spread_of(x: np.ndarray, floor: float = 1e-4) -> np.ndarray:
    """Sample deviation over mean, row by row; 0 for fewer than two values."""
    return x.std(axis=1, ddof=1) / (x.mean(axis=1) + floor) if x.shape[1] >= 2 else np.zeros(len(x))


def evenness_of(boxes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """evenness for many runs of as many boxes: boxes (runs, n, 4), chars (runs, n)."""
    if boxes.shape[1] < 2:
        return np.zeros(len(boxes), bool), np.zeros(len(boxes))
    l, t, r, b = (np.ascontiguousarray(boxes[:, :, k]) for k in range(4))  # noqa: E741
    width, height = (r - l) / chars, b - t
    w, h = np.median(width, axis=1), np.median(height, axis=1)
    share = (chars[:, 1:] + chars[:, :-1]) / 2
    advance, middle, centre = np.diff(l) / share, (t + b) / 2, (l + r) / 2
    steady = (w > 0) & (h > 0) & (advance.min(axis=1) >= np.minimum(0.25 * w, 0.15 * h)) & (advance.max(axis=1) <= np.maximum(6.5 * w, 3.0 * h))
    steady &= ~((np.abs(np.diff(middle)).max(axis=1) > 0.6 * h) | (np.ptp(middle, axis=1) > 1.5 * h))
    pitch = np.diff(centre) / share
    usual = np.median(pitch, axis=1)[:, None]
    with np.errstate(all="ignore"):
        cells = np.where(usual > 0, np.maximum(1, np.rint(pitch / usual)), 1.0)
        few = cells <= 3
        even_pitch = np.where(pitch.mean(axis=1) > 0, spread_of(np.where(few, pitch / cells, pitch)), 0.0)
        gap = (l[:, 1:] - r[:, :-1]) / share
        even_gap = spread_of(np.abs(np.where(few & (cells > 1), gap - (cells - 1) * usual, gap)))
        wide, high = width.mean(axis=1), height.mean(axis=1)
        even_width, shape = spread_of(width, 0.0), wide / high
    steady &= ~(wide <= 0)
    shaped = (high > 0) & (shape >= 0.10) & (shape <= 3.0)
    good = ((even_gap <= EVEN_STEPS) | (even_pitch <= EVEN_STEPS)) & ((even_width <= EVEN_WIDTHS) | (even_pitch <= EVEN_STEPS)) & shaped
    score = 0.4 * (1 - np.minimum(even_gap, 1)) + 0.4 * (1 - np.minimum(np.minimum(even_width, even_pitch), 1)) + 0.2 * shaped
    return steady & good, np.where(steady, score, 0.0)


def evenness(boxes: np.ndarray, chars: np.ndarray) -> tuple[bool, float]:
    """WIN-05: whether boxes of a row are cells of one field, and how evenly they stand (0 to 1).

    Steps count per character; a step over up to two empty cells counts as that many. Cells must advance, keep their baseline, leap
    no whole field, and be even in gaps or pitches, and in widths or pitches. The score is 0.4 gaps, 0.4 sizes, 0.2 shape.
    """
    good, score = evenness_of(boxes[None], chars[None])
    return bool(good[0]), float(score[0])


def medians(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The median of each group; groups stand one after another and are not empty."""
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]
    starts = np.cumsum(sizes) - sizes
    return (ordered[starts + (sizes - 1) // 2] + ordered[starts + sizes // 2]) / 2


def box_runs(boxes: np.ndarray, chars: np.ndarray, sizes: np.ndarray, least: int = 2) -> list[tuple[np.ndarray, int]]:
    """WIN-03, WIN-04: rows (each sorted from the left) split where the gap is that between fields, then into the longest even runs.

    `sizes` has the boxes of each row. Runs come as arrays of first boxes by length; those of all rows are extended together.
    """
    w, h = (np.repeat(medians(np.maximum(1e-3, x), sizes), sizes)[1:] for x in (np.abs(boxes[:, 2] - boxes[:, 0]) / chars, np.abs(boxes[:, 3] - boxes[:, 1])))
    begins = np.zeros(len(boxes), bool)
    begins[np.cumsum(sizes) - sizes] = True
    begins[1:] |= boxes[1:, 0] - boxes[:-1, 2] > np.maximum(np.maximum(4 * w, 2 * h), np.where(boxes[:-1, 0] <= 1.5, 0.065, 42.0))
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(boxes)))
    by_length = np.argsort(-length, kind="stable")
    start, length = start[by_length], length[by_length]
    run, closed = start.copy(), []
    for step in range(1, int(length[0]) if len(length) else 0):
        live = np.searchsorted(-length, -step, "left")
        upto = start[:live] + step
        size = upto - run[:live] + 1
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            cells = run[at, None] + np.arange(n)
            broken = at[~evenness_of(boxes[cells], chars[cells])[0]]
            closed.append((run[broken], int(n) - 1))
            run[broken] = upto[broken]
    size = start + length - run
    closed += [(run[size == n], int(n)) for n in np.unique(size)]
    return [(at, n) for at, n in closed if n >= least and len(at)]


def blanks(boxes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """WIN-06: whether an empty cell, a blank of the run's text, is before a box: boxes (runs, n, 4), chars (runs, n)."""
    step = np.diff((boxes[:, :, 0] + boxes[:, :, 2]) / 2)
    usual = np.median(step / ((chars[:, 1:] + chars[:, :-1]) / 2), axis=1)[:, None] if step.shape[1] else np.zeros((len(boxes), 1))
    gap = boxes[:, 1:, 0] - boxes[:, :-1, 2]
    return np.insert((usual > 0) & ((step >= 1.55 * usual) | (gap >= 0.85 * usual)), 0, False, axis=1)


def clean_runs(boxes: np.ndarray) -> np.ndarray:
    """clean_run for many runs of as many cells: boxes (runs, n, 4)."""
    if boxes.shape[1] < CLEAN_CELLS:
        return np.zeros(len(boxes), bool)
    pitch, width = np.diff((boxes[:, :, 0] + boxes[:, :, 2]) / 2), boxes[:, :, 2] - boxes[:, :, 0]
    with np.errstate(all="ignore"):
        even = (pitch.std(axis=1) / pitch.mean(axis=1) <= CLEAN_STEPS) & (width.std(axis=1) / width.mean(axis=1) <= CLEAN_WIDTHS)
    return even & (pitch.min(axis=1) > 0) & (width.mean(axis=1) > 0)


def clean_run(boxes: np.ndarray) -> bool:
    """WIN-18: whether cells (sorted from the left) stand evenly and are of like widths."""
    return bool(clean_runs(boxes[None])[0])


def joined_cells(boxes: np.ndarray, target: int) -> np.ndarray:
    """WIN-18: cells (sorted from the left) with the two nearest joined until no more than `target` are left."""
    cells = [tuple(b) for b in boxes]
    while len(cells) > target >= CLEAN_CELLS:
        j = min(range(len(cells) - 1), key=lambda i: (cells[i + 1][0] - cells[i][2], i))
        a, b = cells[j], cells[j + 1]
        cells[j : j + 2] = [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
    return np.array(cells)


def is_box_text(c: Column) -> Column:
    """SIM-19: whether a text may be what a character box holds."""
    t = F.trim(c)
    return F.length(t).between(1, BOX_TEXT) & t.rlike(r"^[\p{L}\p{N}@.,/_#-]+$")


#: Boxes that are grouped at once; a page is never parted.
BOXES_AT_ONCE = 50_000


def comb_boxes(toks: DataFrame, *key: str) -> DataFrame:
    """WIN-07: fields written in character boxes: key..., text, n, l, t, r, b, score, clean; one row per run of boxes.

    toks: key..., ord, word, l, t, r, b. A page is a group; only short tokens take part. Nulls in words and boxes are left out.
    A page becomes one row, and the pages of a batch are worked on together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(batch.column("word").value_lengths().to_numpy())
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BOXES_AT_ONCE, "right")))
                yield grouped(batch.slice(start, end - start))
                start = end

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = {c: batch.column(c).flatten() for c in ("word", "l", "t", "r", "b")}
        boxes = np.column_stack([flat[c].to_numpy(zero_copy_only=False) for c in "ltrb"])
        words = [w.strip() for w in flat["word"].to_pylist()]
        pages = batch.column("word").value_lengths().to_numpy().astype(np.int64)
        row, place = bands(boxes, pages)
        order = np.lexsort((place, boxes[:, 0], row))
        boxes, page = boxes[order], np.repeat(np.arange(len(pages)), pages)[order]
        words = [words[i] for i in order]
        chars = np.maximum(1, np.array([len(w) for w in words]))
        out: list[tuple] = []
        for first, n in box_runs(boxes, chars, np.unique(row, return_counts=True)[1]):
            cells = first[:, None] + np.arange(n)
            own, size = boxes[cells], chars[cells]
            texts = ["".join((" " if blank else "") + w for blank, w in zip(bs, words[f : f + n])) for f, bs in zip(first.tolist(), blanks(own, size).tolist())]
            sides = [own[:, :, k].min(axis=1) if k < 2 else own[:, :, k].max(axis=1) for k in range(4)]
            out.append((page[first], texts, np.full(len(first), n, np.int32), *sides, evenness_of(own, size)[1], clean_runs(own)))
        names = [*key, "text", "n", "l", "t", "r", "b", "score", "clean"]
        at, texts, *rest = zip(*out) if out else ([], [], *[[np.empty(0, kind)] for kind in (np.int32, *[float] * 5, bool)])
        docs = pa.array(np.concatenate(at) if out else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(docs) for k in key], pa.array([t for ts in texts for t in ts], pa.string()), *[pa.array(np.concatenate(x)) for x in rest]], names)

    kinds = ", ".join(f"{k} {toks.schema[k].dataType.simpleString()}" for k in key)
    known = toks.where(is_box_text(F.col("word")) & F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("r").isNotNull() & F.col("b").isNotNull())
    box = [F.col(c).cast("double").alias(c) for c in "ltrb"]
    pages = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", *box, "word"))).alias("ws")).select(*key, *[F.col(f"ws.{c}").alias(c) for c in ("word", "l", "t", "r", "b")])
    return pages.mapInArrow(run, f"{kinds}, text string, n int, l double, t double, r double, b double, score double, clean boolean")


# --- logical tables ---------------------------------------------------------------------------------------------------

#: Words of column headings, values that are none, and the only headings of two columns.
HEADINGS = (
    "installment", "installments", "epi", "emi", "number of", "commencement", "date", "due date", "instl", "principal", "interest", "closing", "opening", "rate", "flag", "sr", "sr.", "sl", "no", "no.", "parameter",
    "details", "charges", "fee", "amount", "payable", "description", "particulars", "tenor", "balance", "outstanding", "bounce", "penalty", "gst", "recovery", "agent",
)
VALUES = ("fixed", "floating", "hybrid", "yes", "no", "na", "n/a", "nil", "monthly", "quarterly")
TWO_LEFT, TWO_RIGHT = ("sr.", "no", "parameter", "field", "charge", "fee"), ("details", "value", "amount")
INDEXES = ("sr.", "sr. no.", "sl no", "sl. no.", "no.", "no")
NUMBER = r"^[₹$€£\s]*[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?%?\s*(?:/-)?$"
INDEX = r"^(?:[0-9]+|[a-zA-Z]|[ivxIVX]+|[a-zA-Z]\))\s*[.)]?$"


def is_heading(cells: Column) -> Column:
    """SIM-18: whether a row of filled cells heads columns: none of them is a number or a value, one has a word of headings."""
    no_value = F.forall(cells, lambda c: ~c.rlike(NUMBER) & ~F.lower(c).isin(*VALUES))
    two = (F.size(cells) != 2) | F.lower(F.get(cells, F.lit(0))).isin(*TWO_LEFT) & F.lower(F.get(cells, F.lit(1))).isin(*TWO_RIGHT)
    named = F.exists(cells, lambda c: F.greatest(*[F.lower(c).contains(h) for h in HEADINGS]))
    return (F.size(cells) >= 2) & no_value & two & named


def row_pairs(cells: Column) -> Column:
    """SIM-18: filled cells read as pairs of field and value, after a leading index."""
    first = F.get(cells, F.lit(0))
    rest = F.when(first.rlike(INDEX) | F.lower(first).isin(*INDEXES), F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size(rest) / 2).cast("int"))), lambda i: F.struct(F.try_element_at(rest, 2 * i - 1).alias("field"), F.try_element_at(rest, 2 * i).alias("value")))
    return F.filter(each, lambda p: p["value"].isNotNull())


def row_kinds(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """WIN-12: rows with `cells` filled only, and `kind`: title, total, header, pairs or data. Empty rows are left out."""
    filled = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    known = rows.withColumn(cells, filled).where(F.size(cells) > 0)
    c = F.col(cells)
    first = F.get(c, F.lit(0))
    lead = (first.rlike(INDEX) | F.lower(first).isin(*INDEXES)).cast("int")
    kind = (
        F.when((F.size(c) == 1) & (F.length(first) > 2) & ~first.rlike("^[0-9]+$"), "title")
        .when(F.upper(first).startswith("TOTAL"), "total")
        .when(is_heading(c), "header")
        .when(F.size(c) - lead >= 2, "pairs")
        .otherwise("data")
    )
    return known.withColumn("kind", kind)


def segmented(kinds: DataFrame, *key: str) -> DataFrame:
    """WIN-12: rows of row_kinds (key..., row, cells, kind) with section, title, block ("pairs", "table" or null) and headings.

    A title begins a section. From its first header on, or from a first row of several cells that is no pair, a section is a table, whose
    rows stand under the last header above them; before that its pairs are a block of pairs. Windows carry all of this along.
    """
    w = W.partitionBy(*key).orderBy("row")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    k = F.col("kind")
    marked = kinds.withColumn("section", F.count_if(k == "title").over(upto)).withColumn("title", F.last(F.when(k == "title", F.get("cells", F.lit(0))), ignorenulls=True).over(upto))
    inside = W.partitionBy(*key, "section").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    pairs_before = F.count_if(k == "pairs").over(inside)
    opens = (k == "header") | (k == "data") & (F.size("cells") >= 2) & (pairs_before == 0)
    table = F.coalesce(F.bool_or(opens).over(inside), F.lit(False))
    block = F.when(k.isin("title"), None).when(table, "table").when(k == "pairs", "pairs")
    heads = F.last(F.when(k == "header", F.col("cells")), ignorenulls=True).over(inside)
    return marked.withColumn("block", block).withColumn("headings", heads)


def blocks(rows: DataFrame, *key: str) -> DataFrame:
    """WIN-12, WIN-15, WIN-16: key..., section, title, block, first_row, last_row, n_rows, n_totals, n_headings and suspicious: headings that look like numbers."""
    held = rows.where(F.col("block").isNotNull())
    k = F.col("kind")
    suspicious = F.size(F.filter("headings", lambda h: h.rlike("^[0-9]{4,}$")))
    return held.groupBy(*key, "section", "title", "block").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count_if(~k.isin("header", "total")).alias("n_rows"), F.count_if(k == "total").alias("n_totals"),
        F.coalesce(F.max(F.size("headings")), F.lit(0)).alias("n_headings"), F.coalesce(F.max(suspicious), F.lit(0)).alias("suspicious"),
    )


def continued(found: DataFrame, *key: str) -> DataFrame:
    """WIN-14: blocks that follow each other in the list with the same kind and title merged: key..., grp, title, block, n_blocks, n_rows, first_row, last_row."""
    w = W.partitionBy(*key).orderBy("first_row")
    same = (F.lag("block").over(w) == F.col("block")) & (F.lower(F.trim(F.lag("title").over(w))) == F.lower(F.trim("title"))) & (F.trim("title") != "")
    marked = found.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("grp", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*key, "grp").agg(F.min_by("title", "first_row").alias("title"), F.first("block").alias("block"), F.count(F.lit(1)).alias("n_blocks"), F.sum("n_rows").alias("n_rows"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"))


# --- where a field stands ---------------------------------------------------------------------------------------------


def clean_number(c: Column) -> Column:
    """SIM-17: the first number of a text without separators and a final .0 or .00; '' for none."""
    n = F.regexp_extract(F.regexp_replace(c, "[₹$€£,]", ""), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(n.endswith(".0"), F.regexp_replace(n, r"\.0$", "")).when(n.endswith(".00"), F.regexp_replace(n, r"\.00$", "")).otherwise(n)


_NO_ALNUM, _CURRENCY, _NUMBER_IN, _DATE_MARKS = re.compile("[^a-z0-9]"), re.compile("[₹$€£,]"), re.compile(r"[0-9]+(?:\.[0-9]+)?"), re.compile(r"[/.\s-]", re.ASCII)


def number_in(text: str) -> str:
    """clean_number of a text."""
    m = _NUMBER_IN.search(_CURRENCY.sub("", text))
    n = m.group() if m else ""
    return n[:-2] if n.endswith(".0") else n[:-3] if n.endswith(".00") else n


class Page:
    """WIN-08: the tokens of a page in reading order and their windows: single tokens and runs of up to `longest` on a line or close below each other.

    A window is (p, k): its first token and how many. Its letters and digits are a stretch of those of the page, so windows that may
    equal or hold a value are found where the value, or a part of it that they must share, stands on the page; no window is built before.
    """

    def __init__(self, words: list, lows: list, tops: list, bottoms: list, longest: int, band: float, gap: float) -> None:
        self.words, self.lows, self.tops, self.bottoms, self.longest, self.band, self.gap = words, lows, tops, bottoms, longest, band, gap
        alnum = [_NO_ALNUM.sub("", w or "") for w in lows]
        self.flat, self.at = "".join(alnum), [0, *accumulate(map(len, alnum))]
        self.nums = [number_in(w or "") for w in words]
        self.by_num: dict[str, list[int]] = {}
        self.by_date: dict[str, list[int]] = {}
        for i, (n, w) in enumerate(zip(self.nums, words)):
            self.by_num.setdefault(n, []).append(i)
            self.by_date.setdefault(_DATE_MARKS.sub("", w or ""), []).append(i)
        self.known: dict[int, int] = {}

    def reach(self, p: int) -> int:
        """Tokens of the longest window that begins at p."""
        if p not in self.known:
            t, b, n = self.tops, self.bottoms, min(self.longest, len(self.tops) - p)
            apart = lambda x, y, most, sign: x is None or y is None or not (abs(x - y) if sign else x - y) <= most
            line = next((i for i in range(1, n) if apart(t[p + i], t[p], self.band, True)), n)
            close = next((i for i in range(1, n) if apart(t[p + i], b[p + i - 1], self.gap, False)), n)
            self.known[p] = max(line, close)
        return self.known[p]

    def places_of(self, part: str) -> Iterator[int]:
        """Where a text of letters and digits begins in those of the page."""
        o = self.flat.find(part)
        while o >= 0:
            yield o
            o = self.flat.find(part, o + 1)

    def token_at(self, o: int) -> int:
        return bisect_right(self.at, o) - 1

    def text(self, texts: list, p: int, k: int) -> str:
        return " ".join(w for w in texts[p : p + k] if w is not None)

    def equal(self, low: str, alnum: str, num: str, date: str) -> Iterator[tuple[tuple[int, int], int]]:
        """WIN-09: windows that equal a value, and the way: 0 as text, 1 in letters and digits, 2 as a number, 3 as a date (single tokens)."""
        at, size = self.at, len(self.tops)
        # A value without letters and digits stands only where windows have none.
        starts = self.places_of(alnum) if alnum else (o for o in [-1])
        for o in starts:
            firsts = range(bisect_left(at, o), min(size, bisect_right(at, o))) if alnum else range(size)
            for p in firsts:
                end = at[p] + len(alnum)
                if at[p + 1] > end:
                    continue
                for k in range(1, self.reach(p) + 1):
                    if at[p + k] > end:
                        break
                    if at[p + k] == end:
                        same = self.text(self.lows, p, k) == low
                        if same or alnum:
                            yield (p, k), 0 if same else 1
        for i in self.by_num.get(num, ()) if num else ():
            for p in range(i, max(-1, i - self.longest), -1):
                if p < i and self.nums[p]:
                    break
                for k in range(i - p + 1, self.reach(p) + 1):
                    yield (p, k), 2
        for i in self.by_date.get(date, ()) if date else ():
            yield (i, 1), 3

    def holding(self, alnum: str) -> Iterator[tuple[tuple[int, int], int, int]]:
        """WIN-10: windows whose letters and digits hold a value's or lie in them, the way, and their length: 4 for single tokens, 5 for runs
        of a length like the value's. A window may come twice."""
        at, n = self.at, len(alnum)
        for o in self.places_of(alnum) if n >= 5 else ():
            i = self.token_at(o)
            if o + n <= at[i + 1] and at[i + 1] - at[i] != n:
                yield (i, 1), 4, at[i + 1] - at[i]
        if n >= 8:
            # Every stretch of `least` or more of the value's characters has those in its middle, and so has what holds all of it.
            least = next(m for m in range(int(0.7 * n) - 1, n + 1) if m / n >= 0.70)
            core = alnum[n - least : least]
            for o in self.places_of(core):
                i, j = self.token_at(o), self.token_at(o + len(core) - 1)
                for p in range(max(0, j - self.longest + 1), i + 1):
                    for k in range(max(2, j - p + 1), self.reach(p) + 1):
                        m = at[p + k] - at[p]
                        if min(m, n) / max(m, n) >= 0.70:
                            other = self.flat[at[p] : at[p + k]]
                            if other != alnum and (alnum in other or other in alnum):
                                yield (p, k), 5, m


def places_on(page: Page, values: list[tuple[str, str, str, str]]) -> list[tuple[int, int, int, int, int]]:
    """(p, k, way, length of the value, length of the window) of all windows of a page that have one of the values of a field."""
    equal: dict[tuple[int, int], int] = {}
    for v in values:
        for w, way in page.equal(*v):
            equal[w] = min(way, equal.get(w, way))
    held = {(*w, way, len(v[1]), m, n): None for n, v in enumerate(values) for w, way, m in page.holding(v[1]) if w not in equal}
    return [(*w, way, 0, 0) for w, way in equal.items()] + [x[:5] for x in held]


#: Documents whose tokens are read at once.
AT_ONCE = 64


def located(fields: DataFrame, toks: DataFrame, key: str, most: int = 5, longest: int = 7, band: float = 0.035, gap: float = 0.06) -> DataFrame:
    """WIN-08 to WIN-11, SRT-07: for each field of a document the `most` best places: key, field, place, page, pos, k, text, score, strategy.

    toks: key, page, ord, word, confidence and a box. A window (see Page) equals a value as text, in its letters and digits, as a number
    or, a single token, as a date; else one may hold the other. The tokens and the values of a document each become one row, and its
    windows are never rows. Ranked by 0.7 score, 0.2 confidence and 0.05 for the first page; ties in reading order, shorter windows first.
    """
    v = F.trim(F.regexp_replace("value", r"\s+", " "))
    target = fields.select(key, "field", v.alias("v")).where(v != "").select(
        key, "field", F.lower("v").alias("low"), F.regexp_replace(F.lower("v"), "[^a-z0-9]", "").alias("alnum"), clean_number(F.col("v")).alias("num"),
        F.when(F.col("v").rlike("[/.-]"), F.regexp_replace("v", r"[/.\s-]", "")).otherwise("").alias("date"),
    )
    sought = target.groupBy(key).agg(F.collect_list(F.struct("field", "low", "alnum", "num", "date")).alias("fs"))
    pages = toks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "t", "l", "ord", "word", "b", "confidence"))).alias("ws"))
    # Exploded tokens look as small as their table to the optimiser: without the hint it may broadcast them.
    both = pages.join(sought.hint("merge"), key).select(
        key, *[F.col(f"ws.{c}").alias(c) for c in ("page", "t", "b", "confidence", "word")], F.transform("ws.word", F.lower).alias("low"),
        *[F.col(f"fs.{c}").alias(f"f_{c}") for c in ("field", "low", "alnum", "num", "date")],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                yield from matched(batch.slice(start, AT_ONCE))

    def matched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs, names, sizes, found = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("page", "t", "b", "confidence", "word", "low", "f_field", "f_low", "f_alnum", "f_num", "f_date")]
        for d, (numbers, tops, bottoms, sure, words, lows, fs, *forms) in enumerate(zip(*columns)):
            values: dict = {}
            for f, v in zip(fs, zip(*forms)):
                values.setdefault(f, []).append(v)
            places: dict = {f: [] for f in values}
            begin = 0
            for number, run_of in groupby(numbers):
                end = begin + sum(1 for _ in run_of)
                page = Page(words[begin:end], lows[begin:end], tops[begin:end], bottoms[begin:end], longest, band, gap)
                for f, vs in values.items():
                    for p, k, way, own, other in places_on(page, vs):
                        cs = sure[begin + p : begin + p + k]
                        places[f].append((number, p + 1, k, page.text(page.words, p, k), None if None in cs else sum(cs, 0.0) / k, way, own, other))
                begin = end
            for f, x in places.items():
                if x:
                    docs.append(d)
                    names.append(f)
                    sizes.append(len(x))
                    found += x
        if docs:
            typed = zip(zip(*found), (batch.column("page").type.value_type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))
            inner = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in typed], ["page", "pos", "k", "text", "confidence", "way", "own", "other"])
            lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(docs)), pa.array(names, batch.column("f_field").type.value_type), lists], [key, "field", "found"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = both.mapInArrow(run, f"{key} {kind(toks, key)}, field {kind(fields, 'field')}, found array<struct<page:{kind(toks, 'page')},pos:int,k:int,text:string,confidence:double,way:int,own:int,other:int>>")
    single = F.array(*map(F.lit, (1.0, 0.98, 0.95, 0.95)))
    several = F.array(*map(F.lit, (0.97, 0.95, 0.93, 0.0)))
    names = F.array(*map(F.lit, ("exact", "alphanumeric", "numeric", "date", "containment", "containment")))

    def scored(x: Column) -> Column:
        a, b = x["own"], x["other"]
        return (
            F.when(x["way"] == 4, 0.85 + 0.10 * (a / b))
            .when(x["way"] == 5, F.round(0.82 + 0.12 * (F.least(a, b) / F.greatest(a, b)), 3))
            .when(x["k"] == 1, F.get(single, x["way"]))
            .otherwise(F.get(several, x["way"]))
        )

    def ranked(x: Column) -> Column:
        rank = F.round(x["score"] * 0.7 + x["confidence"] * 0.2 + F.when(x["page"] == 1, 0.05).otherwise(0.0), 9)
        return F.struct(rank.isNull().alias("none"), (-rank).alias("rank"), x["page"].alias("page"), x["k"].alias("k"), x["pos"].alias("pos"), x["text"].alias("text"), x["score"].alias("score"), F.get(names, x["way"]).alias("strategy"))

    marked = F.transform("found", lambda x: x.withField("score", scored(x)))
    best = F.slice(F.array_sort(F.transform(marked, ranked)), 1, most)
    return found.select(key, "field", F.posexplode(best).alias("place", "x")).select(key, "field", (F.col("place") + 1).alias("place"), "x.page", "x.pos", "x.k", "x.text", "x.score", "x.strategy")


def beside_anchor(toks: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """JN-14: for each token that holds a word of a field's name the nearest token right of it or below: key, field, page, anchor, ord, word.

    Right: begins no further left, at most 0.04 off in height. Below: at most 0.08 under it, at most 0.20 off at the left.
    """
    words = fields.select(key, "field", F.explode(F.filter(F.split(F.lower("field"), "_"), lambda w: F.length(w) >= 3)).alias("part")).distinct()
    anchors = toks.join(words, key).where(F.contains(F.lower("word"), F.col("part"))).select(key, "field", "page", F.col("ord").alias("anchor"), *[F.col(c).alias(f"a{c}") for c in "ltrb"]).distinct()
    near = anchors.join(toks.select(key, "page", "ord", "word", "l", "t"), [key, "page"]).where(F.col("ord") != F.col("anchor"))
    right = (F.col("l") >= F.col("al")) & (F.abs(F.col("t") - F.col("at")) <= 0.04)
    below = (F.col("t") >= F.col("ab")) & (F.col("t") - F.col("ab") <= 0.08) & (F.abs(F.col("l") - F.col("al")) <= 0.20)
    dist = F.round(F.sqrt((F.col("l") - F.col("ar")) * (F.col("l") - F.col("ar")) + (F.col("t") - F.col("at")) * (F.col("t") - F.col("at"))), 9)
    best = near.where(right | below).groupBy(key, "field", "page", "anchor").agg(F.min_by(F.struct("ord", "word"), F.struct(dist, "ord")).alias("x"))
    return best.select(key, "field", "page", "anchor", "x.ord", "x.word")


# --- regions, classes, checkboxes -------------------------------------------------------------------------------------


def region_gate(toks: DataFrame, regions: DataFrame, texts: DataFrame, *key: str) -> DataFrame:
    """JN-11: toks with `fate`: "outside" of all regions, "captured" by a cell of the first region that holds them, or "kept" as no cell has their text.

    regions: key..., region, cl, ct, cr, cb; texts: key..., region, text of each filled cell. A token is inside if its centre is, if its box is
    within a fiftieth of the region, or if two fifths of it are. Texts below four characters must be equal, longer ones may hold each other.
    """
    a, c = geo.box(), geo.box("c")
    mx, my = (F.col("cr") - F.col("cl")) * 0.02, (F.col("cb") - F.col("ct")) * 0.02
    nearly = (F.col("l") >= F.col("cl") - mx) & (F.col("t") >= F.col("ct") - my) & (F.col("r") <= F.col("cr") + mx) & (F.col("b") <= F.col("cb") + my)
    inside = geo.centre_inside(a, c) | nearly | (geo.overlap(a, c) >= 0.40)
    first = toks.join(regions, list(key)).where(inside).groupBy(*key, "ord").agg(F.min("region").alias("region"))
    own, cell = F.lower(F.trim("word")), F.lower(F.trim("text"))
    short = (F.length(own) < 4) | (F.length(cell) < 4)
    caught = F.when(short, own == cell).otherwise(F.contains(cell, own) | F.contains(own, cell))
    held = toks.join(first, [*key, "ord"]).join(texts.where(F.trim("text") != ""), [*key, "region"], "left")
    judged = held.groupBy(*key, "ord").agg(F.bool_or(F.col("text").isNotNull()).alias("cells"), F.bool_or(F.coalesce(caught, F.lit(False))).alias("hit"))
    fate = F.when(F.col("cells").isNull(), "outside").when(F.col("cells") & ~F.col("hit") & (F.trim("word") != ""), "kept").otherwise("captured")
    return toks.join(judged, [*key, "ord"], "left").withColumn("fate", fate).drop("cells", "hit")


#: Options of checkboxes by group, with what misread ones mean, and marks of a checked one.
OPTIONS = {
    "action": ("create", "modify", "cancel", "modity"),
    "account_type": ("sb", "ca", "cc", "sb-nre", "sb-nro", "other", "sbica"),
    "debit_type": ("fixed", "maximum", "maxdmum", "fhed"),
    "frequency": ("daily", "dally", "weekly", "monthly", "monthiy", "quarterly", "half-yearly", "yearly", "as and when presented", "presenied", "qty"),
}
MEANT = {"dally": "daily", "monthiy": "monthly", "fhed": "fixed", "maxdmum": "maximum", "modity": "modify", "presenied": "as_and_when_presented", "qty": "quarterly", "sbica": "sb"}
CHECKED = ("x", "区", "☑", "✓", "✔", "v", "■", "black_box", "tick", "ticked", "[x]", "冈")


def option_pattern(option: str) -> str:
    """A text that names an option, alone or beside a mark."""
    return r"(?:^|[\s\[(区☑✓✔vx/冈μB-])" + option.replace("-", r"\-") + r"(?:$|[\s\])区☑✓✔vx/-])"


def checkboxes(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """WIN-20: (key, grp, option, checked): the options that lines without a colon name; the last line that names one decides."""
    relation = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(MEANT.get(o, o.replace(" ", "_"))).alias("option"), F.lit(option_pattern(o)).alias("pattern"), F.lit(i).alias("i")) for i, (g, o) in enumerate((g, o) for g, os in OPTIONS.items() for o in os)])
    low = F.lower(F.trim(text))
    any_option = "|".join(o.replace("-", r"\-") for os in OPTIONS.values() for o in os)
    # Few lines name any option: they alone are read against all of them.
    named = lines.where(~F.contains(F.trim(text), F.lit(":")) & low.rlike(any_option)).select(key, order, low.alias("t"), F.explode(relation).alias("o")).where(F.rlike("t", F.col("o.pattern")))
    checked = F.greatest(*[F.contains("t", F.lit(m)) for m in CHECKED])
    return named.groupBy(key, "o.grp", "o.option").agg(F.max_by(checked, F.struct(order, "o.i")).alias("checked"))


def element_class(c: Column, bottom: Column, confidence: Column) -> Column:
    """WIN-19: what a line of a form is: noise, section_header, branding, checkbox_label, label, value or paragraph, by the first that holds."""
    t = F.trim(c)
    bare = F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s/]", ""))
    options = r"(?i)\b(" + "|".join(o.replace("-", r"\-") for os in OPTIONS.values() for o in os) + r")\b"
    return (
        F.when((confidence < 0.50) | sim.gibberish(t), "noise")
        .when(bare.isin(*sim.SECTION_HEADERS), "section_header")
        .when(F.greatest(*[bare.contains(b) for b in sim.BRANDING_KEYWORDS]), "branding")
        .when((bottom < 0.16) & (bare.contains("bank") | bare.contains("services") | bare.contains("financial")), "branding")
        .when(bare.rlike(options), "checkbox_label")
        .when(t.contains(":") | t.contains("="), "label")
        .when(sim.definite_value(t), "value")
        .when(sim.form_label(t), "label")
        .otherwise("paragraph")
    )


def block_text(found: DataFrame, *key: str) -> DataFrame:
    """SNK-09: key..., section, block and text: blocks as [TABLE] text, a title above, headings first, totals last; pairs under "Field | Value"."""
    k = F.col("kind")
    width = F.size("headings")
    padded = F.when(width > 0, F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)).otherwise(F.col("cells"))
    row = F.when(k == "header", None).when(k == "total", F.array_join("cells", " | ")).when(F.col("block") == "table", F.array_join(padded, " | "))
    pairs = F.when(F.col("block") == "pairs", F.array_join(F.transform(row_pairs(F.col("cells")), lambda p: F.concat_ws(" | ", p["field"], p["value"])), "\n"))
    lines = found.where(F.col("block").isNotNull()).select(*key, "section", "title", "block", "row", (k == "total").cast("int").alias("last"), F.coalesce(row, pairs).alias("line"), F.when(k == "header", F.array_join("cells", " | ")).alias("head"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("last", "row", "line")))), lambda x: x["line"]), "\n")
    whole = lines.groupBy(*key, "section", "title", "block").agg(body.alias("body"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("row"))).alias("head"))
    top = F.when(F.col("block") == "pairs", "Field | Value").otherwise(F.col("head"))
    text = F.concat_ws("\n", F.when(F.col("title").isNotNull(), F.concat(F.lit("### "), "title")), F.lit("[TABLE]"), top, F.nullif("body", F.lit("")), F.lit("[/TABLE]"))
    return whole.select(*key, "section", "block", text.alias("text"))


# --- containers without text of their own -----------------------------------------------------------------------------

#: Labels of layout regions that say nothing of a text.
REGION_LABELS = ("Text Block", "Picture", "Container", "Form Field", "text", "Text", "IMAGE", "Image", "Figure")


def is_container(text: Column, label: Column, source: Column, box: geo.Box) -> Column:
    """GEO-09: whether an element is a region of the layout rather than a recognised text.

    Its formed box has no text, or the text is a region's label or its own; or the box is three times as wide as the text needs, or very
    wide and flat for so few characters; or it bears a region's label and no recogniser as its source.
    """
    t, own = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(label, F.lit("")))
    w, h = F.abs(box[2] - box[0]), F.abs(box[3] - box[1])
    formed = ~(w.isNull() | h.isNull() | (w <= 1e-4) | (h <= 1e-4))
    labels = sorted({x.upper() for x in REGION_LABELS})
    empty = (t == "") | F.upper(t).isin(*labels) | (own != "") & (t == own)
    wide = (t != "") & ((h > 0.1) & (w > F.length(t) * h * 0.45 * 3.0) | (h > 0) & (w / h > 15) & (F.length(t) / h < 0.5))
    generic = (own != "") & F.greatest(*[F.upper(own).contains(x) | F.contains(F.lit(x), F.upper(own)) for x in labels])
    unread = ~F.lower(F.coalesce(source, F.lit(""))).isin("rapidocr", "ocr", "docling_ocr")
    return F.coalesce(formed & empty, F.lit(False)) | F.coalesce(wide, F.lit(False)) | generic & unread


def boxes_from_neighbours(elements: DataFrame, *key: str, reach: float = 0.6) -> DataFrame:
    """AGG-22: containers (key..., ord, box, container) with the joint box of the texts within them: key..., ord, n, l, t, r, b.

    A text counts if it lies within the container, give or take `reach` of the container's height; without any the box stays.
    """
    each = elements.select(*key, "ord", *"ltrb", "container")
    holders = each.where(F.col("container") & (F.abs(F.col("b") - F.col("t")) > 0)).select(*key, F.col("ord").alias("_ord"), *[F.col(c).alias(f"c{c}") for c in "ltrb"])
    texts = each.where(~F.col("container") & ~geo.degenerate(geo.box()))
    give = F.abs(F.col("cb") - F.col("ct")) * reach
    within = (F.col("l") >= F.col("cl") - give) & (F.col("r") <= F.col("cr") + give) & (F.col("t") >= F.col("ct") - give) & (F.col("b") <= F.col("cb") + give)
    # The range condition is checked among the elements of a page.
    joint = holders.join(texts, list(key)).where(within).groupBy(*key, "_ord").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    both = holders.join(joint, [*key, "_ord"], "left")
    return both.select(*key, F.col("_ord").alias("ord"), F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, f"c{c}").alias(c) for c in "ltrb"])


# --- labels and values ------------------------------------------------------------------------------------------------

#: Height within which two elements are of a row; how far right and below a value may stand; scores and confidences of a pair.
ROW, RIGHT, BELOW, LEFT, SCORE, SURE = 0.022, 0.35, 0.045, 0.06, 0.70, 0.72


def fits(label: Column, value: Column) -> Column:
    """JN-13: how well a value suits a label by what both say, from the amounts, banks, codes, numbers and dates that labels ask for."""
    low, v, vl = F.lower(F.trim(label)), F.trim(value), F.lower(F.trim(value))
    has = lambda c, *ws: F.greatest(*[c.contains(w) for w in ws], F.lit(False))
    number, words = v.rlike("^[0-9,.]+$"), sim.amount_in_words(v)
    amount = F.when(has(low, "rupees", "words"), F.when(words, 0.35).when(number, -0.30)).when(low.contains("amount"), F.when(number, 0.35).when(words, 0.15))
    bank = F.when(has(low, "with bank", "bank name"), F.when(has(vl, "bank", "punjab", "hdfc", "sbi", "icici", "axis"), 0.35).when(v.rlike("^[0-9]+$"), -0.40))
    code = F.when(has(low, "code", "ifsc", "micr", "umrn", "reference", "ref") & v.rlike("[0-9]") & ~v.rlike(r"\s{2,}"), 0.30)
    person = F.when(has(low, "pan", "permanent", "account") & (F.upper(v).rlike("[A-Z0-9]{10}") | v.rlike("[0-9]")), 0.35)
    months = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    date = F.when(low.contains("date") & (v.rlike(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}") | has(vl, *months)), 0.35)
    leak = F.when(has(vl, "weekly", "monthly", "daily", "fixed", "maximum"), -0.80)
    noise = F.when(sim.gibberish(v), -0.90)
    parts = [F.coalesce(p, F.lit(0.0)) for p in (amount, bank, code, person, date, leak, noise)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def label_values(elements: DataFrame, *key: str) -> DataFrame:
    """JN-13, WIN-21: key..., label, value, relation of each label with the value that stands right of it or else below it.

    elements: key..., ord, text, class, box, confidence. All pairs that may be are joined and scored; which value a label gets is settled label
    by label in reading order, as a value belongs to one label only: a fold over a page's few scored pairs.
    """
    e = elements.select(*key, "ord", "text", "class", "confidence", *"ltrb")
    labels = e.where("class = 'label'").select(*key, F.col("ord").alias("lo"), F.col("text").alias("label"), F.col("confidence").alias("lc"), *[F.col(c).alias(f"a{c}") for c in "ltrb"])
    values = e.where("class = 'value'").select(*key, F.col("ord").alias("vo"), F.col("text").alias("value"), F.col("confidence").alias("vc"), *[F.col(c).alias(f"v{c}") for c in "ltrb"])
    middle = lambda p: (F.col(f"{p}t") + F.col(f"{p}b")) / 2
    over = F.greatest(F.lit(0.0), F.least("ab", "vb") - F.greatest("at", "vt"))
    row = (F.abs(middle("a") - middle("v")) <= ROW) | (over / F.greatest(F.lit(0.01), F.col("ab") - F.col("at")) >= 0.40)
    dx, dy = F.col("vl") - F.col("ar"), F.col("vt") - F.col("ab")
    right = row & dx.between(-0.02, RIGHT)
    below = dy.between(0.0, BELOW) & ((F.least("ar", "vr") - F.greatest("al", "vl") > 0) | (F.abs(F.col("al") - F.col("vl")) <= LEFT))
    near = labels.join(values, list(key)).where(right | below).withColumns({"right": right, "below": below})
    # Another label between a label and a value to its right keeps them apart.
    others = labels.select(*key, F.col("lo").alias("oo"), F.col("al").alias("ol"), middle("a").alias("om"))
    between = near.alias("n").join(others.alias("o"), list(key)).where((F.col("oo") != F.col("lo")) & (F.col("ar") < F.col("ol")) & (F.col("ol") < F.col("vl")) & (F.abs(F.col("om") - middle("a")) <= ROW))
    parted = between.select(*key, "lo", "vo", F.lit(True).alias("parted")).distinct()
    suits = F.lit(0.50) + fits(F.col("label"), F.col("value"))
    scored = near.join(parted, [*key, "lo", "vo"], "left").select(
        *key, "lo", "vo", "at", "al", "label", "value", F.least("lc", "vc").alias("sure"),
        F.when(F.col("right") & F.col("parted").isNull(), suits + 0.25 - F.greatest(F.lit(0.0), dx) / RIGHT * 0.15).alias("beside"),
        F.when(F.col("below"), suits + 0.15 - dy / BELOW * 0.15).alias("under"),
    )

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        head, taken, out = [pdf[k].iloc[0] for k in key], set(), []
        for _, of in pdf.sort_values(["at", "al", "lo", "vo"], kind="stable").groupby(["at", "al", "lo"], sort=True):
            free = of[~of["vo"].isin(taken)]
            for name, score in (("right_of_label", "beside"), ("below_label", "under")):
                known = free[free[score].notna()]
                if len(known):
                    best = known.loc[known[score].idxmax()]
                    if best[score] >= SCORE and best["sure"] >= SURE:
                        taken.add(best["vo"])
                        out.append((*head, best["label"], best["value"], name))
                    break
        return pd.DataFrame(out, columns=[*key, "label", "value", "relation"])

    kinds = ", ".join(f"{k} {elements.schema[k].dataType.simpleString()}" for k in key)
    return scored.groupBy(*key).applyInPandas(settle, f"{kinds}, label string, value string, relation string")
