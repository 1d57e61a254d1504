"""Token-level operators: words of a page with boxes, spatial joins, windows and ordered folds.

Spatial joins carry an equi-key (document, page), so a partition is a page and the range condition is checked within it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions import geometry as geo

LINES = 40


def tokens(rows: DataFrame, key: str = "extraction_id", text: str = "_formatted_text") -> DataFrame:
    """Words of texts with boxes from their line and place in it: key, page, ord, word, l, t, r, b (0 to 1)."""
    lines = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    words = lines.select(key, "line", F.posexplode(F.split("s", " ")).alias("pos", "word")).where(F.col("word") != "")
    page, row = F.floor(F.col("line") / LINES) + 1, F.col("line") % LINES
    return words.select(
        key, page.cast("int").alias("page"), (F.col("line") * 1000 + F.col("pos")).alias("ord"), "word",
        (F.col("pos") * 0.05).alias("l"), (row * 0.025).alias("t"), (F.col("pos") * 0.05 + F.least(F.length("word") * 0.01, F.lit(0.045))).alias("r"), (row * 0.025 + 0.02).alias("b"),
    )


def cells(toks: DataFrame, key: str) -> DataFrame:
    """A grid of table cells over each page (4 rows by 2 columns), to join tokens with: key, page, cell, cl, ct, cr, cb."""
    pages = toks.select(key, "page").distinct()
    grid = pages.select(key, "page", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cell"))
    col, row = F.col("cell") % 2, F.floor(F.col("cell") / 2)
    return grid.select(key, "page", "cell", (col * 0.25).alias("cl"), (row * 0.25).alias("ct"), (col * 0.25 + 0.25).alias("cr"), (row * 0.25 + 0.25).alias("cb"))


def fuse_cells(toks: DataFrame, grid: DataFrame, key: str, least: float = 0.40) -> DataFrame:
    """JN-10: tokens that belong to a cell (centre inside, or an overlap of `least`), joined to the cell's text in reading order."""
    a, c = geo.box(), geo.box("c")
    joined = toks.join(grid, [key, "page"]).where(geo.centre_inside(a, c) | (geo.overlap(a, c) >= least))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ")
    return joined.groupBy(key, "page", "cell").agg(text.alias("text"), F.count(F.lit(1)).alias("n"))


def outside(toks: DataFrame, grid: DataFrame, key: str, least: float = 0.60) -> DataFrame:
    """JN-11, JN-12: tokens that no cell covers; an anti join with a range condition."""
    return toks.alias("a").join(
        grid.alias("c"),
        (F.col(f"a.{key}") == F.col(f"c.{key}")) & (F.col("a.page") == F.col("c.page")) & (geo.overlap(geo.box("a."), geo.box("c.c")) >= least),
        "left_anti",
    )


def best_cell(toks: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """JN-15: for each token the cell that holds most of it (ties: the lower cell), with the share."""
    share = F.round(geo.overlap(geo.box(), geo.box("c")), 6)
    joined = toks.join(grid, [key, "page"]).withColumn("share", share).where("share > 0")
    best = F.max_by(F.struct("cell", "share"), F.struct("share", -F.col("cell")))
    return joined.groupBy(key, "page", "ord").agg(best.alias("x")).select(key, "page", "ord", "x.cell", "x.share")


def page_windows(toks: DataFrame, key: str, longest: int = 7, band: float = 0.035, gap: float = 0.06) -> DataFrame:
    """WIN-08: all runs of 2 to `longest` consecutive tokens of a page, with joined text and merged box.

    A run goes on over line ends: where a token lies more than `band` off the first one's line, no two tokens after each
    other may be more than `gap` apart in height.
    """
    ahead = W.partitionBy(key, "page").orderBy("ord").rowsBetween(0, longest - 1)
    runs = toks.select(key, "page", "ord", F.collect_list(F.struct("word", "l", "t", "r", "b")).over(ahead).alias("ws")).where("size(ws) >= 2")
    runs = runs.select(key, "page", "ord", "ws", F.explode(F.expr("sequence(2, size(ws))")).alias("k")).withColumn("ws", F.expr("slice(ws, 1, k)"))
    one_line = F.expr(f"forall(ws, x -> abs(x.t - ws[0].t) <= {band})")
    close = F.expr(f"forall(sequence(1, k - 1), i -> ws[i].t - ws[i - 1].b <= {gap})")
    sides = [F.expr(f"{f}(ws.{c})").alias(c) for f, c in (("array_min", "l"), ("array_min", "t"), ("array_max", "r"), ("array_max", "b"))]
    return runs.where(one_line | close).select(key, "page", "ord", "k", F.array_join("ws.word", " ").alias("text"), *sides)


def windows(toks: DataFrame, key: str, longest: int = 4) -> DataFrame:
    """All runs of 2 to `longest` consecutive tokens of one line, with joined text and merged box; see page_windows for WIN-08."""
    line = W.partitionBy(key, "page", "t").orderBy("ord")
    out = None
    for k in range(2, longest + 1):
        frame = line.rowsBetween(0, k - 1)
        run = toks.select(
            key, "page", "ord", F.collect_list("word").over(frame).alias("ws"), F.col("l"), F.max("r").over(frame).alias("r"), F.col("t"), F.max("b").over(frame).alias("b")
        ).where(F.size("ws") == k)
        run = run.select(key, "page", "ord", F.lit(k).alias("k"), F.array_join("ws", " ").alias("text"), "l", "t", "r", "b")
        out = run if out is None else out.unionByName(run)
    return out


def islands(toks: DataFrame, key: str, gap: float) -> DataFrame:
    """WIN-03, WIN-13: a line split into runs where the gap to the token before exceeds `gap`."""
    line = W.partitionBy(key, "page", "t").orderBy("ord")
    broken = F.coalesce((F.col("l") - F.lag("r").over(line) > gap).cast("int"), F.lit(0))
    marked = toks.withColumn("_new", broken).withColumn("run", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "page", "t", "run").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("l"), F.max("r").alias("r"))


def uniformity(toks: DataFrame, key: str) -> DataFrame:
    """WIN-05: per line the variation of widths and of distances between tokens (sample deviation over mean)."""
    line = W.partitionBy(key, "page", "t").orderBy("ord")
    spaced = toks.select(key, "page", "t", (F.col("r") - F.col("l")).alias("w"), (F.col("l") - F.lag("l").over(line)).alias("pitch"))
    cv = lambda c: F.stddev_samp(c) / F.avg(c)
    return spaced.groupBy(key, "page", "t").agg(F.count(F.lit(1)).alias("n"), cv("w").alias("width_cv"), cv("pitch").alias("pitch_cv")).where("n >= 3")


def cluster_rows(toks: DataFrame, key: str, tolerance: float = 0.015) -> DataFrame:
    """WIN-01: rows of a page by centre height, where each row's centre is the running mean of its tokens. An ordered fold per page."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "l", "ord"], kind="stable")
        rows, row, mean, n = [], -1, 0.0, 0
        for t, b in zip(pdf["t"], pdf["b"]):
            y = (t + b) / 2
            if row < 0 or abs(y - mean) > tolerance:
                row, mean, n = row + 1, y, 1
            else:
                mean, n = (mean * n + y) / (n + 1), n + 1
            rows.append(row)
        return pdf.assign(row=rows)[[key, "page", "ord", "row"]]

    kind = toks.schema[key].dataType.simpleString()
    return toks.groupBy(key, "page").applyInPandas(fold, f"{key} {kind}, page int, ord int, row int")


def spatial_dedupe(toks: DataFrame, key: str, same_text: float = 0.20, any_text: float = 0.85) -> DataFrame:
    """DED-04: tokens that no kept token before them repeats: the same text with some overlap, or any text with nearly the same box."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        kept: list[tuple] = []
        keep = []
        for w, l, t, r, b in zip(pdf["word"], pdf["l"], pdf["t"], pdf["r"], pdf["b"]):
            double = False
            for w2, l2, t2, r2, b2 in kept:
                both = max(0.0, min(r, r2) - max(l, l2)) * max(0.0, min(b, b2) - max(t, t2))
                own, other = (r - l) * (b - t), (r2 - l2) * (b2 - t2)
                iou = both / (own + other - both) if own + other > both else 0.0
                if iou >= any_text or w == w2 and (iou >= same_text or own > 0 and both / own >= same_text):
                    double = True
                    break
            keep.append(not double)
            if not double:
                kept.append((w, l, t, r, b))
        return pdf[keep][[key, "page", "ord", "word"]]

    kind = toks.schema[key].dataType.simpleString()
    return toks.groupBy(key, "page").applyInPandas(fold, f"{key} {kind}, page int, ord int, word string")


def nearest_right(toks: DataFrame, key: str, reach: float = 0.35) -> DataFrame:
    """JN-13, JN-14: for each label (a word that ends with a colon) the nearest word right of it on its line."""
    line = W.partitionBy(key, "page", "t").orderBy("ord")
    nxt = toks.select(key, "page", "ord", "word", F.lead("word").over(line).alias("value"), (F.lead("l").over(line) - F.col("r")).alias("dx"))
    return nxt.where(F.col("word").endswith(":") & F.col("value").isNotNull() & (F.col("dx") <= reach)).select(key, "page", "ord", F.rtrim(F.col("word"), F.lit(":")).alias("label"), "value")
