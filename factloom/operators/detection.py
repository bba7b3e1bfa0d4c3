"""Tables and charts on pages: lines of words, tabular runs, regions, images and captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.layout import PAGE

X_JUMP = 0.25
ANCHOR, DRIFT, MIN_RUN, MARGIN = 20, 15, 3, 4
MERGE_SHARE = 0.5
CAPTION_DISTANCE = 30.0
# Words that a caption has.
CAPTION = r"(?i)\b(figure|fig\.?|chart|diagram|exhibit|graph|plot|image|photo)\b"


def lines_of_words(words: DataFrame) -> DataFrame:
    """``document_id, page_number, line_y, part, x0, x1, text``: words on one height, cut where the step to the next word is wide.

    Words: ``document_id, page_number, word_no, x0, x1, top, bottom, text, page_width``. Heights are rounded half to even.
    """
    line = words.withColumn("line_y", F.bround((F.col("top") + F.col("bottom")) / 2, 0).cast("int"))
    w = Window.partitionBy(*PAGE, "line_y").orderBy("x0", "word_no")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) > X_JUMP * F.col("page_width")).cast("int"), F.lit(0))
    parts = line.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda s: s["text"]), " ")
    return parts.groupBy(*PAGE, "line_y", "part").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), text.alias("text"))


def tag_tabular(lines: DataFrame) -> DataFrame:
    """Adds ``tabular`` (short, and with a digit or very short) and ``col_anchor`` (left edge on a grid, half to even)."""
    short = F.length("text") < 60
    tab = short & (F.col("text").rlike(r"\p{Nd}") | (F.length("text") < 20))
    return lines.withColumn("tabular", tab).withColumn("col_anchor", (F.bround(F.col("left") / ANCHOR, 0) * ANCHOR).cast("int"))


def tabular_runs(tagged: DataFrame) -> DataFrame:
    """``document_id, page_number, col_anchor, run, n_lines, left, right, top_y, bottom_y``: runs of tabular lines below each other.

    A line continues a run while its left edge stays within DRIFT of the run's first line; else it begins a new run. That depends on the run's
    beginning, so a page's few lines per anchor are folded in order.
    """
    lines = F.array_sort(F.collect_list(F.struct(F.col("line_y").alias("y"), "part", "left", "right", "tabular")))
    per = tagged.groupBy(*PAGE, "col_anchor").agg(lines.alias("ls"))
    start = F.struct(F.lit(0).alias("run"), F.lit(None).cast("double").alias("x"), F.array().cast("array<struct<run:int,y:int,left:double,right:double>>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        same = s["x"].isNotNull() & (F.abs(line["left"] - s["x"]) <= DRIFT)
        run = F.when(same, s["run"]).otherwise(s["run"] + 1)
        item = F.array(F.struct(run.alias("run"), line["y"].alias("y"), line["left"].alias("left"), line["right"].alias("right")))
        return F.when(line["tabular"], F.struct(run.alias("run"), F.when(same, s["x"]).otherwise(line["left"]).alias("x"), F.concat(s["out"], item).alias("out"))).otherwise(F.struct(s["run"].alias("run"), F.lit(None).cast("double").alias("x"), s["out"].alias("out")))

    items = per.select(*PAGE, "col_anchor", F.explode(F.aggregate("ls", start, step, lambda s: s["out"])).alias("i")).select(*PAGE, "col_anchor", "i.*")
    runs = items.groupBy(*PAGE, "col_anchor", "run").agg(F.count("*").alias("n_lines"), F.min("left").alias("left"), F.max("right").alias("right"), F.min("y").alias("top_y"), F.max("y").alias("bottom_y"))
    return runs.filter(F.col("n_lines") >= MIN_RUN)


def _merge(boxes: list[list[float]]) -> list[list[float]]:
    """Repeats until nothing changes: a region takes in every later one that overlaps it in height by half of the lower one."""
    changed = True
    while changed:
        changed = False
        i = 0
        while i < len(boxes):
            j = i + 1
            while j < len(boxes):
                a, b = boxes[i], boxes[j]
                lower = min(a[3] - a[1], b[3] - b[1])
                if lower > 0 and (min(a[3], b[3]) - max(a[1], b[1])) / lower >= MERGE_SHARE:
                    boxes[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    boxes.pop(j)
                    changed = True
                else:
                    j += 1
            i += 1
    return boxes


def merge_regions(runs: DataFrame, width: float = float("inf"), height: float = float("inf")) -> DataFrame:
    """Regions of a page: the runs' boxes with a margin, clamped to the page (from 0 to ``width`` and ``height``), merged in order while they grow. A page's runs are few; the order matters,
    so the fixpoint runs per page on Arrow batches."""

    def per_page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["col_anchor", "run"])
        boxes = [[max(0.0, r.left - MARGIN), max(0.0, r.top_y - MARGIN), min(width, r.right + MARGIN), min(height, r.bottom_y + MARGIN)] for r in pdf.itertuples()]
        out = _merge([list(map(float, b)) for b in boxes])
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "page_number": pdf["page_number"].iloc[0], "region": range(len(out)), "x0": [b[0] for b in out], "y0": [b[1] for b in out], "x1": [b[2] for b in out], "y1": [b[3] for b in out]})

    return runs.groupBy(*PAGE).applyInPandas(per_page, "document_id string, page_number int, region int, x0 double, y0 double, x1 double, y1 double")


def first_pass(tables: DataFrame) -> DataFrame:
    """Of each page the tables of the first detection pass that found any. Tables: page keys, ``pass``, ``table_no``."""
    w = Window.partitionBy(*PAGE)
    return tables.withColumn("best", F.min("pass").over(w)).filter(F.col("pass") == F.col("best")).drop("best")


def distinct_images(images: DataFrame) -> DataFrame:
    """One rectangle per rounded position on a page, the first."""
    r = [F.bround(F.col(k), 2).alias(f"r_{k}") for k in ("x0", "y0", "x1", "y1")]
    keys = [*PAGE, "r_x0", "r_y0", "r_x1", "r_y1"]
    return images.select("*", *r).groupBy(*keys).agg(F.min("image_no").alias("image_no"))


def chart_candidates(images: DataFrame, covers: DataFrame, least: float = 0.5) -> DataFrame:
    """Images with an area that no text or table covers by half. ``image_no`` counts all images, also those left out."""
    from factloom.operators.layout import without_covered

    real = images.filter("x1 > x0 and y1 > y0")
    return without_covered(real, covers, "image_id", least)


def captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """``image_id, caption``: the first text with a caption's word that overlaps the image's width and ends or begins within 30 points; null if none."""
    b = blocks.filter(F.col("text").rlike(CAPTION)).select(*PAGE, "block_no", "text", *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    above = (F.col("y0") - F.col("b_y1")).between(0, CAPTION_DISTANCE)
    below = (F.col("b_y0") - F.col("y1")).between(0, CAPTION_DISTANCE)
    wide = F.least("x1", "b_x1") > F.greatest("x0", "b_x0")
    hit = images.join(b, PAGE).filter(wide & (above | below)).groupBy("image_id").agg(F.min_by("text", "block_no").alias("caption"))
    return images.select("image_id").join(hit, "image_id", "left")
