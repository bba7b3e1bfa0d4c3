"""Page layout: running heads and feet, columns, paragraphs and reading order, from blocks with geometry.

Blocks: ``document_id, page_number, block_no, block_type, x0, y0, x1, y1, text, page_width, page_height``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = ["document_id", "page_number"]
BAND, HEADER, FOOTER = 0.02, 0.15, 0.85
MIN_PAGES, MIN_SHARE = 2, 0.5
NARROW, WIDE = 0.08, 0.50
GAP_FACTOR, GAP, MAX_COLUMNS = 1.5, 0.15, 3
SPAN_SHARE = 0.70
PARAGRAPH_GAP = 0.015


def normalise_boxes(blocks: DataFrame) -> DataFrame:
    """Coordinates as shares of the page; pages without size are left out."""
    size = blocks.filter((F.col("page_width") > 0) & (F.col("page_height") > 0))
    return size.withColumns({"x0": F.col("x0") / F.col("page_width"), "x1": F.col("x1") / F.col("page_width"), "y0": F.col("y0") / F.col("page_height"), "y1": F.col("y1") / F.col("page_height")})


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("block_type") == 0) & (F.regexp_replace(F.col("text"), r"^\s+|\s+$", "") != ""))


def _y_mid() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def running_bands(blocks: DataFrame) -> DataFrame:
    """``document_id, lo, hi, kind``: bands that hold a block on at least half of the pages (two at least) near the top or the foot.

    Heights are chained into clusters while the step is at most BAND (``lag`` and a running sum); a band lies around each mean. Blocks are
    normalised. A document may hold any share of the blocks: equal heights are counted first, so that the window and the join see a document's distinct heights
    (each with its pages) and not its blocks. All pages count, also those without text.
    """
    mids = blocks.filter("block_type = 0").select(*PAGE, _y_mid().alias("y"))
    heights = mids.groupBy("document_id", "y").agg(F.count("*").alias("n"), F.collect_set("page_number").alias("pages"))
    w = Window.partitionBy("document_id").orderBy("y")
    stepped = heights.withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(w) > BAND).cast("int"), F.lit(1)))
    clusters = stepped.withColumn("c", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("document_id", "c").agg(F.round(F.sum(F.col("y") * F.col("n")) / F.sum("n"), 6).alias("centre"))
    bands = clusters.filter((F.col("centre") < HEADER) | (F.col("centre") > FOOTER)).select("document_id", "centre")
    pages = blocks.select(*PAGE).distinct().groupBy("document_id").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= 2)
    near = bands.join(heights, "document_id").filter(F.abs(F.col("y") - F.col("centre")) <= BAND + 1e-9)
    hits = near.select("document_id", "centre", F.explode("pages").alias("page")).distinct().groupBy("document_id", "centre").agg(F.count("*").alias("hits"))
    kept = hits.join(pages, "document_id").filter((F.col("hits") >= MIN_PAGES) & (F.col("hits") >= MIN_SHARE * F.col("n_pages")))
    return kept.select("document_id", F.round(F.col("centre") - BAND, 6).alias("lo"), F.round(F.col("centre") + BAND, 6).alias("hi"), F.when(F.col("centre") < HEADER, "header").otherwise("footer").alias("kind"), "hits")


def strip_bands(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Blocks whose middle lies in no band of their document."""
    b = bands.select(F.col("document_id").alias("band_document"), "lo", "hi")
    return blocks.join(b, (F.col("document_id") == F.col("band_document")) & _y_mid().between(F.col("lo") - 1e-9, F.col("hi") + 1e-9), "left_anti")


def covered_share(a: str, b: str) -> Column:
    """Share of box a that box b covers; 0 for boxes that only touch."""
    c = lambda s, k: F.col(f"{s}_{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = (c(a, "x1") - c(a, "x0")) * (c(a, "y1") - c(a, "y0"))
    return F.when(area > 0, w * h / area).otherwise(0.0)


def without_covered(blocks: DataFrame, others: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """Blocks of which no other box of the page covers ``least`` of the area. ``key`` identifies a block."""
    a = blocks.select(*PAGE, F.col(key).alias("a_key"), *[F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1")])
    b = others.select(*PAGE, *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    gone = a.join(b, PAGE).filter(covered_share("a", "b") >= least).select(F.col("a_key").alias(key)).distinct()
    return blocks.join(gone, key, "left_anti")


def column_centres(blocks: DataFrame) -> DataFrame:
    """``document_id, page_number, col_index, centre``: centres of the columns of each page.

    Distinct middles of blocks of column width (else of all blocks) are split at wide gaps; beyond MAX_COLUMNS clusters the nearest
    neighbours merge. A page has few blocks; the sorted middles of a page are folded as an array.
    """
    mid, width = (F.col("x0") + F.col("x1")) / 2, F.col("x1") - F.col("x0")
    fits = width.between(NARROW, WIDE)
    sets = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.when(fits, F.round(mid, 6)))).alias("narrow"), F.array_sort(F.collect_set(F.round(mid, 6))).alias("every"))
    mids = sets.select(*PAGE, F.when(F.size("narrow") > 0, F.col("narrow")).otherwise(F.col("every")).alias("m"))
    gaps = F.zip_with(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), F.col("m"), lambda x, y: x - y)
    with_gap = mids.withColumn("g", F.filter(gaps, lambda x: x.isNotNull())).withColumn("mean_gap", F.when(F.size("g") > 0, F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.size("g")).otherwise(0.0))
    exploded = with_gap.select(*PAGE, "mean_gap", F.posexplode("m").alias("i", "x"))
    w = Window.partitionBy(*PAGE).orderBy("i")
    gap = F.col("x") - F.lag("x").over(w)
    new = F.coalesce(((gap > GAP_FACTOR * F.col("mean_gap")) | (gap >= GAP)).cast("int"), F.lit(0))
    clusters = exploded.withColumn("new", new).withColumn("c", F.sum("new").over(w)).groupBy(*PAGE, "c").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    folded = clusters.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("c", "s", "n"))).alias("cs"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("cs") - MAX_COLUMNS, F.lit(1))), lambda i: i)
    merged = F.when(F.size("cs") <= MAX_COLUMNS, F.col("cs")).otherwise(F.aggregate(steps, F.col("cs"), lambda cs, _: _merge_nearest(cs)))
    centres = folded.select(*PAGE, F.posexplode(F.transform(merged, lambda c: c["s"] / c["n"])).alias("col_index", "centre"))
    return centres.select(*PAGE, "col_index", F.round("centre", 6).alias("centre"))


def _merge_nearest(cs: Column) -> Column:
    """Merges the first pair of neighbouring clusters with the smallest distance of their means."""
    mean = F.transform(cs, lambda c: c["s"] / c["n"])
    dist = F.zip_with(F.slice(mean, 2, F.size(mean) - 1), F.slice(mean, 1, F.size(mean) - 1), lambda x, y: F.round(x - y, 9))
    at = F.array_position(dist, F.array_min(dist)).cast("int")
    a, b = F.element_at(cs, at), F.element_at(cs, at + 1)
    joined = F.array(F.struct(a["c"].alias("c"), (a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")))
    return F.concat(F.slice(cs, F.lit(1), at - 1), joined, F.slice(cs, at + 2, F.size(cs)))


def assign_columns(blocks: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds ``col_index`` of the nearest centre; ties go to the lower index."""
    keyed = blocks.withColumn("mid", F.round((F.col("x0") + F.col("x1")) / 2, 6))
    near = keyed.join(centres, PAGE).groupBy(*PAGE, "block_no").agg(F.min_by("col_index", F.struct(F.round(F.abs(F.col("mid") - F.col("centre")), 9), "col_index")).alias("col_index"))
    return blocks.join(near, [*PAGE, "block_no"])


def column_bands(centres: DataFrame) -> DataFrame:
    """``lo, hi`` of each column: halfway to its neighbours, 0 and 1 at the edges."""
    w = Window.partitionBy(*PAGE).orderBy("col_index")
    lo = F.coalesce((F.col("centre") + F.lag("centre").over(w)) / 2, F.lit(0.0))
    hi = F.coalesce((F.col("centre") + F.lead("centre").over(w)) / 2, F.lit(1.0))
    return centres.select(*PAGE, "col_index", F.round(lo, 7).alias("lo"), F.round(hi, 7).alias("hi"))


def classify_spans(blocks: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds ``col_index`` (-1: spans columns) and ``spanning``: a block belongs to the band that holds most of its width if that is 70 % or more."""
    width = F.col("x1") - F.col("x0")
    held = F.greatest(F.lit(0.0), F.least("x1", "hi") - F.greatest("x0", "lo"))
    share = F.when(width > 0, F.round(held / width, 9)).otherwise(0.0)
    best = blocks.join(bands, PAGE).withColumn("share", share).groupBy(*PAGE, "block_no").agg(F.max(F.struct("share", (-F.col("col_index")).alias("neg"))).alias("m"))
    inside = F.col("m.share") >= SPAN_SHARE
    return blocks.join(best, [*PAGE, "block_no"]).withColumn("col_index", F.when(inside, -F.col("m.neg")).otherwise(-1).cast("int")).withColumn("spanning", ~inside).drop("m")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks of a column that follow each other closely become one: ``x0, y0, x1, y1, text, first_block, n_blocks``. White space is taken off where
    texts meet, and stays at the ends."""
    w = Window.partitionBy(*PAGE, "col_index").orderBy("y0", "block_no")
    new = F.coalesce((F.round(F.col("y0") - F.lag("y1").over(w), 9) >= PARAGRAPH_GAP).cast("int"), F.lit(1))
    runs = blocks.filter("not spanning").withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    strip = F.regexp_replace("text", r"^\s+|\s+$", "")
    pieces = F.array_sort(F.collect_list(F.when(strip != "", F.struct("y0", "block_no", strip.alias("t")))))
    ends = F.struct("y0", "block_no")
    lead, trail = F.min_by(F.regexp_extract("text", r"^(\s*)", 1), ends), F.max_by(F.regexp_extract("text", r"(\s*)$", 1), ends)
    grouped = runs.groupBy(*PAGE, "col_index", "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("top"), F.max("x1").alias("x1"), F.max_by("y1", ends).alias("y1"), F.concat(lead, F.array_join(F.transform(pieces, lambda p: p["t"]), " "), trail).alias("text"), F.min_by("block_no", ends).alias("first_block"), F.count("*").alias("n_blocks"))
    return grouped.withColumnRenamed("top", "y0").drop("run")


def order_blocks(merged: DataFrame, spanning: DataFrame) -> DataFrame:
    """``order_index`` on each page: column by column where nothing spans columns, else all by height with spanning blocks first at ties."""
    cols = [*PAGE, "col_index", "x0", "y0", "x1", "y1", "text", "first_block"]
    both = merged.withColumn("spanning", F.lit(False)).select(*cols, "spanning").unionByName(spanning.withColumn("first_block", F.col("block_no")).select(*cols, "spanning"))
    page = Window.partitionBy(*PAGE)
    mixed = F.max(F.col("spanning").cast("int")).over(page) == 1
    keyed = both.withColumn("k", F.when(mixed, F.lit(0)).otherwise(F.col("col_index")))
    return keyed.withColumn("order_index", F.row_number().over(page.orderBy("k", "y0", F.desc("spanning"), "first_block")) - 1).drop("k")


def layout(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The whole of it: heads and feet off, what tables cover off, columns, spans, paragraphs, order. Input in page units."""
    norm = normalise_boxes(text_blocks(blocks))
    body = strip_bands(norm, running_bands(normalise_boxes(blocks)))
    if tables is not None:
        keyed = body.withColumn("key", F.struct(*PAGE, "block_no"))
        body = without_covered(keyed, normalise_boxes(tables), "key").drop("key")
    spans = classify_spans(body, column_bands(column_centres(body)))
    return order_blocks(merge_paragraphs(spans), spans.filter("spanning"))


def reading_order(chunks: DataFrame) -> DataFrame:
    """Index on each page by (top, left); tables before texts before charts at ties."""
    rank = F.when(F.col("chunk_type") == "table", 0).when(F.col("chunk_type") == "text", 1).otherwise(2)
    w = Window.partitionBy(*PAGE).orderBy("bbox.y0", "bbox.x0", rank, "chunk_id")
    return chunks.select("chunk_id", *PAGE, (F.row_number().over(w) - 1).alias("order_index"))
