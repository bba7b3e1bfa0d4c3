"""Page scans: a pluggable decoder of stored documents, and blocks, words and images derived from stored chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
BLOCKS = "document_id string, page_number int, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"


def decode(spark: SparkSession, path: str, decoder: Callable[[str, bytes], Iterable[tuple]], schema: str = BLOCKS, glob: str = "*.pdf") -> DataFrame:
    """Blocks of all files below ``path``; ``decoder(name, bytes)`` yields rows of ``schema``. A file that cannot be decoded gives no rows; :func:`undecodable` lists it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = list(decoder(name, content))
                except Exception:  # noqa: BLE001, S112
                    continue
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def undecodable(spark: SparkSession, path: str, decoder: Callable[[str, bytes], Iterable[tuple]], glob: str = "*.pdf") -> DataFrame:
    """``path, message`` of the files on which the decoder fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    list(decoder(name, content))
                except Exception as e:  # noqa: BLE001
                    bad.append((name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(bad, columns=["path", "message"])

    return files.mapInPandas(run, "path string, message string")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk; repeated chunks are equal."""
    return chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"])


def blocks_of(chunks: DataFrame) -> DataFrame:
    """Text blocks of pages in page units: texts and tables are of type 0, charts of type 1."""
    w = Window.partitionBy("document_id", "page_number").orderBy("reading_order_index", "chunk_id")
    b = F.col("bbox")
    return chunks.select("chunk_id", "document_id", "page_number", (F.row_number().over(w) - 1).alias("block_no"), F.when(F.col("chunk_type") == "chart_candidate", 1).otherwise(0).alias("block_type"), (b["x0"] * PAGE_WIDTH).alias("x0"), (b["y0"] * PAGE_HEIGHT).alias("y0"), (b["x1"] * PAGE_WIDTH).alias("x1"), (b["y1"] * PAGE_HEIGHT).alias("y1"), "text", F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"))


def words_of(chunks: DataFrame) -> DataFrame:
    """Cells of tables laid out on a grid of their page as words with geometry."""
    cells = chunks.filter("table_data is not null").select("chunk_id", "document_id", "page_number", "bbox", F.posexplode("table_data").alias("r", "row")).filter("row is not null").select("*", F.posexplode("row").alias("c", "text")).filter("text is not null and text <> ''")
    x0 = F.floor(F.col("bbox.x0") * 100) * 2 + F.col("c") * 90
    top = F.floor(F.col("bbox.y0") * 100) * 5 + F.col("r") * 14
    return cells.select("document_id", "page_number", F.concat_ws("-", "chunk_id", F.col("r").cast("string"), F.col("c").cast("string")).alias("word_no"), x0.cast("double").alias("x0"), (x0 + F.least(F.length("text") * 5, F.lit(80))).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 11).cast("double").alias("bottom"), "text", F.lit(PAGE_WIDTH).alias("page_width"))


def images_of(chunks: DataFrame) -> DataFrame:
    """Rectangles of charts in page units, numbered on each page."""
    w = Window.partitionBy("document_id", "page_number").orderBy("reading_order_index", "chunk_id")
    b = F.col("bbox")
    return chunks.filter("chunk_type = 'chart_candidate'").select(F.col("chunk_id").alias("image_id"), "document_id", "page_number", (F.row_number().over(w) - 1).alias("image_no"), (b["x0"] * PAGE_WIDTH).alias("x0"), (b["y0"] * PAGE_HEIGHT).alias("y0"), (b["x1"] * PAGE_WIDTH).alias("x1"), (b["y1"] * PAGE_HEIGHT).alias("y1"))
