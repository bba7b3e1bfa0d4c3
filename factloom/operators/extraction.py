"""From chunks to facts: context, filters, the model's answers, hashes and duplicates within a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Signs of formulas.
SYMBOLS = "=+-*/√∑∏∫αβγδθλμΣΠ()[]{}^_"
CONTEXT_LENGTH = 1000
ANSWER = "facts array<struct<statement:string,canonical_entity:string,raw_attribute:string,value:string,unit:string,temporal_scope:map<string,string>,context:map<string,string>,confidence:double,evidence_quote:string>>"


def context_window(chunks: DataFrame) -> DataFrame:
    """Adds ``context_window``: the text before, the chunk's own text in marks, and the text after it on its page, joined by blank lines
    and cut to a fixed length. Chunks without text add nothing."""
    w = Window.partitionBy("document_id", "page_number").orderBy("reading_order_index", "chunk_id")
    text = F.when((F.col("chunk_type") == "text") & (F.col("text") != ""), F.col("text"))
    own = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.concat(F.lit(">>> "), F.col("text"), F.lit(" <<<")))
    return chunks.withColumn("context_window", F.left(F.concat_ws("\n\n", F.lag(text).over(w), own, F.lead(text).over(w)), F.lit(CONTEXT_LENGTH)))


def is_equation(text: Column) -> Column:
    """A short text that ends with a number in brackets, or a text of which more than 15 % are signs of formulas."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    numbered = stripped.rlike(r"[(\[][0-9a-zA-Z]+[)\]]$") & (F.length(stripped) < 150)
    signs = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce((F.length(text) > 0) & (numbered | (signs / F.length(text) > 0.15)), F.lit(False))


def table_text(table: Column, caption: Column | None = None) -> Column:
    """A table as lines of cells, after a caption if it has one; null cells are empty, null rows are left out."""
    rows = F.filter(table, lambda r: r.isNotNull())
    lines = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")
    return lines if caption is None else F.concat(F.when(caption != "", F.concat(F.lit("Caption: "), caption, F.lit("\n\n"))).otherwise(""), lines)


def route(chunk_type: Column) -> Column:
    """The prompt for a chunk: ``text``, ``table`` or ``chart`` (images go to a model that sees); others get none."""
    return F.when(chunk_type == "text", "text").when(chunk_type == "table", "table").when(chunk_type == "chart_candidate", "chart")


def source_type(chunk_type: Column) -> Column:
    """The source of a fact by its chunk."""
    return F.when(chunk_type == "chart_candidate", "chart").when(chunk_type == "table", "table").otherwise("text")


def parse_answers(answers: DataFrame) -> DataFrame:
    """``chunk_id, fact_no, ...``: the facts of a model's answers ``chunk_id, answer``. Broken JSON, or one fact without a required member,
    voids the whole answer."""
    held = answers.withColumn("facts", F.from_json("answer", ANSWER)["facts"])
    needed = ("statement", "canonical_entity", "raw_attribute", "value", "confidence")
    whole = held.filter(F.forall("facts", lambda f: _all_set(f, needed)))
    return whole.select("chunk_id", F.posexplode("facts").alias("fact_no", "f")).select("chunk_id", "fact_no", "f.*")


def _all_set(f: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & f[n].isNotNull()
    return out


def passes_evidence_gate(source_type: Column, quote: Column) -> Column:
    """Facts of texts and tables need a quote; those of charts do not."""
    return F.coalesce((source_type == "chart") | (quote != ""), F.lit(False))


def content_hash(entity: Column, attribute: Column, value: Column, scope_text: Column) -> Column:
    strip = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.sha2(F.concat_ws("|", F.coalesce(entity, F.lit("")), F.coalesce(attribute, F.lit("")), F.coalesce(strip, F.lit("")), F.coalesce(scope_text, F.lit(""))), 256)


def dedup_within_document(facts: DataFrame) -> DataFrame:
    """First fact per document and hash, with the number of its deliveries and the pages where it occurs in order."""
    keyed = facts.groupBy("document_id", F.lower("content_hash").alias("hash")).agg(F.min(F.struct("ingest_seq", "fact_id")).alias("first"), F.count("*").alias("n_facts"), F.array_sort(F.collect_set("source_chunk_id")).alias("chunks"))
    return keyed.select("document_id", "hash", F.col("first.fact_id").alias("fact_id"), "n_facts", F.size("chunks").alias("n_chunks"))


def occurrences(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``document_id, hash, nth, page_number, bbox``: the distinct places of the facts that are one by :func:`dedup_within_document`, in the order of arrival from 0.
    Facts without a chunk have no place. One row per place, so no group is gathered in a list."""
    placed = facts.select("document_id", F.lower("content_hash").alias("hash"), "ingest_seq", F.col("source_chunk_id").alias("chunk_id")).join(chunks.select("chunk_id", "page_number", "bbox"), "chunk_id")
    first = placed.groupBy("document_id", "hash", "page_number", "bbox").agg(F.min(F.struct("ingest_seq", "chunk_id")).alias("at"))
    w = Window.partitionBy("document_id", "hash").orderBy("at")
    return first.select("document_id", "hash", (F.row_number().over(w) - 1).alias("nth"), "page_number", "bbox")


def extract(chunks: DataFrame, extractor: Callable[[list[dict]], list[str]], columns: tuple[str, ...] = ("chunk_id", "chunk_type", "text", "context_window")) -> DataFrame:
    """Runs an injected extractor over chunks (``document_id, page_number, bbox, image_path, context_window`` beside ``columns``) in Arrow batches and makes facts of its answers.

    The equation filter runs before it; each record carries the ``prompt`` that its type takes (:func:`route`), types without one are left out. An answer that is
    broken, or a batch on which the extractor fails, gives no facts; the other chunks keep theirs. Facts of texts and tables without a quote are dropped, facts of charts carry
    the chunk's image, and each has its source type, place and ``content_hash``.
    """
    ready = chunks.filter(~F.coalesce((F.col("chunk_type") == "text") & is_equation(F.col("text")), F.lit(False))).withColumn("prompt", route(F.col("chunk_type"))).filter("prompt is not null")

    def one(record: dict) -> str | None:
        try:
            return extractor([record])[0]
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            records = b.to_dict("records")
            try:
                answers = extractor(records)
            except Exception:  # noqa: BLE001
                answers = [one(r) for r in records]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "answer": answers})

    said = parse_answers(ready.select(*columns, "prompt").mapInPandas(run, "chunk_id string, answer string"))
    held = said.join(chunks.select("chunk_id", "document_id", "chunk_type", "page_number", "bbox", "image_path", F.when(F.col("chunk_type") == "text", F.col("context_window")).alias("evidence_context_window")), "chunk_id")
    held = held.withColumn("source_type", source_type(F.col("chunk_type"))).filter(passes_evidence_gate(F.col("source_type"), F.coalesce("evidence_quote", F.lit(""))))
    image = F.create_map(F.lit("image_path"), F.col("image_path"))
    context = F.coalesce("context", F.create_map().cast("map<string,string>"))
    held = held.withColumn("context", F.when((F.col("source_type") == "chart") & F.col("image_path").isNotNull(), F.map_concat(F.map_filter(context, lambda k, _: k != "image_path"), image)).otherwise(F.col("context")))
    scope = F.array_join(F.transform(F.array_sort(F.map_entries("temporal_scope")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return held.withColumn("content_hash", content_hash(F.col("canonical_entity"), F.col("raw_attribute"), F.col("value"), scope)).drop("chunk_type", "image_path")
