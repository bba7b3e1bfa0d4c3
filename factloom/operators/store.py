"""The fact store: keyed writes, deletes and the reads of the browsing interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_facts(facts: DataFrame) -> DataFrame:
    """One row per ``fact_id``, the one that arrived last. Null ids are left out."""
    cols = [c for c in facts.columns if c != "fact_id"]
    return facts.filter("fact_id is not null").groupBy("fact_id").agg(F.max_by(F.struct(*cols), "ingest_seq").alias("f")).select("fact_id", "f.*")


def relationship_rank(typed_first: bool = False) -> Column:
    first = [F.col("relationship_type").isNotNull()] if typed_first else []
    return F.struct(*first, F.coalesce("created_at", F.lit(float("-inf"))), F.coalesce("relationship_type", F.lit("")), F.coalesce("confidence", F.lit(0.0)), F.coalesce("justification", F.lit("")))


def latest_relationships(edges: DataFrame, typed_first: bool = False) -> DataFrame:
    """One row per directed pair, the one made last; ties go to the greatest row. ``typed_first``: rows without a type only where there is no other."""
    cols = ["relationship_type", "confidence", "justification", "created_at"]
    return edges.filter("fact_id_a is not null and fact_id_b is not null").groupBy("fact_id_a", "fact_id_b").agg(F.max_by(F.struct(*cols), relationship_rank(typed_first)).alias("e")).select("fact_id_a", "fact_id_b", "e.*")


def symmetric_upsert(edges: DataFrame, typed_first: bool = False) -> DataFrame:
    """Stores every edge in both directions; the last one made per direction wins."""
    swapped = edges.select(F.col("fact_id_b").alias("fact_id_a"), F.col("fact_id_a").alias("fact_id_b"), "relationship_type", "confidence", "justification", "created_at")
    return latest_relationships(edges.select(*swapped.columns).unionByName(swapped), typed_first)


def cascade_delete(facts: DataFrame, edges: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts without those of the listed ``documents(document_id)``, and edges without those that touch one of them."""
    gone = facts.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("fact_id").distinct()
    kept = edges.join(gone.withColumnRenamed("fact_id", "fact_id_a"), "fact_id_a", "left_anti").join(gone.withColumnRenamed("fact_id", "fact_id_b"), "fact_id_b", "left_anti")
    return facts.join(documents.select("document_id").distinct(), "document_id", "left_anti"), kept


def page(facts: DataFrame, limit: int = 50, offset: int = 0, document_id: str | None = None, entity: str | None = None, attribute: str | None = None) -> DataFrame:
    """A page of facts in the order of document and arrival. ``limit`` 1..1000, ``offset`` from 0."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset 0 or more")
    for column, wanted in (("document_id", document_id), ("canonical_entity", entity), ("raw_attribute", attribute)):
        if wanted is not None:
            facts = facts.filter(F.col(column) == wanted)
    return facts.orderBy("document_id", "ingest_seq").offset(offset).limit(limit)
