"""The pipeline's two set-based steps: facts made canonical, and new facts compared with what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import interfaces
from factloom.functions import units
from factloom.operators import compare, extraction, graph, knn, matching
from factloom.session import materialize

#: Candidates of a new fact.
TOP_K = 8


def scope_text(scope: F.Column) -> F.Column:
    """A scope (JSON object) as one text whatever the order of its keys; empty and unreadable ones give an empty text."""
    return F.array_join(F.transform(F.coalesce(compare.entries(scope), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def canonicalise_facts(facts: DataFrame, entities: DataFrame, attributes: DataFrame, embedder: interfaces.Embedder, entity_threshold: float = matching.THRESHOLD, attribute_threshold: float = matching.THRESHOLD) -> DataFrame:
    """Facts (``fact_id, canonical_entity, raw_attribute, value, unit, scope``, further columns stay) with ``entity``, ``attribute``, ``original_attribute``, the
    normalised value and ``content_hash`` of the canonical form.

    Entity by cosine, attribute by the lexical rules and then by cosine, against registries ``seq, name``; what matches nothing stays as it is. Names are resolved once
    per distinct name. Null and blank names stay as they are.
    """

    def distinct(column: str) -> DataFrame:
        return materialize(interfaces.embed(facts.filter(F.trim(column) != "").select(F.col(column).alias("name")).distinct(), embedder), "names")

    known = [interfaces.embed(r.select("seq", "name"), embedder) for r in (entities, attributes)]
    resolved = matching.resolve(distinct("canonical_entity"), known[0], entity_threshold).select(F.col("name").alias("canonical_entity"), "resolved")
    snapped = matching.snap_cascade(distinct("raw_attribute"), known[1], attribute_threshold).select(F.col("name").alias("raw_attribute"), "snapped")
    named = facts.join(resolved, "canonical_entity", "left").join(snapped, "raw_attribute", "left")
    named = named.withColumns({"entity": F.coalesce("resolved", "canonical_entity"), "attribute": F.coalesce("snapped", "raw_attribute"), "original_attribute": F.col("raw_attribute")}).drop("resolved", "snapped")
    out = units.with_normalized(named)
    return out.withColumn("content_hash", extraction.content_hash(F.col("entity"), F.col("attribute"), F.col("value"), scope_text(F.col("scope"))))


def compare_new_facts(new: DataFrame, stored: DataFrame, edges: DataFrame, judge: interfaces.Judge, k: int = TOP_K, waves: int = 1) -> DataFrame:
    """``fact_id_a, fact_id_b, relationship_type, confidence, justification, source`` of new facts against what came before them.

    ``new`` and ``stored`` have ``fact_id, document_id, ingest_seq, embedding`` and the fields that the rule and the judge see (``statement,
    canonical_entity, raw_attribute, value, unit, scope``); ``edges`` are the stored ``fact_id_a, fact_id_b, relationship_type``. Each new fact takes the ``k`` most similar earlier
    facts of other documents, new ones included, each of which its group's earliest fact stands for; a pair comes once. The rule decides, else the
    judge; what neither decides gives no row. With ``waves`` above 1 the batch is taken in so many parts in the order of arrival and later
    parts see the corroborations of earlier ones. Facts without a vector have no candidates. An empty batch gives an empty result.
    """
    cols = ["fact_id", "document_id", "ingest_seq", "embedding", "statement", "canonical_entity", "raw_attribute", "value", "unit", "scope"]
    every = materialize(stored.select(*cols).unionByName(new.select(*cols)), "facts-to-compare")
    agreed = edges.filter("relationship_type = 'corroborates'").select(F.col("fact_id_a").alias("a"), F.col("fact_id_b").alias("b"))
    vectors = every.select(F.col("ingest_seq").alias("id"), F.xxhash64("document_id").alias("grp"), "embedding")
    ids = new.select("fact_id", "ingest_seq")
    part = F.ntile(waves).over(_order()) if waves > 1 else F.lit(1)
    asking = materialize(ids.withColumn("wave", part), "asking")
    near = knn.top_k(vectors.join(asking.select(F.col("ingest_seq").alias("id")), "id", "left_semi"), vectors, k, "earlier")
    near = near.join(asking.select(F.col("ingest_seq").alias("query_id"), F.col("fact_id").alias("fact_id_a"), "wave"), "query_id").join(every.select(F.col("ingest_seq").alias("neighbour_id"), F.col("fact_id").alias("other")), "neighbour_id")
    near = materialize(near.select("fact_id_a", "other", "wave"), "near")
    out = None
    for wave in range(1, waves + 1):
        reps = graph.representatives(every, graph.components(agreed)).select(F.col("fact_id").alias("other"), F.col("representative_id").alias("fact_id_b"))
        pairs = near.filter(F.col("wave") == wave).join(reps, "other").filter("fact_id_a <> fact_id_b").select("fact_id_a", "fact_id_b").distinct()
        found = materialize(interfaces.judged(compare.judge_pairs(pairs, every), every, judge), "verdicts")
        out = found if out is None else out.unionByName(found)
        agreed = agreed.unionByName(found.filter("relationship_type = 'corroborates'").select(F.col("fact_id_a").alias("a"), F.col("fact_id_b").alias("b")))
    return out


def _order():
    from pyspark.sql.window import Window

    return Window.orderBy("ingest_seq")  # one batch's ids only


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, as the store keeps them."""
    swapped = edges.select(F.col("fact_id_b").alias("fact_id_a"), F.col("fact_id_a").alias("fact_id_b"), *[c for c in edges.columns if c not in ("fact_id_a", "fact_id_b")])
    return edges.unionByName(swapped)
