"""Queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import canonical_names, components, history, packing, residue, tokens
from factloom.sources.tables import table


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "canonical_entities"), table(spark, d, "canonical_attributes"), table(spark, d, "unit_catalog")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "facts"), *_lists(spark, d))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return history.clusters(history.link_all(table(spark, d, "facts"), *_lists(spark, d))[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.corroboration_groups(table(spark, d, "relationships"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_names.mapped_names(table(spark, d, "facts"), table(spark, d, "canonical_entities"), table(spark, d, "canonical_attributes"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_clusters": p2_clusters, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_packed": p7_packed, "p8_found": p8_found}


ORACLE_SQL: dict[str, str] = {
    "p4_found": r"""
        WITH RECURSIVE e AS (
            SELECT DISTINCT fact_id_a AS a, fact_id_b AS b FROM relationships
            WHERE regexp_replace(trim(regexp_replace(lower(relationship_type), '[^\p{L}\p{N}()]+', ' ', 'g')), '^relationshiptype ', '') = 'corroborates'
              AND trim(fact_id_a) <> '' AND trim(fact_id_b) <> '' AND fact_id_a <> fact_id_b),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(fact_id, other) AS (
            SELECT a, b FROM both_ways UNION SELECT r.fact_id, w.b FROM reach r JOIN both_ways w ON w.a = r.other)
        SELECT fact_id, min(least(fact_id, other)) AS group_id FROM reach GROUP BY fact_id""",
}
