"""Queries of the general operators that stand beside the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import nested, quantities
from factloom.plans import catalogue
from factloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_children(table(spark, d, "facts"), table(spark, d, "chunks"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_values(table(spark, d, "facts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.common_amounts(table(spark, d, "facts"), table(spark, d, "unit_catalog"))


def p3_review(spark: SparkSession, d: str) -> DataFrame:
    return quantities.convert(table(spark, d, "facts"), table(spark, d, "unit_catalog")).filter("how in ('predicted', 'review')").select("fact_id", "how", "predicted_unit", "confidence", "proposed_amount")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return catalogue.QUERIES | {"p1_found": p1_found, "p1_values": p1_values, "p3_found": p3_found, "p3_review": p3_review}


ORACLE_SQL: dict[str, str] = dict(catalogue.ORACLE_SQL)
