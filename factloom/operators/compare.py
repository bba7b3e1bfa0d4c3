"""The deterministic rule on pairs of facts, and what goes to a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import units
from factloom.session import materialize

#: Relative difference up to which two values agree.
TOLERANCE = 0.01
# Years and quarters that scopes are compared by, with their spellings, in the order in which they are sought.
YEARS = (("fy23", ("fy23", "2023")), ("fy24", ("fy24", "2024")), ("fy25", ("fy25", "2025")))
QUARTERS = ("q1", "q2", "q3", "q4")
VERDICTS = ("corroborates", "contradicts", "reconciled", "ambiguous", "unrelated")


def within_tolerance(a: Column, b: Column) -> Column:
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when((a == 0) & (b == 0), F.lit(True)).when((a == 0) | (b == 0), F.lit(False)).otherwise(F.abs(a - b) / larger <= TOLERANCE)


def scope_values(scope_json: Column) -> Column:
    """The values of a scope's JSON object in order, lower case, as an array; null and unreadable scopes have none."""
    held = F.from_json(scope_json, "map<string,string>")
    return F.transform(F.coalesce(F.map_values(held), F.array().cast("array<string>")), lambda v: F.lower(v))


def _first_match(values: Column, table: list[tuple[str, tuple[str, ...]]]) -> Column:
    def label(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, marks in reversed(table):
            hit = F.lit(False)
            for m in marks:
                hit = hit | v.contains(m)
            out = F.when(hit, name).otherwise(out)
        return out

    return F.try_element_at(F.filter(F.transform(values, label), lambda x: x.isNotNull()), F.lit(1))


def scope_year(values: Column) -> Column:
    return _first_match(values, list(YEARS))


def scope_quarter(values: Column) -> Column:
    return _first_match(values, [(q, (q,)) for q in QUARTERS])


def entries(scope_json: Column) -> Column:
    """A scope's entries in one order, for equality whatever the order of the keys."""
    return F.array_sort(F.map_entries(F.from_json(scope_json, "map<string,string>")))


def scope_marks(scope_json: Column) -> Column:
    """What scopes are compared by: ``struct<entries, year, quarter, members>``. Computed once per fact, before pairs are made."""
    values = scope_values(scope_json)
    return F.struct(entries(scope_json).alias("entries"), scope_year(values).alias("year"), scope_quarter(values).alias("quarter"), F.size(values).alias("members"))


def same_marks(a: Column, b: Column) -> Column:
    ya, yb, qa, qb = a["year"], b["year"], a["quarter"], b["quarter"]
    return (
        F.when(F.coalesce(a["entries"] == b["entries"], F.lit(False)), F.lit(True))
        .when(ya.isNotNull() & yb.isNotNull() & (ya != yb), F.lit(False))
        .when(qa.isNotNull() & qb.isNotNull() & (qa != qb), F.lit(False))
        .when(qa.isNotNull() != qb.isNotNull(), F.lit(False))
        .otherwise(F.coalesce(ya == yb, F.lit(False)))
    )


def equivalent_scopes(a: Column, b: Column) -> Column:
    """Whether two scopes (JSON objects) mean the same time: equal, or the same year and no quarter or the same on both sides."""
    return same_marks(scope_marks(a), scope_marks(b))


def verdict(a: str, b: str, block_cross_currency: bool = False) -> Column:
    """The rule on two normalised facts with columns ``{a}_value, {a}_unit, {a}_ok, {a}_marks`` (and ``{a}_currency``): ``corroborates``,
    ``reconciled``, or null where a judge must decide.

    By default facts in two currencies are compared by their numbers; ``block_cross_currency`` defers them.
    """

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    va, vb = col(a, "value"), col(b, "value")
    same_unit = col(a, "unit").eqNullSafe(col(b, "unit"))
    empty = (col(a, "marks")["members"] == 0) | (col(b, "marks")["members"] == 0)
    defer = ~F.coalesce(col(a, "ok"), F.lit(False)) | ~F.coalesce(col(b, "ok"), F.lit(False)) | va.isNull() | vb.isNull() | (~same_unit & (F.abs(va) < 1000)) | ~within_tolerance(va, vb) | empty
    if block_cross_currency:
        defer = defer | F.coalesce(col(a, "currency") != col(b, "currency"), F.lit(False))
    return F.when(~F.coalesce(defer, F.lit(True)), F.when(same_marks(col(a, "marks"), col(b, "marks")), "corroborates").otherwise("reconciled"))


def normalised_side(facts: DataFrame, side: str) -> DataFrame:
    """Columns of one side of a pair, prefixed."""
    n = units.with_normalized(facts.select("fact_id", "value", "unit", scope_marks(F.col("scope")).alias("marks")))
    return n.select(F.col("fact_id").alias(f"{side}_id"), F.col("normalized_value").alias(f"{side}_value"), F.col("normalized_unit").alias(f"{side}_unit"), F.col("currency").alias(f"{side}_currency"), F.col("parse_ok").alias(f"{side}_ok"), F.col("marks").alias(f"{side}_marks"))


def judge_pairs(pairs: DataFrame, facts: DataFrame, block_cross_currency: bool = False) -> DataFrame:
    """``fact_id_a, fact_id_b, rule_verdict, confidence, justification`` for pairs ``fact_id_a, fact_id_b``; null verdicts are the judge's queue. Pairs with an
    id that the facts lack are left out."""
    every = materialize(normalised_side(facts, "a"), "sides")  # each fact is normalised once, however many pairs it is in
    a, b = every, every.withColumnsRenamed({c: f"b{c[1:]}" for c in every.columns})
    joined = pairs.select(F.col("fact_id_a").alias("a_id"), F.col("fact_id_b").alias("b_id")).join(a, "a_id").join(b, "b_id")
    said = joined.select(F.col("a_id").alias("fact_id_a"), F.col("b_id").alias("fact_id_b"), verdict("a", "b", block_cross_currency).alias("rule_verdict"), "a_value", "b_value", "a_unit", "b_unit")
    sure = F.col("rule_verdict").isNotNull()
    figures = F.concat_ws(" ", F.lit("The two figures agree within the tolerance:"), F.col("a_value").cast("string"), "a_unit", F.lit("and"), F.col("b_value").cast("string"), "b_unit")
    text = F.concat(figures, F.when(F.col("rule_verdict") == "corroborates", "; the scopes are the same.").otherwise("; the scopes differ."))
    return said.select("fact_id_a", "fact_id_b", "rule_verdict", F.when(sure, 1.0).alias("confidence"), F.when(sure, text).alias("justification"))


def parse_judgement(text: Column) -> Column:
    """A judge's answer: fences are taken off; an unknown type, missing members and broken JSON give null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*```\w*\s*", ""), r"\s*```\s*$", "")
    held = F.from_json(bare, "relationship_type string, confidence double, justification string")
    return F.when(held["relationship_type"].isin(*VERDICTS) & held["confidence"].isNotNull() & held["justification"].isNotNull(), held)
