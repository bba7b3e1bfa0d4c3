"""Quantities recorded in different units (problem 3).

The number of a fact and the readings of its scale and unit come from its fields. A calibrated random forest, trained on the facts that
state their unit, says how likely each common unit is from the magnitude, the source, the category (words of the attribute) and neighbouring fields (words of the
sentence and of the general note). Where the text leaves several readings (a lone "m", "pounds", several units beside the number or in the notes) the
forest's word and the reliability of the readings decide together; a single reading beside the number or in a note is weighed against the forest the same way.
The reliability is learned: how often sentence, note and first reading say what held-out facts state. What only the forest says is converted
to no amount but reported with its confidence, the uncertain rest for review.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import amounts
from factloom.session import hash_sample, materialize

#: Bound of the labelled sample that the forest is fitted on.
TRAINING_ROWS = 12_000
#: Share of the sample that the calibration and the reported accuracy are taken from.
HELD_OUT = 0.25
TREES, DEPTH, HASHED = 24, 9, 128
#: Calibrated confidence from which a unit that no text confirms counts as predicted, not as uncertain.
CONFIDENT = 0.9
NO_UNIT = {"", "-", "–", "n.a.", "n/a", "na", "none", "null", "nil", "?", "unknown"}

READ_SCHEMA = "fact_id string, seq bigint, number double, scale string, unit string, amount_text string, how string, conflict boolean, other_units array<string>, other_scales array<string>, source_type string, attribute string, words string"


def record_text(json: F.Column) -> F.Column:
    """A stored record's own JSON: without a fence, and unwrapped where it was stored as a JSON string."""
    bare = F.regexp_replace(F.trim(json), r"^\s*`{3}\w*\s*|\s*`{3}\s*$", "")
    return F.when(bare.startswith('"'), F.get_json_object(F.concat(F.lit('{"a":'), bare, F.lit("}")), "$.a")).otherwise(bare)


def evidence_window(json: F.Column) -> F.Column:
    return F.get_json_object(record_text(json), "$.evidence_context_window")


@dataclass(frozen=True)
class Reading:
    """One reading of a fact's scale and unit, and where the unit was found: ``stated``, ``sentence`` or ``note``."""

    scale: str | None
    unit: str
    how: str


def read_all(value: str | None, unit: str | None, statement: str | None, window: str | None) -> tuple[Decimal | None, str | None, list[Reading], bool]:
    """Number, scale, the readings of the unit, the likeliest by the text first, and whether two units clash."""
    got = amounts.read_value(value)
    if got is None:
        return None, None, [], False
    own = got.phrase
    if unit is not None and unit.strip().lower() not in NO_UNIT:
        beside = amounts.read_phrase(amounts.plain(unit))
    else:
        beside = amounts.Phrase(None, None, False, "")
    if own.bare_m and beside.unit not in (None, "metre"):
        own = amounts.as_million(own)
    if beside.bare_m and own.unit not in (None, "metre"):
        beside = amounts.as_million(beside)
    if own.clash or beside.clash or (own.unit and beside.unit and own.unit != beside.unit):
        return got.number, None, [], True
    scale = own.scale or beside.scale
    stated = own.unit or beside.unit
    lone = stated == "metre" and (own.bare_m or own.unit is None) and (beside.bare_m or beside.unit is None)  # a lone "m": metre or million
    if stated and not lone:
        readings = [Reading(scale, stated, "stated")]
        if stated in amounts.NAMESAKES and re.search(rf"\b{stated}s?\b", f"{amounts.plain(value)} {amounts.plain(unit)}", re.I):
            readings.append(Reading(scale, amounts.NAMESAKES[stated], "stated"))
        return got.number, scale, readings, False
    near = [Reading(scale or p.scale, p.unit, "sentence") for p in amounts.all_beside(statement, got.number)]
    notes = [Reading(scale or p.scale, p.unit, "note") for p in amounts.general_notes(window)]
    if lone:
        as_million = [Reading("million", r.unit, r.how) for r in (near or notes) if r.unit != "metre"]
        metre = [Reading(scale, "metre", "stated")]
        return got.number, scale, as_million + metre if near and as_million else metre + as_million, False
    return got.number, scale, near or notes, False


def read_fact(value: str | None, unit: str | None, statement: str | None, window: str | None) -> tuple[Decimal | None, str | None, str | None, str | None, bool]:
    """Number, scale, unit, where the unit was found (``stated``, ``sentence``, ``note`` or None), and whether two units clash, by the first reading."""
    number, scale, readings, conflict = read_all(value, unit, statement, window)
    if conflict or not readings:
        return number, None if conflict else scale, None, None, conflict
    return number, readings[0].scale, readings[0].unit, readings[0].how, False


def near_words(statement: str | None, window: str | None) -> str:
    """:func:`words_near` of one fact."""
    text = f"{statement or ''} {window or ''}".lower().replace("|", " ")
    return " ".join(w for w in text.split() if not any(c.isdecimal() for c in w))


def words_near(statement: F.Column, window: F.Column) -> F.Column:
    """Neighbouring words for the classifier: all of the sentence and the note but those with digits."""
    text = F.lower(F.concat_ws(" ", statement, window))
    return F.array_join(F.filter(F.split(F.replace(text, F.lit("|"), F.lit(" ")), r"\s+"), lambda w: ~w.rlike(r"\p{Nd}")), " ")


def _cells(facts: DataFrame) -> DataFrame:
    return facts.select("fact_id", F.col("ingest_seq").cast("bigint").alias("seq"), "value", "unit", "statement", "raw_attribute", "source_type", evidence_window(F.col("data_json")).alias("window")).filter(F.col("fact_id").isNotNull() & F.col("value").rlike(r"\p{Nd}"))


def read_quantities(facts: DataFrame) -> DataFrame:
    """One row per delivered fact whose value is one number (columns of READ_SCHEMA); ``unit`` is null where none was found, ``other_units`` are the further
    readings of the text, null where there is none, and ``words`` the neighbouring words of facts that do not state one unit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for fid, seq, value, unit, statement, attribute, source, window in b.itertuples(index=False, name=None):
                number, scale, readings, conflict = read_all(value, unit, statement, window)
                if number is None:
                    continue
                first, others = (readings[0], readings[1:]) if readings else (Reading(None if conflict else scale, None, None), [])
                rows.append((fid, seq, float(number), first.scale, first.unit, str(number), first.how, conflict, [r.unit for r in others] or None, [r.scale for r in others] or None, source, attribute, None if first.how == "stated" and not others else near_words(statement, window)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ_SCHEMA.split(", ")])

    return _cells(facts).mapInPandas(read, READ_SCHEMA)


def _features(rows: DataFrame) -> DataFrame:
    scale = F.create_map(*[x for k, v in (("thousand", 3), ("lakh", 5), ("million", 6), ("crore", 7), ("billion", 9), ("trillion", 12), ("lakh_crore", 12)) for x in (F.lit(k), F.lit(float(v)))])
    exponent = F.coalesce(F.element_at(scale, F.col("scale")), F.lit(0.0))
    size = F.log10(F.abs("number") + 1.0)
    return rows.select("*", size.alias("size"), exponent.alias("exponent"), (F.col("number") < 0).cast("double").alias("negative"), (F.round("number") == F.col("number")).cast("double").alias("whole"), F.coalesce((F.col("source_type") == "table").cast("double"), F.lit(0.0)).alias("is_table"), F.coalesce((F.col("source_type") == "chart").cast("double"), F.lit(0.0)).alias("is_chart"), F.lower(F.coalesce("attribute", F.lit(""))).alias("attribute_text"), F.coalesce("words", F.lit("")).alias("near_text"))


class UnitModel:
    """Random forest over common units with isotonic calibration of its top probability, and the reliability of the texts' readings.

    ``labelled``: facts with one stated unit; ``cells``: statement and note of the facts. ``report`` has the accuracy of the forest and of its calibration (mean
    distance of confidence and share of hits) on the held-out part, and the reliabilities.
    """

    def __init__(self, labelled: DataFrame, cells: DataFrame, seed: int = 7):
        spark = labelled.sparkSession
        chosen = materialize(hash_sample(labelled.drop("words"), TRAINING_ROWS, "fact_id"), "unit-labels")  # a bounded sample
        texts = cells.join(F.broadcast(chosen.select("fact_id", "seq")), ["fact_id", "seq"], "left_semi").dropDuplicates(["fact_id"]).select("fact_id", "statement", "window")
        sample = materialize(_features(chosen.join(texts, "fact_id", "left").withColumn("words", words_near(F.col("statement"), F.col("window")))), "unit-sample")
        part = F.pmod(F.xxhash64("fact_id", F.lit("part")), F.lit(1000)) < int(1000 * HELD_OUT)
        fit, held = sample.filter(~part), sample.filter(part)
        self.classes: list[str] = [r[0] for r in sample.select("common_unit").distinct().orderBy("common_unit").collect()]
        self.usable = len(self.classes) > 1 and fit.limit(50).count() == 50
        self.report: dict[str, float] = {}
        if not self.usable:
            return
        self.reliability = self._reliability(held)
        stages = [
            RegexTokenizer(inputCol="attribute_text", outputCol="a_words", pattern=r"[^\p{L}]+"),
            HashingTF(inputCol="a_words", outputCol="a_tf", numFeatures=HASHED, binary=True),
            RegexTokenizer(inputCol="near_text", outputCol="n_words", pattern=r"[\s,;()\[\]]+", toLowercase=True),
            HashingTF(inputCol="n_words", outputCol="n_tf", numFeatures=HASHED, binary=True),
            VectorAssembler(inputCols=["size", "exponent", "negative", "whole", "is_table", "is_chart", "a_tf", "n_tf"], outputCol="features"),
        ]
        self.prepare = Pipeline(stages=stages).fit(fit)
        index = StringIndexer(inputCol="common_unit", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(sample)
        self.classes = list(index.labels)
        self.forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.25", minInstancesPerNode=2, seed=seed, maxMemoryInMB=128).fit(index.transform(self.prepare.transform(fit)))
        checked = self._probabilities(index.transform(held)).select(F.array_max("p").alias("top"), (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("double").alias("hit"))
        pairs = checked.filter("top is not null and hit is not null").toPandas()  # the held-out part of the bounded sample
        if len(pairs):
            iso = IsotonicRegression(featuresCol="top", labelCol="hit").fit(spark.createDataFrame(pairs))
            self.bounds, self.values = np.array(iso.boundaries), np.array(iso.predictions)
        else:
            self.bounds, self.values = np.array([0.0, 1.0]), np.array([0.0, 0.0])
        off = np.abs(np.interp(pairs["top"], self.bounds, self.values) - pairs["hit"]) if len(pairs) else np.zeros(1)
        self.report = {"held_out": float(len(pairs)), "accuracy": float(pairs["hit"].mean()) if len(pairs) else 0.0, "mean_distance": float(off.mean())} | {f"reliability_{k}": v for k, v in self.reliability.items()}

    @staticmethod
    def _reliability(held: DataFrame) -> dict[str, float]:
        """How often the readings of sentence and note say what a fact states, its own unit being hidden: of ``sentence`` and ``note`` alone, of the ``first`` of
        several readings and of any ``other``; with one hit and one miss added."""

        @F.pandas_udf("struct<how:string,hit:boolean,other:boolean>")
        def hidden(number: pd.Series, unit: pd.Series, statement: pd.Series, window: pd.Series) -> pd.DataFrame:
            out = []
            for n, u, s, w in zip(number, unit, statement, window, strict=True):
                _, _, readings, _ = read_all(n, None, s if isinstance(s, str) else None, w if isinstance(w, str) else None)
                several = len(readings) > 1
                out.append((("several" if several else readings[0].how) if readings else None, bool(readings) and readings[0].unit == u, any(r.unit == u for r in readings[1:])))
            return pd.DataFrame(out, columns=["how", "hit", "other"])

        rows = held.select(hidden("amount_text", "unit", "statement", "window").alias("h")).groupBy("h.how").agg(F.count("*").alias("n"), F.count_if("h.hit").alias("hits"), F.count_if("h.other").alias("others")).collect()  # four rows at most
        counted = {r["how"]: (r["n"], r["hits"], r["others"]) for r in rows}
        share = lambda how, k: (counted.get(how, (0, 0, 0))[k] + 1) / (counted.get(how, (0, 0, 0))[0] + 2)
        return {"sentence": share("sentence", 1), "note": share("note", 1), "first": share("several", 1), "other": share("several", 2)}

    def _probabilities(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.forest.transform(self.prepare.transform(rows)).withColumn("p", vector_to_array("probability"))

    def score(self, rows: DataFrame) -> DataFrame:
        return self._probabilities(_features(rows))


def convert(facts: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """``fact_id, common_unit, amount, how, confidence, predicted_unit, proposed_amount``: one row per fact whose value is one number.

    ``how``: ``stated`` (unit in value and unit), ``sentence``, ``note`` (where the first reading was found; which reading counts is weighed with the forest), ``predicted`` (only the
    forest says so, confidently), ``review`` (uncertain, or two units clash). ``amount`` is filled for the first three and is the number in the common unit,
    rounded half up; for ``predicted`` ``proposed_amount`` has the conversion that a reviewer may accept. Numbers that do not fit a bigint go to review.
    Of a fact delivered more than once the first delivery counts. Too few labelled facts for a forest leave the unconfirmed for review.
    """
    spark = facts.sparkSession
    catalog = {r["unit_name"]: (r["common_unit"], str(r["factor"])) for r in unit_catalog.select("unit_name", "common_unit", "factor").collect()}  # a fixed list of units
    units = spark.createDataFrame([(u, c) for u, (c, _) in catalog.items() if c], "unit string, common_unit string")
    first = Window.partitionBy("fact_id").orderBy("seq")
    read = materialize(read_quantities(facts).withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth").join(F.broadcast(units), "unit", "left"), "quantities")
    single = F.col("other_units").isNull()
    stated = read.filter("how = 'stated' and common_unit is not null").filter(single)
    model = UnitModel(stated, _cells(facts))
    unclear = read.filter(F.col("how").isNull() | (F.col("how") != "stated") | ~single)
    if model.usable:
        classes, bounds, values, reliability = model.classes, model.bounds, model.values, model.reliability
        common_of = {u: c for u, (c, _) in catalog.items() if c}
        scored = model.score(unclear).select("fact_id", "scale", "unit", "common_unit", "amount_text", "how", "conflict", "other_units", "other_scales", "p")

        @F.pandas_udf("struct<chosen:int,confidence:double,forest_unit:string,forest_confidence:double>")
        def weigh(p: pd.Series, first: pd.Series, how: pd.Series, others: pd.Series) -> pd.DataFrame:
            """``chosen``: the reading that text and forest together hold for the likeliest (0: the first), or -1 if another unit is likelier."""
            at = {c: i for i, c in enumerate(classes)}
            out = []
            for probs, unit, where, more in zip(p, first, how, others, strict=True):
                probs = np.asarray(probs)
                smooth = (probs * TREES + 0.5) / (TREES + 0.5 * len(classes))
                top = float(np.interp(probs.max(), bounds, values))
                named = classes[int(probs.argmax())]
                if not isinstance(unit, str):
                    out.append((-1, 0.0, named, top))
                    continue
                readings = [unit, *[common_of.get(u) for u in (more if more is not None else [])]]
                if len(readings) == 1:
                    trust = [reliability.get(where, reliability["first"])]
                else:
                    trust = [reliability["first"], *[reliability["other"] / (len(readings) - 1)] * (len(readings) - 1)]
                    trust = [t * min(1.0, 0.999 / sum(trust)) for t in trust]
                weight = np.full(len(classes), (1 - sum(trust)) / max(1, len(classes) - 1))
                new = [k for k, u in enumerate(readings) if u not in at]  # a unit of which the sample has no fact has the forest's least word
                score = [t * (smooth[at[u]] if k not in new else 0.5 / (TREES + 0.5 * len(classes))) for k, (u, t) in enumerate(zip(readings, trust, strict=True))]
                for u in readings:
                    if u in at:
                        weight[at[u]] = 0.0
                rest = smooth * weight
                best = int(np.argmax(score))
                total = sum(score) + rest.sum()
                out.append((best if score[best] >= rest.max(initial=0.0) else -1, score[best] / total, named, top))
            return pd.DataFrame(out, columns=["chosen", "confidence", "forest_unit", "forest_confidence"])

        weighed = scored.withColumn("w", weigh("p", "common_unit", "how", "other_units"))
        agreed = (F.col("w.chosen") >= 0) & ~F.col("conflict")
        pick = lambda name: F.when(F.col("w.chosen") > 0, F.get(f"other_{name}s", F.col("w.chosen") - 1)).otherwise(F.col(name))
        unclear = weighed.select("fact_id", "amount_text", pick("scale").alias("scale"), pick("unit").alias("unit"), F.when(agreed, F.col("how")).when(~F.col("conflict") & F.col("how").isNull() & (F.col("w.forest_confidence") >= CONFIDENT), "predicted").otherwise("review").alias("how"), F.when(agreed, F.col("w.confidence")).otherwise(F.col("w.forest_confidence")).alias("confidence"), F.col("w.forest_unit").alias("predicted_unit"))
        unclear = unclear.join(F.broadcast(units), "unit", "left")
    else:
        unclear = unclear.select("fact_id", "amount_text", "scale", "unit", F.when(F.col("how").isNotNull(), F.col("how")).otherwise("review").alias("how"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("predicted_unit"), "common_unit")
    clear = stated.select("fact_id", "amount_text", "scale", "unit", "how", F.lit(1.0).alias("confidence"), F.col("common_unit").alias("predicted_unit"), "common_unit")
    rows = clear.unionByName(unclear)

    @F.pandas_udf("bigint")
    def amount(number: pd.Series, scale: pd.Series, unit: pd.Series) -> pd.Series:
        out = []
        for n, s, u in zip(number, scale, unit, strict=True):
            x = Decimal(n) * Decimal(catalog[s][1] if isinstance(s, str) and s in catalog else 1) * Decimal(catalog[u][1] if isinstance(u, str) and u in catalog else 1)
            x = int(x.to_integral_value(ROUND_HALF_UP))
            out.append(x if abs(x) < 2**63 else None)
        return pd.Series(out, dtype="Int64")

    found = F.col("how").isin("stated", "sentence", "note")
    base = rows.withColumn("a", amount("amount_text", "scale", F.when(found, F.col("unit"))))
    too_large = found & F.col("a").isNull()
    return base.select("fact_id", F.when(found & ~too_large, F.col("common_unit")).alias("common_unit"), F.when(found, F.col("a")).alias("amount"), F.when(too_large, "review").otherwise(F.col("how")).alias("how"), "confidence", "predicted_unit", F.when(F.col("how") == "predicted", F.col("a")).alias("proposed_amount"))


def common_amounts(facts: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """``fact_id, common_unit, amount`` of the facts whose unit is certain."""
    return convert(facts, unit_catalog).filter("how in ('stated', 'sentence', 'note') and amount is not null").select("fact_id", "common_unit", "amount")
