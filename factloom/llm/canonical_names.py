"""Freely typed names mapped to a reference list (problem 5).

Distinct values are normalised; candidates come from an inverted index of character n-grams of the list's entries, scored by the
cosine of idf-weighted n-grams. A value gets the entry with the highest cosine if that reaches a threshold, fitted to misspellings and shortenings of the list's own entries, and
exceeds the next one's by a margin. Candidates that an alignment word by word shows to be another name, or farther from the value than another candidate, are
vetoed before: sister companies and look-alikes have high cosines. All others are reported with -1.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.session import materialize

#: The next entry's cosine must be lower by so much.
MARGIN = 0.05
#: A candidate is vetoed by another one that is nearer in its alignment by so much.
NEARER = 0.5
#: The share of the lowest cosine of single misspellings of the list's entries at which the threshold lies (a name may have several).
SLACK = 0.5
#: A list of more entries is misspelt by tasks, not by the driver.
DRIVER_ENTRIES = 1_000
#: Entries of a reference list at most; every task holds the list.
LIST_ROWS = 50_000
#: The index is repeated so often, and the values salted, where it is too large to be broadcast and a gram may be hot.
SALTS = 8
#: A table of so many rows at most is broadcast.
BROADCAST_ROWS = 200_000


def grams(words: list[str], acronyms: set[str] = frozenset()) -> Counter:
    """Character n-grams of padded words, beginnings of words, first with last letters, and acronyms as wholes."""
    out: Counter = Counter()
    for w in words:
        w = w.rstrip(".")
        padded = f"^{w}$"
        out.update(padded[i : i + 3] for i in range(max(1, len(padded) - 2)))
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out[f"<{w[:4]}"] += 1
        out[f"{w[:1]}~{w[-1:]}"] += 1
    for a in acronyms:
        out[f"#{a}"] += 3
    return out


class Entries:
    """The reference list in normal form; small by nature and held by every task."""

    def __init__(self, rows: list[tuple[int, str]], short_names: bool):
        self.words = {seq: names.core_of(names.words_of(name)) for seq, name in rows}
        self.own_acronyms = {seq: names.acronyms_of(name) for seq, name in rows}
        self.acronyms: dict[str, set[int]] = defaultdict(set)
        self.firsts: dict[str, set[int]] = defaultdict(set)
        for seq, name in rows:
            for a in names.acronyms_of(name):
                self.acronyms[a].add(seq)
            if short_names and self.words[seq][0]:
                self.firsts[self.words[seq][0][0]].add(seq)
        self.short_names = short_names
        df: Counter = Counter()
        for seq in self.words:
            df.update(self._grams(seq).keys())
        n = max(1, len(rows))
        self.idf = {g: math.log(1 + n / c) for g, c in df.items()}
        self.top = max(self.idf.values(), default=1.0)
        self.postings = [(seq, g, w) for seq in self.words for g, w in self.weights(seq).items()]

    def _grams(self, seq: int) -> Counter:
        return grams(self.words[seq][0], self.own_acronyms[seq])

    def weights(self, seq: int) -> dict[str, float]:
        """The weight of each gram of an entry; their squares add up to 1."""
        held = self._grams(seq)
        norm = math.sqrt(sum((c * self.idf[g]) ** 2 for g, c in held.items()))
        return {g: c * self.idf[g] / norm for g, c in held.items()}

    def weighted(self, raw: str) -> dict[str, float]:
        words = names.readings(raw)[0]
        a = names.is_acronym(raw)
        g = grams(words, {a} if a else set())
        w = {x: c * self.idf.get(x, self.top) for x, c in g.items()}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        return {x: v / norm for x, v in w.items() if x in self.idf}

    def fit_threshold(self) -> float:
        """SLACK times the lowest cosine of any entry with its own misspellings and shortenings that the alignment accepts."""
        return SLACK * self.lowest_cosine(self.words)

    def lowest_cosine(self, seqs: Iterable[int]) -> float:
        lowest = 1.0
        for seq in seqs:
            words, weights = self.words[seq][0], self.weights(seq)
            for k, w in enumerate(words):
                mid = len(w) // 2
                for typed in (w[:mid] + w[mid + 1 :], w[: mid - 1] + w[mid : mid + 1] + w[mid - 1 : mid] + w[mid + 1 :] if mid else w, w[:4] + "."):
                    value = [*words[:k], typed, *words[k + 1 :]]
                    if names.alignment(value, words) < 9:
                        lowest = min(lowest, sum(v * weights.get(g, 0.0) for g, v in self.weighted(" ".join(value)).items()))
            short = [w[:4] + "." if len(w) > 4 else w for w in words]
            if names.alignment(short, words) < 9:
                lowest = min(lowest, sum(v * weights.get(g, 0.0) for g, v in self.weighted(" ".join(short)).items()))
        return lowest

    def choose(self, raw: str, candidates: list[tuple[int, float]], margin: float) -> int:
        """The entry that the value names, or -1. ``candidates``: entries and their cosines."""
        readings = names.readings(raw)
        a = names.is_acronym(raw)
        if a and "." in raw and len(self.acronyms.get(a, ())) == 1:
            return next(iter(self.acronyms[a]))
        legal = set(names.core_of(names.words_of(raw))[1])
        if readings[0]:
            near = []
            for seq, cosine in candidates:
                d = min(names.alignment(r, self.words[seq][0]) for r in readings)
                if d < 9:
                    near.append((d + 0.6 * bool(legal and legal != set(self.words[seq][1])), -cosine, seq))
            if near:
                least = min(near)[0]
                near = sorted((-c, seq) for d, c, seq in near if d < least + NEARER)[::-1]
                return near[0][1] if len(near) == 1 or near[0][0] - near[1][0] >= margin else -1
        if a and len(self.acronyms.get(a, ())) == 1:
            return next(iter(self.acronyms[a]))
        if self.short_names and len(readings[0]) == 1:  # the distinctive first word alone
            w = readings[0][0].rstrip(".")
            hit = {s for f in {self.words[c][0][0] for c, _ in candidates if self.words[c][0]} if len(self.firsts[f]) == 1 and names.edits(w, f, 1) <= (len(f) > 5) for s in self.firsts[f]}
            if len(hit) == 1:
                return hit.pop()
        return -1


def fitted_threshold(spark: SparkSession, held: Entries) -> float:
    """``held.fit_threshold()`` over all entries of the list; the entries of a long one are spread over tasks."""
    seqs = list(held.words)
    if len(seqs) <= DRIVER_ENTRIES:
        return held.fit_threshold()

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lowest": [held.lowest_cosine([seqs[i] for i in b["id"]])]})

    return SLACK * spark.range(0, len(seqs), 1, 4 * spark.sparkContext.defaultParallelism).mapInPandas(lowest, "lowest double").agg(F.min("lowest")).first()[0]


def map_values(values: DataFrame, entries: DataFrame, short_names: bool, threshold: float | None = None, margin: float = MARGIN) -> DataFrame:
    """``raw, seq``: for distinct values ``raw`` the entry of ``entries(seq, name)`` they name, else -1.

    Blank values get -1. Values that are as near to one entry as to another get -1. An empty list gives -1 for all; one of more than LIST_ROWS entries is
    an error. Without a ``threshold`` it is fitted.
    """
    spark: SparkSession = values.sparkSession
    if entries.count() > LIST_ROWS:
        raise ValueError(f"a reference list of more than {LIST_ROWS} entries")
    rows = [(int(r["seq"]), r["name"]) for r in entries.select("seq", "name").filter("name is not null").collect()]  # the list itself: LIST_ROWS at most
    held = Entries(rows, short_names)
    index = spark.createDataFrame(held.postings or [(-1, "", 0.0)], "seq bigint, gram string, weight double")
    small = len(held.postings) <= BROADCAST_ROWS
    held.postings = []  # the index has them, tasks need not
    least = fitted_threshold(spark, held) if threshold is None else threshold
    index = F.broadcast(index) if small else index.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    keys = ["gram"] if small else ["gram", "salt"]

    @F.pandas_udf("array<struct<gram:string,w:double>>")
    def weigh(raw: pd.Series) -> pd.Series:
        return raw.map(lambda v: [{"gram": g, "w": w} for g, w in held.weighted(v).items()])

    @F.pandas_udf("bigint")
    def choose(raw: pd.Series, seqs: pd.Series) -> pd.Series:
        return pd.Series([held.choose(v, [(c["seq"], c["cosine"]) for c in s] if s is not None else [], margin) for v, s in zip(raw, seqs, strict=True)])

    values = values.select("raw").filter("raw is not null")
    weighed = values.select("raw", F.explode(weigh("raw")).alias("g")).select("raw", "g.gram", "g.w")
    weighed = weighed if small else weighed.withColumn("salt", F.pmod(F.xxhash64("raw"), F.lit(SALTS)).cast("int"))
    scored = weighed.join(index, keys).groupBy("raw", "seq").agg(F.sum(F.col("w") * F.col("weight")).alias("cosine"))
    # every entry from the threshold on: as many as the list has at most
    found = scored.filter(F.col("cosine") >= least).groupBy("raw").agg(F.collect_list(F.struct("seq", "cosine")).alias("seqs"))
    return values.join(found, "raw", "left").select("raw", choose("raw", "seqs").alias("seq"))


def _sized_join(facts: DataFrame, mapping: DataFrame, on: str, rows: int) -> DataFrame:
    """Broadcast below a checked size; beyond it a shuffle join, whose hot keys AQE splits."""
    return facts.join(F.broadcast(mapping) if rows <= BROADCAST_ROWS else mapping, on, "left")


def value_maps(facts: DataFrame, entities: DataFrame, attributes: DataFrame) -> list[tuple[str, str, DataFrame, int]]:
    """For each of the two fields: its column, the name of the entry's number, the mapping of its distinct values, and the mapping's size."""
    out = []
    for column, entries, name, short in (("canonical_entity", entities, "entity_seq", True), ("raw_attribute", attributes, "attribute_seq", False)):
        filled = F.regexp_replace(F.col(column), r"^[\s\p{Z}]+$", "") != ""
        values = materialize(facts.filter(filled).select(F.col(column).alias("raw")).distinct(), "values")
        mapping = materialize(map_values(values, entries, short).select(F.col("raw").alias(column), F.col("seq").alias(name)), "mapping")
        out.append((column, name, mapping, mapping.count()))
    return out


def with_entries(facts: DataFrame, maps: list[tuple[str, str, DataFrame, int]]) -> DataFrame:
    for column, _, mapping, rows in maps:
        facts = _sized_join(facts, mapping, column, rows)
    return facts


def resolve_facts(facts: DataFrame, entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """``fact_id, entity_seq, attribute_seq`` with one row per fact: -1 where a value names nothing, null where it is null or blank.

    A fact delivered more than once counts by its first delivery. Extra columns are ignored.
    """
    once = facts.select("fact_id", "canonical_entity", "raw_attribute", F.col("ingest_seq").cast("bigint").alias("n"))
    out = with_entries(once, value_maps(once, entities, attributes))
    return out.groupBy("fact_id").agg(F.min_by(F.struct("entity_seq", "attribute_seq"), "n").alias("m")).select("fact_id", "m.entity_seq", "m.attribute_seq")


def mapped_names(facts: DataFrame, entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """``fact_id, field, seq`` for both fields; -1 reports a value that names no entry."""
    wide = resolve_facts(facts, entities, attributes)
    pair = F.explode(F.array(F.struct(F.lit("canonical_entity").alias("field"), F.col("entity_seq").alias("seq")), F.struct(F.lit("raw_attribute").alias("field"), F.col("attribute_seq").alias("seq"))))
    return wide.select("fact_id", pair.alias("p")).select("fact_id", "p.field", "p.seq").filter("seq is not null")
