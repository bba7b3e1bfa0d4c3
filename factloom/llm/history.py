"""New batches of facts deduplicated against all accepted history (problem 2).

Incremental record linkage. Of every accepted fact the blocking keys are kept in tables in the shared folder, in buckets of the
report: the report with the content hash, the report with the normalised statement (entity, attribute, period, segment, value), and
two looser keys that leave out the entity or the attribute. A new batch probes the buckets of its reports; the history's texts are
never read again. Pairs that agree on a looser key are scored field by field with learned weights (log-odds of agreement
in matches and non-matches, counted over all pairs of facts of a report). A repeat joins the cluster of the accepted fact; only clusters that a batch links are
merged, through a table of representatives. A manifest says which batches are whole: a history is opened again by its path, and a batch
that was cut off leaves nothing behind that counts.

Facts that a batch brings are decided in their order of arrival without a sequential pass: whoever has an accepted fact before it
under one of its keys is a repeat; whoever is first under all of its keys is accepted; rounds go on until all are decided. Exact
copies are collapsed first, so no key's group is gathered in one task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import amounts, names, scopes
from factloom.llm import canonical_names
from factloom.llm.components import star_components
from factloom.operators.quantities import read_fact, record_text
from factloom.session import materialize, work_dir, write_work

#: Buckets of a new history. A batch reads those that its reports fall into, so a large history takes more of them than a batch has reports.
BUCKETS = 16
#: Small sides of joins on keys that may be hot are repeated so often, and the other side is salted.
SALTS = 8
#: Distinct names of a report are compared in blocks of about so many, their letters also word by word, as far as so many words.
NAME_BLOCK, WORDS = 256, 4
#: Posterior probability from which a scored pair is a match.
MATCH_PROBABILITY = 0.9
#: Share of matches among the pairs that agree on a looser key, before their names are compared.
PRIOR = 0.2

NORMAL = "fact_id string, seq bigint, report string, hash string, canonical_entity string, raw_attribute string, entity_words string, attribute_words string, period string, segment string, value_key string"


def value_key(value: str | None, unit: str | None, statement: str | None, window: str | None, catalog: dict[str, tuple[str | None, str]]) -> str:
    """What the value says, apart from how it is written."""
    number, scale, name, _, conflict = read_fact(value, unit, statement, window)
    if number is not None:
        x = number * Decimal(catalog[scale][1] if scale in catalog else 1)
        if name in catalog:
            x, kind = x * Decimal(catalog[name][1]), catalog[name][0]
        elif conflict:
            kind = f"clash {amounts.read_value(value).phrase.unit or ''}"
        else:
            kind = "none"
        return f"{kind} {x.normalize():f}"
    text = amounts.plain(value).lower()
    if not any(c.isdigit() for c in text):
        return f"text {text}"
    body = amounts.FOOTNOTE.sub(" ", text.replace("'000", " thousand "))
    numbers = [f"{amounts.number_of(m[0]).normalize():f}" for m in amounts.NUMBER.finditer(body)]
    said = amounts.read_phrase(amounts.NUMBER.sub(" ", body).replace("-", " "))
    return f"text {' '.join(numbers)} {said.scale or ''} {said.unit or ''} {said.rest}"


def normalise(facts: DataFrame, entities: DataFrame, attributes: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """One row per fact (first delivery) with its fields in normal form and its keys.

    A null or blank report gives null keys, such a fact is never a repeat; a null or blank hash gives no hash key. Null fields
    count as a value of their own.
    """
    catalog = {r["unit_name"]: (r["common_unit"], str(r["factor"])) for r in unit_catalog.select("unit_name", "common_unit", "factor").collect()}  # a fixed list
    record = record_text(F.col("data_json"))
    cols = facts.filter("fact_id is not null").select("fact_id", F.col("ingest_seq").cast("bigint").alias("seq"), "document_id", "content_hash", "canonical_entity", "raw_attribute", "value", "unit", "statement", F.get_json_object(record, "$.temporal_scope").alias("scope"), F.get_json_object(record, "$.evidence_context_window").alias("window"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for fid, seq, doc, digest, entity, attribute, value, unit, statement, scope, window in b.itertuples(index=False, name=None):
                period, segment = scopes.scope_of(scope, statement, value)
                e, a = (" ".join(names.readings(x)[0]) or amounts.plain(x).lower() for x in (entity, attribute))
                rows.append((fid, seq, scopes.report_key(doc), (digest or "").strip().lower() or None, entity, attribute, e, a, period, segment, value_key(value, unit, statement, window, catalog)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NORMAL.split(", ")])

    read_rows = cols.mapInPandas(read, NORMAL)
    fields = [c.split()[0] for c in NORMAL.split(", ")][2:]
    once = materialize(read_rows.groupBy("fact_id").agg(F.min("seq").alias("seq"), F.min_by(F.struct(*fields), "seq").alias("f")).select("fact_id", "seq", "f.*"), "normal")
    named = canonical_names.with_entries(once, canonical_names.value_maps(once, entities, attributes))

    def key(seq: str, words: str) -> F.Column:
        return F.when(F.col(seq) >= 0, F.concat(F.lit("#"), F.col(seq).cast("string"))).otherwise(F.col(words))

    def hashed(*cols: str) -> F.Column:
        return F.when(F.col("report").isNotNull(), F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in cols]))

    @F.pandas_udf("string")
    def words_of(name: pd.Series) -> pd.Series:
        return name.map(lambda x: " ".join(names.readings(x)[0]) or amounts.plain(x).lower())

    for field, held in (("entity", entities), ("attribute", attributes)):  # the name on the list, null for a field that is on none
        named = named.join(F.broadcast(held.dropDuplicates(["seq"]).select(F.col("seq").alias(f"{field}_seq"), words_of("name").alias(f"{field}_name"))), f"{field}_seq", "left")
    out = named.withColumn("entity_key", key("entity_seq", "entity_words")).withColumn("attribute_key", key("attribute_seq", "attribute_words")).withColumn("listed", (F.coalesce(F.col("entity_seq"), F.lit(-1)) >= 0) & (F.coalesce(F.col("attribute_seq"), F.lit(-1)) >= 0))
    where = ("period", "segment", "value_key")
    return out.select(
        "fact_id", "seq", "entity_words", "attribute_words", "entity_key", "attribute_key", "entity_name", "attribute_name", "listed",
        F.when(F.col("report").isNotNull(), F.xxhash64("report")).alias("report"),
        F.when(F.col("report").isNotNull() & F.col("hash").isNotNull(), F.xxhash64(F.lit("hash"), "hash")).alias("k_hash"),
        hashed("entity_key", "attribute_key", *where).alias("k_says"),
        hashed("attribute_key", *where).alias("k_no_entity"),
        hashed("entity_key", *where).alias("k_no_attribute"),
    )


# --- learned weights -------------------------------------------------------------------------------------------------

LEVELS = ("same", "close", "other")


def agreement(a: str | None, b: str | None) -> str:
    """How two names in normal form agree: ``same``, ``close`` (misspelt, shortened) or ``other``."""
    if a == b:
        return "same"
    x, y = (a or "").split(), (b or "").split()
    if x and y and min(names.alignment(x, [w.rstrip(".") for w in y]), names.alignment(y, [w.rstrip(".") for w in x])) < 9:
        return "close"
    return "other"


@lru_cache(maxsize=100_000)
def _close(a: str, b: str) -> bool:
    return agreement(a, b) == "close"


@lru_cache(maxsize=20_000)
def _traits(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """How often each letter occurs, in 32 bins, in the name and in each of its first words, without stops and marks of a cut word; these
    words' initials; which of them are shortened; which to one or two letters, that none is misspelt of; the name's letters and its words."""
    words = name.split()
    letters, initials, short, tiny = np.zeros((1 + WORDS, 32), dtype=np.int32), np.zeros(WORDS, dtype=np.int32), np.zeros(WORDS, dtype=bool), np.zeros(WORDS, dtype=bool)
    for k, w in enumerate(["".join(words), *words[:WORDS]]):
        letters[k] = np.bincount(np.frombuffer(w.replace(".", "").replace("~", "").encode("utf-32-le"), dtype=np.uint32) & 31, minlength=32)
    for k, w in enumerate(words[:WORDS]):
        initials[k], short[k] = ord(w[0]), w.endswith(".")
        tiny[k] = short[k] and len(w) <= 3 and w != "~."
    return letters, initials, short, tiny, sum(len(w.rstrip(".")) for w in words), len(words)


_MOST = np.array([names.allowed_edits(k) for k in range(18)])


def close_pairs(left: list[str], right: list[str], within: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of a left with a right name whose agreement is ``close``; ``within``: both lists are the same, each pair once.

    Before the alignment, letters are counted: a misspelling adds one letter at most that the other name lacks, and only a shortened
    word, where names have as many words, may lack more letters than it has misspellings.
    """
    (a, first_a, short_a, tiny_a, size_a, n_a), (b, first_b, short_b, tiny_b, size_b, n_b) = (map(np.array, zip(*map(_traits, side), strict=True)) for side in (left, right))
    apart = np.abs(a[:, None, 0] - b[None, :, 0]).sum(2)
    over = (apart + a[:, 0].sum(1)[:, None] - b[:, 0].sum(1)[None, :]) // 2  # letters of the left name that the right one lacks
    under = apart - over
    most = _MOST[np.minimum(np.maximum.outer(size_a, size_b), len(_MOST) - 1)]
    as_many = np.equal.outer(n_a, n_b)
    maybe = np.where(as_many, np.minimum(over, under), np.maximum(over, under)) <= most
    i, j = np.nonzero(np.triu(maybe, 1) if within else maybe)
    more = a[i, 1:] - b[j, 1:]  # the same word by word
    over, under = np.maximum(more, 0).sum(2), np.maximum(-more, 0).sum(2)
    either, begin = np.maximum(over, under), first_a[i] != first_b[j]
    least_a = np.where(short_a[i], over, either) + 9 * (tiny_a[i] & begin)
    least_b = np.where(short_b[j], under, either) + 9 * (tiny_b[j] & begin)
    least = np.minimum(least_a.sum(1), least_b.sum(1))
    maybe = ~as_many[i, j] | (least <= most[i, j])
    i, j = i[maybe], j[maybe]
    hit = np.array([_close(*sorted((left[x], right[y]))) for x, y in zip(i, j, strict=True)], dtype=bool)
    return i[hit], j[hit]


def count_close(typed: DataFrame) -> DataFrame:
    """``matches, field, close``: the pairs of facts under a key whose names are close; ``typed(matches, field, key, words, n)`` has the distinct names.

    A key's names are compared block by block, each pair of blocks by itself, so that no key is gathered in one task.
    """
    typed = typed.filter("words <> ''")
    key = ["matches", "field", "key"]
    many = typed.groupBy(*key).agg(F.ceil(F.count("*") / NAME_BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    placed = typed.join(many, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).repartition(4 * typed.sparkSession.sparkContext.defaultParallelism, *key, "lo", "hi")
    met = met.groupBy(*key, "lo", "hi").agg(F.collect_list(F.struct("words", "n", "own")).alias("names"))
    met = met.filter(F.size("names") > 1).select("matches", "field", "lo", "hi", "names.words", "names.n", "names.own")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for matches, field, lo, hi, words, n, own in b.itertuples(index=False, name=None):
                left, right = (np.flatnonzero(np.asarray(own) == k) for k in (lo, hi))
                if len(left) and len(right):
                    i, j = close_pairs([words[x] for x in left], [words[x] for x in right], lo == hi)
                    n = np.asarray(n)
                    out.append((matches, field, float((n[left[i]] * n[right[j]]).sum())))
            yield pd.DataFrame(out, columns=["matches", "field", "close"])

    return met.mapInPandas(count, "matches boolean, field string, close double").groupBy("matches", "field").agg(F.sum("close").alias("close"))


FIELDS = ("entity", "attribute")


def count_levels(normal: DataFrame) -> dict[str, dict[str, dict[str, float]]]:
    """How many pairs of facts of a report agree on each level, by field: ``matches``, those with the same normalised statement, and ``others``.

    All pairs count: equal names by their numbers, close ones by the numbers of each two distinct names of a report, the rest are others.
    """
    where = ["report", "k_says"]
    spelt = normal.filter("report is not null").groupBy(*where, *[f"{f}_words" for f in FIELDS]).agg(F.count("*").cast("double").alias("n"))
    spelt = materialize(spelt, "spellings")
    crowded = spelt.groupBy(*where).agg(F.sum("n").alias("all")).filter("all > 1").select(*where)
    field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_words").alias("words")) for f in FIELDS])).alias("f")
    parts = spelt.select(F.lit(False).alias("matches"), F.col("report").alias("key"), "n", field)
    parts = parts.unionByName(spelt.join(crowded, where, "left_semi").select(F.lit(True).alias("matches"), F.xxhash64(*where).alias("key"), "n", field))
    typed = materialize(parts.groupBy("matches", "f.field", "key", "f.words").agg(F.sum("n").alias("n")), "typed")
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    sums = typed.groupBy("matches", "field", "key").agg(F.sum("n").alias("all"), pairs("n").alias("same")).groupBy("matches", "field").agg(pairs("all").alias("all"), F.sum("same").alias("same"))
    got = {(r["matches"], r["field"]): r for r in sums.join(count_close(typed), ["matches", "field"], "left").collect()}  # four rows
    out: dict[str, dict[str, dict[str, float]]] = {}
    for f in FIELDS:
        held = {}
        for matches in (True, False):
            r = got.get((matches, f))
            same, close, every = (r["same"], r["close"] or 0.0, r["all"]) if r else (0.0, 0.0, 0.0)
            held[matches] = {"same": same, "close": close, "other": every - same - close}
        out[f] = {"matches": held[True], "others": {level: held[False][level] - held[True][level] for level in LEVELS}}
    return out


def weights_of(counts: dict[str, dict[str, dict[str, float]]]) -> dict:
    """Log-odds of each level of agreement of entity and attribute in matches against non-matches, and the counts that they come from."""
    out: dict = {"counts": counts}
    for field, held in counts.items():
        m, u = ({level: 1.0 + held[side][level] for level in LEVELS} for side in ("matches", "others"))
        out[field] = {level: math.log(m[level] / sum(m.values())) - math.log(u[level] / sum(u.values())) for level in LEVELS}
    return out


def learn_weights(normal: DataFrame) -> dict:
    return weights_of(count_levels(normal))


def with_counts(held: dict | None, new: dict) -> dict:
    """The weights from the counts of both; weights without counts give way to new ones."""
    if not held or "counts" not in held or "counts" not in new:
        return new
    return weights_of({f: {side: {level: held["counts"][f][side][level] + n for level, n in levels.items()} for side, levels in sides.items()} for f, sides in new["counts"].items()})


def score_pair(weights: dict[str, dict[str, float]], entities: tuple[str | None, str | None], attributes: tuple[str | None, str | None]) -> float:
    """Posterior probability that two facts which agree on everything else state the same."""
    return posterior(weights, {"entity": agreement(*entities), "attribute": agreement(*attributes)})


def posterior(weights: dict[str, dict[str, float]], levels: dict[str, str]) -> float:
    if "other" in levels.values():  # the exact check: another entity or attribute is no repeat, whatever the rest
        return 0.0
    odds = math.log(PRIOR / (1 - PRIOR)) + sum(weights[f][level] for f, level in levels.items())
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def field_agreement(a: tuple[str | None, str | None, str | None], b: tuple[str | None, str | None, str | None]) -> str:
    """How a field of two facts agrees, each given as its key, its words as typed and its name on the list (null if on none): ``same``
    under one key; else as the words agree, or the words of the side on no list with the other's name on the list."""
    if a[0] == b[0]:
        return "same"
    level = agreement(a[1], b[1])
    for listed, typed in ((a, b), (b, a)):
        if level == "other" and listed[2] is not None and typed[2] is None:
            level = agreement(listed[2], typed[1])
    return level


# --- the history's tables --------------------------------------------------------------------------------------------


#: What the names of a fact are compared by.
NAMES = ("entity_words", "attribute_words", "entity_key", "attribute_key", "entity_name", "attribute_name")


class History:
    """The tables that a store of accepted facts keeps, in buckets of the report: ``classes`` (blocking keys and names of the accepted facts) and ``clusters``
    (representative of every fact seen); and ``merges``, which representative another one stands for, the last batch's word counting.

    ``History(spark, path)`` opens what is there, or begins anew. ``manifest.json`` holds the number of whole batches, the buckets and the learned weights; it is
    replaced when a batch is whole, so that a batch that fails may be given again.
    """

    SCHEMAS = {
        "classes": "report bigint, k_hash bigint, k_says bigint, k_no_entity bigint, k_no_attribute bigint, entity_words string, attribute_words string, entity_key string, attribute_key string, entity_name string, attribute_name string, listed boolean, fact_id string, seq bigint, bucket int",
        "clusters": "fact_id string, representative string, bucket int",
        "merges": "member string, root string",
    }

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        import uuid

        self.spark = spark
        self.path = path or f"{work_dir(spark)}/factloom/history-{uuid.uuid4().hex}"
        self.weights: dict | None = None
        self.batches, self.buckets = 0, buckets
        self.merged: list[int] = []  # the batches that merged clusters
        held = self._manifest()
        if held:
            self.batches, self.buckets, self.weights, self.merged = held["batches"], held["buckets"], held["weights"], held["merged"]

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        p, fs = self._file("manifest.json")
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.option("wholetext", "true").text(p.toString()).first()[0])

    def commit(self, merged: bool, learned: dict | None = None) -> None:
        """Makes the batch that was written count, and the weights learned from it."""
        self.weights = learned or self.weights
        if merged:
            self.merged.append(self.batches)
        self.batches += 1
        self._write_manifest()

    def keep(self, weights: dict) -> None:
        self.weights = weights
        self._write_manifest()

    def _write_manifest(self) -> None:
        part, fs = self._file("manifest.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"batches": self.batches, "buckets": self.buckets, "weights": self.weights, "merged": self.merged}).encode()))
        out.close()
        target, _ = self._file("manifest.json")
        fs.delete(target, False)
        fs.rename(part, target)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        known = self.merged if name == "merges" else range(self.batches)
        if not len(known):
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        parts = [f"{self.path}/{name}/batch={k}" for k in known]
        columns = [c.split()[0] for c in self.SCHEMAS[name].split(", ")]
        df = self.spark.read.schema(self.SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*parts)
        if name == "merges":  # a member's last word
            return df.groupBy("member").agg(F.max_by("root", F.col("batch").cast("int")).alias("root"))
        df = df.select(*columns)
        return df.filter(F.col("bucket").isin(buckets)) if buckets is not None else df

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in self.SCHEMAS[name].split(", ")]
        rows = rows.select(*columns)
        target = f"{self.path}/{name}/batch={self.batches}"
        (rows.repartition("bucket").write.partitionBy("bucket") if "bucket" in columns else rows.write).mode("overwrite").parquet(target)


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def _salt(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def _settle(combos: DataFrame, keys: DataFrame) -> DataFrame:
    """Which combos are accepted. ``combos(combo, seq)``; ``keys(report, key, combo, seq)``. Returns ``combo``.

    Rounds: whoever is the earliest undecided under all of its keys is accepted, whoever shares a key with an accepted one is
    decided. Only keys with more than one combo take part.
    """
    shared = keys.groupBy("report", "key").agg(F.count("*").alias("n")).filter("n > 1").select("report", "key")
    mixed = materialize(_salt(keys, "combo").join(_salted(shared), ["report", "key", "salt"]).drop("salt"), "shared-keys")
    accepted = combos.join(mixed.select("combo").distinct(), "combo", "left_anti").select("combo")
    todo = mixed
    parts = [accepted]
    while not todo.isEmpty():
        first = todo.groupBy("report", "key").agg(F.min("seq").alias("first"))
        state = _salt(todo, "combo").join(_salted(first), ["report", "key", "salt"]).groupBy("combo").agg(F.max(F.col("first") < F.col("seq")).alias("waits"))
        state = materialize(state, "round")
        now = state.filter("not waits").select("combo")
        parts.append(now)
        taken = todo.join(now, "combo", "left_semi").select("report", "key").distinct()
        decided = _salt(todo, "combo").join(_salted(taken), ["report", "key", "salt"]).select("combo").distinct()
        todo = materialize(todo.join(decided, "combo", "left_anti"), "undecided")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def link_batch(history: History, normal: DataFrame, weights: dict | None = None) -> DataFrame:
    """Checks a batch of facts in normal form (:func:`normalise`) against the history and against itself, and adds it to the history.

    Returns ``fact_id, accepted_id``: each repeat with every accepted fact that it repeats (one by hash and one by
    statement may differ). Facts that the history has seen under their id are deliveries of the same fact and are left out. An empty
    batch changes nothing. The batch's ``ingest_seq`` must lie after the history's. Without ``weights`` they come from all pairs of facts that
    arrived in one batch, this one's and the earlier ones', whose counts the manifest keeps.
    """
    normal = normal.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("report"), F.lit(history.buckets)), F.lit(0)).cast("int"))
    buckets = [r[0] for r in normal.select("bucket").distinct().collect()] if history.batches else []  # as many rows as there are buckets at most
    if history.batches:  # a fact that comes again comes with its report
        normal = materialize(normal.join(history.read("clusters", buckets).select("fact_id"), "fact_id", "left_anti"), "batch")
    learned = with_counts(history.weights, learn_weights(normal)) if weights is None else None
    weights = weights or learned
    # Copies with the same keys are one combo, which its first fact stands for.
    grouped = normal.filter("report is not null").groupBy("report", "k_hash", "k_says").agg(F.min(F.struct("seq", "fact_id", "k_no_entity", "k_no_attribute", *NAMES, "listed", "bucket")).alias("f"))
    combos = materialize(grouped.select("report", "k_hash", "k_says", "f.*", F.xxhash64("report", F.coalesce("k_hash", F.lit(0)), "k_says").alias("combo")), "combos")
    # Looser keys: classes that differ in one name, of which at least one is on no list, in every spelling of the batch.
    old = history.read("classes", buckets)
    sides = ("report", "k_says", "k_no_entity", "k_no_attribute", *NAMES, "listed")
    spelt = materialize(normal.filter("report is not null").select(*sides).distinct(), "spelt")
    every = spelt.withColumn("is_old", F.lit(False)).withColumn("fact_id", F.lit(None).cast("string")).withColumn("seq", F.lit(None).cast("bigint"))
    every = every.unionByName(old.select(*sides, "fact_id", "seq").withColumn("is_old", F.lit(True))) if history.batches else every

    @F.pandas_udf("double")
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
        out = []
        for x, y in zip(left.astype(object).where(left.notna(), None).itertuples(index=False), right.astype(object).where(right.notna(), None).itertuples(index=False), strict=True):
            out.append(posterior(weights, {"entity": field_agreement(x[0::2], y[0::2]), "attribute": field_agreement(x[1::2], y[1::2])}))
        return pd.Series(out, dtype=float)

    carried = ("k_says", "fact_id", "seq", "is_old")
    ordered = ("entity_key", "attribute_key", "entity_words", "attribute_words", "entity_name", "attribute_name")
    near = None
    for key in ("k_no_entity", "k_no_attribute"):
        left = every.filter("not listed").select("report", key, *[F.col(c).alias(f"l_{c}") for c in (*carried, *NAMES)])
        right = every.select("report", key, *[F.col(c).alias(f"r_{c}") for c in (*carried, *NAMES)])
        pairs = left.join(right, ["report", key]).filter("l_k_says <> r_k_says and not (l_is_old and r_is_old)").drop(key)
        near = pairs if near is None else near.unionByName(pairs)
    near = near.filter(score(*[F.struct(*[F.col(f"{side}_{c}") for c in ordered]) for side in "lr"]) >= MATCH_PROBABILITY)
    near = materialize(near.select("report", *[f"{side}_{c}" for side in "lr" for c in carried]).distinct(), "near")
    flipped = near.select("report", *[F.col(f"r_{c}").alias(f"l_{c}") for c in carried], *[F.col(f"l_{c}").alias(f"r_{c}") for c in carried])
    both = near.unionByName(flipped)
    near_old = both.filter("not l_is_old and r_is_old").select("report", F.col("l_k_says").alias("k_says"), F.col("r_fact_id").alias("accepted_id"), F.col("r_seq").alias("accepted_seq")).distinct()
    near_new = both.filter("not l_is_old and not r_is_old").select("report", F.col("l_k_says").alias("k_says"), F.xxhash64(F.least("l_k_says", "r_k_says"), F.greatest("l_k_says", "r_k_says")).alias("key")).distinct()
    own = combos.select("report", "combo", "seq", F.explode(F.array("k_hash", "k_says")).alias("key")).filter("key is not null")
    keys = own.unionByName(near_new.join(combos.select("report", "k_says", "combo", "seq"), ["report", "k_says"]).select("report", "combo", "seq", "key"))
    # Probe the history, then settle the rest of the batch.
    empty = history.spark.createDataFrame([], "combo bigint, accepted_id string, accepted_seq bigint")
    hits = empty
    if history.batches:
        old_keys = old.select("report", F.explode(F.array("k_hash", "k_says")).alias("key"), F.col("fact_id").alias("accepted_id"), F.col("seq").alias("accepted_seq")).filter("key is not null")
        probe = _salt(keys, "combo").join(_salted(_touched(old_keys, keys)), ["report", "key", "salt"]).select("combo", "accepted_id", "accepted_seq")
        loose = near_old.join(combos.select("report", "k_says", "combo"), ["report", "k_says"]).select("combo", "accepted_id", "accepted_seq")
        hits = materialize(probe.unionByName(loose).distinct(), "hits")
    known = hits.select("combo").distinct()
    open_combos, open_keys = (combos.join(known, "combo", "left_anti"), keys.join(known, "combo", "left_anti")) if history.batches else (combos, keys)
    accepted = materialize(_settle(open_combos.select("combo", "seq"), open_keys).distinct(), "accepted")
    # A combo's accepted facts: those of the history and the earlier ones of the batch under any of its keys.
    accepted_keys = keys.join(accepted, "combo", "left_semi").select("report", "key", "combo").join(combos.select("combo", F.col("fact_id").alias("accepted_id"), F.col("seq").alias("accepted_seq")), "combo").drop("combo")
    several = keys.groupBy("report", "key").agg(F.count("*").alias("n")).filter("n > 1").select("report", "key")
    inside = _salt(keys, "combo").join(_salted(accepted_keys.join(several, ["report", "key"], "left_semi")), ["report", "key", "salt"]).filter("accepted_seq < seq").select("combo", "accepted_id", "accepted_seq")
    # The other facts of an accepted combo repeat its first fact.
    crowded = normal.filter("report is not null").groupBy("report", "k_hash", "k_says").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("report", F.coalesce("k_hash", F.lit(0)), "k_says").alias("combo"))
    copies = combos.join(accepted, "combo", "left_semi").join(crowded, "combo", "left_semi").select("combo", F.col("fact_id").alias("accepted_id"), F.col("seq").alias("accepted_seq"))
    targets = hits.unionByName(inside).unionByName(copies).distinct()
    members = _salt(normal.filter("report is not null").select("fact_id", "seq", F.xxhash64("report", F.coalesce("k_hash", F.lit(0)), "k_says").alias("combo")), "fact_id")
    pairs, _ = write_work(members.join(_salted(targets), ["combo", "salt"]).filter("accepted_seq < seq and accepted_id <> fact_id").select("fact_id", "accepted_id", "accepted_seq").distinct(), "repeats")
    kept = combos.join(accepted, "combo", "left_semi").drop(*NAMES)
    _remember(history, normal, kept.join(spelt.select("report", "k_says", *NAMES), ["report", "k_says"]), pairs, learned)
    return pairs.select("fact_id", "accepted_id")


def _touched(old_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """The history's keys that the batch has, before they are repeated for the salted join."""
    return old_keys.join(keys.select("report", "key").distinct(), ["report", "key"], "left_semi")


def _remember(history: History, normal: DataFrame, accepted: DataFrame, pairs: DataFrame, learned: dict | None) -> None:
    history.append("classes", accepted)
    chosen = pairs.groupBy("fact_id").agg(F.min_by("accepted_id", "accepted_seq").alias("representative"))
    history.append("clusters", normal.select("fact_id", "bucket").join(chosen, "fact_id", "left").select("fact_id", F.coalesce("representative", "fact_id").alias("representative"), "bucket"))
    # A fact that repeats two accepted facts joins their clusters; only those clusters change their representative.
    ends = pairs.groupBy("fact_id").agg(F.min("accepted_id").alias("u"), F.max("accepted_id").alias("v")).filter("u <> v").select("u", "v").distinct()
    some = not ends.isEmpty()
    if some:
        known = history.read("merges")
        for end in ("u", "v"):
            ends = ends.join(known.select(F.col("member").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(end, F.coalesce(f"r{end}", end)).drop(f"r{end}")
        joined = materialize(star_components(ends.filter("u <> v")), "joined")
        moved = known.join(joined.select(F.col("member").alias("root"), F.col("root").alias("to")), "root").select("member", F.col("to").alias("root"))
        history.append("merges", joined.unionByName(moved).groupBy("member").agg(F.min("root").alias("root")))
    history.commit(some, learned)


def clusters(history: History) -> DataFrame:
    """``fact_id, representative`` of all facts seen so far."""
    held = history.read("clusters").select("fact_id", "representative")
    if not history.merged:
        return held
    return held.join(history.read("merges").select(F.col("member").alias("representative"), "root"), "representative", "left").select("fact_id", F.coalesce("root", "representative").alias("representative"))


def link_all(facts: DataFrame, entities: DataFrame, attributes: DataFrame, unit_catalog: DataFrame, steps: int = 3, path: str | None = None) -> tuple[DataFrame, History]:
    """Feeds a table of facts batch by batch, in ``steps`` runs of consecutive batch numbers, through :func:`link_batch`.

    The weights come from all pairs of facts of the table and, of a history opened again, the counts that it holds. The result does not depend on ``steps``, but for near pairs that only a later run's spelling of an accepted fact would link. Null batch numbers come first. An empty table gives an empty result.
    """
    history = History(facts.sparkSession, path)
    batch_of = facts.groupBy("fact_id").agg(F.min_by("batch_no", "ingest_seq").alias("batch_no"))
    normal = materialize(normalise(facts, entities, attributes, unit_catalog).join(batch_of, "fact_id"), "normal")
    bounds = normal.agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).first()
    lo, hi = (bounds["lo"], bounds["hi"]) if bounds["lo"] is not None else (0, 0)
    number = F.coalesce(F.col("batch_no"), F.lit(lo))
    fresh = normal.join(history.read("clusters").select("fact_id"), "fact_id", "left_anti") if history.batches else normal
    weights = with_counts(history.weights, learn_weights(fresh))
    starts = sorted({lo + (hi + 1 - lo) * k // steps for k in range(steps)})
    out = None
    for start, end in zip(starts, [*starts[1:], hi + 1], strict=True):
        found = link_batch(history, normal.filter((number >= start) & (number < end)).drop("batch_no"), weights)
        out = found if out is None else out.unionByName(found)
    history.keep(weights)
    return out, history


def repeats(facts: DataFrame, entities: DataFrame, attributes: DataFrame, unit_catalog: DataFrame) -> DataFrame:
    """``fact_id_a, fact_id_b``: each repeat with the accepted fact that it repeats, smaller id first."""
    pairs, _ = link_all(facts, entities, attributes, unit_catalog)
    return pairs.select(F.least("fact_id", "accepted_id").alias("fact_id_a"), F.greatest("fact_id", "accepted_id").alias("fact_id_b")).distinct()
