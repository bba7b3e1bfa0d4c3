"""Entity and attribute resolution against registries, and the growth of registries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import similarity
from factloom.operators import knn
from factloom.session import materialize

THRESHOLD = 0.85
TOKEN_SET = 90.0
#: Entries per block of a registry. A registry is small by nature; a larger one is met block by block.
BLOCK = 2_000


def resolve(names: DataFrame, registry: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``name, resolved, score`` for distinct ``names(name, embedding)``: the most similar entry from the threshold on, ties to the
    earliest; else the name itself with 1.0. Blank names give an empty result with 0.0.

    Names meet the registry (``seq, name, embedding``) in matrix products of blocks.
    """
    keyed = names.select(F.xxhash64("name").alias("id"), F.lit(1).alias("grp"), "embedding").filter(F.trim("name") != "")
    base = registry.select(F.col("seq").alias("id"), F.lit(0).alias("grp"), "embedding")
    best = knn.top_k(keyed, base, 1, "other_group").select(F.col("query_id").alias("id"), F.col("neighbour_id").alias("seq"), F.col("similarity").alias("s")).filter(F.col("s") >= threshold)
    known = best.join(registry.select("seq", F.col("name").alias("known")), "seq")
    out = names.select("name", F.xxhash64("name").alias("id")).join(known, "id", "left")
    blank = F.trim("name") == ""
    return out.select("name", F.when(blank, "").otherwise(F.coalesce("known", F.trim("name"))).alias("resolved"), F.when(blank, 0.0).otherwise(F.coalesce("s", F.lit(1.0))).alias("score"))


def _against_registry(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Each name with each block of the registry: ``name, entries``."""
    blocks = max(1, -(-registry.count() // BLOCK))
    packed = registry.filter("name is not null").groupBy(F.pmod(F.xxhash64("seq"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("entries"))
    return names.select("name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")).join(packed, "block").select("name", "entries")


def snap(names: DataFrame, registry: DataFrame) -> DataFrame:
    """``name, snapped, how``: the first entry in the registry's order that matches as an acronym, by its words or as a beginning; else the name.

    ``names(name)`` are distinct; blank names stay as they are.
    """

    @F.pandas_udf("struct<seq:bigint,known:string,how:string>")
    def first(name: pd.Series, entries: pd.Series) -> pd.DataFrame:
        rows = []
        for n, held in zip(name, entries, strict=True):
            hit = next(((e["seq"], e["name"], how) for e in held if (how := similarity.lexical_match(n, e["name"]))), (None, None, None))
            rows.append(hit)
        return pd.DataFrame(rows, columns=["seq", "known", "how"]).astype({"seq": "Int64"})

    pairs = _against_registry(names.filter(F.trim("name") != ""), registry)
    hit = pairs.select("name", first("name", "entries").alias("m")).filter("m.seq is not null").groupBy("name").agg(F.min(F.struct("m.seq", "m.known", "m.how")).alias("m"))
    return names.join(hit, "name", "left").select("name", F.coalesce("m.known", "name").alias("snapped"), F.coalesce("m.how", F.lit("none")).alias("how"))


def snap_cascade(names: DataFrame, registry: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``name, snapped, how``: :func:`snap`, and where no entry matches by its letters the most similar one by cosine from the threshold on (``meaning``), else the
    name itself (``none``), which :func:`grow_registry` makes an entry. ``names(name, embedding)``, ``registry(seq, name, embedding)``."""
    lexical = materialize(snap(names.select("name"), registry), "snapped")
    rest = names.join(lexical.filter("how = 'none'").select("name"), "name", "left_semi")
    near = resolve(rest, registry, threshold).filter("name <> resolved and resolved <> ''").select("name", "resolved")
    known = near.join(registry.select(F.col("name").alias("resolved")).distinct(), "resolved", "left_semi")
    return lexical.join(known, "name", "left").select("name", F.coalesce("resolved", "snapped").alias("snapped"), F.when(F.col("resolved").isNotNull(), "meaning").otherwise(F.col("how")).alias("how"))


def similar_words(names: DataFrame, registry: DataFrame, least: float = TOKEN_SET) -> DataFrame:
    """``name, seq, score``: entries whose words score more than ``least``."""

    @F.pandas_udf("array<struct<seq:bigint,score:double>>")
    def near(name: pd.Series, entries: pd.Series) -> pd.Series:
        out = []
        for n, held in zip(name, entries, strict=True):
            scored = [(int(e["seq"]), similarity.token_set_score(n, e["name"])) for e in held]
            out.append([{"seq": q, "score": x} for q, x in scored if x > least])
        return pd.Series(out)

    pairs = _against_registry(names.filter(F.trim("name") != ""), registry)
    return pairs.select("name", F.explode(near("name", "entries")).alias("m")).select("name", "m.seq", "m.score")


def acronym_pairs(names: DataFrame, registry: DataFrame) -> DataFrame:
    """``name, seq`` of names and entries of which one is the other's acronym: two joins on the letters."""
    k = registry.select("seq", F.col("name").alias("known"))
    left = names.select("name").join(k.withColumn("letters", similarity.initials_of(F.col("known"))), F.col("name") == F.col("letters"))
    right = names.select("name", similarity.initials_of(F.col("name")).alias("letters")).join(k, F.col("letters") == F.col("known"))
    both = left.select("name", "seq", "known").unionByName(right.select("name", "seq", "known"))
    return both.filter(similarity.acronym_match(F.col("name"), F.col("known"))).select("name", "seq").distinct()


def prefix_pairs(names: DataFrame, registry: DataFrame) -> DataFrame:
    """``name, seq`` of names and entries of which one begins with the other: a join on the first five letters."""
    k = registry.select("seq", F.col("name").alias("known"), F.lower(F.substring("name", 1, 5)).alias("head"))
    n = names.select("name", F.lower(F.substring("name", 1, 5)).alias("head"))
    return n.join(k, "head").filter(similarity.prefix_match(F.col("name"), F.col("known"))).select("name", "seq")


def grow_registry(names: DataFrame, registry: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``seq, name``: the registry after all names have come in their order.

    A name that is similar to no entry becomes one, visible to the names after it. Names are matched with the present registry in parallel;
    only distinct unmatched ones, in the order of ``first_seq``, go through the ordered fold.
    ``names(name, embedding, first_seq)``, ``registry(seq, name, embedding)``.
    """
    known = resolve(names.select("name", "embedding"), registry, threshold)
    have = registry.select("name").distinct()
    fresh = names.join(known.filter(F.col("resolved") == F.trim("name")), "name", "left_semi").join(have, "name", "left_anti").filter(F.trim("name") != "")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []
        for b in batches:
            rows = []
            for name, vector, seq in b[["name", "embedding", "first_seq"]].itertuples(index=False, name=None):
                v = np.asarray(vector, float)
                n = np.linalg.norm(v)
                v = v / n if n else v
                if kept and n and max(float(v @ k) for k in kept) >= threshold:
                    continue
                kept.append(v)
                rows.append((seq, name))
            yield pd.DataFrame(rows, columns=["first_seq", "name"])

    ordered = fresh.select("name", "embedding", "first_seq").coalesce(1).sortWithinPartitions("first_seq", "name").mapInPandas(fold, "first_seq bigint, name string")
    start = registry.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    from pyspark.sql.window import Window

    added = ordered.withColumn("seq", F.row_number().over(Window.orderBy("first_seq", "name")) - 1 + start).select("seq", "name")
    return registry.select("seq", "name").unionByName(added)
