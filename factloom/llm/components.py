"""Groups out of pairwise matches (problem 4): alternating large-star and small-star.

Each round rewrites the edges by distributed joins; no neighbourhood is ever gathered into one task. A node's
smallest neighbour is a partial aggregation, and rewriting its edges is a join on the node. Nodes with very many
edges ("hubs") would load one task of that join, so they are joined by broadcast: a node counts as a hub above
2 * edges / HUBS edges, hence there are fewer than HUBS of them at any size of the data.

Names are numbered once in their own order, the rounds compare and shuffle the numbers, and the result is named again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import drop_work, write_work

#: Proven bound of the broadcast side: so many nodes at most have more than 2 * edges / HUBS edges.
HUBS = 5_000
#: No node with fewer edges counts as a hub.
LEAST_HUB_DEGREE = 20_000


def is_corroboration(verdict: F.Column) -> F.Column:
    """Whether a verdict says "corroborates", however it is written: case, quotes, white space, a full stop, an enum's prefix.

    A verdict that mentions the word beside another one is no such verdict; null and blank are none.
    """
    plain = F.regexp_replace(F.lower(verdict), r"[^\p{L}\p{N}()]+", " ")
    return F.coalesce(F.regexp_replace(F.trim(plain), r"^relationshiptype ", "") == "corroborates", F.lit(False))


def corroboration_edges(relationships: DataFrame) -> DataFrame:
    """Distinct undirected edges ``u, v`` with u < v. Pairs of a fact with itself, null and blank ids give none."""
    a, b = F.col("fact_id_a"), F.col("fact_id_b")
    held = relationships.filter(is_corroboration(F.col("relationship_type"))).filter((F.trim(a) != "") & (F.trim(b) != "") & (a != b))
    return held.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _toward_minimum(edges: DataFrame, both_ways: bool, n_edges: int) -> DataFrame:
    """Large-star (both_ways): each node links its larger neighbours to the smallest node of its neighbourhood.
    Small-star: each node links its smaller neighbours and itself to the smallest of them."""
    away = edges.select(F.col("v").alias("n"), F.col("u").alias("m"))  # n has the smaller neighbour m
    around = away.unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("m"))) if both_ways else away
    least = around.groupBy("n").agg(F.min("m").alias("least"), F.count("m").alias("degree"))
    if both_ways:
        least = least.withColumn("least", F.least("n", "least"))
        moved = around.filter("m > n")
    else:
        moved = away
    threshold = max(LEAST_HUB_DEGREE, 2 * n_edges // HUBS)
    hubs = least.filter(F.col("degree") > threshold).select("n", F.col("least").alias("hub_least"))
    if n_edges > threshold:
        split = moved.join(F.broadcast(hubs), "n", "left")
        by_hub = split.filter("hub_least is not null").select("n", "m", F.col("hub_least").alias("least"))
        others = split.filter("hub_least is null").select("n", "m").join(least.filter(F.col("degree") <= threshold).select("n", "least"), "n")
        linked = others.select("n", "m", "least").unionByName(by_hub)
    else:
        linked = moved.join(least.select("n", "least"), "n")
    out = linked.select(F.col("least").alias("u"), F.col("m").alias("v"))
    if not both_ways:
        out = out.unionByName(least.select(F.col("least").alias("u"), F.col("n").alias("v")))
    return out.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _sum_of(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return r["n"], r["h"] or 0


def star_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``member, root``: each node of the undirected edges ``u, v`` with the smallest node of its component.

    Nodes are compared as they are (strings in binary order). The smallest node itself is a row too. Without edges
    the result is empty. Rounds go on until a round changes nothing; ``max_rounds`` guards against a defect
    and raises, it never returns unfinished groups.
    """
    spark = edges.sparkSession
    now, path = write_work(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = _sum_of(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large, large_path = write_work(_toward_minimum(now, True, seen[0]), "large-star")
        small, small_path = write_work(_toward_minimum(large, False, seen[0]), "small-star")
        found = _sum_of(small)
        drop_work(spark, path)
        drop_work(spark, large_path)
        now, path = small, small_path
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("member"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("member"), F.col("u").alias("root")).distinct())


def _looked_up(rows: DataFrame, key: str, counted: DataFrame, value: str, n_rows: int) -> DataFrame:
    """Adds ``value`` of ``counted(key, value, degree)``, which has each key of ``rows`` once with the number of its rows there: keys of very many rows by
    broadcast (fewer than HUBS), the others by a join."""
    threshold = max(LEAST_HUB_DEGREE, 2 * n_rows // HUBS)
    if n_rows <= threshold:
        return rows.join(counted.select(key, value), key)
    hubs = counted.filter(F.col("degree") > threshold).select(key, F.col(value).alias("hub_value"))
    split = rows.join(F.broadcast(hubs), key, "left")
    others = split.filter("hub_value is null").drop("hub_value").join(counted.filter(F.col("degree") <= threshold).select(key, value), key)
    return split.filter("hub_value is not null").withColumnRenamed("hub_value", value).unionByName(others)


def named_components(edges: DataFrame) -> DataFrame:
    """:func:`star_components` for nodes with names, in rounds over numbers. The numbers ascend with the names: a range partitioning by name, sorted, counted
    through (they need not be without gaps), and written, so that a lost executor cannot number anew."""
    spark = edges.sparkSession
    edges, edges_path = write_work(edges.select("u", "v"), "named-edges")
    n = edges.count()
    degrees = edges.select(F.explode(F.array("u", "v")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    numbered = degrees.repartitionByRange("name").sortWithinPartitions("name").withColumn("number", F.monotonically_increasing_id())
    nodes, nodes_path = write_work(numbered, "nodes")
    by_u = _looked_up(edges, "u", nodes.withColumnRenamed("name", "u"), "number", n).select("v", F.col("number").alias("nu"))
    both = _looked_up(by_u, "v", nodes.withColumnRenamed("name", "v"), "number", n).select(F.col("nu").alias("u"), F.col("number").alias("v"))
    found, found_path = write_work(star_components(both), "components")
    drop_work(spark, edges_path)
    members = found.join(nodes.select(F.col("number").alias("member"), "name"), "member").select("root", "name")
    # sizes are counted by number; a component of very many members gets its name by broadcast
    sizes = found.groupBy("root").agg(F.count("*").alias("degree"))
    roots = sizes.join(nodes.select(F.col("number").alias("root"), F.col("name").alias("root_name")), "root")
    out, _ = write_work(_looked_up(members, "root", roots, "root_name", 2 * n).select(F.col("name").alias("member"), F.col("root_name").alias("root")), "named-components")
    for path in (nodes_path, found_path):
        drop_work(spark, path)
    return out


def corroboration_groups(relationships: DataFrame) -> DataFrame:
    """``fact_id, group_id`` of every id that a corroborating verdict links to another id."""
    return named_components(corroboration_edges(relationships)).select(F.col("member").alias("fact_id"), F.col("root").alias("group_id"))
