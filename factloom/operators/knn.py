"""Exact nearest neighbours by blocks of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors per block; a pair of blocks is one matrix product.
BLOCK = 4096
OUT = "query_id bigint, neighbour_id bigint, similarity double"


def top_k(queries: DataFrame, base: DataFrame, k: int = 8, rule: str = "other_group", block: int = BLOCK) -> DataFrame:
    """``query_id, neighbour_id, similarity, rank``: the k most similar base vectors of each query, ties to the smaller id.

    Both sides have ``id, grp, embedding``. ``rule``: ``other_group`` (another document), ``other_id``, or ``earlier`` (another
    document and a smaller id, what was stored before). Blocks of queries meet blocks of base vectors in matrix products; each product keeps its k
    best, and the blocks' winners are merged by a window of at most k rows per block and query. Null and zero vectors match nothing.
    """
    n_base = base.count()
    n_query = queries.count()
    nb, nq = max(1, -(-n_base // block)), max(1, -(-n_query // block))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        rows = df.filter("embedding is not null").withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)))
        return rows.groupBy(name).agg(F.collect_list(F.struct("id", "grp", "embedding")).alias(f"{name}_rows"))  # about ``block`` rows each

    # every block of queries against every block of the base: the stated set against all rows, in blocks
    grid = packed(queries, nq, "q").select("q_rows", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b")).repartition(max(1, nb * nq), "b").join(packed(base, nb, "b"), "b")

    def best(batches):
        for pdf in batches:
            for qs, bs in zip(pdf["q_rows"], pdf["b_rows"], strict=True):
                q_id, b_id = (np.array([r["id"] for r in x], np.int64) for x in (qs, bs))
                q_g, b_g = (np.array([r["grp"] for r in x], np.int64) for x in (qs, bs))
                q, b = (_unit(np.array([r["embedding"] for r in x], np.float64)) for x in (qs, bs))
                order = np.argsort(b_id, kind="stable")
                b_id, b_g, b = b_id[order], b_g[order], b[order]
                sim = q @ b.T
                bad = (q_id[:, None] == b_id) if rule == "other_id" else (q_g[:, None] == b_g)
                if rule == "earlier":
                    bad |= b_id >= q_id[:, None]
                bad |= (np.abs(q).sum(1) == 0)[:, None] | (np.abs(b).sum(1) == 0)
                sim = np.where(bad, -np.inf, np.round(sim, 9))
                top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                s = np.take_along_axis(sim, top, 1)
                keep = np.isfinite(s)
                yield pd.DataFrame({"query_id": np.repeat(q_id, keep.sum(1)), "neighbour_id": b_id[top][keep], "similarity": s[keep]})

    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return grid.select("q_rows", "b_rows").mapInPandas(best, OUT).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
