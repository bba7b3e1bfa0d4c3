"""Filling fixed-capacity containers (problem 7): pattern packing by non-negative least squares.

The plan is made from the histogram of the lengths alone, which has at most as many entries as the capacity,
whatever the size of the data. Patterns of few lengths that fill a container exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down; what is left over is packed by best fit over
lengths with counts. The plan says which ranks of each length go to which containers; the documents get their ranks by a
distributed count and look their container up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.tokens import TOKENIZERS, token_counts
from factloom.session import materialize

CAPACITY = 2048
#: Rows per bucket in which ranks are counted.
RANK_BUCKET = 50_000


def enumerate_patterns(counts: np.ndarray) -> np.ndarray:
    """Patterns of up to three lengths, one per row and padded by 0, of which each sums to the capacity exactly.

    ``counts[l]``: how many items have length l; lengths that do not occur make no pattern.
    """
    capacity = len(counts) - 1
    have = np.flatnonzero(counts[1:]) + 1
    there = counts > 0
    out = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    pairs = have[(have * 2 <= capacity)]
    pairs = pairs[there[capacity - pairs]]
    out.append(np.stack([capacity - pairs, pairs, np.zeros_like(pairs)], 1))
    for a in have[have * 3 >= capacity]:
        b = have[np.searchsorted(have, (capacity - a + 1) // 2) : np.searchsorted(have, min(a, capacity - a - 1), "right")]
        b = b[there[capacity - a - b]]
        if len(b):
            out.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradient; A counts lengths in patterns."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    flat, of = patterns[used], np.nonzero(used)[0]
    h = counts.astype(float)
    scale = max(h.max(), 1.0)
    h = h / scale
    # A'A has row sums of at most (lengths in a pattern) x (patterns of a length)
    per_length = np.bincount(flat, minlength=len(counts))
    lipschitz = 3.0 * max(per_length.max(), 1)
    weight = 1.0 / np.sqrt(np.maximum(per_length, 1.0))  # frequent lengths must not slow down the others
    x = np.zeros(len(patterns))
    y, t = x.copy(), 1.0
    lipschitz = 3.0 * np.max(np.bincount(of, weights=weight[flat] ** 2 * per_length[flat], minlength=len(patterns)))
    for _ in range(rounds):
        residual = (np.bincount(flat, weights=y[of], minlength=len(counts)) - h) * weight**2
        grad = np.bincount(of, weights=residual[flat], minlength=len(patterns))
        nxt = np.maximum(0.0, y - grad / lipschitz)
        t_nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t_nxt * (nxt - x), nxt, t_nxt
    return x * scale


def plan_containers(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The packing of ``counts[l]`` items of each length l, as runs of ranks.

    Run i puts the items of length ``length`` with ranks ``rank``..``rank + n - 1`` into the containers ``container``.. (one each),
    each beginning at token ``start``. Every item is in exactly one run; no container holds more than the capacity.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    patterns = enumerate_patterns(left)
    repeats = np.floor(fit_repeats(patterns, left)).astype(np.int64)
    runs: list[tuple[int, int, int, int, int]] = []  # length, rank, n, container, start
    next_rank = np.zeros(capacity + 1, np.int64)
    made = 0

    def put(length: int, n: int, container: int, start: int) -> None:
        runs.append((length, int(next_rank[length]), n, container, start))
        next_rank[length] += n
        left[length] -= n

    for k in np.argsort(-repeats, kind="stable"):
        n = int(repeats[k])
        if n == 0:
            break
        lengths, need = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(n, int((left[lengths] // need).min()))
        if n <= 0:
            continue
        start = 0
        for length in sorted(patterns[k][patterns[k] > 0], reverse=True):
            put(int(length), n, made, start)
            start += int(length)
        made += n
    # What is left: longest first into the open containers with the least room that suffices; equal containers go as one group.
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> groups (first container, how many)
    for length in range(capacity, 0, -1):
        for free in range(length, capacity):
            while left[length] and room.get(free):
                first, n = room[free].pop()
                take = min(n, int(left[length]))
                put(length, take, first, capacity - free)
                if take < n:
                    room[free].append((first + take, n - take))
                room.setdefault(free - length, []).append((first, take))
            if not left[length]:
                break
        each = capacity // length
        while left[length]:
            full = max(1, int(left[length]) // each)
            per = min(each, int(left[length]))
            for k in range(per):
                put(length, full, made, k * length)
            room.setdefault(capacity - per * length, []).append((made, full))
            made += full
    cols = np.array(runs, np.int64).reshape(-1, 5)
    order = np.lexsort((cols[:, 1], cols[:, 0]))
    return {k: cols[order, i] for i, k in enumerate(("length", "rank", "n", "container", "start"))} | {"containers": np.array([made])}


def pieces_of(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, n_tokens``: a document is one piece unless it exceeds the capacity; then full pieces and a rest."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
    several = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("bigint"))
    return sizes.select("doc_id", n.alias("all_tokens"), F.explode(several).alias("piece_no")).select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.least(F.lit(capacity), F.col("all_tokens") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))


def with_ranks(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, counted from 0 within each length. A length may hold any share of the rows: the count runs in
    buckets of a hash of the row, and the sizes of the buckets before it are added."""
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    inner = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")
    held = salted.groupBy("n_tokens", "bucket").count()
    before = held.select("n_tokens", "bucket", (F.sum("count").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(inner) - 1)
    return ranked.join(before, ["n_tokens", "bucket"]).select("doc_id", "piece_no", "n_tokens", (F.col("before") + F.col("nth")).alias("rank"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, container_id, start, n_tokens`` for rows ``doc_id, n_tokens``.

    Each document lies whole in one container unless it alone exceeds the capacity: then its full pieces fill containers and the
    rest is packed like any other item. Documents without tokens (null, empty) take no room and are listed in container 0.
    Repeated rows are items of their own. Container numbers count from 0 without gaps. An empty table gives an empty result.
    """
    sizes = materialize(sizes.select("doc_id", "n_tokens"), "sizes")
    pieces = pieces_of(sizes, capacity)
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # capacity + 1 rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total, counts[0] = int(counts.sum()), 0
    plan = plan_containers(counts)
    span = np.int64(1) << 40
    keys, rank0, box, start = plan["length"] * span + plan["rank"], plan["rank"], plan["container"], plan["start"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (np.asarray(b.column(k), np.int64) for k in (2, 3))
            k = np.searchsorted(keys, n * span + rank, "right") - 1
            some = n > 0
            k[~some] = 0
            to, at = (np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)) if not len(keys) else (box[k] + rank - rank0[k], start[k])
            to[~some], at[~some] = 0, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to), pa.array(at.astype(np.int32)), b.column(2)], ["doc_id", "piece_no", "container_id", "start", "n_tokens"])

    kind = sizes.schema["doc_id"].dataType.simpleString()
    return with_ranks(pieces, max(1, -(-total // RANK_BUCKET))).mapInArrow(look_up, f"doc_id {kind}, piece_no int, container_id bigint, start int, n_tokens int")


def pack_documents(documents: DataFrame, folder: str = TOKENIZERS, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_counts(documents, folder), capacity)
