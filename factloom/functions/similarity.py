"""Similarity of names and vectors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length or is null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def initials_of(c: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z]+)"), 1), lambda w: F.upper(F.substring(w, 1, 1))), "")


def _all_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def acronym_match(a: Column, b: Column) -> Column:
    """One side is written in capitals only, has two letters at least and is made of the first letters of the other side's words."""
    left = _all_upper(a) & (F.length(a) >= 2) & ~_all_upper(b) & (initials_of(b) == a)
    right = _all_upper(b) & (F.length(b) >= 2) & ~_all_upper(a) & (initials_of(a) == b)
    return F.coalesce(left | right, F.lit(False))


def prefix_match(a: Column, b: Column) -> Column:
    """One name begins with the other; both have five letters at least; case aside."""
    x, y = F.lower(a), F.lower(b)
    return F.coalesce((F.least(F.length(x), F.length(y)) >= 5) & (x.startswith(y) | y.startswith(x)), F.lit(False))


def indel_similarity(a: str, b: str) -> float:
    """Percentage of letters that a longest common subsequence keeps; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    # one row of the table as bits of an integer
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = (1 << len(b)) - 1
    for ch in a:
        hit = row & masks.get(ch, 0)
        row = (row + hit) | (row - hit)
    common = len(b) - bin(row & ((1 << len(b)) - 1)).count("1")
    return 200.0 * common / (len(a) + len(b))


def token_set_score(a: str | None, b: str | None) -> float:
    """100 if one side's set of words holds the other's, else the best of three comparisons of common and remaining words."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel_similarity(one, two)]
    if both:
        scores += [indel_similarity(both, one), indel_similarity(both, two)]
    return max(scores)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def initials(name: str) -> str:
    return "".join(w[0].upper() for w in re.findall("[a-zA-Z]+", name))


def lexical_match(name: str, known: str) -> str | None:
    """``acronym``, ``words`` or ``beginning``: the first of the three rules by which two names match, or None."""

    def upper(x: str) -> bool:
        return x.upper() == x and x.lower() != x

    if (upper(name) and len(name) >= 2 and not upper(known) and initials(known) == name) or (upper(known) and len(known) >= 2 and not upper(name) and initials(name) == known):
        return "acronym"
    if token_set_score(name, known) > 90.0:
        return "words"
    x, y = name.lower(), known.lower()
    if min(len(x), len(y)) >= 5 and (x.startswith(y) or y.startswith(x)):
        return "beginning"
    return None
