"""What is injected from outside, embedder, extractor and judge, and stand-ins that work offline."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from factloom.operators import compare


class Embedder(Protocol):
    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Vectors from hashed character trigrams: repeatable, without a model. Null and blank texts have the zero vector, which matches nothing."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            if not (t or "").strip():
                continue  # a blank text has no vector
            s = f"  {(t or '').lower()} "
            for k in range(len(s) - 2):
                h = zlib.crc32(s[k : k + 3].encode())
                out[i, h % self.size] += 1 if h & 0x10000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def embed(names: DataFrame, embedder: Embedder, column: str = "name") -> DataFrame:
    """Adds ``embedding`` in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=list(embedder.encode(b[column].fillna("").tolist())))

    return names.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in names.schema)}, embedding array<float>")


Judge = Callable[[list[dict]], list[str | None]]


def no_judge(pairs: list[dict]) -> list[str | None]:
    return [None] * len(pairs)


def table_judge(answers: dict[tuple[str, str], str]) -> Judge:
    """A judge that looks its verdicts up; unknown pairs get none."""

    def judge(pairs: list[dict]) -> list[str | None]:
        return [json.dumps({"relationship_type": v, "confidence": 0.5, "justification": "table"}) if (v := answers.get((p["fact_id_a"], p["fact_id_b"]))) else None for p in pairs]

    return judge


def field_judge(pairs: list[dict]) -> list[str | None]:
    """A judge that looks at the fields alone: facts about different things are unrelated, equal values with unclear scopes ambiguous, others contradict."""
    out: list[str | None] = []
    for p in pairs:
        if p["a_canonical_entity"] != p["b_canonical_entity"] or p["a_raw_attribute"] != p["b_raw_attribute"]:
            verdict = "unrelated"
        else:
            verdict = "ambiguous" if p["a_value"] == p["b_value"] else "contradicts"
        out.append(json.dumps({"relationship_type": verdict, "confidence": 0.5, "justification": f"{p['a_value']} against {p['b_value']}"}))
    return out


#: What a judge sees of each fact, prefixed by a_ and b_.
FIELDS = ("canonical_entity", "raw_attribute", "statement", "value", "unit", "scope")
EDGE = "fact_id_a string, fact_id_b string, relationship_type string, confidence double, justification string, source string"


def judged(pairs: DataFrame, facts: DataFrame, judge: Judge) -> DataFrame:
    """Asks the judge about the pairs of :func:`compare.judge_pairs` whose rule verdict is null and joins both kinds (columns of EDGE). The judge sees the six
    FIELDS of both facts. Pairs that it leaves open, answers out of form and pairs on which it fails are dropped; a failure
    on one pair does not touch the others."""
    from pyspark.sql import functions as F

    def one(pair: dict) -> str | None:
        try:
            return judge([pair])[0]
        except Exception:  # noqa: BLE001
            return None

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            records = b.astype(object).where(b.notna(), None).to_dict("records")
            try:
                answers = judge(records)
            except Exception:  # noqa: BLE001
                answers = [one(r) for r in records]
            yield pd.DataFrame({"fact_id_a": b["fact_id_a"], "fact_id_b": b["fact_id_b"], "answer": answers})

    def side(k: str) -> DataFrame:
        return facts.select(F.col("fact_id").alias(f"fact_id_{k}"), *[F.col(c).alias(f"{k}_{c}") for c in FIELDS])

    sure = pairs.filter("rule_verdict is not null").select("fact_id_a", "fact_id_b", F.col("rule_verdict").alias("relationship_type"), "confidence", "justification", F.lit("rule").alias("source"))
    open_pairs = pairs.filter("rule_verdict is null").select("fact_id_a", "fact_id_b").join(side("a"), "fact_id_a").join(side("b"), "fact_id_b")
    asked = open_pairs.mapInPandas(ask, "fact_id_a string, fact_id_b string, answer string")
    said = asked.select("fact_id_a", "fact_id_b", compare.parse_judgement(F.col("answer")).alias("j")).filter("j is not null")
    return sure.unionByName(said.select("fact_id_a", "fact_id_b", "j.*", F.lit("judge").alias("source")))
