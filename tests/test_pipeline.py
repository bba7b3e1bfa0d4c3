"""From chunks to facts, from facts to verdicts, and the ingest of batches."""

import json

import numpy as np
import pytest

from factloom import interfaces
from factloom.operators import extraction, matching, pipeline
from factloom.streaming import ingest

FACT = "fact_id string, document_id string, ingest_seq bigint, embedding array<double>, statement string, canonical_entity string, raw_attribute string, value string, unit string, scope string"
IN = "fact_id string, document_id string, statement string, canonical_entity string, raw_attribute string, value string, unit string, scope string, ingest_seq bigint"
FY24 = '{"period":"FY24"}'


def fact(i, doc, value, vector, scope=FY24, entity="X", attribute="Revenue"):
    return (f"f{i}", doc, i, vector, "s", entity, attribute, value, "INR", scope)


def _compare(spark, new, stored, edges=(), **kw):
    e = spark.createDataFrame(list(edges), "fact_id_a string, fact_id_b string, relationship_type string")
    got = pipeline.compare_new_facts(spark.createDataFrame(new, FACT), spark.createDataFrame(stored, FACT), e, interfaces.field_judge, **kw).collect()
    return {(r.fact_id_a, r.fact_id_b, r.relationship_type, r.source) for r in got}, got


def test_rule_then_judge(spark):
    stored = [fact(1, "d1", "5 crore", [1.0, 0.0]), fact(2, "d2", "50 million", [1.0, 0.1]), fact(3, "d3", "9 crore", [0.9, 0.2]), fact(4, "d4", "5 crore", [1.0, 0.0], '{"period":"FY23"}'), fact(5, "d9", "5 crore", None)]
    got, rows = _compare(spark, [fact(7, "d9", "5.01 crore", [1.0, 0.0])], stored, k=4)
    assert got == {("f7", "f1", "corroborates", "rule"), ("f7", "f2", "corroborates", "rule"), ("f7", "f3", "contradicts", "judge"), ("f7", "f4", "reconciled", "rule")}
    assert all(r.confidence == (1.0 if r.source == "rule" else 0.5) and r.justification for r in rows)
    # a group is met through its earliest fact, also one of the same document
    got, _ = _compare(spark, [fact(7, "d1", "5 crore", [1.0, 0.0])], stored, [("f2", "f1", "corroborates"), ("f1", "f2", "corroborates")], k=1)
    assert got == {("f7", "f4", "reconciled", "rule")}
    got, _ = _compare(spark, [fact(7, "d1", "5 crore", [1.0, 0.1])], stored, [("f2", "f1", "corroborates")], k=1)
    assert got == {("f7", "f1", "corroborates", "rule")}
    assert _compare(spark, [], stored)[0] == set() and _compare(spark, [fact(1, "d1", None, None)], [])[0] == set()


def test_later_facts_see_corroborations_of_the_batch(spark):
    """f7 joins the groups of f1 and f2; for f8, in a later part of the batch, f1 stands for both."""
    stored = [fact(1, "d1", "5 crore", [1.0, 0.0]), fact(2, "d2", "5 crore", [1.0, 0.1])]
    new = [fact(7, "d9", "5 crore", [1.0, 0.0]), fact(8, "d9", "5 crore", [1.0, 0.1])]
    assert {p[:2] for p in _compare(spark, new, stored)[0]} == {("f7", "f1"), ("f7", "f2"), ("f8", "f1"), ("f8", "f2")}
    assert {p[:2] for p in _compare(spark, new, stored, waves=2)[0]} == {("f7", "f1"), ("f7", "f2"), ("f8", "f1")}


def test_snap_by_meaning(spark):
    names = spark.createDataFrame([("PAT", [0.0, 0.0]), ("Turnover", [0.9, 0.1]), ("Other", [0.0, 1.0])], "name string, embedding array<double>")
    reg = spark.createDataFrame([(0, "Profit After Tax", [1.0, -1.0]), (1, "Revenue", [1.0, 0.1])], "seq bigint, name string, embedding array<double>")
    got = {r.name: (r.snapped, r.how) for r in matching.snap_cascade(names, reg).collect()}
    assert got == {"PAT": ("Profit After Tax", "acronym"), "Turnover": ("Revenue", "meaning"), "Other": ("Other", "none")}


def test_extraction_tail(spark):
    """Routing, the gate on the quote, source types, the image of a chart, and chunks that fail alone."""
    chunk = "chunk_id string, document_id string, page_number int, chunk_type string, text string, context_window string, bbox struct<x0:double,y0:double>, image_path string"
    rows = [("t", "d", 1, "text", "a", "w", (0.0, 1.0), None), ("c", "d", 2, "chart_candidate", None, None, (0.0, 0.0), "img.png"), ("b", "d", 3, "text", "bad", None, None, None), ("x", "d", 3, "other", "a", None, None, None), ("e", "d", 1, "text", "x = y (1)", None, None, None)]
    one = {"statement": "s", "canonical_entity": "E", "raw_attribute": "A", "value": "5", "unit": None, "temporal_scope": {"b": "2", "a": "1"}, "context": {}, "confidence": 0.9, "evidence_quote": "q"}

    def extractor(records):
        assert all(r["prompt"] in ("text", "table", "chart") and r["text"] != "x = y (1)" for r in records)
        if any(r["text"] == "bad" for r in records):
            raise RuntimeError("no answer")
        return [json.dumps({"facts": [one, one | {"evidence_quote": None, "value": "6"}]}) for _ in records]

    got = {(r.chunk_id, r.value): r for r in extraction.extract(spark.createDataFrame(rows, chunk), extractor).collect()}
    assert set(got) == {("t", "5"), ("c", "5"), ("c", "6")}
    assert got["c", "5"].context == {"image_path": "img.png"} and got["c", "5"].source_type == "chart" and got["t", "5"].evidence_context_window == "w" and got["c", "5"].evidence_context_window is None
    assert got["t", "5"].content_hash == got["c", "5"].content_hash != got["c", "6"].content_hash


def test_occurrences(spark):
    facts = spark.createDataFrame([("d", "H", 2, "c1"), ("d", "h", 1, "c2"), ("d", "h", 3, "c2"), ("d", "h", 4, "none")], "document_id string, content_hash string, ingest_seq bigint, source_chunk_id string")
    chunks = spark.createDataFrame([("c1", 7, (0.1,)), ("c2", 9, (0.2,))], "chunk_id string, page_number int, bbox struct<x0:double>")
    assert sorted((r.nth, r.page_number) for r in extraction.occurrences(facts, chunks).collect()) == [(0, 9), (1, 7)]


def _batch(spark, *rows):
    return spark.createDataFrame([(f"f{i}", doc, "s", entity, attribute, value, "INR", FY24, i) for i, doc, entity, attribute, value in rows], IN)


def test_ingest(spark, tmp_path):
    state, emb = str(tmp_path / "state"), interfaces.HashEmbedder()
    first = ingest.ingest_facts(_batch(spark, (1, "d1", "Beryan Motors", "Revenue", "5 crore"), (2, "d1", "Zeta Foods", "Headcount", "7")), state, 0, emb, interfaces.field_judge)
    assert (first["status"], first["n_facts"], first["n_edges"]) == ("done", 2, 0)
    again = ingest.ingest_facts(_batch(spark, (3, "d1", "Beryan Motors", "Revenue", "6 crore")), state, 1, emb, interfaces.field_judge)
    assert (again["status"], again["n_facts"]) == ("done", 0)  # the document is there
    second = ingest.ingest_facts(_batch(spark, (4, "d2", "BERYAN MOTORS", "Revenue", "50 million"), (5, "d2", "Beryan Motors", "Rev", "1")), state, 2, emb, interfaces.field_judge)
    assert second["status"] == "done" and second["n_facts"] == 2 and second["n_rule"] >= 1
    edges = {(r.fact_id_a, r.fact_id_b): r.relationship_type for r in spark.read.parquet(f"{state}/edges").collect()}
    assert edges["f4", "f1"] == edges["f1", "f4"] == "corroborates"
    names = {r.name for r in spark.read.parquet(f"{state}/entities").collect()}
    assert names == {"Beryan Motors", "Zeta Foods"}
    repeated = ingest.ingest_facts(_batch(spark, (4, "d2", "BERYAN MOTORS", "Revenue", "50 million"), (5, "d2", "Beryan Motors", "Rev", "1")), state, 2, emb, interfaces.field_judge)
    assert (repeated["n_facts"], repeated["n_edges"]) == (second["n_facts"], second["n_edges"])  # an epoch that comes again replaces itself
    forced = ingest.ingest_facts(_batch(spark, (6, "d2", "Zeta Foods", "Headcount", "7")), state, 3, emb, interfaces.field_judge, force=True)
    assert forced["n_facts"] == 1

    class Broken:
        def encode(self, texts):
            raise RuntimeError("no model")

    failed = ingest.ingest_facts(_batch(spark, (9, "d9", "Zeta Foods", "Headcount", "7")), state, 4, Broken(), interfaces.field_judge)
    assert (failed["status"], failed["phase"]) == ("error", "canonicalise") and "no model" in failed["message"]
    assert {r.epoch: r.status for r in ingest.job_status(spark, state).collect()} == {0: "done", 1: "done", 2: "done", 3: "done", 4: "error"}


def test_rejudge(spark):
    edges = spark.createDataFrame([("a", "b", "reconciled", 1.0, "x", 1.0), ("b", "a", "reconciled", 1.0, "x", 1.0), ("a", "c", "ambiguous", 0.5, "y", 1.0)], "fact_id_a string, fact_id_b string, relationship_type string, confidence double, justification string, created_at double")
    facts = spark.createDataFrame([("a", "E", "A", "s", "5 crore", "INR", FY24), ("b", "E", "A", "s", "50 million", "INR", FY24)], "fact_id string, canonical_entity string, raw_attribute string, statement string, value string, unit string, scope string")
    got = {(r.fact_id_a, r.fact_id_b): r.relationship_type for r in ingest.rejudge(edges, spark.createDataFrame([("a", "b"), ("a", "c")], "fact_id_a string, fact_id_b string"), facts, interfaces.no_judge, 2.0).collect()}
    assert got == {("a", "b"): "corroborates", ("b", "a"): "corroborates", ("a", "c"): "ambiguous"}


@pytest.mark.parametrize("size", [8, 64])
def test_embedder_is_repeatable(size):
    e = interfaces.HashEmbedder(size)
    assert np.array_equal(e.encode(["a b", ""]), e.encode(["a b", ""])) and not e.encode([""]).any()
