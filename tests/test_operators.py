import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import interfaces
from factloom.operators import detection, extraction, graph, knn, layout, matching, store
from factloom.sources import pages, tables
from factloom.streaming import ingest


def test_store_keeps_the_last(spark):
    f = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None), (None, 9, "q")], "fact_id string, ingest_seq bigint, value string")
    assert sorted((r.fact_id, r.value) for r in store.latest_facts(f).collect()) == [("a", "z"), ("b", None)]
    with pytest.raises(ValueError):
        store.page(f, 0)


def test_edges_both_ways(spark):
    e = spark.createDataFrame([("f1", "f2", "corroborates", 0.9, "m", 123.0), ("f1", "f2", "contradicts", 0.9, "m", 124.0)], "fact_id_a string, fact_id_b string, relationship_type string, confidence double, justification string, created_at double")
    got = {(r.fact_id_a, r.fact_id_b): r.relationship_type for r in store.symmetric_upsert(e).collect()}
    assert got == {("f1", "f2"): "contradicts", ("f2", "f1"): "contradicts"}


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(40)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("s", "s")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {k: v for k, v in got.items() if k in linked} == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("rule", ["other_group", "other_id", "earlier"])
def test_knn_against_brute_force(spark, rule):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v[7] = 0
    v[9] = v[3]
    rows = [(i, i % 4, [float(x) for x in v[i]]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, grp int, embedding array<double>")
    got = {(r.query_id, r.rank): r.neighbour_id for r in knn.top_k(df, df, 5, rule, block=9).collect()}
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    sim = np.round(n @ n.T, 9)
    for i in range(40):
        ok = [j for j in range(40) if i != 7 and j != 7 and (j != i if rule == "other_id" else j % 4 != i % 4) and (rule != "earlier" or j < i)]
        best = sorted(ok, key=lambda j: (-sim[i, j], j))[:5]
        assert [got[(i, k + 1)] for k in range(len(best))] == best


def test_registry_grows_in_order(spark):
    names = spark.createDataFrame([("Foo Inc", [1.0, 0.0], 1), ("Foo", [0.98, 0.02], 2), ("Beta Ltd", [0.0, 1.0], 3), (" ", [0.5, 0.5], 4), ("Zero", [0.0, 0.0], 5)], "name string, embedding array<double>, first_seq bigint")
    registry = spark.createDataFrame([], "seq bigint, name string, embedding array<double>")
    assert [(r.seq, r.name) for r in matching.grow_registry(names, registry).orderBy("seq").collect()] == [(0, "Foo Inc"), (1, "Beta Ltd"), (2, "Zero")]
    known = spark.createDataFrame([(0, "Foo Inc", [1.0, 0.0])], "seq bigint, name string, embedding array<double>")
    got = {r.name: (r.resolved, r.score) for r in matching.resolve(names.select("name", "embedding"), known).collect()}
    assert got["Foo"][0] == "Foo Inc" and got["Foo"][1] == pytest.approx(0.999792, abs=1e-5)
    assert got["Beta Ltd"] == ("Beta Ltd", 1.0) and got[" "] == ("", 0.0)


def test_snap(spark):
    reg = spark.createDataFrame([(0, "Profit After Tax"), (1, "Revenue from Operations")], "seq bigint, name string")
    got = {r.name: r.snapped for r in matching.snap(spark.createDataFrame([("PAT",), ("net profit after tax",), ("Other",), ("",)], "name string"), reg).collect()}
    assert got == {"PAT": "Profit After Tax", "net profit after tax": "Profit After Tax", "Other": "Other", "": ""}


BLOCK = pages.BLOCKS


def _page(doc, page, boxes):
    return [(doc, page, i, 0, x0, y0, x1, y1, t, 1.0, 1.0) for i, (x0, y0, x1, y1, t) in enumerate(boxes)]


def test_two_columns_and_spanning_heading(spark):
    left = [(0.05, 0.2 + 0.02 * i, 0.45, 0.21 + 0.02 * i, f"l{i}") for i in range(5)]
    right = [(0.55, 0.2 + 0.02 * i, 0.95, 0.21 + 0.02 * i, f"r{i}") for i in range(5)]
    blocks = spark.createDataFrame(_page("d", 1, [(0.05, 0.1, 0.95, 0.14, "head"), *left, *right]), BLOCK)
    spans = layout.classify_spans(blocks, layout.column_bands(layout.column_centres(blocks)))
    got = {r.text: (r.col_index, r.spanning) for r in spans.collect()}
    assert got["head"] == (-1, True) and got["l0"] == (0, False) and got["r4"] == (1, False)
    merged = {r.text for r in layout.merge_paragraphs(spans).collect()}
    assert merged == {"l0 l1 l2 l3 l4", "r0 r1 r2 r3 r4"}
    order = [r.text for r in layout.order_blocks(layout.merge_paragraphs(spans), spans.filter("spanning")).orderBy("order_index").collect()]
    assert order[0] == "head" and len(order) == 3


def test_columns_are_capped(spark):
    boxes = [(x, 0.3, x + 0.09, 0.32, str(x)) for x in (0.0, 0.2, 0.42, 0.66, 0.9)]
    assert layout.column_centres(spark.createDataFrame(_page("d", 1, boxes), BLOCK)).count() == 3


def test_running_heads(spark):
    rows = [r for p in (1, 2, 3) for r in _page("d", p, [(0.1, 0.02, 0.9, 0.04, "head"), (0.1, 0.3 + p / 20, 0.9, 0.5, "body")])] + _page("single", 1, [(0.1, 0.02, 0.9, 0.04, "head")])
    blocks = spark.createDataFrame(rows, BLOCK)
    bands = layout.running_bands(blocks)
    assert [(r.document_id, r.kind, r.hits) for r in bands.collect()] == [("d", "header", 3)]
    assert {r.text for r in layout.strip_bands(blocks, bands).filter("document_id = 'd'").collect()} == {"body"}


def test_cover_and_captions(spark):
    images = spark.createDataFrame([("i1", "d", 1, 0, 100.0, 100.0, 200.0, 200.0), ("i2", "d", 1, 1, 300.0, 300.0, 300.0, 400.0), ("i3", "d", 1, 2, 0.0, 500.0, 50.0, 550.0)], "image_id string, document_id string, page_number int, image_no int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([("d", 1, 0, 0, 100.0, 210.0, 220.0, 225.0, "Figure 1: trend", 612.0, 792.0), ("d", 1, 1, 0, 0.0, 500.0, 50.0, 549.0, "text", 612.0, 792.0)], BLOCK)
    assert {r.image_id for r in detection.chart_candidates(images, blocks).collect()} == {"i1"}
    assert {r.image_id: r.caption for r in detection.captions(images, blocks).collect()} == {"i1": "Figure 1: trend", "i2": None, "i3": None}


def test_tabular_runs_restart_after_drift(spark):
    lines = [("d", 1, y, 0, x, x + 30, str(y)) for y, x in ((10, 100.0), (20, 101.0), (30, 99.0), (40, 109.0), (60, 100.5), (70, 100.0))]
    df = detection.tag_tabular(spark.createDataFrame(lines, "document_id string, page_number int, line_y int, part int, left double, right double, text string"))
    assert [(r.n_lines, r.top_y, r.bottom_y) for r in detection.tabular_runs(df).collect()] == [(6, 10, 70)]
    assert detection._merge([[0, 0, 10, 10], [0, 30, 10, 40], [0, 4, 10, 36]]) == [[0, 0, 10, 40]]


def test_context_and_tables(spark):
    c = spark.createDataFrame([("a", "d", 1, "text", "one", 0, None), ("b", "d", 1, "table", None, 1, [["x", None], None, ["", "y"]]), ("c", "d", 1, "text", "three", 2, None)], "chunk_id string, document_id string, page_number int, chunk_type string, text string, reading_order_index int, table_data array<array<string>>")
    got = {r.chunk_id: r.context_window for r in extraction.context_window(c).collect()}
    assert got == {"a": ">>> one <<<", "b": "one\n\nthree", "c": ">>> three <<<"}
    assert c.filter("chunk_id = 'b'").select(extraction.table_text(F.col("table_data")).alias("t")).first().t == "x | \n | y"
    assert c.filter("chunk_id = 'b'").select(extraction.table_text(F.col("table_data"), F.lit("T")).alias("t")).first().t == "Caption: T\n\nx | \n | y"


def test_injected_judge(spark):
    """The judge sees six fields of both facts; a pair on which it fails costs only itself."""
    pairs = spark.createDataFrame([("a", "b", "corroborates", 1.0, "same"), ("a", "c", None, None, None), ("a", "d", None, None, None), ("a", "e", None, None, None)], "fact_id_a string, fact_id_b string, rule_verdict string, confidence double, justification string")
    facts = spark.createDataFrame([(k, "X", "Revenue", f"s{k}", k, None, "{}") for k in "abcde"], "fact_id string, canonical_entity string, raw_attribute string, statement string, value string, unit string, scope string")
    got = {(r.fact_id_b, r.relationship_type, r.source) for r in interfaces.judged(pairs, facts, interfaces.table_judge({("a", "c"): "ambiguous"})).collect()}
    assert got == {("b", "corroborates", "rule"), ("c", "ambiguous", "judge")}

    def fails(rows):
        if any(r["b_value"] == "d" for r in rows):
            raise RuntimeError("no answer")
        return interfaces.field_judge(rows)

    assert {(r.fact_id_b, r.relationship_type) for r in interfaces.judged(pairs, facts, fails).collect()} == {("b", "corroborates"), ("c", "contradicts"), ("e", "contradicts")}


def test_registry_file(spark, tmp_path):
    p = tmp_path / "names.json"
    assert tables.canonical_list(spark, str(p)).count() == 0
    tables.save_canonical_list(spark.createDataFrame([(1, "b"), (0, "a")], "seq bigint, name string"), str(p))
    assert [(r.seq, r.name) for r in tables.canonical_list(spark, str(p)).orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    p.write_text("{broken")
    assert tables.canonical_list(spark, str(p)).count() == 0


def test_decoder(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one two")
    (tmp_path / "bad.pdf").write_bytes(b" ")
    got = pages.decode(spark, str(tmp_path), lambda name, b: [("x", 1, 0, 0, 0.0, 0.0, 1.0, 1.0, b.decode().split()[0], 612.0, 792.0)]).collect()
    assert [r.text for r in got] == ["one"]
    bad = pages.undecodable(spark, str(tmp_path), lambda name, b: [b.decode().split()[0]]).collect()
    assert len(bad) == 1 and bad[0].path.endswith("bad.pdf") and "IndexError" in bad[0].message


def test_stream_is_idempotent(spark, tmp_path):
    landing, out = tmp_path / "in", tmp_path / "out"
    schema = "fact_id string, document_id string, value string, unit string"
    spark.createDataFrame([("a", "d1", "5 crore", "INR")], schema).coalesce(1).write.parquet(str(landing / "1"))
    ingest.stream_facts(spark, str(landing / "*"), str(out), str(tmp_path / "cp"), schema).awaitTermination()
    spark.createDataFrame([("b", "d1", "1", None), ("c", "d2", "2", None)], schema).coalesce(1).write.parquet(str(landing / "2"))
    ingest.stream_facts(spark, str(landing / "*"), str(out), str(tmp_path / "cp"), schema).awaitTermination()
    got = {r.fact_id: r.normalized_value for r in spark.read.parquet(str(out)).collect()}
    assert got == {"a": 5e7, "c": 2.0}
