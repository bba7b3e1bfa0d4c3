import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import similarity, units
from factloom.operators import compare, extraction

UNITS = [
    ("42 crore", "INR", 4.2e8, "INR", "INR", False, True), ("0.42 lakh crore", "INR", 4.2e11, "INR", "INR", False, True), ("420000000", "INR", 4.2e8, "INR", "INR", False, True),
    ("500 million", "USD", 5e8, "USD", "USD", False, True), ("1.5 billion", "USD", 1.5e9, "USD", "USD", False, True), ("12.5%", None, 12.5, "%", None, False, True), ("200 bps", None, 200.0, "bps", None, False, True),
    ("100 crore INR", "USD", 1e9, "INR", "INR", True, True), ("1266", "Mn", 1.266e9, "mn", None, False, True), ("127", "Cr", 1.27e9, "cr", None, False, True), ("0.00042", "lakh crore", 4.2e8, "lakh crore", None, False, True),
    ("1.6", "%", 1.6, "%", None, False, True), ("$10M", None, 1e7, "USD", "USD", False, True), ("5 m", None, 5e6, "m", None, False, True), ("100", "users", 100.0, "INR", "INR", False, True), ("2024", None, 2024.0, None, None, False, True),
    ("100 units", None, None, None, None, False, False), ("Rs. 127 Cr", None, None, None, None, False, False), ("(452)", "Cr", None, "Cr", None, False, False), ("-₹5", None, None, None, None, False, False), ("", None, None, None, None, False, False), (None, None, None, None, None, False, False),
]


def test_units(spark):
    df = spark.createDataFrame([(i, v, u) for i, (v, u, *_) in enumerate(UNITS)], "i int, value string, unit string")
    got = {r.i: r for r in units.with_normalized(df).collect()}
    for i, (v, u, number, unit, currency, conflict, ok) in enumerate(UNITS):
        n = got[i]
        assert (n.normalized_unit, n.currency, n.currency_conflict, n.parse_ok) == (unit, currency, conflict, ok), (v, u, n)
        assert n.normalized_value == (pytest.approx(number) if number is not None else None), (v, u)


def test_periods(spark):
    cases = [("FY2024-25", "FY", "2024-2025"), ("Q3 FY24", "Q3", "FY2024"), ("Q2 2024", "Q2", "FY2024"), ("FY24", "FY", "FY2024"), ("FY2024", "FY", "FY2024"), ("year 2023", "annual", "2023"), ("H1 FY24", "FY", "FY2024"), ("FY123", "FY", "FY123"), ("none", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", units.period(F.col("t")).alias("p")).collect()}
    assert [(got[i].period, got[i].vintage) for i in range(len(cases))] == [(p, v) for _, p, v in cases]


def test_same_currency(spark):
    df = spark.createDataFrame([("INR", "INR", True), ("USD", "INR", False), (None, None, True), ("km", "km", True), ("km", "kg", False)], "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", units.same_currency(F.col("a"), F.col("b")).alias("got")).collect())


def test_tolerance(spark):
    cases = [(100.0, 100.5, True), (1.266e9, 1.27e9, True), (8.1415e10, 8.142e10, True), (99.0, 100.0, True), (98.99, 100.0, False), (0.0, 0.0, True), (0.0, 1e-9, False), (-100.0, 100.0, False), (-100.0, -100.5, True)]
    rows = spark.createDataFrame(cases, "a double, b double, want boolean").select("want", compare.within_tolerance(F.col("a"), F.col("b")).alias("x"), compare.within_tolerance(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(r.want == r.x == r.y for r in rows)


def test_scopes(spark):
    cases = [('{"year":2023}', '{"year":2023}', True), ('{"year":2023}', '{"year":2024}', False), ('{"period":"FY24"}', '{"period":"FY24","type":"fiscal_year"}', True), ('{"year":2023}', '{"year":"2023"}', True), ('{"period":"Q3 FY24"}', '{"period":"FY24"}', False), ('{"period":"Q3 FY24"}', '{"period":"Q4 FY24"}', False), ('{"period":"FY22"}', '{"period":"fiscal 2022"}', False), ('{"period":"FY2023-24"}', '{"period":"FY24"}', False), ('{"period":"FY24"}', '{"note":"x"}', False), ('{"b":"1","a":"FY24"}', '{"a":"FY24","b":"1"}', True)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean").select("a", "b", "want", compare.equivalent_scopes(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b) for r in rows if r.got != r.want] == []


def test_rule(spark):
    s23, s24, f24 = '{"year":2023}', '{"year":2024}', '{"period":"FY24"}'
    cases = [("100", "USD", s23, "100.5", "USD", s24, "reconciled"), ("100", "USD", s23, "100", "USD", s23, "corroborates"), ("100", "usd", "{}", "100", "usd", s24, None), ("1266", "Mn", f24, "127", "Cr", f24, "corroborates"), ("5000000", "USD", f24, "5000000", "INR", f24, "corroborates"), ("x", "USD", f24, "5", "USD", f24, None), ("FY24", None, f24, "FY24", None, f24, None), ("1.266", "billion", f24, "2.5", "billion", f24, None)]
    facts = [r for i, c in enumerate(cases) for r in ((f"a{i}", *c[:3]), (f"b{i}", *c[3:6]))]
    f = spark.createDataFrame(facts, "fact_id string, value string, unit string, scope string")
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(len(cases))] + [("a0", "absent")], "fact_id_a string, fact_id_b string")
    got = {r.fact_id_a: r.rule_verdict for r in compare.judge_pairs(pairs, f).collect()}
    assert got == {f"a{i}": c[6] for i, c in enumerate(cases)}
    strict = {r.fact_id_a: r.rule_verdict for r in compare.judge_pairs(pairs, f, True).collect()}
    assert strict["a4"] is None


def test_judgement(spark):
    good = '```json\n{"relationship_type":"corroborates","confidence":0.9,"justification":"x"}\n```'
    rows = spark.createDataFrame([(good,), ('{"broken": json',), ('{"relationship_type":"maybe","confidence":1,"justification":"x"}',), (None,)], "t string").select(compare.parse_judgement(F.col("t"))["relationship_type"].alias("v")).collect()
    assert [r.v for r in rows] == ["corroborates", None, None, None]


def test_names(spark):
    cases = [("Profit After Tax", "PAT", True, False), ("PAT", "profit after tax", True, False), ("market_capitalization", "market_cap", False, True), ("rev", "revenue", False, False), ("EBITDA", "operating_ebitda", False, False), (None, "PAT", False, False)]
    rows = spark.createDataFrame(cases, "a string, b string, acr boolean, pre boolean").select("acr", "pre", similarity.acronym_match(F.col("a"), F.col("b")).alias("x"), similarity.prefix_match(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.acr == r.x and r.pre == r.y for r in rows)


@pytest.mark.parametrize(("a", "b", "want"), [("market_capitalization", "market_cap", 64.52), ("profit", "net profit", 100), ("net profit margin", "net profit margins", 97.14), ("profit after tax", "PAT", 21.05), ("EBITDA", "operating_ebitda", 54.55), ("revenue", "net_revenue", 77.78), ("Revenue", "Profit", 15.38)])
def test_token_set(a, b, want):
    assert similarity.token_set_score(a, b) == pytest.approx(want, abs=0.01)


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_indel_is_symmetric_and_bounded(a, b):
    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
    assert similarity.indel_similarity(a, b) == pytest.approx(want)


def test_equations(spark):
    cases = [("x = ∑ ( α + β ) / 2  (1)", True), ("Revenue grew 5% in FY24.", False), ("As shown by the authors [12]", True), ("(1) First point of the list", False), ("see_table", False), ("w" * 157 + "(3)", False), ("", False), (None, False)]
    rows = spark.createDataFrame(cases, "t string, want boolean").select("want", extraction.is_equation(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_hash(spark):
    r = spark.createDataFrame([("Revenue", "amount", " 100 ", "")], "e string, a string, v string, s string").select(extraction.content_hash(F.col("e"), F.col("a"), F.col("v"), F.col("s")).alias("h")).first()
    assert r.h == hashlib.sha256(b"Revenue|amount|100|").hexdigest() == "49234c2d5c87883b571928300900fdad2d9a917aa40ee925999ab6b49303a672"


def test_answers(spark):
    ok = '{"facts":[{"statement":"s","canonical_entity":"e","raw_attribute":"a","value":"1","confidence":0.9,"context":{"exclusion":"x"}}]}'
    missing = '{"facts":[{"canonical_entity":"e","raw_attribute":"a","value":"1","confidence":0.9}]}'
    df = spark.createDataFrame([("c1", ok), ("c2", missing), ("c3", '{"broken": json'), ("c4", None)], "chunk_id string, answer string")
    got = extraction.parse_answers(df).collect()
    assert [(r.chunk_id, r.context["exclusion"]) for r in got] == [("c1", "x")]
