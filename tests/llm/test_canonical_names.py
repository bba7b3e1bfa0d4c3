import random
import zlib

import pytest

from factloom.functions import names
from factloom.llm import canonical_names

ENTITIES = [(0, "Beryan Motors Limited"), (1, "Beryar Motors Limited"), (2, "Zoldreavia Ports Authority"), (3, "Caywexon Finance Holdings Limited"), (4, "Republic of Jaswexemia"), (5, "Fenkad Retail Limited"), (6, "Fenkad Airways Limited"), (7, "Bralun Cement Group"), (8, "Tigpaxine Power Private Limited")]
ATTRIBUTES = [(0, "Revenue from Operations"), (1, "Total Income"), (2, "Profit After Tax"), (3, "EBITDA"), (4, "EBITDA Margin"), (5, "On-time Delivery Rate"), (6, "Capacity Utilisation"), (7, "Research and Development Spend"), (8, "Profit Before Tax")]

TYPED = [
    ("Beryan Motors Limited", 0), ("  BERYAN  MOTORS ", 0), ("Limited, Beryan Motors", 0), ("M/s Beryan Motors Ltd.", 0), ('"Beryan Motors Limted"', 0), ("Beryan\xa0Motors (consolidated)", 0), ("Beryar Motros Ltd", 1), ("Berya Motors", -1), ("Z.P.A.", 2), ("ZPA", 2), ("Zoldreavia P0rts Auth.", 2), ("Caywexon", 3), ("Caywexon Hldgs Ltd", 3),
    ("Republic o Jaswexemia", 4), ("Republic of Jasw.", 4), ("Fenkad", -1), ("Fenkad Insurance Limited", -1), ("Bralun Cement Group of Companies", 7), ("Tigpaxine Power, (P) Ltd", 8), ("Tigpaxine Steel Works Limited", -1), ("unknown", -1), ("aforesaid entity", -1), ("Group", -1), ("???", -1), ("x" * 50_000, -1), ("Table 4", -1),
]
ATTR = [("total_revenue_from_operations", 0), ("Reve. from Oper.", 0), ("RevenueFromOperations", 0), ("Reported Total Income", 1), ("total_total_income", 1), ("Income, Total", 1), ("P.A.T.", 2), ("Before Tax, Profit", 8), ("EBlTDA (A)", 3), ("ebitda-margin", 4), ("TDR", 5), ("On-t. Deli. Rate", 5), ("Capaccity Utilisatin:", 6), ("Research  and Development Spends", 7), ("Board Attendance", -1), ("do.", -1)]


@pytest.mark.parametrize(("typed", "want"), TYPED)
def test_choice(typed, want):
    e = canonical_names.Entries(ENTITIES, True)
    weights = {}
    for seq, g, w in e.postings:
        weights.setdefault(seq, {})[g] = w
    cosines = [(s, sum(v * weights[s].get(g, 0.0) for g, v in e.weighted(typed).items())) for s, _ in ENTITIES]
    assert e.choose(typed, [c for c in cosines if c[1] >= e.fit_threshold()], canonical_names.MARGIN) == want


def test_threshold_is_fitted_to_the_list():
    t = canonical_names.Entries(ENTITIES, True).fit_threshold()
    assert 0.1 < t < 0.8 and canonical_names.Entries([], True).fit_threshold() == canonical_names.SLACK


def long_list(odd: str, n: int = 600) -> list[tuple[int, str]]:
    """A list of names that misspellings change little, and among them one of a single word."""
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnoprstuvwyz", k=4)) for _ in range(10))) for i in range(n)]
    at = max(range(n), key=lambda i: zlib.crc32(str(i).encode()))
    return [*rows[:at], (at, odd), *rows[at + 1 :]]


def test_threshold_is_fitted_to_every_entry(spark, monkeypatch):
    rows = long_list("Beryan")
    at = next(i for i, name in rows if name == "Beryan")
    e = canonical_names.Entries(rows, False)
    weights = {g: w for seq, g, w in e.postings if seq == at}
    t = e.fit_threshold()
    assert t <= canonical_names.SLACK * sum(v * weights.get(g, 0.0) for g, v in e.weighted("Beyran").items()) < 0.13
    values = spark.createDataFrame([("Beyran",), ("Bryan",), (rows[0][1].upper(),), ("Xyxyxyx",)], "raw string")
    for most in (1_000, 0):  # fitted by the driver, by tasks
        monkeypatch.setattr(canonical_names, "DRIVER_ENTRIES", most)
        assert canonical_names.fitted_threshold(spark, e) == t
        got = {r.raw: r.seq for r in canonical_names.map_values(values, spark.createDataFrame(rows, "seq bigint, name string"), False).collect()}
        assert got == {"Beyran": at, "Bryan": at, rows[0][1].upper(): rows[0][0], "Xyxyxyx": -1}


def test_edits():
    assert [names.edits(a, b, 3) for a, b in (("abc", "acb"), ("abc", "abc"), ("abc", "xyz"), ("abcd", "abd"), ("", "abcdefg"))] == [1, 0, 3, 1, 4]


def test_mapping(spark):
    ents = spark.createDataFrame(ENTITIES, "seq bigint, name string")
    atts = spark.createDataFrame(ATTRIBUTES, "seq bigint, name string")
    schema = "fact_id string, canonical_entity string, raw_attribute string, ingest_seq bigint, seq int, n int, raw string"
    rows = [(f"e{i}", t, None, i, 0, 0, "") for i, (t, _) in enumerate(TYPED)] + [(f"a{i}", "  ", t, 1000 + i, 0, 0, "") for i, (t, _) in enumerate(ATTR)]
    rows += [("e0", "Fenkad Retail Limited", None, 5000, 0, 0, ""), ("z", None, None, 6000, 0, 0, "")]
    got = {(r.fact_id, r.field): r.seq for r in canonical_names.mapped_names(spark.createDataFrame(rows, schema), ents, atts).collect()}
    want = {(f"e{i}", "canonical_entity"): w for i, (_, w) in enumerate(TYPED)} | {(f"a{i}", "raw_attribute"): w for i, (_, w) in enumerate(ATTR)}
    assert got == want
    assert canonical_names.mapped_names(spark.createDataFrame([], schema), ents, atts).count() == 0
    empty = canonical_names.mapped_names(spark.createDataFrame(rows[:3], schema), ents.limit(0), atts.limit(0))
    assert {r.seq for r in empty.collect()} == {-1}
