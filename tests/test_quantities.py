from decimal import Decimal

import pytest

from factloom.functions import amounts, scopes
from factloom.operators import quantities

CATALOG = [("rupee", "money", "INR", 1.0), ("us_dollar", "money", "USD", 1.0), ("euro", "money", "EUR", 1.0), ("percent", "ratio", "bps", 100.0), ("basis_point", "ratio", "bps", 1.0), ("tonne", "mass", "kg", 1000.0), ("kilogram", "mass", "kg", 1.0), ("metre", "length", "m", 1.0), ("square_metre", "area", "sq_m", 1.0), ("each", "count", "count", 1.0), ("day", "time", "min", 1440.0), ("us_gallon", "volume", "l", 3.785412), ("thousand", "scale", None, 1e3), ("lakh", "scale", None, 1e5), ("million", "scale", None, 1e6), ("crore", "scale", None, 1e7), ("billion", "scale", None, 1e9), ("lakh_crore", "scale", None, 1e12)]
FACTORS = {n: f for n, _, _, f in CATALOG}

READ = [
    ("₹1,022.2 Cr", None, None, None, "1022.2", "crore", "rupee"), ("1.369,00", "Rs", None, None, "1369.00", None, "rupee"), ("69,63", "pct", None, None, "69.63", None, "percent"), ("3,97,27,081.6 EUR", "", None, None, "39727081.6", None, "euro"),
    ("１８７９７４３０", None, None, "Amount: Rs.", "18797430", None, "rupee"), ("२२४.९५M", "$", None, None, "224.95", "million", "us_dollar"), ("(₹9) करोड़", None, None, None, "-9", "crore", "rupee"), ("−5 %", None, None, None, "-5", None, "percent"),
    ("6'438", "-", "it reached 6,438 tonnes, Zone 12.", None, "6438", None, "tonne"), ("598*", "m²", None, None, "598", None, "square_metre"), ("27 '000 US gallons", None, None, None, "27", "thousand", "us_gallon"), ("about 12 lakh cr", "INR", None, None, "12", "lakh_crore", "rupee"),
    ("132", "n.a.", "recorded margin amounting to 132.", "(in basis points)\n\n>>> x | 132 <<<", "132", None, "basis_point"), ("24.8", None, None, "All figures are stated in INR cr, rounded.\n\n>>> x <<<", "24.8", "crore", "rupee"), ("468", None, None, "(day(s))\n\n>>> 468 % <<<", "468", None, "day"),
    ("29", "n.a.", "Expenditure, Capital $29billions (Q1 FY24), up 1.3% year on year", None, "29", "billion", "us_dollar"), ("9.9% [a]", None, None, None, "9.9", None, "percent"), ("4 531 mn", "euro", None, None, "4531", "million", "euro"), ("5 m", None, None, None, "5", None, "metre"),
]


@pytest.mark.parametrize(("value", "unit", "statement", "note", "number", "scale", "name"), READ)
def test_read(value, unit, statement, note, number, scale, name):
    got = quantities.read_fact(value, unit, statement, note)
    assert (got[0], got[1], got[2]) == (Decimal(number), scale, name)


@pytest.mark.parametrize("value", [None, "", "  ", "Q1 FY24", "see note 9", "9-11 %", "between 5 and 9 bps", "AA+ (stable)", "double-digit", "12 of 30", "N/A", "x" * 100_000])
def test_no_number(value):
    assert quantities.read_fact(value, "INR", "5 crore", None)[0] is None


def test_two_currencies_are_no_case():
    assert quantities.read_fact("Rs 257.5 Bn", "U.S. dollars", None, None)[2:] == (None, None, True)


def test_scopes():
    assert scopes.report_key(" WEXKADA_FILING_FY24_000220 ") == scopes.report_key("wexkada-filing-fy24-000220 (2).PDF") == scopes.report_key("wexkada-filing-fy24-000220_9cce68f3") == "wexkada-filing-fy24-000220"
    assert scopes.report_key(None) is None and scopes.report_key(" ") is None
    assert scopes.scope_of('{"quarter":"Q2","fiscal_year":"FY24","segment":"Plant 12"}', None, None) == ("Q2 FY24", "plant 12")
    assert scopes.scope_of(None, "Zone 7: 2024 bps (2023)", "2024") == ("2023", "zone 7")
    assert scopes.scope_of("{bad", "In FY2023-24 it was 5", "5") == ("FY24", None)


def test_convert(spark):
    catalog = spark.createDataFrame(CATALOG, "unit_name string, dimension string, common_unit string, factor double")
    schema = "fact_id string, value string, unit string, statement string, raw_attribute string, source_type string, data_json string, ingest_seq bigint, seq int, number int"
    rows = [(f"r{i}", f"{i + 1}.5 {'crore' if i % 2 else 'lakh'}", "INR" if i % 2 else "₹", f"Revenue was {i} crore", "Revenue", "text", None, i, 1, 1) for i in range(150)]
    rows += [(f"p{i}", f"{i % 90}", "%", f"margin of {i} per cent", "Gross Margin", "table", None, 1000 + i, 1, 1) for i in range(150)]
    rows += [("q1", "12", None, "Gross Margin was 12", "Gross Margin", "table", None, 2000, 1, 1), ("q2", "12", None, None, "Gross Margin", "table", '```json\n{"evidence_context_window": "(in crore Rs.)"}\n```', 2001, 1, 1), ("q3", "7", "kg", None, None, None, None, 2002, 1, 1), ("q3", "8", "kg", None, None, None, None, 2003, 1, 1), ("q4", "9" * 30, "INR", None, None, None, None, 2004, 1, 1), ("q5", None, None, None, None, None, None, 2005, 1, 1), (None, "5", "kg", None, None, None, None, 2006, 1, 1)]
    got = {r.fact_id: r for r in quantities.convert(spark.createDataFrame(rows, schema), catalog).collect()}
    assert (got["r1"].common_unit, got["r1"].amount, got["r0"].amount) == ("INR", 25_000_000, 150_000)
    assert got["p12"].amount == 1200 and got["q3"].amount == 7 and got["q4"].how == "review" and "q5" not in got
    assert (got["q2"].how, got["q2"].amount) == ("note", 120_000_000)
    assert got["q1"].amount is None and got["q1"].how in ("predicted", "review") and got["q1"].predicted_unit == "bps"
    few = quantities.convert(spark.createDataFrame(rows[300:303], schema), catalog)
    assert {r.fact_id: r.how for r in few.collect()} == {"q1": "review", "q2": "note", "q3": "stated"}
    assert quantities.common_amounts(spark.createDataFrame([], schema), catalog).count() == 0


def test_readings():
    """Where the text leaves several readings, all come out, the likeliest first; long texts are read whole."""
    said = lambda *a: [(r.scale, r.unit, r.how) for r in quantities.read_all(*a)[2]]
    assert said("5 m", None, None, "(in Rs)\n>>> x <<<") == [(None, "metre", "stated"), ("million", "rupee", "note")]
    assert said("5 m", None, "it was 5 m tonnes", None) == [("million", "tonne", "sentence"), (None, "metre", "stated")]
    assert said("5", "pounds", None, None) == [(None, "pound", "stated"), (None, "pound_sterling", "stated")] and said("5", "lbs", None, None) == [(None, "pound", "stated")]
    assert said("7", None, "it was 7 kg, or 7 tonnes", None) == [(None, "kilogram", "sentence"), (None, "tonne", "sentence")]
    assert said("7", None, None, "(in %)\n(in tonnes)") == [(None, "percent", "note"), (None, "tonne", "note")]
    assert said("7", None, "word " * 50_000 + "it was 7" + " " * 500 + "kg", None) == [(None, "kilogram", "sentence")]
    assert quantities.near_words("In FY24 it | was", "x 5") == "in it was x"


def test_the_forest_turns_a_reading(spark):
    """Two notes name two units; the first would be wrong for the attribute."""
    catalog = spark.createDataFrame(CATALOG, "unit_name string, dimension string, common_unit string, factor double")
    schema = "fact_id string, value string, unit string, statement string, raw_attribute string, source_type string, data_json string, ingest_seq bigint, words string"
    rows = [(f"r{i}", f"{i + 1}", "kg", "Cotton was weighed", "Cotton", "text", None, i, "") for i in range(150)] + [(f"p{i}", f"{i % 90}", "%", "margin it was", "Gross Margin", "table", None, 1000 + i, "") for i in range(150)]
    note = '{"evidence_context_window": "(in kg)\\n(in %)"}'
    rows += [("q1", "12", None, "margin it was", "Gross Margin", "table", note, 2000, ""), ("q2", "12", None, "Cotton was weighed", "Cotton", "text", note, 2001, "")]
    got = {r.fact_id: (r.common_unit, r.amount, r.how) for r in quantities.convert(spark.createDataFrame(rows, schema), catalog).filter("fact_id like 'q%'").collect()}
    assert got == {"q1": ("bps", 1200, "note"), "q2": ("kg", 12, "note")}
