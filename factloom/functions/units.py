"""Units, scales, currencies and periods of single values as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factors of the scale words.
SCALES = {"crore": 1e7, "cr": 1e7, "lakh crore": 1e12, "lakh": 1e5, "lac": 1e5, "million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12, "thousand": 1e3, "k": 1e3}
# Currency marks in the order in which they are sought, as substrings.
CURRENCIES = [("₹", "INR"), ("rs", "INR"), ("rs.", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY")]
# Patterns of the notations.
SCALE_WORDS = r"lakh\s+crore|lakh_crore|lakh|crore|lac|million|billion|trillion|thousand|mn|bn|tn|cr|k|m|b"
BPS = r"(?i)^\s*([+-]?\d+(?:\.\d+)?)\s*(?:bps?|basis\s*points?)\s*$"
PERCENT = r"^\s*([+-]?\d+(?:\.\d+)?)\s*%\s*$"
NUMERIC = rf"(?i)^(?:[₹$€£¥]?\s*)?([+-]?\d+(?:\.\d+)?)\s*({SCALE_WORDS})?\s*(?:[₹$€£¥]?\s*(?:inr|usd|eur|gbp|jpy|rs\.?)?)?$"
FY_LONG = r"(?i)\bFY\s*(\d{4})\s*[-/]\s*(\d{2,4})\b"
QUARTER = r"(?i)\b(Q[1-4])\s*(?:FY)?\s*(\d{2,4})\b"
FY_SHORT = r"(?i)\bFY\s*(\d{2,4})\b"
YEAR = r"\b((?:19|20)\d{2})\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def basis_points(value: Column) -> Column:
    return _group(value, BPS, 1).cast("double")


def percent(value: Column) -> Column:
    return _group(value, PERCENT, 1).cast("double")


def _bare(value: Column) -> Column:
    return strip(F.regexp_replace(value, ",", ""))


def number(value: Column) -> Column:
    return _group(_bare(value), NUMERIC, 1).cast("double")


def _scale_key(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("lakh") & low.contains("crore"), "lakh crore").otherwise(low)


def scale_key(value: Column, unit: Column) -> Column:
    """The scale word of the value, else of the unit; null if neither has one."""
    own = _scale_key(_group(_bare(value), NUMERIC, 2))
    return F.coalesce(own, _scale_key(_group(unit, rf"(?i)\b({SCALE_WORDS})\b", 1)))


def scale_factor(key: Column) -> Column:
    table = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, key), F.lit(1.0))


def currency(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for mark, code in reversed(CURRENCIES):
        out = F.when(low.contains(mark), code).otherwise(out)
    return out


def currency_conflict(value: Column, unit: Column) -> Column:
    a, b = currency(value), currency(unit)
    return F.coalesce(a.isNotNull() & b.isNotNull() & (a != b), F.lit(False))


def same_currency(a: Column, b: Column) -> Column:
    """Both absent, or the same currency; without a currency on either side the texts must be equal."""
    x, y = currency(a), currency(b)
    return F.when(a.isNull() & b.isNull(), F.lit(True)).when(x.isNull() & y.isNull(), F.coalesce(a == b, F.lit(False))).otherwise(F.coalesce(x == y, F.lit(False)))


def _year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)


def _period(y1: Column, y2: Column, q: Column, q_year: Column, fy: Column, year: Column) -> Column:
    long = F.concat(y1, F.lit("-"), F.when(F.length(y2) == 2, F.concat(F.substring(y1, 1, 2), y2)).otherwise(y2))
    kind = F.when(y1.isNotNull(), "FY").when(q.isNotNull(), F.upper(q)).when(fy.isNotNull(), "FY").when(year.isNotNull(), "annual")
    vintage = F.when(y1.isNotNull(), long).when(q.isNotNull(), F.concat(F.lit("FY"), _year(q_year))).when(fy.isNotNull(), F.concat(F.lit("FY"), _year(fy))).otherwise(year)
    return F.struct(kind.alias("period"), vintage.alias("vintage"))


def period(text: Column) -> Column:
    """``struct<period, vintage>``; both null if no period is found."""
    return _period(*[_group(text, p, k) for p, k in ((FY_LONG, 1), (FY_LONG, 2), (QUARTER, 1), (QUARTER, 2), (FY_SHORT, 1), (YEAR, 1))])


#: What a normalised value consists of.
NORMALIZED = ("normalized_value", "normalized_unit", "currency", "currency_conflict", "period", "vintage", "parse_ok")


def with_normalized(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Adds the columns NORMALIZED: basis points, percent, number with scale, period, or nothing, in this order. A null or blank value parses to nothing.

    Each pattern is applied once, in a step of its own below the columns made of its groups: columns that are used several times are not pulled up into them, so
    that the generated code stays small.
    """
    v, u = F.col(value), F.col(unit)
    groups = {
        "_bare": strip(F.regexp_replace(v, ",", "")), "_text": strip(v), "_bps": basis_points(v), "_pct": percent(v), "_cv": currency(v), "_cu": currency(u), "_su": _group(u, rf"(?i)\b({SCALE_WORDS})\b", 1),
    }
    step = df.withColumns(groups)
    bare, text = F.col("_bare"), F.col("_text")
    step = step.withColumns({"_n": _group(bare, NUMERIC, 1).cast("double"), "_sv": _group(bare, NUMERIC, 2), "_y1": _group(text, FY_LONG, 1), "_y2": _group(text, FY_LONG, 2), "_q": _group(text, QUARTER, 1), "_qy": _group(text, QUARTER, 2), "_fy": _group(text, FY_SHORT, 1), "_yr": _group(text, YEAR, 1)})
    c = {k: F.col(f"_{k}") for k in ("bps", "pct", "n", "cv", "cu", "y1", "y2", "q", "qy", "fy", "yr")}
    step = step.withColumns({"_key": F.coalesce(_scale_key(F.col("_sv")), _scale_key(F.col("_su"))), "_simple": c["bps"].isNotNull() | c["pct"].isNotNull(), "_p": _period(c["y1"], c["y2"], c["q"], c["qy"], c["fy"], c["yr"])})
    key, simple, p = F.col("_key"), F.col("_simple"), F.col("_p")
    is_num, is_period = c["n"].isNotNull(), p["period"].isNotNull()
    code = F.coalesce(c["cv"], c["cu"])
    plain_unit = F.nullif(u, F.lit(""))
    out = step.withColumns({
        "normalized_value": F.when(c["bps"].isNotNull(), c["bps"]).when(c["pct"].isNotNull(), c["pct"]).when(is_num, c["n"] * scale_factor(key)),
        "normalized_unit": F.when(c["bps"].isNotNull(), "bps").when(c["pct"].isNotNull(), "%").when(is_num, F.coalesce(code, key, plain_unit)).when(is_period, "period").otherwise(plain_unit),
        "currency": F.when(~simple & is_num, code),
        "currency_conflict": ~simple & is_num & F.coalesce(c["cv"] != c["cu"], F.lit(False)),
        "period": F.when(~simple & ~is_num, p["period"]),
        "vintage": F.when(~simple & ~is_num, p["vintage"]),
        "parse_ok": simple | is_num | is_period,
    })
    return out.drop(*[x for x in out.columns if x.startswith("_") and x not in df.columns])
