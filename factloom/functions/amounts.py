"""Numbers with units as people write them: one number, its scale word and its unit, in many notations."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

# Spellings of the units of the catalogue, in lower case.
UNITS = {
    "rupee": ["₹", "rs", "inr", "rupees", "rupee", "re"],
    "us_dollar": ["$", "us$", "usd", "us dollars", "us dollar", "u.s. dollars", "u.s. dollar", "dollars"],
    "euro": ["€", "eur", "euro", "euros"],
    "pound_sterling": ["£", "gbp", "pounds sterling", "pound sterling", "sterling"],
    "yen": ["¥", "jpy", "yen"],
    "percent": ["%", "pct", "per cent", "percent", "per-cent", "प्रतिशत"],
    "basis_point": ["bps", "bp", "basis points", "basis point"],
    "percentage_point": ["percentage points", "percentage point", "ppt", "ppts", "pp", "pps", "% points"],
    "tonne": ["t", "tonne", "tonnes", "metric tonnes", "metric tonne", "metric tons", "metric ton", "mt", "tons"],
    "quintal": ["qtl", "qtls", "quintal", "quintals"],
    "kilogram": ["kg", "kgs", "kilogram", "kilograms", "kilo"],
    "pound": ["lb", "lbs", "pound", "pounds"],
    "kilometre": ["km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"],
    "metre": ["m", "metre", "metres", "meter", "meters", "mtr", "mtrs"],
    "mile": ["mi", "mile", "miles"],
    "foot": ["ft", "foot", "feet"],
    "square_metre": ["sq m", "sqm", "m2", "sq mtr", "sq mtrs", "square metre", "square metres", "square meter", "square meters", "sq metres", "sq meters"],
    "square_foot": ["sq ft", "sqft", "sft", "square foot", "square feet", "sq feet", "ft2"],
    "acre": ["acre", "acres", "ac"],
    "hectare": ["ha", "hectare", "hectares"],
    "kilowatt_hour": ["kwh", "kilowatt-hour", "kilowatt-hours", "kilowatt hour", "kilowatt hours"],
    "megawatt_hour": ["mwh", "megawatt hour", "megawatt hours", "megawatt-hour", "megawatt-hours"],
    "gigawatt_hour": ["gwh", "gigawatt hour", "gigawatt hours", "gigawatt-hour", "gigawatt-hours"],
    "gigajoule": ["gj", "gigajoule", "gigajoules"],
    "each": ["units", "unit", "numbers", "number", "nos", "no", "employees", "users", "vehicles", "centres", "centers", "codes", "shipments", "patents", "pieces", "pcs", "customers", "parcels", "persons", "people", "items"],
    "minute": ["min", "mins", "minute", "minutes"],
    "hour": ["h", "hr", "hrs", "hour", "hours"],
    "day": ["day", "days", "day(s)"],
    "litre": ["l", "litre", "litres", "liter", "liters", "ltr", "ltrs"],
    "kilolitre": ["kl", "kilolitre", "kilolitres", "kiloliter", "kiloliters"],
    "barrel": ["bbl", "bbls", "barrel", "barrels"],
    "us_gallon": ["us gal", "us gallon", "us gallons", "u.s. gallons", "gallons", "gal"],
}
# Spellings of the scale words.
SCALES = {
    "thousand": ["thousand", "thousands", "k", "'000", "000s", "हज़ार"],
    "lakh": ["lakh", "lakhs", "lac", "lacs", "लाख"],
    "million": ["million", "millions", "mn", "mio", "mln"],
    "crore": ["crore", "crores", "cr", "crs", "करोड़"],
    "billion": ["billion", "billions", "bn", "mrd"],
    "trillion": ["trillion", "trillions", "tn", "trn"],
    "lakh_crore": ["lakh crore", "lakh crores", "lakh cr", "lac crore", "lakh_crore", "lakh crs"],
}
#: Letters that are a scale beside a currency and a unit, or nothing, elsewhere.
SHORT_SCALES = {"m": "million", "b": "billion"}
# Words and marks around a number that change nothing.
FILLERS = {"about", "approx", "approximately", "c", "ca", "circa", "over", "nearly", "around", "almost", "some", "upto", "~", "*", "#", "†", "in", "/", "-", ".", ",", ":", "of", "the"}
FOOTNOTE = re.compile(r"\[\w{1,2}\]|[*#†‡^]+")

_DIGITS = {c: str(unicodedata.decimal(chr(c))) for c in range(0x660, 0x1FBFA) if unicodedata.decimal(chr(c), None) is not None}
_PLAIN = str.maketrans({**{k: v for k, v in _DIGITS.items()}, "−": "-", "–": "-", "—": "-", "‐": "-", "‑": "-", "’": "'", "‘": "'", "٬": ",", "٫": "."})
NUMBER = re.compile(r"\d{1,3}(?:[ ']\d{3})+(?!\d)(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,]\d+)*")


def plain(text: str | None) -> str:
    """One way of writing: compatibility forms, ASCII digits, plain spaces, minus and apostrophe."""
    text = (text or "").replace("m²", "sqm").replace("ft²", "sqft")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).translate(_PLAIN)).strip()


def number_of(s: str) -> Decimal:
    """The number that the digits and separators of one number stand for. The last of two kinds of separators is the
    decimal one; a single kind is decimal if it occurs once before other than three digits (a full stop: if it occurs once)."""
    s = s.replace(" ", "").replace("'", "")
    comma, dot = s.rfind(","), s.rfind(".")
    if comma >= 0 and dot >= 0:
        s = s.replace(",", "") if dot > comma else s.replace(".", "").replace(",", ".")
    elif comma >= 0:
        s = s.replace(",", ".") if s.count(",") == 1 and len(s) - comma - 1 != 3 else s.replace(",", "")
    elif s.count(".") > 1:
        s = s.replace(".", "")
    return Decimal(s)


@dataclass(frozen=True)
class Phrase:
    """What the words around a number say."""

    scale: str | None
    unit: str | None
    clash: bool  # two different units or scales
    rest: str  # words that say neither
    bare_m: bool = False  # the unit is "metre" only because of a lone "m"


def _lexicon() -> tuple[re.Pattern, dict[str, tuple[str, str]]]:
    table: dict[str, tuple[str, str]] = {}
    for kind, held in (("unit", UNITS), ("scale", SCALES)):
        for name, spellings in held.items():
            for s in spellings:
                table[plain(s)] = (kind, name)
    words = sorted(table, key=len, reverse=True)
    parts = [re.escape(w).replace(r"\ ", r"[ .]{1,2}") + ("" if not w[-1].isalnum() else r"(?!\w)") for w in words]
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(parts) + r")\.?(?!\w)|[$€£¥₹%]|'000"), table


_WORDS, _TABLE = _lexicon()


@lru_cache(maxsize=200_000)
def read_phrase(text: str) -> Phrase:
    """Scale and unit in ``text``, which :func:`plain` made and which has no number any more."""
    s = FOOTNOTE.sub(" ", text.lower())
    scales: list[str] = []
    units: list[str] = []
    rest = ""
    at = 0
    short: list[str] = []
    for m in _WORDS.finditer(s):
        rest += s[at : m.start()] + " "
        at = m.end()
        word = re.sub(r"\s+", " ", m[0].strip())
        hit = _TABLE.get(word) or _TABLE.get(word.rstrip(".")) or _TABLE.get(re.sub(r"\. ?", " ", word).strip()) or _TABLE.get(re.sub(r"[ .]+", " ", word).strip())
        if hit is None:
            rest += word
        elif word.rstrip(".") in SHORT_SCALES:
            short.append(word.rstrip("."))
        else:
            (units if hit[0] == "unit" else scales).append(hit[1])
    rest += s[at:]
    for b in re.findall(r"(?<!\w)b(?!\w)", rest):
        if units:
            short.append("b")
            rest = re.sub(r"(?<!\w)b(?!\w)", " ", rest, count=1)
    bare_m = False
    for w in short:  # "m": million beside another unit, else metre
        if w == "b" or units:
            scales.append(SHORT_SCALES[w])
        else:
            units.append("metre")
            bare_m = True
    if scales == ["lakh", "crore"] or scales == ["lakh_crore"] or scales[:2] == ["lakh", "crore"]:
        scales = ["lakh_crore"]
    left = " ".join(w for w in re.findall(r"[^\W_]+|[^\w\s]", rest) if w not in FILLERS and w not in "()[]")
    us, ss = list(dict.fromkeys(units)), list(dict.fromkeys(scales))
    return Phrase(ss[0] if ss else None, us[0] if us else None, len(us) > 1 or len(ss) > 1, left, bare_m)


def as_million(p: Phrase) -> Phrase:
    """The other reading of a lone "m"."""
    return Phrase("million", None, p.scale is not None, p.rest)


@dataclass(frozen=True)
class Reading:
    number: Decimal  # with its sign, without scale
    phrase: Phrase


@lru_cache(maxsize=200_000)
def read_value(value: str | None) -> Reading | None:
    """A value that is one number, with what stands around it; None for ranges, ratings, periods, references, words and blanks."""
    s = plain(value)
    if not s or not any(c.isdigit() for c in s):
        return None
    body = re.sub(r"\[\w{1,2}\]", " ", s)
    body = re.sub(r"'000", " thousand ", body)
    found = list(NUMBER.finditer(body))
    if len(found) != 1:
        return None
    m = found[0]
    before, after = body[: m.start()], body[m.end() :]
    if re.search(r"[^\W\d_]$", before) and not re.search(r"(?:rs|inr|usd|eur|gbp|jpy|us)$", before, re.I):
        return None  # Q1, FY24
    if re.match(r"\s*[:/]\s*\d", after):
        return None
    minus = bool(re.search(r"-\s*$|-\s*\(?(?:rs\.?|inr|usd|us\$|eur|gbp|jpy|[$€£¥₹])\s*$", before, re.I)) or (bool(re.match(r"[^()]*\)", after)) and bool(re.search(r"\([^()]*$", before)))
    phrase = read_phrase(f"{before.replace('-', ' ')} {after}")
    if phrase.rest:
        return None
    return Reading(number_of(m[0]) * (-1 if minus else 1), phrase)


_PREFIX = re.compile(r"(?:rs\.?|inr|usd|us\$|eur|gbp|jpy|[$€£¥₹])\s*[-(]?\s*$", re.I)


_LEAD = re.compile(r"\s*\)?\s*")
_WORD = re.compile(r"\s*(?:'000|[%$€£¥₹]|[^\W\d_][\w²/()'-]*\.?|/)")
_PARTIAL = re.compile(r"(?:us|u|u s|sq|square|per|basis|percentage|metric|pounds|lakh|kilowatt|megawatt|gigawatt|u\.s)")
_GLUED = re.compile(r"(?:rs|inr|usd|eur|gbp|jpy)$", re.I)
_NUMBERED = re.compile(r"\b(?:zone|plant|branch|depot|circle|terminal|table|note|column|page)\s*$", re.I)
#: More than any mark before a number is long, once white space is single.
_BEFORE = 16


def all_beside(statement: str | None, number: Decimal) -> list[Phrase]:
    """The phrases with a unit beside the same number in a sentence, one per unit, in the order of the sentence."""
    s = plain(statement)
    found: dict[str, Phrase] = {}
    for m in NUMBER.finditer(s):
        try:
            if number_of(m[0]) != abs(number):
                continue
        except ArithmeticError:
            continue
        before = s[max(0, m.start() - _BEFORE) : m.start()]
        if before and (before[-1].isalnum() or before[-1] == "'") and not _GLUED.search(before):
            continue
        if _NUMBERED.search(before):
            continue
        p = _PREFIX.search(before)
        words, at = "", _LEAD.match(s, m.end()).end()
        while w := _WORD.match(s, at):
            grown = words + w[0]
            read = read_phrase(grown)
            if read.rest and not _PARTIAL.fullmatch(read.rest):
                break
            words, at = grown, w.end()
        read = read_phrase(f"{p[0] if p else ''} {words}")
        if read.unit and not read.clash:
            found.setdefault(read.unit, read)
    return list(found.values())


def beside(statement: str | None, number: Decimal) -> Phrase | None:
    """The first of :func:`all_beside`."""
    return next(iter(all_beside(statement, number)), None)


# Units that share a spelling with another unit of the catalogue.
NAMESAKES = {"pound": "pound_sterling"}
_NOTE = re.compile(r">>>.*?<<<", re.S)
_NOTE_WORDS = re.compile(r"\b(?:statement|annexure|notes?|form|part|of|the|all|amounts?|figures?|values?|are|is|in|unless|otherwise|stated|rounded|expressed|reported|currency|unit|units of|numbers are)\b|[()\[\]:;,>|]", re.I)


@lru_cache(maxsize=50_000)
def general_notes(window: str | None) -> tuple[Phrase, ...]:
    """The general notes around an extract (``>>> ... <<<`` is the extract itself): the lines that say a unit and nothing else, one per unit, in order."""
    found: dict[str, Phrase] = {}
    if window and window.strip():
        for line in re.split(r"[\n\r]+|(?<=annexure\.)\s", _NOTE.sub("\n", window)):
            s = plain(line)
            if not s:
                continue
            for part in (s, *re.findall(r"[(\[]([^()\[\]]*(?:\([^()]*\))?[^()\[\]]*)[)\]]", s)):
                words = _NOTE_WORDS.sub(" ", re.sub(r"day\(s\)", "days", part, flags=re.I))
                read = read_phrase(re.sub(r"\s+", " ", words).strip())
                if read.unit and not read.clash and not read.rest:
                    found.setdefault(read.unit, read)
                    break
    return tuple(found.values())


def general_note(window: str | None) -> Phrase | None:
    """The first of :func:`general_notes`."""
    return next(iter(general_notes(window)), None)
