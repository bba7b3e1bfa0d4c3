"""Where and when a fact holds: report, period and segment in one way of writing."""

from __future__ import annotations

import json
import re

# Kinds of segments.
SEGMENTS = ("zone", "plant", "branch", "depot", "circle", "terminal")
_SEGMENT = re.compile(rf"\b({'|'.join(SEGMENTS)})\s*[-#]?\s*(\d+)\b", re.I)
_PERIOD = re.compile(r"(?:\b(Q[1-4]|H[12])[\s,-]*)?\bFY\s*['’]?\s*(\d{4}\s*[-/]\s*\d{2,4}|\d{4}|\d{2})(?![\d])|(?<![\d.,'’₹$€£¥])\b((?:19|20)\d\d)\b(?![.,]?\d)", re.I)


def report_key(document_id: str | None) -> str | None:
    """One name for a report that was taken in more than once: case, white space, file ending, copy number and the suffix of
    an upload aside, underscores as hyphens. None for null and blank."""
    if document_id is None or not document_id.strip():
        return None
    s = re.sub(r"\s+", " ", document_id).strip().lower()
    prev = None
    while prev != s:
        prev = s
        s = re.sub(r"\.pdf$", "", s)
        s = re.sub(r"\s*\(\d+\)$", "", s)
        s = re.sub(r"_[0-9a-f]{8}$", "", s).strip()
    return s.replace("_", "-")


def period_key(text: str | None, value_text: str | None = None) -> str | None:
    """The first period in ``text``: ``Q1 FY24``, ``H2 FY24``, ``FY24`` (also for FY2023-24) or a calendar year. A year that is
    the fact's own value is no period while another one follows."""
    fallback = None
    for m in _PERIOD.finditer(text or ""):
        if m[3]:
            if value_text and m[3] in value_text and fallback is None:
                fallback = m[3]
                continue
            return m[3]
        year = re.findall(r"\d+", m[2])[-1][-2:]
        return f"{m[1].upper()} FY{year}" if m[1] else f"FY{year}"
    return fallback


def segment_key(text: str | None) -> str | None:
    m = _SEGMENT.search(text or "")
    return f"{m[1].lower()} {m[2]}" if m else None


def scope_of(scope_json: str | None, statement: str | None, value: str | None) -> tuple[str | None, str | None]:
    """Period and segment of a fact: from its scope, else from its sentence."""
    scope: dict = {}
    if scope_json:
        try:
            held = json.loads(scope_json)
            scope = held if isinstance(held, dict) else {}
        except ValueError:
            scope = {}
    low = {str(k).lower(): v for k, v in scope.items() if v is not None}
    said = low.get("period") or (f"{low.get('quarter', '')} {low['fiscal_year']}" if "fiscal_year" in low else low.get("year"))
    period = period_key(str(said)) if said else None
    segment = segment_key(str(low["segment"])) or str(low["segment"]).strip().lower() if low.get("segment") else None
    return period or period_key(statement, value), segment or segment_key(statement)
