"""Normal forms of typed names and the alignment of a name with an entry of a list."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that say a legal form, as they are written, and the form they stand for.
LEGAL = {
    "limited": "limited", "ltd": "limited", "limted": "limited", "private": "private", "pvt": "private", "p": "private",
    "corporation": "corporation", "corp": "corporation", "corpn": "corporation", "group": "group", "grp": "group",
    "companies": "group", "holdings": "holdings", "hldgs": "holdings",
}
# Words that an acronym may leave out.
SMALL_WORDS = {"of", "on", "from", "and", "the", "in", "for", "per", "to", "after"}
# Qualifiers before or after a name that do not belong to it.
BEFORE = re.compile(r"^(?:m/s\.?|messrs\.?|the|reported)[\s_]+")
AFTER = re.compile(r"\((?:[^()]*)\)\s*$|\bgroup of companies\s*$")
QUOTES = re.compile(r"[\"“”„«»`]+|^'+|'+$")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def words_of(raw: str | None) -> list[str]:
    """Lower-case words of a name: without quotes, qualifiers and separators; a full stop stays at a shortened word."""
    if raw is None:
        return []
    s = unicodedata.normalize("NFKC", raw)
    s = QUOTES.sub(" ", s.strip())
    s = s.strip(" :;\t\n")
    if " " not in s.strip() and "_" not in s:
        s = CAMEL.sub(" ", s)
    s = s.lower().strip()
    prev = None
    while prev != s:
        prev = s
        s = BEFORE.sub("", s)
        s = re.sub(r"\bgroup of companies\b", "group", s)
        s = re.sub(r"\(p\)", " p ", s)
        s = re.sub(r"\([^()]*\)\s*[:.]?\s*$", "", s).strip(" :;")
    head, comma, tail = s.partition(",")
    if comma:
        s = f"{tail} {head}" if not all(w in LEGAL for w in _split(tail)) else f"{head} {tail}"
    return _split(s)


def _split(s: str) -> list[str]:
    # "Non-.": a word of two parts that was cut at the hyphen; the second part may be any
    return re.findall(r"[^\W_]+\.?|~\.", re.sub(r"[&]", " and ", s).replace("'", "").replace("-.", " ~."), re.UNICODE)


def readings(raw: str | None) -> list[list[str]]:
    """Word lists that a name may stand for: as typed, and without a leading "total"."""
    core = core_of(words_of(raw))[0]
    return [core, core[1:]] if len(core) > 1 and core[0] == "total" else [core]


def is_acronym(raw: str | None) -> str | None:
    """The letters of a name typed as an acronym (``ZPA``, ``Z.P.A.``), in lower case."""
    s = QUOTES.sub("", (raw or "").strip()).strip()
    s = re.sub(r"\([^()]*\)\s*$", "", s).strip(" :;")
    if re.fullmatch(r"(?:[A-Za-z]\.){2,8}|[A-Z]{2,8}", s):
        return s.replace(".", "").lower()
    return None


def core_of(words: list[str]) -> tuple[list[str], list[str]]:
    """Words without legal forms, and the legal forms."""
    core = [w for w in words if LEGAL.get(w.rstrip(".")) is None]
    return core, [LEGAL[w.rstrip(".")] for w in words if w.rstrip(".") in LEGAL]


def acronyms_of(name: str) -> set[str]:
    words = [w.rstrip(".") for w in core_of(words_of(name))[0]]
    every = "".join(w[0] for w in words)
    return {a for a in (every, "".join(w[0] for w in words if w not in SMALL_WORDS)) if len(a) > 1}


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (optimal string alignment); more than ``most`` counts as most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _unrestricted(a: str, b: str) -> int:
    """Damerau-Levenshtein distance where letters may also swap places across a letter that was lost."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        hit = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), hit
            if x == y:
                hit = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[len(a) + 1][len(b) + 1]


def allowed_edits(length: int) -> int:
    """Misspellings that a name of so many letters may have."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 16 else 3


@lru_cache(maxsize=100_000)
def _word_distance(v: str, c: str) -> float:
    if v == c:
        return 0.0
    if v == "~.":
        return 0.05
    if v.endswith("."):
        v = v[:-1]
        if v and c.startswith(v):
            return 0.0 if len(v) == len(c) else 0.05
        return min(9, edits(v, c[: len(v)], 2)) + 0.3 if len(v) >= 3 else 9.0
    d = edits(v, c, 3)
    if d == 3 and len(c) > 4 and sorted(v) != sorted(c):
        d = min(d, _unrestricted(v, c))
    return float(d) if d <= 3 else 9.0


def alignment(value: list[str], entry: list[str]) -> float:
    """Distance of a typed name's words from an entry's words; 9 and more: another name.

    Word by word where the number of words agrees, else without the spaces. Words shortened with a full stop
    match by their beginning.
    """
    most = allowed_edits(max(sum(len(w.rstrip(".")) for w in value), sum(map(len, entry))))
    best = 9.0
    if len(value) == len(entry):
        each = [_word_distance(v, c) for v, c in zip(value, entry, strict=True)]
        if all(d <= (1.4 if len(c) <= 2 else 2.4) for d, c in zip(each, entry, strict=True)):
            best = sum(each)
    if best > most + 0.9 and len(value) != len(entry):
        a, b = "".join(value).replace(".", ""), "".join(entry)
        d = edits(a, b, most)
        if d <= most:
            best = d + 0.1
    return best if best <= most + 0.9 else 9.0
