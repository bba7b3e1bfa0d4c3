"""Weak signs of residue, for the labels that the classifier is trained on, and the structural check of open slots."""

from __future__ import annotations

import re

# Notations of a slot in a template, by the marks that open and close it.
_NAME = r"[A-Za-z][\w. /-]{0,40}"
# Names of fields that stand in a slot without any further mark.
_FIELDS = "date|amount|name|period|auditor|registrar|entity|revenue|company|company name|fiscal year|report title|pat current|year|title|figure|number|address|city|country|currency"
_MERGED = r"«\s*(?:(?-i:[A-Z]+(?:[_.][A-Z]+)+)|[A-Za-z]+(?:_[A-Za-z]+)+|(?-i:" + _FIELDS.upper() + r"))\s*»"
SLOT = re.compile(
    r"\{\{\s*[\w.]+\s*\}\}|[$#]\{\s*[\w.]+\s*\}|<%=?\s*[\w. ]+\s*%>|\{%\s*[\w. ]+\s*%\}|<<\s*" + _NAME + r">>|@@\s*[\w. ]+\s*@@|\$\$\s*[A-Z][A-Z_.]{2,40}\s*\$\$|(?<!\w)__[A-Z][A-Z_. ]*__(?!\w)|(?<![\w%])%[A-Z][A-Z_.]{2,}%(?!\w)"
    r"|(?<![\w:]):[a-z][a-z_.]{2,40}:(?![\w:])|&lt;\s*(?-i:[A-Z])[\w. /-]{1,40}&gt;|\[\[[^\[\]\n]{2,60}\]\]|\[\s*●\s*\]|(?<![\w$\\_^}])\{\d{1,2}\}(?!\w)|\bX{2,}\.X+\b|(?<!\w)_{4,}(?!\w)|\bMERGEFIELD\s+\"?[\w.]+"
    r"|[<\[]\s*(?:insert|enter|your|add|to be|tb[dac])\b[^<>\[\]\n]{0,60}[>\]]|\[(?:" + _FIELDS + r")\]|\bTB[DC]:"
    r"|" + _MERGED,
    re.I,
)
#: A merge field as word processors show it; its marks are also those of a quotation.
MERGE_FIELD = re.compile(_MERGED)
#: What opens and closes a quotation; a slot inside is only mentioned.
QUOTED = re.compile(r"“[^”\n]{0,80}”|„[^“”\n]{0,80}[“”]|«[^»\n]{0,80}»|\"(?=[\[{<$#%@_&:])[^\"\n]{1,80}\"|‘[^’\n]{0,80}’|`[^`\n]{0,80}`")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]|<\|endoftext\|>")

# Response statuses as such pages write them.
STATUS = re.compile(r"\b(?:http )?(?:error|status)(?: code)?:?\s*[45]\d\d\b|^\W*[45]\d\d\W*$|\b[45]\d\d (?:not found|forbidden|gone|unauthorized|bad gateway|service unavailable)\b|\btraceback \(most recent|\b[\w.]+exception:", re.I)
# Common phrases of script notices, of error and refusal pages and of filler, in lower case.
PHRASES = (
    "enable javascript", "requires javascript", "javascript is disabled", "javascript aktivieren", "benötigt javascript", "activer javascript", "activez javascript", "activar javascript", "habilite javascript", "जावास्क्रिप्ट", "enable cookies", "<noscript",
    "page not found", "seite nicht gefunden", "page introuvable", "página no encontrada", "पृष्ठ नहीं मिला", "no longer exists", "access denied", "zugriff verweigert", "accès refusé", "acceso denegado", "अनुमति नहीं", "do not have permission",
    "internal server error", "service unavailable", "temporarily unavailable", "bad gateway", "too many requests", "something went wrong", "try again later", "session has expired", "timed out", "planned maintenance",
    "lorem ipsum", "dolor sit amet", "dummy text", "sample text", "placeholder", "filler text", "blindtext", "platzhalter", "faux texte", "texte de remplissage", "texto de relleno", "texto de prueba", "नमूना पाठ", "your text here", "your headline", "click to add", "text goes here", "copy goes here", "replace this", "add a short",
)
_PARTS = re.compile(r"[\r\n  \x0b\x0c]+|(?<=[.!?।…])\s+")
#: Share of a part's characters that a phrase has at least, or the part only mentions it.
COVERED = 0.25
#: Share of the characters of whole sentences from which weakly signed parts make a text residue for the training.
SHARE = 0.4
#: Share of repeated words from which a text is filler for the training.
REPEATED = 0.6


def clean(text: str) -> str:
    """Without characters that do not show."""
    return _INVISIBLE.sub("", text)


_SLOT_SIGN = re.compile(r"[{\[«@<●]|__|\$\$|&lt;|%[A-Z]|XX|:[a-zA-Z]|mergefield|tb[dac]:", re.I)


def open_slot(text: str) -> bool:
    """Whether a slot stands where a value belongs; a quoted slot, a formula and a stored record are none."""
    if not (_SLOT_SIGN.search(text) and SLOT.search(text)):
        return False
    bare = QUOTED.sub(lambda m: m[0] if MERGE_FIELD.fullmatch(m[0]) else " ", text)
    bare = re.sub(r"(?<!\$)\$(?!\$)[^$\n]{1,200}\$", " ", bare) if "\\" in bare else bare
    return SLOT.search(bare) is not None


def weak_slot(part: str) -> int:
    return int(open_slot(clean(part)))


_MAY_BE_STATUS = re.compile(r"(?:error|status|code)[: ]{1,2}[45]\d|[45]\d\d (?:[nfgubs])|^[^\w\n]*[45]\d\d[^\w\n]*$|traceback|exception:", re.M)


def weak_notice(text: str, repeated: float = 0.0) -> int:
    """1: a text mostly of a response status, of common phrases of such pages or of words that repeat the one or two before them (``repeated`` is their
    share); 0: none of them, or beside other sentences."""
    if repeated >= REPEATED:
        return 1
    low = text.lower()
    spaced = " ".join(low.split())
    if not (any(p in spaced for p in PHRASES) or _MAY_BE_STATUS.search(low)):
        return 0
    signed = other = 0
    for part in _PARTS.split(clean(text)):
        n = len(part)
        bare = QUOTED.sub(" ", part)
        small = " ".join(bare.lower().split())
        sentence = part.rstrip()[-1:] in ".!?।…" and part.strip() != ""  # titles and page furniture are none
        if STATUS.search(bare) or max((len(p) for p in PHRASES if p in small), default=0) >= COVERED * max(n, 1):
            signed += max(n, 1)
        elif small.startswith(PHRASES) and not other:
            return 1  # the content begins with it
        elif sentence:
            other += n
    return int(signed > 0 and signed >= SHARE * (signed + other))
