"""Template residue, filler, error pages and script notices among documents (problem 8).

Regularised linear classifiers on hashed n-grams, length and title features. One scores whole texts: is the content filler, an error or
refusal message or a notice about scripts. The other scores their parts (lines and sentences): does a slot of a template stand open. Both are fitted on
a bounded sample with weak labels (response statuses, common phrases, slot notations); what the labels miss the n-grams
beside them say. The thresholds are those of the best balance of precision and recall on hosts that the fit has not seen. The
classifiers decide; a text taken for its slot is then looked at once more, whether the slot is open or quoted.
Scoring is a vectorised array job per Arrow batch: no shuffle.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import residue_text
from factloom.session import hash_sample

#: Bound of the sample from which the classifiers are fitted and checked.
SAMPLE_ROWS = 12_000
#: Share of the hosts that are kept for the check.
UNSEEN_HOSTS = 0.25
#: Hashed features.
BITS = 17
#: Weight of the squared norm in the fit, size of a step, rows of a batch, and passes over the sample.
REGULARISATION, RATE, BATCH, EPOCHS = 1e-4, 0.1, 256, 8
#: So often the fit is repeated with the labels that it gave itself.
RELABELLINGS = 2
#: Log-odds from which a text is labelled by what the other texts teach.
CONFIDENT = 1.0
#: In the choice of the threshold for slots recall counts so often, since a look at the slot itself follows.
SLOT_BETA = 8.0
#: Bytes of text that are scored at once.
SLICE = 2_000_000
BLANK, LOWER, UPPER, DIGIT, SIGN = 0, 2, 3, 4, 5
TEXT_EXTRA, PART_EXTRA = 8, 4
#: Signs of ordinary sentences: alone they make no shape.
PLAIN_SIGNS = ".,;()-'/&₹€£¥!?–—’*|+"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point (those beyond the basic plane count as its last one): kind, folded form, whether it is an unusual sign, whether it ends a sentence."""
    n = 0x10000
    kind, fold = np.full(n, LOWER, np.uint8), np.arange(n, dtype=np.uint64)
    for c in range(n):
        s = chr(c)
        group = unicodedata.category(s)
        if group[0] in "ZC":
            kind[c] = BLANK
        elif group == "Nd":
            kind[c] = DIGIT
        elif group[0] in "LM":
            kind[c] = UPPER if s.isupper() else LOWER
            fold[c] = ord(s.lower()) if len(s.lower()) == 1 else c
        else:
            kind[c] = SIGN
    unusual = kind == SIGN
    unusual[[ord(c) for c in PLAIN_SIGNS]] = False
    ends = np.zeros(n, bool)
    ends[[ord(c) for c in ".!?।…"]] = True
    return kind, fold, unusual, ends


_BASE = 0x9E3779B97F4A7C15
_LINE_ENDS = np.array([0x0A, 0x0B, 0x0C, 0x0D, 0x2028, 0x2029], np.uint16)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SLICE + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Features:
    """Of a slice of texts. ``words`` and ``pairs`` (of neighbours): hashed, one per word; ``bounds``: the words of part i are
    ``bounds[i]:bounds[i + 1]``. ``shapes``: hashed forms of three neighbours around an unusual sign, ``shape_part`` their part. ``part_text`` says which text
    a part belongs to, ``text_bounds`` which words; ``part_extra`` and ``text_extra`` are length and title features."""

    words: np.ndarray
    pairs: np.ndarray
    bounds: np.ndarray
    shapes: np.ndarray
    shape_part: np.ndarray
    part_text: np.ndarray
    text_bounds: np.ndarray
    part_extra: np.ndarray
    text_extra: np.ndarray
    part_span: np.ndarray  # code points of the slice where the parts begin, and its end
    points: np.ndarray


def _decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each text begins and the last one ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[o[0] : o[-1]]
    o = o - o[0]
    if raw.size and raw.max() >= 0x80:
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        return np.minimum(points, 0xFFFF).astype(np.uint16), lead[o]
    return raw.astype(np.uint16), o


def features(texts: pa.Array) -> Features:
    """Words are runs of letters and marks, runs of digits, all alike, and single other signs. Parts end with a line or a sentence."""
    points, at_text = _decode(texts)
    kinds, fold, unusual, ends = _tables()
    n, n_texts = len(points), len(texts)
    kind = kinds[points]
    plain = np.where(kind == UPPER, np.uint8(LOWER), kind)
    cut = np.zeros(n + 1, bool)
    cut[at_text] = True
    if n:
        line = np.isin(points, _LINE_ENDS)
        cut[1:] |= line
        cut[2:] |= (kind[1:] == BLANK) & ends[points[:-1]] & ~line[1:]
        across = at_text[1:-1] + 1  # what ends a text does not reach into the next
        across = across[across < n]
        across = across[(at_text[np.searchsorted(at_text, across, "right") - 1] != across) & ~line[across - 1]]
        cut[across] = False
    cut[n] = False
    start = cut[:n].copy()
    start[1:] |= plain[1:] != plain[:-1]
    start |= kind == SIGN
    begin = np.flatnonzero(cut[:n])
    at = np.flatnonzero(start)
    stop = np.append(at[1:], n)
    used = plain[at] != BLANK
    at, stop = at[used], stop[used]
    up, down = _powers() if n <= SLICE else (np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64))), np.cumprod(np.append(np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(fold[points] * up[:n], dtype=np.uint64)))
    code = (total[stop] - total[at]) * down[at]
    first = kind[at]
    code[first == DIGIT] = 48
    bounds = np.searchsorted(at, np.append(begin, n))
    opens = bounds[:-1][bounds[:-1] < len(at)]
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[opens] = 7
    pair = before * np.uint64(0xC2B2AE3D27D4EB4F) + code
    # forms: a sign is itself, a word says whether it is written in capitals
    form = code.copy()
    letters = (first == LOWER) | (first == UPPER)
    second = np.zeros(len(at), np.uint8)
    long = stop - at > 1
    second[long] = kind[at[long] + 1]
    form[letters] = np.where(first == LOWER, 1, np.where(second == UPPER, 2, 3))[letters].astype(np.uint64)
    odd = np.zeros(len(at) + 4, bool)
    odd[2:-2] = (first == SIGN) & unusual[points[at]]
    around = np.flatnonzero(odd[1:-3] | odd[2:-2] | odd[3:-1])  # the middle one of three
    part_of = np.searchsorted(bounds, around, "right") - 1
    prev, nxt = np.full(len(around), 5, np.uint64), np.full(len(around), 6, np.uint64)
    inner = around > bounds[part_of]
    prev[inner] = form[around[inner] - 1]
    inner = around + 1 < bounds[part_of + 1]
    nxt[inner] = form[around[inner] + 1]
    shape = (prev * np.uint64(0x165667B19E3779F9) + form[around]) * np.uint64(0x27D4EB2F165667C5) + nxt
    part_text = np.searchsorted(at_text, begin, "right") - 1
    text_bounds = np.searchsorted(at, at_text)
    ended = np.append(begin[1:], n)

    each = np.diff(bounds)
    digits = np.concatenate(([0], np.cumsum(first == DIGIT)))
    capitals = np.concatenate(([0], np.cumsum(kind == UPPER)))
    part_extra = np.zeros((len(begin), PART_EXTRA))
    part_extra[:, 0] = 1.0
    part_extra[:, 1] = np.log1p(each) / 4
    part_extra[:, 2] = (capitals[ended] - capitals[begin]) / np.maximum(ended - begin, 1)
    part_extra[:, 3] = (digits[bounds[1:]] - digits[bounds[:-1]]) / np.maximum(each, 1)

    size = np.diff(text_bounds)
    title = each < 9
    closed = np.flatnonzero(each > 0)
    title[closed] &= ~ends[points[at[bounds[closed + 1] - 1]]]
    again = np.zeros(len(at) + 1, np.int64)
    again[2:] += code[1:] == code[:-1]
    again[3:] |= code[2:] == code[:-2]
    again = np.cumsum(again)
    text_extra = np.zeros((n_texts, TEXT_EXTRA))
    count = np.maximum(np.bincount(part_text, minlength=n_texts), 1)
    text_extra[:, 0] = 1.0
    text_extra[:, 1] = np.log1p(size) / 4
    text_extra[:, 2] = np.log1p(count) / 2
    text_extra[:, 3] = (capitals[at_text[1:]] - capitals[at_text[:-1]]) / np.maximum(np.diff(at_text), 1)
    text_extra[:, 4] = (digits[text_bounds[1:]] - digits[text_bounds[:-1]]) / np.maximum(size, 1)
    text_extra[:, 5] = np.bincount(part_text, weights=title, minlength=n_texts) / count
    text_extra[:, 6] = size / count / 20
    text_extra[:, 7] = np.where(size > 7, (again[text_bounds[1:]] - again[text_bounds[:-1]]) / np.maximum(size, 1), 0.0)
    return Features(_mix(code), _mix(pair), bounds, _mix(shape), part_of, part_text, text_bounds, part_extra, text_extra, np.append(begin, n), points)


def features_of_all(texts: pa.Array) -> Features:
    """:func:`features` slice by slice, put together."""
    held = [features(texts.slice(lo, hi - lo)) for lo, hi in _slices(texts)] or [features(texts)]

    def joined(name: str) -> np.ndarray:
        return np.concatenate([getattr(f, name) for f in held])

    def shifted(name: str, sizes: list[int], bounds: bool) -> np.ndarray:
        steps = np.cumsum([0, *sizes])
        return np.concatenate([(getattr(f, name)[:-1] if bounds and k + 1 < len(held) else getattr(f, name)) + steps[k] for k, f in enumerate(held)])

    words, parts, signs = [len(f.words) for f in held], [len(f.part_text) for f in held], [len(f.points) for f in held]
    return Features(
        joined("words"), joined("pairs"), shifted("bounds", words, True), joined("shapes"), shifted("shape_part", parts, False), shifted("part_text", [len(f.text_extra) for f in held], False),
        shifted("text_bounds", words, True), joined("part_extra"), joined("text_extra"), shifted("part_span", signs, True), joined("points"),
    )


def part_strings(f: Features, some: np.ndarray) -> list[str]:
    """The parts of these numbers as text (characters beyond the basic plane come out as one sign)."""
    return [f.points[f.part_span[i] : f.part_span[i + 1]].tobytes().decode("utf-16-le", "replace") for i in some.tolist()]


@dataclass
class Linear:
    """Weights of hashed n-grams and of the extra features, and the threshold."""

    weights: np.ndarray
    extra: np.ndarray
    threshold: float = 0.0


def fit(codes: np.ndarray, values: np.ndarray, each: np.ndarray, extra: np.ndarray, y: np.ndarray, seed: int = 5) -> Linear:
    """Logistic regression with a squared-norm penalty, both classes weighing the same, by adaptive gradient steps over batches of rows.

    Row i has the next ``each[i]`` of the sparse features ``codes`` with their ``values``, and ``extra[i]``.
    """
    n, at = len(y), np.concatenate(([0], np.cumsum(each)))
    order = np.random.default_rng(seed).permutation(n)
    weigh = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    batches = []
    for lo in range(0, n, BATCH):
        rows = order[lo : lo + BATCH]
        size = each[rows]
        take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[rows], size)
        used, local = np.unique(codes[take], return_inverse=True)
        batches.append((rows, used, local.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), size), values[take]))
    w, b = np.zeros(1 << BITS), np.zeros(extra.shape[1])
    gw, gb = np.full(1 << BITS, 1e-4), np.full(extra.shape[1], 1e-4)
    for _ in range(EPOCHS):
        for rows, used, local, row, value in batches:
            z = np.bincount(row, weights=w[used][local] * value, minlength=len(rows)) + extra[rows] @ b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weigh[rows] / len(rows)
            dw = np.bincount(local, weights=g[row] * value, minlength=len(used)) + REGULARISATION * w[used]
            db = extra[rows].T @ g
            gw[used] += dw**2
            gb += db**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            b -= RATE * db / np.sqrt(gb)
    return Linear(w.astype(np.float32), b)


def _damped(bounds: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(bounds), 1) ** -0.5


def _sums(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def text_scores(model: Linear, f: Features) -> np.ndarray:
    """Log-odds of each text to be a notice, an error page or filler."""
    return _sums(model.weights[f.words] + model.weights[f.pairs], f.text_bounds) * _damped(f.text_bounds) + f.text_extra @ model.extra


def part_scores(model: Linear, f: Features) -> np.ndarray:
    """Log-odds of each part to hold an open slot."""
    shapes = np.bincount(f.shape_part, weights=model.weights[f.shapes], minlength=len(f.bounds) - 1) if len(f.shapes) else 0.0
    return _sums(model.weights[f.words], f.bounds) * _damped(f.bounds) + shapes + f.part_extra @ model.extra


def _matrix(f: Features, of_text: bool, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of the texts or parts ``keep`` (ascending): words and pairs of texts, words and shapes of parts."""
    bounds = f.text_bounds if of_text else f.bounds
    each, damping = np.diff(bounds), _damped(bounds).astype(np.float32)
    row = np.full(len(each), -1)
    row[keep] = np.arange(len(keep))
    of = row[np.repeat(np.arange(len(each)), each)].astype(np.int32)
    held = of >= 0
    if of_text:
        rows, codes, values = np.tile(of[held], 2), np.concatenate((f.words[held], f.pairs[held])), np.tile(damping[keep][of[held]], 2)
    else:
        marked = row[f.shape_part]
        there = marked >= 0
        rows, codes, values = np.concatenate((of[held], marked[there])), np.concatenate((f.words[held], f.shapes[there])), np.concatenate((damping[keep][of[held]], np.ones(there.sum(), np.float32)))
    order = np.argsort(rows, kind="stable")
    return codes[order], values[order], np.bincount(rows, minlength=len(keep))


def best_threshold(scores: np.ndarray, y: np.ndarray, beta: float) -> tuple[float, float, float]:
    """The threshold with the best balance of precision and recall (F-measure in which recall counts ``beta`` times), in the middle of the gap
    below it, with both figures."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    balance = (1 + beta**2) * hits / (np.arange(1, len(y) + 1) + beta**2 * max(y.sum(), 1))
    k = int(len(y) - 1 - np.argmax(balance[::-1]))
    low = scores[order[k + 1]] if k + 1 < len(y) else scores[order[k]] - 1
    return float((scores[order[k]] + low) / 2), float(hits[k] / (k + 1)), float(hits[k] / max(y.sum(), 1))


@dataclass
class Trained:
    """``notice`` and ``slot`` are None where the sample has not both labels: then no text is taken for that reason."""

    notice: Linear | None
    slot: Linear | None
    report: dict[str, float]


def host_of(document_id: str | None) -> str:
    """The publisher by whom a report's id begins."""
    return (document_id or "").strip().lower().partition("-")[0].partition("_")[0]


def train(documents: DataFrame) -> Trained:
    """Fits and checks the classifiers on a bounded sample of the texts that are not blank.

    The report gives precision and recall against the weak labels on unseen hosts at the thresholds.
    """
    some = documents.select("doc_id", "document_id", "text").filter(F.trim("text") != "")
    sample = hash_sample(some, SAMPLE_ROWS, "doc_id").toPandas()  # a bounded sample
    return train_on(sample["text"].tolist(), sample["document_id"].tolist())


def train_on(texts: list[str], document_ids: list[str | None]) -> Trained:
    report = {"texts": float(len(texts))}
    if not texts:
        return Trained(None, None, report)
    f = features_of_all(pa.array(texts, pa.large_string()))
    y_text = np.array([residue_text.weak_notice(t, r) for t, r in zip(texts, f.text_extra[:, 7].tolist(), strict=True)])
    y_part = np.zeros(len(f.part_text), np.int64)
    signed = np.unique(np.concatenate((f.shape_part, np.flatnonzero(f.part_extra[:, 2] > 0))))
    y_part[signed] = [residue_text.weak_slot(p) for p in part_strings(f, signed)]
    unseen = np.array([(zlib.crc32(host_of(d).encode()) & 0xFFFF) / 65536 < UNSEEN_HOSTS for d in document_ids])
    if not (y_text[unseen].any() and y_text[~unseen].any()):  # too few hosts: every fourth text
        unseen = np.arange(len(texts)) % 4 == 0
    models: dict[str, Linear | None] = {}
    for name, y, out, extra in (("notice", y_text, unseen, f.text_extra), ("slot", y_part, unseen[f.part_text], f.part_extra)):
        seen = np.flatnonzero(~out)
        if len(set(y[seen].tolist())) < 2:
            models[name] = None
            continue
        of_text = name == "notice"
        score = text_scores if of_text else part_scores

        def fitted(rows: np.ndarray, of_text: bool = of_text, extra: np.ndarray = extra) -> Linear:
            return fit(*_matrix(f, of_text, rows), extra[rows], y[rows])  # noqa: B023

        if of_text:  # the labels know few phrases: each half is labelled anew by what the other half teaches
            half = np.arange(len(seen)) % 2 == 0
            for _ in range(RELABELLINGS):
                if not (y[seen[half]].any() and y[seen[~half]].any()):
                    break
                one, other = fitted(seen[half]), fitted(seen[~half])
                z = np.minimum(score(one, f), score(other, f))
                z[seen[half]], z[seen[~half]] = score(other, f)[seen[half]], score(one, f)[seen[~half]]
                y = np.maximum(y_text, (z > CONFIDENT) & (f.text_extra[:, 5] < 1))  # not mere titles
        model = fitted(seen)
        scores = score(model, f)
        check = out if y[out].any() and not y[out].all() else ~out
        model.threshold, precision, recall = best_threshold(scores[check], y[check], 1.0 if of_text else SLOT_BETA)
        models[name] = model
        report |= {f"{name}_precision": precision, f"{name}_recall": recall, f"{name}_unseen": float(y[check].sum()), f"{name}_threshold": model.threshold}
    return Trained(models["notice"], models["slot"], report)


def judge(trained: Trained, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are notices, and which hold an open slot, the check of its quotation included."""
    f = features(texts)
    notice, slot = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    if trained.notice is not None:
        notice = (text_scores(trained.notice, f) >= trained.notice.threshold) & (np.diff(f.text_bounds) > 0)
    if trained.slot is not None and len(f.part_text):
        taken = np.flatnonzero(part_scores(trained.slot, f) >= trained.slot.threshold)
        for i in np.unique(f.part_text[taken]).tolist():
            slot[i] = residue_text.open_slot(residue_text.clean(texts[i].as_py()))
    return notice, slot


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        base = size[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(size, base + SLICE, "right"))), lo + 20_000)
        yield lo, hi
        lo = hi


def find_residue(documents: DataFrame, trained: Trained | None = None) -> DataFrame:
    """``doc_id`` of the texts that are or contain an unfilled template, or whose content is filler, an error or refusal message or
    a notice about scripts. Null, empty and blank texts are none. Ids that come twice are listed once. An empty table gives none.
    """
    held = trained or train(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                notice, slot = judge(held, batch.column(1).slice(lo, hi - lo))
                hit = np.flatnonzero(notice | slot)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(hit))], ["doc_id"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.col("text") != "")).mapInArrow(run, f"doc_id {kind}").distinct()


def scores(documents: DataFrame, trained: Trained | None = None) -> DataFrame:
    """``doc_id, notice, slot``: what :func:`judge` says of each text; false for null and blank texts."""
    held = trained or train(documents)

    @F.pandas_udf("struct<notice:boolean,slot:boolean>")
    def score(text: pd.Series) -> pd.DataFrame:
        notice, slot = judge(held, pa.array(text.tolist(), pa.large_string()))
        return pd.DataFrame({"notice": notice, "slot": slot})

    return documents.select("doc_id", score("text").alias("s")).select("doc_id", "s.*")
