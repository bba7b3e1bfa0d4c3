"""Flat tables out of deeply nested records (problem 1).

JSON text is indexed the way a vectorised parser does it: bitmaps of quotes, brackets and delimiters over the
bytes of a whole Arrow batch, string interiors masked by the running parity of the quotes, nesting depth by
prefix sums. A stable sort of the structural bytes by depth then puts each container's opening, separators and
closing side by side, so that children, their places and their keys fall out of prefix sums and binary search;
no record is walked byte by byte in Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of JSON's structure.
QUOTE, BACKSLASH = 0x22, 0x5C
STRUCTURE = b"{}[]:,"
KINDS = ("occurrence", "region", "panel", "series", "point")
#: member key -> what it leads to, by the state of the record that has the member. Lists name the kind of their children.
MEMBERS = {
    "root": {"occurrences": "list:occurrence", "context": "context"},
    "context": {"chart": "chart"},
    "chart": {"panels": "list:panel"},
    "occurrence": {"regions": "list:region"},
    "panel": {"series": "list:series"},
    "series": {"points": "list:point"},
    "region": {},
    "point": {},
}
PLACE = {"occurrence": 0, "region": 1, "panel": 0, "series": 1, "point": 2}
FENCE = re.compile(r"^\s*`{3,}[A-Za-z0-9_-]*\s*(.*?)\s*`{3,}\s*$", re.S)


@dataclass
class Index:
    """Structural index of a batch of texts that lie one after the other in ``buf``."""

    buf: np.ndarray
    starts: np.ndarray
    valid: np.ndarray  # by text
    root: np.ndarray  # byte of the root value, by text; -1: none
    quotes: np.ndarray
    open_pos: np.ndarray  # by container in byte order
    slot_lo: np.ndarray  # by container in byte order: its slots are slot_lo..slot_hi-1
    slot_hi: np.ndarray
    value_lo: np.ndarray  # by slot: bytes of the value
    value_hi: np.ndarray
    place: np.ndarray  # by slot: number in its list
    colon: np.ndarray  # by slot: byte of the colon, -1 in lists


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates lo[i]..hi[i]-1; the second array says which i each item comes from."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), of


def index_batch(buf: np.ndarray, starts: np.ndarray) -> Index:
    """buf: bytes; starts: offsets of the texts, one more than there are texts."""
    n_texts = len(starts) - 1
    # 1. Quote bitmap without escaped quotes: those after an odd run of backslashes.
    quotes = np.flatnonzero(buf == QUOTE)
    slashes = np.flatnonzero(buf == BACKSLASH)
    if len(slashes) and len(quotes):
        first = np.empty(len(slashes), bool)
        first[0] = True
        np.not_equal(np.diff(slashes), 1, out=first[1:])
        run_start = slashes[np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))]
        k = np.searchsorted(slashes, quotes - 1)
        k[k == len(slashes)] = 0
        before = (slashes[k] == quotes - 1) & (quotes > 0)
        text_start = starts[np.searchsorted(starts, quotes, "right") - 1]
        run = np.where(before, quotes - np.maximum(run_start[k], text_start), 0)
        quotes = quotes[run % 2 == 0]
    # 2. Structural bitmap, minus the interiors of strings: an odd number of quotes before it in its text.
    wanted = np.zeros(256, bool)
    wanted[list(STRUCTURE)] = True
    at = np.flatnonzero(wanted[buf])
    quotes_before_text = np.searchsorted(quotes, starts)
    text_of = np.searchsorted(starts, at, "right") - 1
    at = at[(np.searchsorted(quotes, at) - quotes_before_text[text_of]) % 2 == 0]
    text_of = np.searchsorted(starts, at, "right") - 1
    kind = buf[at]
    is_open, is_close = (kind == 0x7B) | (kind == 0x5B), (kind == 0x7D) | (kind == 0x5D)
    # 3. Depth by prefix sums, from zero in each text.
    step = is_open.astype(np.int64) - is_close
    total = np.concatenate(([0], np.cumsum(step)))
    first_token = np.searchsorted(at, starts)
    depth = total[1:] + is_close - total[first_token[text_of]] if len(at) else np.zeros(0, np.int64)
    # 4. Whole texts only: quotes paired, depth back to zero and never below, one root.
    low = np.full(n_texts, 1, np.int64)
    roots = np.zeros(n_texts, np.int64)
    if len(at):
        np.minimum.at(low, text_of, depth)
        np.add.at(roots, text_of[is_open & (depth == 1)], 1)
    valid = (np.diff(quotes_before_text) % 2 == 0) & (total[first_token[1:]] == total[first_token[:-1]]) & (low >= 1) & (roots <= 1)
    # 5. Sorted by depth, a container's opening, separators and closing are neighbours.
    keep = valid[text_of] if len(at) else np.zeros(0, bool)
    at, kind, is_open, is_close, depth, text_of = (x[keep] for x in (at, kind, is_open, is_close, depth, text_of))
    order = np.lexsort((at, depth))
    at, kind, is_open, is_close, text_of = (x[order] for x in (at, kind, is_open, is_close, text_of))
    n = len(at)
    container = np.cumsum(is_open) - 1
    opens = np.flatnonzero(is_open)
    comma = np.cumsum(kind == 0x2C)
    place = comma - comma[opens][container] if n else comma
    in_list = kind[opens][container] == 0x5B if n else np.zeros(0, bool)
    if n:  # a bracket that another kind of bracket closes spoils its text
        bad = is_close & (kind != kind[opens][container] + 2)
        valid[text_of[bad]] = False
    # 6. Slots: what follows an opening or comma in a list, or a colon in a record, up to the next separator.
    nxt = np.append(at[1:], len(buf))
    slot = ~is_close & (in_list | (kind == 0x3A))
    lo, hi = at[slot] + 1, nxt[slot]
    slot_container = container[slot]
    slots_of = np.searchsorted(slot_container, np.arange(len(opens) + 1))
    by_pos = np.argsort(at[opens], kind="stable")
    blank = np.zeros(256, bool)
    blank[[0x20, 0x09, 0x0A, 0x0D]] = True
    # The root: the first byte of the text that is not blank must open the root or a string.
    root = np.full(n_texts, -1, np.int64)
    lead = starts[:-1].copy()
    live = lead < starts[1:]
    while True:
        move = live & blank[buf[np.minimum(lead, max(len(buf) - 1, 0))]] if len(buf) else np.zeros(n_texts, bool)
        if not move.any():
            break
        lead[move] += 1
        live &= lead < starts[1:]
    root[live] = lead[live]
    lo = _skip_blank(buf, lo, hi, blank)
    empty = lo >= hi
    place_s, colon = place[slot], np.where(kind[slot] == 0x3A, at[slot], -1)
    if empty.any():  # "[]" has an opening and no child
        kept = ~empty
        counts = np.concatenate(([0], np.cumsum(kept)))
        slots_of = counts[slots_of]
        lo, hi, place_s, colon = lo[kept], hi[kept], place_s[kept], colon[kept]
    return Index(buf, starts, valid, root, quotes, at[opens][by_pos], slots_of[:-1][by_pos], slots_of[1:][by_pos], lo, hi, place_s, colon)


def _skip_blank(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, blank: np.ndarray) -> np.ndarray:
    lo = lo.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        live = live[blank[buf[lo[live]]]]
        lo[live] += 1
        live = live[lo[live] < hi[live]]
    return lo


def _keyed(ix: Index, slots: np.ndarray, key: str) -> np.ndarray:
    """Which of the slots of records have this key."""
    q = np.searchsorted(ix.quotes, ix.colon[slots]) - 1  # the key's closing quote
    end, start = ix.quotes[q], ix.quotes[q - 1] + 1
    want = np.frombuffer(key.encode(), np.uint8)
    hit = end - start == len(want)
    some = np.flatnonzero(hit)
    if len(some):
        hit[some] = (ix.buf[start[some][:, None] + np.arange(len(want))] == want).all(1)
    return hit


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def shred(texts: list[bytes] | tuple[np.ndarray, np.ndarray], with_json: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Children of all texts of a batch: number of the text, kind, places (n x 3, -1 where unused), JSON of the child."""
    buf, starts = _pack(texts) if isinstance(texts, list) else texts
    n = len(starts) - 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
    work = [(buf, starts, np.arange(n), np.full((n, 3), -1, np.int32), np.array(["root"] * n, object))]
    while work:
        buf, starts, row, pos, state = work.pop()
        deferred: list[tuple[bytes, int, np.ndarray, str]] = []
        ix = index_batch(buf, starts)
        top = np.flatnonzero(ix.root >= 0)
        # a fenced record is not JSON before the fence is taken off
        fence = top[buf[ix.root[top]] == 0x60]
        for t in fence:
            if m := FENCE.match(bytes(buf[starts[t] : starts[t + 1]]).decode("utf-8", "replace")):
                deferred.append((m[1].encode(), int(row[t]), pos[t], state[t]))
        top = top[ix.valid[top]]
        lo, hi, row_f, pos_f, state_f = ix.root[top], starts[top + 1], row[top], pos[top], state[top]
        while len(lo):
            kind = buf[lo]
            for i in np.flatnonzero(kind == QUOTE):  # stored as JSON text
                held = bytes(buf[lo[i] : hi[i]])
                try:
                    text = json.loads(held)
                except ValueError:
                    continue
                if isinstance(text, str) and text.strip()[:1] in ("{", "[", '"', "`"):
                    deferred.append((text.encode("utf-8", "replace"), int(row_f[i]), pos_f[i], state_f[i]))
            box = np.flatnonzero((kind == 0x7B) | (kind == 0x5B))
            lo, row_f, pos_f, state_f, kind = lo[box], row_f[box], pos_f[box], state_f[box], kind[box]
            hi = hi[box]
            c = np.searchsorted(ix.open_pos, lo)
            nxt: list[tuple] = []
            for name in dict.fromkeys(state_f):
                of = np.flatnonzero(state_f == name)
                if name.startswith("list:"):
                    child = name[5:]
                    lone = of[kind[of] == 0x7B]
                    p = pos_f[lone].copy()
                    p[:, PLACE[child]] = 0
                    nxt.append((lo[lone], hi[lone], row_f[lone], p, child, True))
                    of = of[kind[of] == 0x5B]
                    s, src = _ranges(ix.slot_lo[c[of]], ix.slot_hi[c[of]])
                    p = pos_f[of][src]
                    p[:, PLACE[child]] = ix.place[s]
                    nxt.append((ix.value_lo[s], ix.value_hi[s], row_f[of][src], p, child, True))
                    continue
                if name in KINDS:
                    rec = of[kind[of] == 0x7B]
                    out.append((row_f[rec], np.full(len(rec), KINDS.index(name), np.int8), pos_f[rec], [bytes(buf[a:b]) for a, b in zip(lo[rec], _closing(ix, c[rec], hi[rec]), strict=True)] if with_json else []))
                wrapped = of[kind[of] == 0x5B]  # a list around one record counts as the record
                wrapped = wrapped[ix.slot_hi[c[wrapped]] - ix.slot_lo[c[wrapped]] == 1]
                if name == "root" and len(wrapped):
                    s = ix.slot_lo[c[wrapped]]
                    nxt.append((ix.value_lo[s], ix.value_hi[s], row_f[wrapped], pos_f[wrapped], name, False))
                rec = of[kind[of] == 0x7B]
                s, src = _ranges(ix.slot_lo[c[rec]], ix.slot_hi[c[rec]])
                for key, to in MEMBERS[name].items():
                    hit = np.flatnonzero(_keyed(ix, s, key)) if len(s) else np.zeros(0, np.int64)
                    if len(hit):  # of a key that is given twice the last counts
                        hit = hit[np.append(np.diff(src[hit]) > 0, True)]
                        nxt.append((ix.value_lo[s[hit]], ix.value_hi[s[hit]], row_f[rec][src[hit]], pos_f[rec][src[hit]], to, False))
            nxt = [x for x in nxt if len(x[0])]
            if not nxt:
                break
            lo, hi, row_f = (np.concatenate([x[k] for x in nxt]) for k in (0, 1, 2))
            pos_f = np.concatenate([x[3] for x in nxt])
            state_f = np.concatenate([np.array([x[4]] * len(x[0]), object) for x in nxt])
        if deferred:
            b, s = _pack([d[0] for d in deferred])
            work.append((b, s, np.array([d[1] for d in deferred]), np.array([d[2] for d in deferred]), np.array([d[3] for d in deferred], object)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros((0, 3), np.int32), []
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]), [x for o in out for x in o[3]]


def _closing(ix: Index, containers: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The value's end; blanks before the next separator stay outside."""
    end = hi.copy()
    for i in range(len(end)):
        while end[i] > 0 and ix.buf[end[i] - 1] not in (0x7D, 0x5D):
            end[i] -= 1
    return end


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], (o - o[0]).astype(np.int64)


def _shred_batches(with_json: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kind, pos, raw = shred(_buffer(batch.column(1)), with_json)
            order = np.argsort(row, kind="stable")
            ids = batch.column(0)
            n = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(n)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32))
            fields = [pa.array(kind[order].astype(np.int8)), *(pa.array(pos[order, k].astype(np.int32)) for k in range(3))]
            names = ["kind", "pos1", "pos2", "pos3"]
            if with_json:
                fields.append(pa.array([raw[i].decode("utf-8", "replace") for i in order], pa.string()))
                names.append("child_json")
            children = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), batch.column(2).take(pa.array(some)), children], ["parent_id", "seq", "children"])

    return run


def shred_records(facts: DataFrame, with_json: bool = False, id_col: str = "fact_id", json_col: str = "data_json", seq_col: str = "ingest_seq") -> DataFrame:
    """``parent_id, child_kind, pos1, pos2, pos3[, child_json]``: one row per child of each record.

    Of a record that was delivered more than once the first delivery counts. Nulls, blanks, texts that are cut off
    or are no JSON, and nulls in lists give no row; places count from 0 and a null keeps its place. A lone record
    where a list is due is a list of one; lists and records stored as JSON text, fenced, or wrapped in a list of
    one are opened. Scalars where a record is due give no row. Only the three columns named are read, so further columns never
    clash. An empty table gives an empty result.
    """
    rows = facts.select(F.col(id_col).alias("parent_id"), F.col(json_col).alias("json"), F.col(seq_col).cast("bigint").alias("seq")).filter(F.col("parent_id").isNotNull() & F.col("json").isNotNull())
    member = "kind tinyint, pos1 int, pos2 int, pos3 int" + ", child_json string" * with_json
    packed = rows.mapInArrow(_shred_batches(with_json), f"parent_id string, seq bigint, children array<struct<{member.replace(' tinyint', ':tinyint').replace(' int', ':int').replace(' string', ':string')}>>")
    once = packed.groupBy("parent_id").agg(F.min_by("children", "seq").alias("children"))
    kinds = F.array(*map(F.lit, KINDS))
    flat = once.select("parent_id", F.explode("children").alias("c"))
    cols = [F.element_at(kinds, F.col("c.kind") + 1).alias("child_kind"), "c.pos1", "c.pos2", "c.pos3"]
    return flat.select("parent_id", *cols, *(["c.child_json"] if with_json else []))


def table_cells(chunks: DataFrame) -> DataFrame:
    """``parent_id, child_kind, pos1, pos2, pos3, cell``: one row per cell of ``table_data``.

    Null tables, rows and cells give no row and keep their place; an empty cell is a cell. Repeated chunks count once.
    """
    tables = chunks.filter(F.col("table_data").isNotNull() & F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("parent_id")).agg(F.min("table_data").alias("t"))
    rows = tables.select("parent_id", F.posexplode("t").alias("pos1", "r")).filter("r is not null")
    cells = rows.select("parent_id", "pos1", F.posexplode("r").alias("pos2", "cell")).filter("cell is not null")
    return cells.select("parent_id", F.lit("cell").alias("child_kind"), "pos1", "pos2", F.lit(-1).alias("pos3"), "cell")


def flat_children(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """All children of records and tables in one keyed list."""
    return shred_records(facts).unionByName(table_cells(chunks).drop("cell"))


#: Typed members of the children; bounding boxes come as a list of four numbers or as a record.
CHILD_SCHEMA = "page_number string, label string, bbox string, title string, name string, x string, y double, value_source string"


def _corner(k: int) -> F.Column:
    name = ("x0", "y0", "x1", "y1")[k]
    box = F.col("v.bbox")
    return F.coalesce(F.get_json_object(box, f"$[{k}]"), F.get_json_object(box, f"$.{name}")).try_cast("double").alias(name)


def child_values(facts: DataFrame) -> DataFrame:
    """The children with their typed values, linked to the record by ``parent_id`` and to the parent child by the places."""
    kids = shred_records(facts, with_json=True).withColumn("v", F.from_json("child_json", CHILD_SCHEMA))
    return kids.select("parent_id", "child_kind", "pos1", "pos2", "pos3", F.col("v.page_number").try_cast("int").alias("page_number"), F.coalesce("v.label", "v.name", "v.title").alias("label"), *(_corner(k) for k in range(4)), F.col("v.x").alias("x"), F.col("v.y").alias("y"))
