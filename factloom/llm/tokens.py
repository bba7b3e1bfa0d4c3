"""Token ids of a public byte-level BPE (problem 6).

Per partition: the texts of an Arrow batch are cut into words by array operations over their code points (the
published pre-tokenisation: contractions, an optional space before letters, digits or other signs, runs of white
space). Each word that the partition has not met goes, as rows of (word, position, token), through a recursive DuckDB query
that joins neighbouring tokens with the merge table and contracts each word's minimum-rank pair from the leftmost
occurrence on, until no pair of the word merges; an ordered aggregation gives the word's ids. Texts are then
put together from the ids of their words by offsets.

Long words cost no more a byte than short ones: a word is cut where two bytes meet that no token of the vocabulary has side by side, since no merge can reach
across; what is still long contracts all pairs at once that have the least rank as far as a token can reach.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Words, and their bytes, kept by a worker between batches; beyond either the store starts anew, which costs time and changes nothing.
KEPT_WORDS, KEPT_BYTES = 400_000, 32_000_000
#: Characters handled at once in a worker: some 30 bytes of memory each.
SLICE = 4_000_000
#: Bytes of words that a recursive query contracts at once, without the first piece, which may be longer: some 200 bytes of memory each.
AT_ONCE = 500_000

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Endings of the published pattern that follow an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

CONTRACT = """
WITH RECURSIVE step(word, pos, tok, done) AS (
    SELECT word, pos, tok, false FROM start
  UNION ALL
    SELECT word, pos, CASE WHEN chosen THEN merged ELSE tok END, best IS NULL
    FROM (
        SELECT *, lag(chosen, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
        FROM (
            SELECT *, hit AND (row_number() OVER (PARTITION BY word, hit, ord - nth ORDER BY pos)) % 2 = 1 AS chosen
            FROM (
                SELECT *, coalesce(rank = best, false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS ord,
                       row_number() OVER (PARTITION BY word, coalesce(rank = best, false) ORDER BY pos) AS nth
                FROM (
                    SELECT c.word, c.pos, c.tok, m.rank, m.merged, min(m.rank) OVER (PARTITION BY c.word) AS best
                    FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step WHERE NOT done) c
                    LEFT JOIN merges m ON m.pair = c.tok::BIGINT * 1048576 + c.nxt
                )
            )
        )
    )
    WHERE NOT swallowed
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY word ORDER BY word
"""

#: Pieces of words longer than this (bytes) are contracted at many places at once.
LONG = 64
# A pair may merge before lower ranks elsewhere if none is within reach ({reach} tokens, the bytes of the longest token): whatever merges there
# cannot grow as far as the pair. A run of equal pairs merges only as a whole, so that it is taken from its leftmost pair on.
CONTRACT_LONG = """
WITH RECURSIVE step(word, pos, tok, done) AS (
    SELECT word, pos, tok, false FROM start
  UNION ALL
    SELECT word, pos, CASE WHEN chosen THEN merged ELSE tok END, best IS NULL
    FROM (
        SELECT *, lag(chosen, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
        FROM (
            SELECT *, coalesce(min((rank = near)::INT) OVER run = 1, false) AND (row_number() OVER (run ORDER BY pos)) % 2 = 1 AS chosen
            FROM (
                SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, rank ORDER BY pos) AS run_no,
                       min(rank) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS near, min(rank) OVER (PARTITION BY word) AS best
                FROM (
                    SELECT c.word, c.pos, c.tok, m.rank, m.merged
                    FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM step WHERE NOT done) c
                    LEFT JOIN merges m ON m.pair = c.tok::BIGINT * 1048576 + c.nxt
                )
            )
            WINDOW run AS (PARTITION BY word, rank, run_no)
        )
    )
    WHERE NOT swallowed
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY word ORDER BY word
"""


@lru_cache(maxsize=1)
def _char_classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    classes = np.zeros(0x110000, np.uint8)
    for pattern, to in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        classes[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = to
    return classes


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in ``points`` (code points of all texts) where a word begins; words cover the texts without gaps."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = _char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts[text_starts < n]] = True
    first[n] = True
    run = first.copy()  # a run of one class begins
    run[1:n] |= cls[1:] != cls[:-1]
    starts = run.copy()
    runs = np.flatnonzero(run)
    lo, hi = runs[:-1], runs[1:]
    # The last sign of white space before something else: a space goes with what follows, another sign stands alone.
    inner = (cls[lo] == SPACE) & ~first[hi]
    last = hi[inner] - 1
    plain = points[last] == 0x20
    starts[last] = True
    starts[hi[inner][plain]] = False
    # Contractions: a lone apostrophe that begins a word, then one of the endings.
    at = lo[(points[lo] == 0x27) & (hi - lo == 1) & starts[lo]]
    text_end = text_starts[np.searchsorted(text_starts, at, "right")] if len(at) else at
    free = np.ones(len(at), bool)
    for ending in ENDINGS:
        hit = free & (at + len(ending) < text_end)
        for k, ch in enumerate(ending, 1):
            hit &= points[np.minimum(at + k, n - 1)] == ord(ch)
        starts[at[hit] + 1] = False
        ends = at[hit] + 1 + len(ending)
        starts[ends[ends < n]] = True
        free &= ~hit
    # a space that stands before an apostrophe took it along; then no contraction begins there (see ``starts[lo]`` above)
    return np.flatnonzero(starts[:n])


class Encoder:
    """Word store of one worker and the DuckDB connection with the merge table."""

    def __init__(self, folder: str):
        import duckdb

        with open(os.path.join(folder, VOCABULARY), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in _byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        merges = pa.table({"pair": left * 1048576 + right, "rank": np.arange(len(pairs), dtype=np.int32), "merged": np.array([vocab[a + b] for a, b in pairs], np.int32)})  # noqa: F841
        self.db = duckdb.connect()
        # a piece of millions of bytes goes through the folder, which is made only then
        spill = os.path.join(tempfile.gettempdir(), f"factloom-{uuid.uuid4().hex}")
        self.db.execute(f"SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = '{spill}'; SET preserve_insertion_order = false")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        back = {c: b for b, c in enumerate(_byte_letters())}
        tokens = [bytes(map(back.__getitem__, t)) for t in vocab if all(c in back for c in t)]
        flat = np.frombuffer(b"\0".join(tokens), np.uint8)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum([len(t) + 1 for t in tokens])[:-1] - 1] = False
        both = inside[:-1] & inside[1:]
        #: Whether two bytes are side by side in any token.
        self.meet = np.zeros((256, 256), bool)
        self.meet[flat[:-1][both], flat[1:][both]] = True
        self.by_length = sorted(tokens, key=len, reverse=True)
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _contract(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, off, data = words.buffers()
        o = np.frombuffer(off, np.int64)[words.offset : words.offset + len(words) + 1]
        tok = self.byte_id[np.frombuffer(data, np.uint8)[o[0] : o[-1]]]
        data = np.frombuffer(data, np.uint8)[o[0] : o[-1]]
        o = o - o[0]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.meet[data[:-1], data[1:]]
        cut[o] = True
        piece = np.flatnonzero(cut)
        n = np.diff(piece)
        short, long = np.flatnonzero(n <= LONG), np.flatnonzero(n > LONG)
        held = [self._run(CONTRACT, tok, piece, some) for some in _groups(short, n)]
        if len(long):
            sql = CONTRACT_LONG.format(reach=self._reach(data, piece[long], piece[long + 1]))
            held += [self._run(sql, tok, piece, some) for some in _groups(long, n)]
        got = pa.concat_tables(held)
        got = (got.sort_by("word") if len(short) and len(long) else got).combine_chunks()
        ids = got.column("ids").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        each = np.diff(np.asarray(ids.offsets)).astype(np.int64)
        return np.diff(np.concatenate(([0], np.cumsum(each)))[np.searchsorted(piece, o)]), np.asarray(ids.flatten(), np.int32)

    def _reach(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> int:
        """Bytes of the longest token that is made of these pieces' bytes."""
        there: set[int] = set()
        for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
            there |= set(data[lo:hi].tobytes())
        return next((len(t) for t in self.by_length if there.issuperset(t)), 1)

    def _run(self, sql: str, tok: np.ndarray, bounds: np.ndarray, some: np.ndarray) -> pa.Table:
        """The ids of the pieces ``some`` of ``tok``."""
        n = np.diff(bounds)[some]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = pa.table({"word": np.repeat(some.astype(np.int32), n), "pos": nth.astype(np.int32), "tok": tok[np.repeat(bounds[some], n) + nth]})  # noqa: F841
        return self.db.sql(sql).to_arrow_table()

    def _lookup(self, words: pa.Array) -> np.ndarray:
        """Number in the store of each word; new words are added."""
        at = pc.index_in(words, value_set=self.words) if len(self.words) else pa.nulls(len(words), pa.int32())
        new = pc.filter(words, pc.is_null(at))
        if len(new):
            n, ids = self._contract(new)
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(n)))
            self.ids = np.concatenate((self.ids, ids))
            self.words = pa.concat_arrays([self.words, new])
            at = pc.index_in(words, value_set=self.words)
        return np.asarray(at, np.int64)

    def encode(self, texts: pa.Array, only_sizes: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text, and all ids one after the other."""
        if len(self.words) > KEPT_WORDS or self.words.nbytes + self.ids.nbytes > KEPT_BYTES:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, off, data = texts.buffers()
        o = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[o[0] : o[-1]]
        if not len(raw):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        point_at = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each code point
        text_starts = np.searchsorted(point_at, o - o[0])
        starts = word_starts(points, text_starts)
        offsets = np.append(point_at[starts], len(raw)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        held = words.dictionary_encode()
        number = self._lookup(held.dictionary)[np.asarray(held.indices)]
        n = np.diff(self.offsets)[number]
        word_bounds = np.searchsorted(starts, text_starts)
        total = np.concatenate(([0], np.cumsum(n)))
        sizes = np.diff(total[word_bounds])
        if only_sizes:
            return sizes, None
        take = np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(self.offsets[number], n)
        return sizes, self.ids[take]


def _byte_letters() -> list[str]:
    """The letter by which the vocabulary file writes each byte: printable bytes as they are, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _groups(some: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """``some`` in order, cut so that the sizes ``n`` of a group add up to AT_ONCE at most without its first."""
    return np.split(some, np.flatnonzero(np.diff((np.cumsum(n[some]) - 1) // AT_ONCE)) + 1) if len(some) else []


@lru_cache(maxsize=2)
def encoder(folder: str) -> Encoder:
    return Encoder(folder)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + SLICE, "right")))
        yield lo, hi
        lo = hi


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: ids of the whole text without special tokens, one row per row of the input.

    Null and empty texts give an empty list; the strings of special tokens are ordinary text. Repeated rows stay repeated,
    a null id stays null. Further columns are not read. No rows in, no rows out. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                sizes, ids = enc.encode(batch.column(1).slice(lo, hi - lo))
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: number of ids of each text; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                sizes, _ = enc.encode(batch.column(1).slice(lo, hi - lo), only_sizes=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
