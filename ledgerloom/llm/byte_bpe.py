"""Byte-level BPE by merge ranks, with a pre-tokeniser that works on arrays.

Texts become code-point arrays and then arrays of symbol classes (one table lookup, one or two neighbours looked at).
A small automaton reads the classes; its transition functions form a finite monoid, so the state before every
character comes from an associative scan over monoid elements: rows of a matrix are composed column by column for all
rows at once, row totals are scanned the same way. A boundary is a property of (state before, class). No regular
expression runs. The slices go through a per-worker cache of merged pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space of the pattern's \s (Unicode property White_Space): fixed values.
SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: What follows an apostrophe in the pattern's contractions: fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# classes of a character: letter, digit, other, apostrophe, blank (U+0020), other white space, end of a text
LETTER, DIGIT, OTHER, QUOTE, BLANK, SPACE, END = range(7)
# symbols the automaton reads; a blank or space is told apart by what follows it, a quote by the letters after it
S_LETTER, S_DIGIT, S_OTHER, S_QUOTE1, S_QUOTE2, S_LEAD, S_LAST, S_INNER, S_END = range(9)
# states after a character: start of a text, in letters, in digits, in others, after a leading blank, in white space,
# one or two letters of a contraction still to come, contraction complete
START, LETTERS, DIGITS, OTHERS, LED, WHITE, OPEN1, OPEN2, CLOSED = range(9)

#: Next state by symbol: the state where it is the same from everywhere, and the exceptions.
RULES = {
    S_LETTER: (LETTERS, {OPEN2: OPEN1, OPEN1: CLOSED}),
    S_DIGIT: (DIGITS, {}),
    S_OTHER: (OTHERS, {}),
    S_QUOTE1: (OPEN1, {LED: OTHERS, OTHERS: OTHERS}),
    S_QUOTE2: (OPEN2, {LED: OTHERS, OTHERS: OTHERS}),
    S_LEAD: (LED, {}),
    S_LAST: (WHITE, {}),
    S_INNER: (WHITE, {}),
    S_END: (START, {}),
}
#: States from which a symbol continues the running piece; from all others it begins one.
CONTINUES = {
    S_LETTER: {LETTERS, LED, OPEN1, OPEN2}, S_DIGIT: {DIGITS, LED}, S_OTHER: {OTHERS, LED}, S_QUOTE1: {OTHERS, LED},
    S_QUOTE2: {OTHERS, LED}, S_LEAD: set(), S_LAST: set(), S_INNER: {WHITE}, S_END: set(),
}


@cache
def class_table() -> np.ndarray:
    """Class of every code point, from the Unicode general categories."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = DIGIT
    table[SPACES] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Element of each symbol; composition table (first, then second); state each element leads to from START; identity."""
    functions = [tuple(RULES[s][1].get(q, RULES[s][0]) for q in range(9)) for s in range(9)]
    elements = list(dict.fromkeys([tuple(range(9)), *functions]))
    for f in elements:  # grows until closed
        for g in functions:
            if (h := tuple(g[q] for q in f)) not in elements:
                elements.append(h)
    index = {f: i for i, f in enumerate(elements)}
    compose = np.array([[index[tuple(g[q] for q in f)] for g in elements] for f in elements], np.uint8)
    return np.array([index[f] for f in functions], np.uint8), compose, np.array([f[START] for f in elements], np.uint8), 0


def scan(elements: np.ndarray, width: int = 128) -> np.ndarray:
    """Inclusive prefix compositions of an array of monoid elements."""
    _, compose, _, identity = monoid()
    n = len(elements)
    if n <= 1:
        return elements.copy()
    rows = -(-n // width)
    padded = np.full(rows * width, identity, np.uint8)
    padded[:n] = elements
    grid = padded.reshape(rows, width).T.copy()  # a column holds consecutive elements: steps run over whole rows
    flat, k = compose.reshape(-1), len(compose)
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.int32) * k + grid[i]]
    if rows > 1:
        before = np.concatenate([[identity], scan(grid[-1].copy(), width)[:-1]]).astype(np.int32) * k
        for i in range(width):
            grid[i] = flat[before + grid[i]]
    return grid.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each position. points: code points of texts, each followed by one separator, whose
    positions are `ends`; a separator counts as a piece of its own."""
    kinds = class_table()[points]
    kinds[ends] = END
    after = np.append(kinds[1:], END)
    white = (kinds == BLANK) | (kinds == SPACE)
    inner = white & ((after == BLANK) | (after == SPACE) | (after == END))
    symbols = np.array([S_LETTER, S_DIGIT, S_OTHER, S_OTHER, S_LEAD, S_LAST, S_END], np.uint8)[kinds]
    symbols[inner] = S_INNER
    quotes = np.flatnonzero(kinds == QUOTE)
    one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]  # a separator is no letter
    for tail in CONTRACTIONS:
        hit = (one == ord(tail[0])) & ((len(tail) == 1) | (two == ord(tail[-1])))
        symbols[quotes[hit]] = S_QUOTE1 if len(tail) == 1 else S_QUOTE2
    element, _, leads, _ = monoid()
    before = np.concatenate([[START], leads[scan(element[symbols])[:-1]]])
    begins = np.array([[q not in CONTINUES[s] for s in range(9)] for q in range(9)])
    out = begins[before, symbols]
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 40:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """merge() with a heap over a linked list: n log n for very long pieces."""
    n = len(parts)
    left, right = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one side has changed since
        parts[i] += parts[j]
        parts[j] = b""
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p]


class ByteCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cache = common.FlatCache(lambda pieces: common.flattened([merge(p.encode(), self.ranks) for p in pieces]))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.text = [b"%d " % i for i in range(len(tokens))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other; the number of ids of each text."""
        joined = "\n".join([*texts, ""])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        if not len(texts):
            return np.zeros(0, np.int64), sizes
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        begins = np.flatnonzero(boundaries(points, ends))
        at = begins.tolist()
        own = ~np.isin(begins, ends, assume_unique=True)
        at.append(len(points))
        pieces = [joined[a:b] for a, b, k in zip(at, at[1:], own.tolist(), strict=False) if k]
        rows = self.cache.rows(pieces)
        per_text = np.diff(np.searchsorted(begins[own], np.concatenate([[0], ends])))
        return self.cache.ids(rows), common.split_sums(self.cache.size[rows], per_text)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids: token offsets give each token's place in the output."""
        flat = common.gather(self.bytes, self.start[ids], self.size[ids]).tobytes()
        ends = np.cumsum(common.split_sums(self.size[ids], counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def id_text(self, ids: list[int]) -> bytes:
        return b"".join([self.text[i] for i in ids])[:-1]


_codecs: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """One for each worker and file."""
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs' columns doc_id and ids array<int>: the general form. Null texts count as empty: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                ids, n = codec(path).encode(common.texts_of(part))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs: each text is encoded, the ids decoded again.

    Null texts count as empty: no ids, digests of the empty string. Null ids and repeated rows give a row each; an
    empty table gives none; columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in common.slices(batch):
                ids, n = own.encode(common.texts_of(part))
                ends, listed = np.cumsum(n).tolist(), ids.tolist()
                shas = [hashlib.sha256(own.id_text(listed[a:b])).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
                back = [hashlib.sha256(x).hexdigest() for x in own.decode(ids, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
