"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by vocabulary offsets.

Pre-tokenisation uses no regular expression. Every code point has a class (letter, number, white space, space,
other); each code point then stands for a transition function of a four-state automaton, packed into one byte (two bits
per state), and functions compose through a 256 x 256 table. Composition is associative, so a blocked prefix scan over
NumPy lanes gives the state before every code point of a whole batch at once; a document's first code point is a constant
function, which resets the automaton without splitting the batch. Boundaries follow from states and neighbouring classes.

The states: 0, a match may start at an apostrophe here; 1, an apostrophe would belong to the match in progress (after a
space or inside a run of other characters); 2 and 3, one and two letters of a contraction are still to come.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh

LETTER, NUMBER, OTHER, WHITE, SPACE = range(5)
#: Code points that one vectorised step handles, unless a single document is longer.
STEP = 1 << 19
#: Distinct slices that a worker's merge cache holds before it is emptied.
CACHE = 200_000
#: Slices of up to so many bytes are merged all at once; longer ones one by one, with a heap.
WIDE = 48
NONE = 1 << 40
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _pack(f: list[int]) -> int:
    return f[0] | f[1] << 2 | f[2] << 4 | f[3] << 6


_PLAIN, _BLOCK, _ONE, _TWO = _pack([0, 0, 0, 2]), _pack([1, 1, 0, 2]), _pack([2, 1, 0, 2]), _pack([3, 1, 0, 2])


def _classes() -> np.ndarray:
    """Class of each code point.

    The classes follow the Unicode version of the tiktoken library, which is asked once for each property.
    """
    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        single = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        classes[np.frombuffer(bytes(single.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    classes[list(_WHITE)] = WHITE
    classes[0x20] = SPACE
    return classes


def _composition(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes, the composition table (first, then second), and the constant form of each function."""
    codes = np.arange(256)
    at = np.stack([codes >> 2 * s & 3 for s in range(4)], axis=1)  # at[f, s]
    compose = sum((at[:, at[:, s]].T << 2 * s for s in range(4))).astype(np.uint8)  # compose[a, b]: b after a
    reset = (at[:, 0] * 0b01010101).astype(np.uint8)
    return classes, np.ascontiguousarray(compose.reshape(-1)), reset


_cached: dict = {}


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "tables" not in _cached:
        _cached["tables"] = _composition(_classes())
    return _cached["tables"]


def scan(f: np.ndarray, compose: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix composition of transition functions: lanes of `width`, then a scan of the lanes' totals."""
    n = len(f)
    if n <= width:
        out, total = f.copy(), None
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) << 8 | int(f[i])]
        return out
    lanes = -(-n // width)
    grid = np.full(lanes * width, _pack([0, 1, 2, 3]), np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)  # step j of all lanes lies together
    for j in range(1, width):
        grid[j] = compose[(grid[j - 1].astype(np.uint16) << 8) | grid[j]]
    before = scan(grid[-1], compose, width)[:-1].astype(np.uint16) << 8
    grid[:, 1:] = compose[before[None, :] | grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def boundaries(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a match of the pattern starts. cp: code points of all documents; first: True at each document's start."""
    classes, compose, reset = tables()
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    c = classes[cp]
    f = np.where((c == OTHER) | (c == SPACE), np.uint8(_BLOCK), np.uint8(_PLAIN))
    marks = np.flatnonzero(cp == 0x27)
    if len(marks):
        padded, ends = np.append(cp, [0, 0]), np.append(first, [True, True])
        one, two = padded[marks + 1], padded[marks + 2]
        in1 = ~ends[marks + 1]
        in2 = in1 & ~ends[marks + 2]
        f[marks[in1 & np.isin(one, [ord(x) for x in "stmd"])]] = _ONE
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        f[marks[in2 & pair]] = _TWO
    f[first] = reset[f[first]]
    after = scan(f, compose) & 3
    before = np.empty_like(after)
    before[0] = 0
    before[1:] = after[:-1]
    before[first] = 0
    ended = np.zeros(n, bool)  # the previous code point ended a contraction
    ended[1:] = before[:-1] == 2
    white = c >= WHITE
    prev_white = np.empty(n, bool)
    prev_white[0], prev_white[1:] = False, white[:-1]
    prev = np.empty_like(c)
    prev[0], prev[1:] = OTHER, c[:-1]
    last = np.zeros(n, bool)  # the next code point is in the same document and is not white space
    last[:-1] = ~white[1:] & ~first[1:]
    start = np.where(white, np.where(prev_white, last, True), np.where(prev_white, prev != SPACE, prev != c))
    start |= ended
    start &= before < 2
    start |= first
    return start


class Vocabulary:
    """Ranks of a byte-level BPE, the merge cache, and the blob and offsets by which ids are decoded."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        top = max(self.ranks.values(), default=-1) + 1
        pieces = [b""] * top
        for k, v in self.ranks.items():
            pieces[v] = k
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if top else np.zeros(0, np.int64)
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.table = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: always the adjacent pair of lowest rank first, leftmost among equals. O(n log n)."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after = list(range(1, n + 1))  # start of the part that follows
        before = list(range(-1, n - 1))
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressing table from a pair of ids to the rank of their joined bytes, over all splits of all ranks."""
        if self.table is None:
            ranks = self.ranks
            found = {}
            for piece, rank in ranks.items():
                for k in range(1, len(piece)):
                    a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                    if a is not None and b is not None:
                        found[a << 32 | b] = rank
            keys = np.full(1 << max(4, (4 * len(found)).bit_length()), -1, np.int64)
            values = np.full(len(keys), NONE, np.int64)
            k, v = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            at = self.slot(k, len(keys))
            while len(k):
                free = keys[at] < 0
                _, won = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
                won = won[free[won]]
                keys[at[won]], values[at[won]] = k[won], v[won]
                rest = np.ones(len(k), bool)
                rest[won] = False
                k, v, at = k[rest], v[rest], (at[rest] + 1) & (len(keys) - 1)
            self.table = keys, values
        return self.table

    @staticmethod
    def slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; NONE where the pair has none."""
        keys, values = self.pairs()
        want = left << 32 | right
        at = self.slot(want, len(keys))
        out = np.full(len(want), NONE, np.int64)
        todo = np.arange(len(want))
        while len(todo):
            key = keys[at]
            hit = key == want
            out[todo[hit]] = values[at[hit]]
            go = ~hit & (key >= 0)
            todo, want, at = todo[go], want[go], (at[go] + 1) & (len(keys) - 1)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of slices of at most WIDE bytes: one merge in every slice at each step, all slices at once."""
        out: list[bytes] = [b""] * len(pieces)
        byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        low = 0
        for width in (8, 12, 16, 24, 32, WIDE):
            high = int(np.searchsorted(size[order], width, "right"))
            for base in range(low, high, 1 << 14):
                rows = order[base : min(high, base + (1 << 14))]
                own = size[rows]
                grid = byte_ids[np.frombuffer(b"".join([pieces[i].ljust(width + 1, b"\0") for i in rows.tolist()]), np.uint8)].reshape(-1, width + 1)
                column = np.arange(width)
                rank = self.rank_of(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(-1, width)
                rank[column[None, :] >= (own - 1)[:, None]] = NONE
                live = np.arange(len(rows))
                while len(live):
                    g, r = grid[live], rank[live]
                    at = r.argmin(axis=1)
                    line = np.arange(len(live))
                    least = r[line, at]
                    go = least < NONE
                    live, g, r, at, least = live[go], g[go], r[go], at[go], least[go]
                    if not len(live):
                        break
                    line = np.arange(len(live))
                    shift = column[None, :] > at[:, None]  # what lies behind the merged pair moves one place up
                    g[:, :-1] = np.where(shift, g[:, 1:], g[:, :-1])
                    r[:, :-1] = np.where(shift[:, :-1], r[:, 1:], r[:, :-1])
                    r[:, -1] = NONE
                    g[line, at] = least
                    own[live] -= 1
                    left, right = at > 0, at < own[live] - 1
                    r[line, at] = NONE
                    r[line[right], at[right]] = self.rank_of(least[right], g[line[right], at[right] + 1])
                    r[line[left], at[left] - 1] = self.rank_of(g[line[left], at[left] - 1], least[left])
                    grid[live], rank[live] = g, r
                done = grid.astype("<u4")
                for i, n, ids in zip(rows.tolist(), own.tolist(), done, strict=True):
                    out[i] = ids[:n].tobytes()
            low = high
        return out

    def packed(self, data: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
        """The ids of each slice of data, little-endian."""
        cache = self.cache
        pieces = [data[s:e] for s, e in zip(starts, ends, strict=True)]
        out = list(map(cache.get, pieces))
        if None in out:
            ranks, short, long = self.ranks, [], {}
            for piece in {p for p, ids in zip(pieces, out, strict=True) if ids is None}:
                if piece in ranks:
                    cache[piece] = ranks[piece].to_bytes(4, "little")
                elif len(piece) <= WIDE:
                    short.append(piece)
                else:
                    long[piece] = np.array(self.merge(piece), "<u4").tobytes()
            cache.update(zip(short, self.merge_many(short), strict=True))
            out = [cache[p] if ids is None and p in cache else long[p] if ids is None else ids for p, ids in zip(pieces, out, strict=True)]
        if len(cache) > CACHE:
            cache.clear()
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and the end of each id's bytes."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b"", ends
        shift = self.starts[ids] - (ends - size)
        return self.blob[np.arange(ends[-1]) + np.repeat(shift, size)].tobytes(), ends


def sound(data: bytes, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The documents with U+FFFD in place of bytes that are not UTF-8; nearly always they come back as they are."""
    try:
        data.decode("utf-8")
        return data, sizes
    except UnicodeDecodeError:
        ends = np.cumsum(sizes).tolist()
        texts = [data[s:e].decode("utf-8", "replace").encode("utf-8") for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        return b"".join(texts), np.array([len(t) for t in texts], np.int64)


def encode_batch(vocabulary: Vocabulary, data: bytes, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids (little-endian, packed) of documents that lie one after another in data, and each document's number of ids."""
    data, sizes = sound(data, sizes)
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.empty(len(cp) + 1, np.int64)  # byte offset of each code point
    at[0] = 0
    np.cumsum(width, out=at[1:])
    first_byte = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(cp), bool)
    first[np.searchsorted(at, first_byte[:-1][sizes > 0])] = True
    starts = at[:-1][boundaries(cp, first)]
    s = starts.tolist()
    pieces = vocabulary.packed(data, s, [*s[1:], len(data)] if s else [])
    counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)])
    per_doc = counts[np.searchsorted(starts, first_byte)]
    return b"".join(pieces), np.diff(per_doc)


def _steps(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Ranges of rows of a string or binary array with about STEP bytes each, their bytes and sizes; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
        yield i, j, data[int(offsets[i]) : int(offsets[j])].to_pybytes(), np.diff(offsets[i : j + 1])
        i = j


def _binary(blob: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).cast(pa.binary())


def _vocabulary(held) -> Vocabulary:
    """The vocabulary of a broadcast, made once in each worker; the classes of code points come with it."""
    raw, packed = held.value
    key = "vocabulary", hashlib.md5(raw).digest()
    if key not in _cached:
        _cached.setdefault("tables", _composition(np.frombuffer(zlib.decompress(packed), np.uint8)))
        _cached[key] = Vocabulary(raw)
    return _cached[key]


def load_ranks(spark: SparkSession, path: str):
    """Broadcast a rank file (`base64 rank` lines; about 1 MB, at most 64 MB). Read on the driver only."""
    with open(path, "rb") as f:
        raw = f.read((64 << 20) + 1)
    if len(raw) > 64 << 20:
        raise ValueError("the rank file is larger than 64 MB")
    return spark.sparkContext.broadcast((raw, zlib.compress(tables()[0].tobytes())))


def _decoded(vocabulary: Vocabulary, blob: bytes, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each document's ids, and the end of each id's bytes in its document."""
    plain, ends = vocabulary.decode(np.frombuffer(blob, "<u4"))
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return _binary(plain, np.diff(at)), ends - np.repeat(at[:-1], counts)


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """df with `ids` (binary: little-endian unsigned 32-bit ids of the whole text) and `n_tokens`, in place of `text`.

    decoded: a further column, for the bytes to which the ids decode, made in the same pass over the text. Null and empty text: empty ids, 0 tokens. Bytes that are not UTF-8 count as U+FFFD, and decode to it. Columns of df that are called like the two outputs are replaced. Rows
    are independent: repeated rows give equal results, an empty table an empty one, and a very long text is handled as one slice
    sequence in O(n log n). No shuffle.
    """
    held = load_ranks(df.sparkSession, ranks_path)
    keep = [c for c in df.columns if c not in (text, ids, n_tokens, decoded)]
    names = [*keep, ids, n_tokens] + ([decoded] if decoded else [])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())] + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    def run(batches):
        vocabulary = _vocabulary(held)
        for batch in batches:
            for i, j, data, sizes in _steps(batch.column(len(keep))):
                blob, counts = encode_batch(vocabulary, data, sizes)
                part = batch.slice(i, j - i)
                new = [_binary(blob, counts * 4), pa.array(counts)]
                if decoded:
                    new.append(_decoded(vocabulary, blob, counts)[0])
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + new, names=names)

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", offsets: str | None = None, keep_ids: bool = True) -> DataFrame:
    """df with `decoded` (binary): the bytes of packed ids, and on demand `offsets` (binary: 64-bit end of each id's bytes).

    Null ids count as none. Ids beyond the vocabulary raise. No shuffle.
    """
    held = load_ranks(df.sparkSession, ranks_path)
    keep = [c for c in df.columns if c not in (decoded, offsets) and (keep_ids or c != ids)]
    extra = [decoded] + ([offsets] if offsets else [])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.BinaryType()) for c in extra])
    (packed,) = fresh(df, "packed")

    def run(batches):
        vocabulary = _vocabulary(held)
        for batch in batches:
            for i, j, data, sizes in _steps(batch.column(len(keep))):
                part = batch.slice(i, j - i)
                plain, ends = _decoded(vocabulary, data, sizes // 4)
                new = [plain] + ([_binary(ends.astype("<i8").tobytes(), sizes * 2)] if offsets else [])
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + new, names=[*keep, *extra])

    return df.select(*keep, df[ids].alias(packed)).mapInArrow(run, schema)
