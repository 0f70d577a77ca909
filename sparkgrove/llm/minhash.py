"""Near-duplicates: improved consistent weighted sampling (ICWS) over TF-IDF shingles, banded, verified exactly.

A shingle is five consecutive words `[^\\x20\\x09-\\x0D]+`; a text of one to four words is one shingle. Its weight in a
document is tf * idf with idf = 1 + ln(N / df) / ln N, between 1 and 2, so the copies of a large group, whose
shingles are frequent, still outweigh the few words in which they differ. Document frequencies are counted over all
documents in a hashed feature space of fixed size, which bounds what is broadcast; colliding shingles share a count.

Steps: equal shingle sets meet in one class by an aggregate; ICWS samples of the others form bands; all pairs of every
bucket are verified by exact weighted Jaccard similarity on whole texts, each pair in the first band that it shares: as
rows in small buckets, in salted blocks in large ones; connected components of the links are the classes.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity s becomes a candidate with probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8.
BANDS, ROWS = 12, 3
#: Candidates with fewer equal samples than this share are not verified; at similarity 0.8 one in 10**5 has so few.
LEAST_AGREEMENT = 0.5
#: Log2 of the features that document frequencies are counted in.
FEATURES = 20
#: Buckets of up to so many documents give their pairs as rows; larger ones are compared in blocks of about so many.
SMALL, BLOCK = 12, 1024
_STEP = 1 << 19
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)
_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, modulo 2**64."""
    out = []
    for base in (_M, _INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingles(data: bytes, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 48-bit hash of every shingle of the documents that lie one after another in data."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = 1 << max(20, int(n).bit_length())
    power, inverse = _powers(size)
    doc_end = np.cumsum(sizes)
    word = ~_WHITE[raw]
    cut_ = np.zeros(n + 1, bool)
    cut_[doc_end] = True  # documents are not separated in data
    cut_[0] = True
    start = np.flatnonzero(word & (cut_[:-1] | ~np.concatenate([[False], word[:-1]])))
    end = np.flatnonzero(word & (cut_[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * power[:n], dtype=np.uint64)])
        w = mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
        doc = np.searchsorted(doc_end, start, "right")
        total = np.bincount(doc, minlength=len(sizes))
        first = np.concatenate([[0], np.cumsum(total)[:-1]])
        h = np.zeros(len(w), np.uint64)
        at = np.arange(len(w)) - first[doc]
        short = total[doc] < width
        for k in range(width):
            part = np.concatenate([w[k:], np.zeros(min(k, len(w)), np.uint64)]) * _U((2 * k + 3) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF | 1)
            h += np.where(short & (at + k >= total[doc]), _U(k), part)
        use = (at + width <= total[doc]) | (short & (at == 0))
        return doc[use], mix64(h[use]) >> _U(16)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, and how often each occurs. At most 65,536 documents."""
    both, tf = np.unique(doc.astype(np.uint64) << _U(48) | h, return_counts=True)
    return (both >> _U(48)).astype(np.int64), both & _U((1 << 48) - 1), tf


def _steps(column: pa.Array):
    """Row ranges of up to 65,536 rows and about _STEP bytes, their bytes and sizes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, i = column.buffers()[2] or pa.py_buffer(b""), 0
    while i < len(column):
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STEP, "right")) - 1), i + 65_536)
        yield i, j, data[int(offsets[i]) : int(offsets[j])].to_pybytes(), np.diff(offsets[i : j + 1])
        i = j


def document_frequencies(df: DataFrame, text: str = "text", bits: int = FEATURES) -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each of 2**bits features (4 MB at 20 bits), and the number of documents.

    Tasks sum into blocks of features; blocks are summed by stream, so memory is bounded by the number of features.
    """
    blocks = 64

    def count(batches):
        df_, rows = np.zeros(1 << bits, np.uint32), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, sizes in _steps(batch.column(0)):
                doc, h, _ = counted(*shingles(data, sizes))
                np.add.at(df_, (h & _U((1 << bits) - 1)).astype(np.int64), 1)
        if rows:
            yield pa.RecordBatch.from_pydict({"block": list(range(blocks)), "n": [rows] + [0] * (blocks - 1), "part": [zlib.compress(x.tobytes(), 1) for x in np.split(df_, blocks)]})

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for b, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(zlib.decompress(part), np.uint32)
                have = total.setdefault(b, [0, np.zeros(len(new), np.uint64)])
                have[0] += n
                have[1] += new
        if total:
            yield pa.RecordBatch.from_pydict({"block": list(total), "n": [x[0] for x in total.values()], "part": [zlib.compress(x[1].astype(np.uint32).tobytes(), 1) for x in total.values()]})

    shape = "block long, n long, part binary"
    parts = df.select(text).mapInArrow(count, shape).repartition(16, "block").mapInArrow(add, shape).collect()  # `blocks` rows
    out = np.zeros(1 << bits, np.uint32)
    for r in parts:
        out.reshape(blocks, -1)[r["block"]] += np.frombuffer(zlib.decompress(bytes(r["part"])), np.uint32)
    return out, sum(r["n"] for r in parts)


def idf(frequency: np.ndarray, n: int) -> np.ndarray:
    """1 + ln(n / df) / ln n for each feature, in [1, 2]."""
    n = max(n, 2)
    return (1 + np.log(n / np.clip(frequency, 1, n)) / np.log(n)).astype(np.float32)


@functools.lru_cache(1)
def _gamma() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at 8,192 mid-points, by bisection."""
    q = (np.arange(8192) + 0.5) / 8192
    low, high = np.zeros(8192), np.full(8192, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return ((low + high) / 2).astype(np.float32)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """ICWS: k samples (32-bit hashes of the sampled shingle and its level) of each document; 0 where it has no shingle."""
    out = np.zeros((docs, k), np.uint32)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    log_w, gamma, rows = np.log(weight).astype(np.float32), _gamma(), np.arange(len(h), dtype=np.int64)
    with np.errstate(over="ignore"):
        for i in range(k):
            bits = mix64(h * _U(0xD6E8FEB86659FD93) + _U((i + 1) * _M & 0xFFFFFFFFFFFFFFFF))
            r = gamma[(bits & _U(8191)).astype(np.int64)]
            beta = ((bits >> _U(13)) & _U(2047)).astype(np.float32) * np.float32(1 / 2048)
            u = (((bits >> _U(24)) & _U(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-20)
            v = ((bits >> _U(44)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-20)
            t = np.floor(log_w / r + beta)
            log_a = np.log(-np.log(u) - np.log(v)) - r * (t - beta) - r
            key = log_a.view(np.int32).astype(np.int64)
            key = np.where(key < 0, key ^ 0x7FFFFFFF, key)  # orders like the numbers
            least = np.minimum.reduceat(key << 32 | rows, first) & 0xFFFFFFFF
            out[doc[first], i] = (mix64(h[least] * _U(31) + t[least].astype(np.int64).astype(np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted shingles, weights): sum of minima over sum of maxima; two empty ones: 0."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit = y[at] == x
    low = float(np.minimum(wx[hit], wy[at[hit]]).sum())
    return low / (float(wx.sum()) + float(wy.sum()) - low)


def _weights(held, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
    return held.value[(h & _U(len(held.value) - 1)).astype(np.int64)] * tf


def signatures(df: DataFrame, held, key: str, text: str) -> DataFrame:
    """id, d1, d2 (digest of the weighted shingle set; null without words) and sig (packed samples) of every row."""

    def run(batches):
        for batch in batches:
            for i, j, data, sizes in _steps(batch.column(1)):
                doc, h, tf = counted(*shingles(data, sizes))
                sig = samples(doc, h, _weights(held, h, tf), j - i)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                both = np.stack([h, tf.astype(np.uint64)], axis=1)
                digests = [hashlib.blake2b(both[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                d = [np.frombuffer(x, np.int64).tolist() if x else (None, None) for x in digests]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "d1", "d2", "sig"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, T.StructType([T.StructField("id", df.schema[key].dataType), *T._parse_datatype_string("d1 long, d2 long, sig binary").fields]))


def _bands(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of each row of samples (documents x bands x rows)."""
    with np.errstate(over="ignore"):
        band = np.zeros(sig.shape[:2], np.uint64)
        for r in range(sig.shape[2]):
            band = mix64(band * _U(_M) + sig[:, :, r].astype(np.uint64) + _U(1))
        return mix64(band + np.arange(sig.shape[1], dtype=np.uint64) * _U(0xA24BAED4963EE407))


def bucketed(reps: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, key and band of every bucket of two members or more, and its number of members."""

    def explode(batches):
        for batch in batches:
            key = _bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, bands, rows))
            at = np.repeat(np.arange(len(key)), bands)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(key.view(np.int64).ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(key)))], names=["id", "key", "band"])

    shape = T.StructType([T.StructField("id", reps.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("band", T.IntegerType())])
    keyed = cut(reps.select("id", "sig").mapInArrow(explode, shape))
    return cut(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))


def candidates(buckets: DataFrame, small: int = SMALL) -> DataFrame:
    """a < b, band: all pairs of every bucket of up to `small` members, so linear in the number of ids."""
    few = buckets.where(F.col("n") <= small).groupBy("key", "band").agg(F.sort_array(F.collect_list("id")).alias("m"))
    pairs = few.select("band", "m", F.posexplode("m").alias("i", "a"))
    return pairs.select("a", F.explode(F.slice("m", F.col("i") + 2, small)).alias("b"), "band").where("a < b")


def agreeing(pairs: DataFrame, reps: DataFrame, least: float = LEAST_AGREEMENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The pairs whose samples agree in at least a share `least` of places, in the first band that they share."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, bands, rows) for k in (3, 4))
            same = x == y
            keep = (same.mean(axis=(1, 2)) >= least) & (same.all(axis=2).argmax(axis=1) == batch.column(2).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(keep))

    sig = reps.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "band", "sa", "sb")
    return both.mapInArrow(run, T.StructType(pairs.schema.fields[:2]))


def common(doc: np.ndarray, h: np.ndarray, tf: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, docs: int) -> np.ndarray:
    """Weight that each document of `left` has in common with each of `right`: sums of minima over their shingles.

    A shingle that occurs tf times is tf elements. Elements of many documents are multiplied as matrices, some columns at
    a time; those of few are added pair by pair.
    """
    row, col = np.full(docs, -1), np.full(docs, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    at = np.repeat(np.arange(len(h)), tf)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)
    doc, one = doc[at], (weight / tf)[at].astype(np.float64)
    order = np.lexsort((nth, h[at]))
    hh, nn = h[at][order], nth[order]
    number = np.cumsum(np.concatenate([[False], (hh[1:] != hh[:-1]) | (nn[1:] != nn[:-1])]))
    doc, one = doc[order], one[order]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(number)]]))
    out = np.zeros((len(left), len(right)))
    for e in np.flatnonzero((size > 1) & (size <= 16)).tolist():
        d = doc[first[e] : first[e] + size[e]]
        x, y = row[d], col[d]
        out[np.ix_(x[x >= 0], y[y >= 0])] += one[first[e]]
    many = np.flatnonzero(size > 16)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        place = np.repeat(np.arange(len(part)), size[part])
        use = np.concatenate([np.arange(first[e], first[e] + size[e]) for e in part])
        x, y = np.zeros((len(left), len(part))), np.zeros((len(right), len(part)))
        r, c = row[doc[use]], col[doc[use]]
        x[r[r >= 0], place[r >= 0]] = one[use][r >= 0]
        y[c[c >= 0], place[c >= 0]] = 1
        out += x @ y.T
    return out


def block_links(buckets: DataFrame, reps: DataFrame, df: DataFrame, held, key: str, text: str, least: float = SIMILARITY, small: int = SMALL, block: int = BLOCK, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, root, n from all pairs of the buckets of more than `small` members, each verified once, in its first shared band.

    A bucket's members are dealt into blocks of about `block`, and every two blocks (and each with itself) meet in one
    group, so a group's memory is bounded; the work grows with the square of a bucket. A group gives a row for each id that it links: the
    least id that its links lead to, and the number of links. Pairs themselves never become rows.
    """

    def compare(table: pa.Table) -> pa.Table:
        ids, side, sig = (table.column(c).to_pylist() for c in ("id", "side", "sig"))
        raw = [x.encode() for x in table.column("t").to_pylist()]
        band, within = table.column("band")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        docs, h, tf, weight = [], [], [], []
        for i in range(0, len(raw), 256):
            d, x, n = counted(*shingles(b"".join(raw[i : i + 256]), np.array([len(r) for r in raw[i : i + 256]])))
            docs, h, tf, weight = [*docs, d + i], [*h, x], [*tf, n], [*weight, _weights(held, x, n)]
        docs, h, tf, weight = (np.concatenate(x) for x in (docs, h, tf, weight))
        total = np.bincount(docs, weight, len(raw))
        side = np.array(side)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
        low = common(docs, h, tf, weight, left, right, len(raw))
        link = low >= least * (total[left][:, None] + total[right][None, :] - low)
        bucket = _bands(np.frombuffer(b"".join(sig), np.uint32).reshape(-1, bands, rows))
        for t in range(band):
            link &= bucket[left, t][:, None] != bucket[right, t][None, :]
        names = sorted(set(ids))
        number = {x: i for i, x in enumerate(names)}
        of = np.array([number[x] for x in ids], np.int64)  # rows that repeat an id count as one
        x, y = np.nonzero(link)
        near = np.zeros((len(names), len(names)), bool)
        near[of[left[x]], of[right[y]]] = True
        near |= near.T
        np.fill_diagonal(near, False)
        n, root = near.sum(axis=1), np.full(len(names), -1)
        for i in np.flatnonzero(n).tolist():
            front = np.array([i]) if root[i] < 0 else np.zeros(0, np.int64)
            while len(front):
                root[front] = i
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
        found = np.flatnonzero(n)
        at = pa.array(names, table.schema.field("id").type)
        return pa.table([at.take(pa.array(found)), at.take(pa.array(root[found])), pa.array(n[found].astype(np.int64))], names=["id", "root", "n"])

    members = buckets.where(F.col("n") > small).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    whole = reps.select("id", "sig").join(members.select("id").distinct(), "id", "left_semi").join(_texts(df, members.select("id"), key, text), "id")
    mine = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    dealt = members.join(whole, "id").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "sig", "t", "key", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    shape = T.StructType([T.StructField(c, df.schema[key].dataType) for c in ("id", "root")] + [T.StructField("n", T.LongType())])
    return dealt.groupBy("key", "i", "j").applyInArrow(compare, shape)


def _texts(df: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """id and text (t) of the rows of df whose id is in the column of `ids`, and of some more.

    A filter of fixed size on hashed ids keeps most texts of other rows out of the shuffles.
    """
    bits = 1 << 23

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("int")
    ids = ids.select(slot(F.col(ids.columns[0])).alias("slot")).distinct()
    # at most `bits` slots in 256 words of bits: a bitmap of 1 MB at any size of input
    words_ = ids.groupBy((F.col("slot") / 4096).cast("int").alias("w")).agg(F.bitmap_construct_agg((F.col("slot") % 4096).cast("long")).alias("m")).collect()
    marks = np.zeros(bits // 8, np.uint8)
    for r in words_:
        marks[r["w"] * 512 : r["w"] * 512 + 512] = np.frombuffer(bytes(r["m"]), np.uint8)[:512]
    seen = df.sparkSession.sparkContext.broadcast(np.unpackbits(marks, bitorder="little").astype(bool))

    def kept(batches):
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(seen.value[batch.column(2).to_numpy()]))

    texts = df.select(F.col(key).alias("id"), F.col(text).alias("t"), slot(F.col(key)).alias("slot"))
    return texts.where("id is not null and t is not null").mapInArrow(kept, T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("t", T.StringType())]))


def verified(pairs: DataFrame, df: DataFrame, held, key: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the pairs whose exact weighted Jaccard similarity is at least `least`, from whole texts."""
    texts = _texts(df, pairs.select("a").union(pairs.select("b")), key, text)

    def compare(batches):
        for batch in batches:
            out, i = [], 0
            size = [x or 0 for x in batch.column(3).to_pylist()]
            while i < batch.num_rows:
                j, total = i, 0
                while j < batch.num_rows and j - i < 20_000 and (j == i or total < _STEP):
                    total += size[j]
                    j += 1
                sets = []
                for column in (2, 4):
                    part = batch.column(column).slice(i, j - i).to_pylist()
                    raw = [x.encode() for x in part]
                    doc, h, tf = counted(*shingles(b"".join(raw), np.array([len(x) for x in raw])))
                    at, w = np.searchsorted(doc, np.arange(j - i + 1)), _weights(held, h, tf)
                    sets.append([(h[s:e], w[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)])
                out += [similarity(x, y) for x, y in zip(*sets, strict=True)]
                i = j
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])
            yield made.filter(pa.array(np.array(out) >= least))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", F.length("ta").alias("n"), "tb")
    return both.mapInArrow(compare, T.StructType([*pairs.schema.fields, T.StructField("similarity", T.DoubleType())]))


def components(edges: DataFrame) -> DataFrame:
    """id, root of every id in edges (a, b): root is the least id of its connected component.

    Alternating large-star and small-star steps, each an aggregate and a join, until the edges no longer change.
    """
    edges = cut(edges.select("a", "b"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # every id with its smaller neighbours
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("m").alias("b"), F.explode(F.array("a", "b")).alias("a")).where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
        after = cut(small)
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        drop_cut(edges)
        edges = after
        if now == before:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        before = now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """key, class_id, n_links, is_first of every row of df.

    class_id: the least key of the row's class, a connected component of pairs with weighted Jaccard of at least `least` (equal
    shingle sets included). n_links: verified links of the row's distinct text to other distinct texts. is_first: the row that stays when
    one row of each class does. Texts without words (null, empty, white space) are near nothing: a class of their own
    each. Rows with a null key get class null and stay. Keys should be unique; rows that repeat a key share its class.
    """
    spark = df.sparkSession
    frequency, n = document_frequencies(df, text)
    held = spark.sparkContext.broadcast(idf(frequency, n))
    sig = cut(signatures(df, held, key, text))
    reps = sig.where("id is not null and d1 is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = cut(reps)
    lead = sig.where("id is not null and d1 is not null").join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "sig").dropDuplicates(["id"])
    lead = cut(lead)
    buckets = bucketed(lead)
    pairs = cut(agreeing(candidates(buckets), lead))
    links = cut(verified(pairs, df, held, key, text, least).dropDuplicates(["a", "b"]))
    blocks = cut(block_links(buckets, lead, df, held, key, text, least))
    roots = components(links.select("a", "b").union(blocks.where("root < id").select("root", "id").distinct()))
    count = links.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).alias("n")).union(blocks.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n_links"))
    classed = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(count.withColumnRenamed("id", "rep"), "rep", "left")
    classed = classed.select("d1", "d2", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sig.select("id", "d1", "d2").join(classed, ["d1", "d2"], "left").select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("is_first", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))
