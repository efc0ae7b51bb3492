"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document's set is its distinct word n-grams, hashed to 64 bits. Sizes fall into bands. In a band, two
sets that may link differ in at most H elements; the hash universe is cut into segments, and segments
get weights that add up to more than H: 0 (not indexed), 1 (a set's part is indexed as it is) or 2 (also
every part with one element deleted). If two sets link, some segment differs by less than its weight:
they share a key. Weights are allocated by cost: a unit of weight costs the index rows it makes and the
chance meetings of its segment, whose number is estimated from all sets of the band (the second
frequency moment of the segment's parts, as squared sums of random signs, which add up over partitions).
Some weight to spare lets a set leave out its few empty parts, which would otherwise be keys of
everything. Sets of the next band that are small enough also visit a band's index.

Nodes are distinct sets (copies collapse to their 63-bit fingerprint before any shuffle). Index rows
cross the shuffle once, as packed and sorted runs of (key, node). A key that many nodes of one run share
is a hot key: its rows are dealt out as buckets of their own, and only the least native of each goes on to
the key's partition. Every bucket compares its members with its leader; pairs that a parity sketch
rules out (bins in which two sketches differ are never more than the elements in which the sets differ)
are not verified, all others are, on the whole sets. Then, round by round, each member of a bucket that
still spans several components proposes its nearest members of other components by sketch, until no
bucket has an untested pair that could join two components. So no link between components is lost, while
a group of near copies costs a few pairs per member, not its square. Large buckets are dealt into blocks of
bounded rows and bytes, and a task sees two blocks.

Edge cases: null, empty and white-space texts have empty sets and link with nothing; with fewer words
than n the whole sequence is the one element; repeated rows are copies; null ids stay alone unless
their text has a copy; texts and words of any length are hashed in slices; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, drop_written, fresh_name, release, shuffled_joins, texts_of, written
from corvina.llm.components import components

#: Words of a shingle; link at 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 85
#: Ratio of a band's largest size to its least.
RATIO = 1.25
#: Bytes hashed at once.
SLICE = 1 << 20
#: Index rows of a packed run and, about, of an index partition; nodes of one run that make a key hot there.
RUN, HOT = 1 << 20, 64
#: Segments of a band up to which weights follow measured costs; wider bands spread theirs evenly. It bounds the
#: weights of all bands together to some five times as many bytes.
MEASURED = 1 << 16
#: Members and sketch bytes of a block of a bucket, partners a member proposes per pair of blocks in the first round,
#: and how many times as many in each later one: what the first rounds leave mostly fails, and has to be tested all the same.
BLOCK, BLOCK_BYTES, PROPOSALS, MORE = 2048, 8 << 20, 2, 4
#: Members, about, of the small buckets that one task call compares.
CELL = 10_000
#: Bits of the node filter: fixed, so its broadcast is 8 MiB whatever the corpus. A fuller filter only lets more sets through.
FILTER_BITS = 26
#: What a chance meeting of two sets costs, in index rows.
MEETING = 20.0
#: Median moments up to which a segment's moment may be chance: it is exponential, so one segment in 500 has more.
NOISE = 9.0

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


class Hasher:
    """Word and shingle hashes of raw UTF-8 texts; a word's hash is a polynomial in its bytes, whatever surrounds it."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self.up, self.down = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)
        byte = np.arange(256)
        self.space = np.isin(byte, [0x20, *range(0x09, 0x0E)])
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.value = mix(lower.astype(np.uint64) + _U(1))

    def _slice(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of every word of at most SLICE bytes."""
        data = np.frombuffer(raw, np.uint8)
        gap = self.space[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: len(data)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)), starts

    def _giant(self, word: bytes) -> np.ndarray:
        """Hash of one word, slice by slice."""
        total, scale = 0, 1
        for k in range(0, len(word), SLICE):
            data = np.frombuffer(word[k : k + SLICE], np.uint8)
            total += scale * int((self.value[data] * self.up[: len(data)]).sum(dtype=np.uint64))
            scale = scale * pow(_BASE, len(data), 1 << 64)
        return mix(np.array([(total + len(word)) & (1 << 64) - 1], np.uint64))

    def words(self, raw: bytes) -> np.ndarray:
        out, at, spaces = [np.zeros(0, np.uint64)], 0, [bytes([c]) for c in (0x20, *range(0x09, 0x0E))]
        while at < len(raw):
            end = min(len(raw), at + SLICE)
            if end < len(raw):
                cut = max(raw.rfind(c, at, end) for c in spaces)
                if cut < at:  # a word that goes on beyond the slice
                    end = min((k for c in spaces if (k := raw.find(c, end)) >= 0), default=len(raw))
                    out.append(self._giant(raw[at:end]))
                    at = end
                    continue
                end = cut + 1
            out.append(self._slice(raw[at:end])[0])
            at = end
        return np.concatenate(out)

    def _shingles(self, w: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * _U(_BASE) + w[k : len(w) - n + 1 + k]
        return mix(h)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        w = self.words(text.encode("utf-8", "surrogatepass"))
        return _distinct(self._shingles(w, min(self.n, len(w)))) if len(w) else w

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of every text; short texts are hashed together."""
        group: list[bytes] = []
        size = 0
        for text in [*texts, None]:
            raw = None if text is None else text.encode("utf-8", "surrogatepass")
            if group and (raw is None or size + len(raw) >= SLICE):
                yield from self._together(group)
                group, size = [], 0
            if raw is not None and len(raw) >= SLICE - 1:
                yield self.shingles(text)
            elif raw is not None:
                group.append(raw)
                size += len(raw) + 1

    def _together(self, group: list[bytes]) -> Iterator[np.ndarray]:
        w, starts = self._slice(b"\n".join(group))
        ends = np.cumsum([len(r) + 1 for r in group])
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        h = self._shingles(w, self.n) if len(w) >= self.n else w[:0]
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= self.n:
                yield _distinct(h[a : b - self.n + 1])
            else:
                yield self._shingles(w[a:b], b - a) if b > a else w[:0]


def fingerprint(h: np.ndarray) -> int:
    """Signed, non-negative 63-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(h + _U(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + _U(len(h))], np.uint64))
    return int(x[0] >> _U(1))


class Band:
    """Segments and their weights for sizes lo..hi."""

    def __init__(self, index: int, lo: int, hi: int, percent: int):
        self.index, self.lo, self.hi = index, lo, hi
        self.need = (100 - percent) * hi // percent + 1  # more than the elements by which a linked pair can differ
        one, slack = self._segments(lo, self.need, 0)
        two, extra = self._segments(lo, (self.need + 1) // 2, 1)
        weak = lambda m, most: m * sum(math.exp(-lo / m) * (lo / m) ** k / math.factorial(k) for k in range(most + 1))
        # A part that is all but empty meets unrelated sets.
        pairs = two + hi + MEETING * weak(two, 1) < one + MEETING * weak(one, 0)
        spare = extra * 2 if pairs else slack
        self.m = two if pairs else one + max(1, one // 16)  # segments to choose from
        self.tag = mix(np.arange(self.m, dtype=np.uint64) + _U(index << 32))
        self.allocate(self.need + spare, None)

    @staticmethod
    def _segments(lo: int, need: int, weak: int) -> tuple[int, int]:
        m = need
        for _ in range(6):
            x = m * sum(math.exp(-lo / m) * (lo / m) ** k for k in range(weak + 1))
            extra = math.ceil(x + 3 * math.sqrt(x)) * (2 if weak else 1)
            m = need + min(extra, need)
        return m, m - need

    def allocate(self, total: int | None, meetings: np.ndarray | None, sets: float = 1.0) -> None:
        """Spread the units of weight over the segments where they cost least.

        meetings: estimated chance meetings of each segment's parts; sets: how many sets make rows in it.
        """
        self.total = total = total or self.total
        meet = np.zeros(self.m) if meetings is None else meetings
        first = sets + MEETING * meet
        second = sets * self.hi / self.m + 3 * MEETING * meet  # rows of the deletions, and their meetings
        second = np.maximum(second, first)  # a segment's second unit never comes before its first
        cost = np.concatenate([first, second])
        chosen = np.argsort(cost, kind="stable")[: min(total, 2 * self.m)]
        self.weights = np.bincount(chosen % self.m, minlength=self.m).astype(np.int8)
        spare = int(self.weights.sum()) - self.need
        # Weight a set may leave out: all that is to spare where equal parts are empty in both, half where they may differ.
        self.skip = spare if self.weights.max() < 2 else spare // 2
        self.double = bool(self.weights.max() == 2)

    def parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment of each element, hash of each element, sum and size of each segment's part)."""
        seg = ((h >> _U(32)) * _U(self.m)) >> _U(32)
        cuts = np.searchsorted(seg, np.arange(self.m + 1, dtype=np.uint64))
        value = mix(h ^ _U(0xD1B54A32D192ED03))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        return seg, value, sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts)

    def keys(self, h: np.ndarray) -> np.ndarray:
        seg, value, parts, sizes = self.parts(h)
        few = (sizes < self.weights) if self.double else (sizes == 0) & (self.weights > 0)
        keep = self.weights > 0
        if self.weights[few].sum() <= self.skip:
            keep &= ~few
        out = [parts[keep] + self.tag[keep]]
        if self.double:
            at = seg.astype(np.int64)
            deleted = (keep & (self.weights == 2))[at]
            out.append(parts[at[deleted]] - value[deleted] + self.tag[at[deleted]])
        return mix(np.concatenate(out))

    def signs(self, h: np.ndarray) -> np.ndarray:
        """Two random signs of each segment's part, as the sums that estimate its meetings add them."""
        _, _, parts, sizes = self.parts(h)
        x = mix(parts + self.tag)
        one = 1 - 2 * (x >> _U(63)).astype(np.int64)
        two = 1 - 2 * (x >> _U(62) & _U(1)).astype(np.int64)
        return np.stack([one, two]) * (sizes > 0)


class Bands:
    def __init__(self, percent: int = PERCENT, costs: dict[int, tuple[float, np.ndarray]] | None = None):
        self.percent, self.costs, self.list, self.ends = percent, costs or {}, [], []
        # The least size at which two different sets can link; below it copies are the only links.
        self.least = -(-percent // (100 - percent))

    def at(self, size: int) -> int:
        """Index of the band of a size."""
        while not self.ends or self.ends[-1] < size:
            lo = self.ends[-1] + 1 if self.ends else self.least
            hi = max(lo, int(lo * RATIO))
            band = Band(len(self.list), lo, hi, self.percent)
            if band.index in self.costs:
                sets, meetings = self.costs[band.index]
                band.allocate(None, meetings.astype(float), sets)
            self.list.append(band)
            self.ends.append(hi)
        return int(np.searchsorted(self.ends, size))

    def keys(self, h: np.ndarray, fp: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, nodes); a node's sign tells natives of the key's band (negative) from visitors."""
        n = len(h)
        if n < self.least:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k = self.at(n)
        own = self.list[k].keys(h)
        keys, nodes = [own], [np.full(len(own), -1 - fp)]
        while k and self.percent * n <= 100 * self.ends[k - 1]:
            k -= 1
            more = self.list[k].keys(h)
            keys.append(more)
            nodes.append(np.full(len(more), fp))
        return np.concatenate(keys), np.concatenate(nodes)


def sketch(h: np.ndarray, percent: int) -> bytes:
    """Parities of the set's elements in 2^k bins, at least 16 bins per element that a linked set may differ in."""
    bound = max(16, (100 - percent) * len(h) // percent)
    bins = 1 << (16 * bound - 1).bit_length()
    odd = np.bincount((h & _U(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(raw: bytes, size: int) -> np.ndarray:
    """A sketch with fewer bins: bins that coincide modulo the new number add up."""
    x = np.frombuffer(raw, np.uint64)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _documents(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row of every document: doc_id, text_hash, n_shingles, fp (null: empty) and sketch (null: too small to link but with copies).

    Rows with a band instead hold a partition's sums of signs of a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands = Hasher(n), Bands(percent)
        sums: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        names = ["doc_id", "text_hash", "n_shingles", "fp", "sketch", "band", "segment", "sets", "one", "two"]
        for b in batches:
            size, fps, sketches = [], [], []
            seen: dict[int, bytes | None] = {}
            for h in hasher.sets(texts_of(b.column(1))):
                size.append(len(h))
                fp = fingerprint(h) if len(h) else None
                fps.append(fp)
                if fp is not None and fp not in seen:
                    seen[fp] = None
                    if len(h) >= bands.least:
                        seen[fp] = sketch(h, percent)
                        band = bands.list[bands.at(len(h))]
                        if band.m <= MEASURED:
                            if band.index not in sums:
                                sums[band.index], count[band.index] = np.zeros((2, band.m), np.int64), 0
                            sums[band.index] += band.signs(h)
                            count[band.index] += 1
                sketches.append(None if fp is None else seen[fp])
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), *none], names)
        for k, x in sums.items():
            m = x.shape[1]
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            some = [pa.array(np.full(m, k, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, count[k])), pa.array(x[0]), pa.array(x[1])]
            yield pa.RecordBatch.from_arrays([*none, *some], names)

    schema = "doc_id long, text_hash long, n_shingles long, fp long, sketch binary, band int, segment int, sets long, one long, two long"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _costs(hashed: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """By band: its sets, and the chance meetings of each segment. Sums over all documents; MEASURED bounds what reaches the driver.

    What all segments of a band have in common, as copies and near copies that meet in each, is no reason to
    choose, nor is what chance gives the squared sums.
    """
    got = hashed.filter("band is not null").groupBy("band", "segment").agg(F.sum("sets").alias("sets"), F.sum("one").alias("one"), F.sum("two").alias("two")).toArrow()
    band, segment, sets, one, two = (got[c].to_numpy() for c in ("band", "segment", "sets", "one", "two"))
    out = {}
    for k in np.unique(band).tolist():
        at = np.flatnonzero(band == k)
        at = at[np.argsort(segment[at])]
        moment = (one[at].astype(float) ** 2 + two[at].astype(float) ** 2) / 2
        out[k] = float(sets[at[0]]), np.maximum(0, (moment - NOISE * np.median(moment)) / 2).astype(np.float32)
    return out


def _pack(keys: np.ndarray, nodes: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Sorted runs (partition, kind, rows) of index rows: kind 0 plain rows, 1 leaders of hot buckets, 2 members of hot buckets."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    heads = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.append(heads, len(keys)))
    out = []
    hot = sizes >= HOT
    if hot.any():
        for a, size in zip(heads[hot].tolist(), sizes[hot].tolist()):
            k, v = keys[a : a + size], nodes[a : a + size]
            lead = int(v.min())
            place = int(mix(np.array([int(k[0]) ^ lead & (1 << 64) - 1], np.uint64))[0]) % parts
            out.append((place, 2, k.tobytes() + v.tobytes()))
            out.append(((int(k[0]) >> 32) * parts >> 32, 1, k[:1].tobytes() + np.array([lead], np.int64).tobytes()))
        plain = np.repeat(~hot, sizes)
        keys, nodes = keys[plain], nodes[plain]
    part = ((keys >> _U(32)) * _U(parts)) >> _U(32)
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            out.append((p, 0, keys[a:b].tobytes() + nodes[a:b].tobytes()))
    return out


def _index(docs: DataFrame, n: int, percent: int, costs, parts: int) -> DataFrame:
    """Packed index rows (part, kind, run) of all sets that can link with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands = Hasher(n), Bands(percent, costs.value)
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            part, kind, rows = zip(*_pack(np.concatenate(keys), np.concatenate(nodes), parts))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(rows, pa.binary())], ["part", "kind", "run"])

        for b in batches:
            for h in hasher.sets(texts_of(b.column(0))):
                if len(h) < bands.least or (fp := fingerprint(h)) in seen:
                    continue
                seen.add(fp)
                k, v = bands.keys(h, fp)
                keys.append(k)
                nodes.append(v)
                size += len(k)
                if size >= RUN:
                    yield flush()
                    keys, nodes, size = [], [], 0
                    seen.clear()
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "part int, kind int, run binary")


def _buckets(index: DataFrame, parts: int) -> DataFrame:
    """(key, node, native, leader, whole) rows of keys of two nodes or more; whole: the leader meets every member in these rows."""

    def rows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        half = len(raw) // 2
        return np.frombuffer(raw[:half], np.uint64), np.frombuffer(raw[half:], np.int64)

    def found(keys: np.ndarray, nodes: np.ndarray, marked: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys, nodes, marked = keys[order], nodes[order], marked[order]
        same = keys[1:] == keys[:-1]
        shared = np.append(same, False) | np.append(False, same) if len(keys) else marked
        keys, nodes, marked = keys[shared], nodes[shared], marked[shared]
        order = np.lexsort((nodes, keys))
        keys, nodes, marked = keys[order], nodes[order], marked[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
        group = np.cumsum(np.append(True, keys[1:] != keys[:-1])[: len(keys)]) - 1
        count = np.bincount(group[fresh])
        hot = np.bincount(group, weights=marked) > 0
        least = nodes[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]  # nodes ascend in a group, natives first
        good = (count >= 2) & (least < 0)
        take = np.flatnonzero(fresh & good[group]) if len(keys) else np.zeros(0, np.int64)
        node = lambda x: np.where(x < 0, -1 - x, x)
        for a in range(0, len(take), 1 << 17):
            t = take[a : a + (1 << 17)]
            cols = [keys[t].view(np.int64), node(nodes[t]), nodes[t] < 0, node(least[group[t]]), ~hot[group[t]] & whole]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "native", "leader", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, marked = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for b in batches:
            for kind, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                k, v = rows(raw)
                if kind == 2:
                    yield from found(k, v, np.ones(len(k), bool), False)
                    continue
                keys.append(k)
                nodes.append(v)
                marked.append(np.full(len(k), kind == 1))
        yield from found(np.concatenate(keys), np.concatenate(nodes), np.concatenate(marked), True)

    return index.repartitionById(parts, F.col("part")).mapInArrow(run, "key long, node long, native boolean, leader long, whole boolean")


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two filter positions of each node."""
    mask = (1 << FILTER_BITS) - 1
    return keys & mask, (keys >> FILTER_BITS) & mask


def _filter(df: DataFrame, col: str) -> np.ndarray:
    """Bloom filter of a column of non-negative longs: words are or-ed by Spark, only the fixed-size bitmap reaches the driver."""
    mask = (1 << FILTER_BITS) - 1
    at = F.explode(F.array(F.col(col).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(F.col(col), FILTER_BITS).bitwiseAND(F.lit(mask)))).alias("at")
    words = df.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("x"))
    got = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["w"].to_numpy()] = got["x"].to_numpy()
    return out


def _wanted(docs: DataFrame, n: int, bits) -> DataFrame:
    """(fp, h) of the sets that a filter of nodes knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for b in batches:
            sets: dict[int, bytes] = {}
            hs = [h for h in hasher.sets(texts_of(b.column(0))) if len(h)]
            fps = np.array([fingerprint(h) for h in hs], np.int64)
            one, two = _bits(fps)
            known = (bits.value[one >> 6] >> (one & 63)) & (bits.value[two >> 6] >> (two & 63)) & 1
            for k in np.flatnonzero(known).tolist():
                if int(fps[k]) not in sets:
                    sets[int(fps[k])] = hs[k].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], ["fp", "h"])

    return docs.select("text").mapInArrow(run, "fp long, h binary")


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both sets, as column_a and column_b."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("fp").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{s}" for c in columns for s in ("a", "b")])


def _sieve(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            ham = np.zeros(b.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                size = min(len(x), len(y)) // 8
                ham[k] = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum(dtype=np.int64))
            yield b.select(["a", "b"]).filter(pa.array(ham * (100 + percent) <= (100 - percent) * total))

    return _beside(pairs, sketches, "size", "sketch").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact intersection and union sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, either = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                both.append(same)
                either.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    return _beside(pairs, sets, "h").mapInArrow(run, "a long, b long, both long, either long")


def _nearest(percent: int, most: int):
    """A cell, which is one pair of blocks of one large bucket or many small buckets, to (a, b) proposals."""

    def bucket(fp, native, comp, size, side, raws, failed) -> Iterator[np.ndarray]:
        words = min(map(len, raws)) // 8
        bits = np.stack([_fold(r, words) for r in raws])
        cut = int((side == side[0]).sum())
        alone = cut == len(fp)
        left, right = np.arange(cut), np.arange(0 if alone else cut, len(fp))
        far = np.iinfo(np.int64).max

        def look(rows: np.ndarray, others: np.ndarray) -> Iterator[np.ndarray]:
            step = max(1, 2_000_000 // max(1, len(others) * words))
            for s in range(0, len(rows) if len(others) else 0, step):
                r = rows[s : s + step]
                ok = (comp[r][:, None] != comp[others][None, :]) & (native[r][:, None] | native[others][None, :])
                ham = np.bitwise_count(bits[r][:, None, :] ^ bits[others][None, :, :]).sum(-1, dtype=np.int64)
                ok &= ham * (100 + percent) <= (100 - percent) * (size[r][:, None] + size[others][None, :])
                if not ok.any():
                    continue
                for k, x in enumerate(r.tolist()):
                    if failed[x] and ok[k].any():
                        ok[k] &= ~np.isin(fp[others], failed[x])
                ham = np.where(ok, ham, far)
                best = np.argsort(ham, axis=1, kind="stable")[:, :most]
                near = np.take_along_axis(ham, best, 1) < far
                yield np.stack([np.repeat(fp[r], near.sum(1)), fp[others][best[near]]], 1)

        yield from look(left, right)
        if not alone:
            yield from look(right, left)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table["block"].to_numpy(), table["key"].to_numpy()))
        keys, *cols = (table[c].to_numpy()[order] for c in ("key", "fp", "native", "c", "size", "block"))
        raws, failed = table["sketch"].to_pylist(), table["failed"].to_pylist()
        raws, failed = [raws[k] for k in order], [failed[k] for k in order]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts, cuts[1:]):
            found += bucket(*[c[a:b] for c in cols], raws[a:b], failed[a:b])
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _propose(members: DataFrame, cells: int, stars: DataFrame, sketches: DataFrame, tested: DataFrame | None, percent: int, block: int, most: int = PROPOSALS) -> DataFrame:
    """Untested pairs (a, b) of different components in one bucket, each among the nearest of one of the two; a pair can come from several buckets."""
    rows = members.join(stars.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("c", F.coalesce("component", "fp")).drop("component")
    # Rows, then the bytes of their sketches, decide how many blocks a bucket has.
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    mixed = rows.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), blocks).filter("c1 <> c2").select("key", "blocks")
    known = sketches
    if tested is None:
        known = known.withColumn("failed", F.lit(None).cast("array<long>"))
    else:
        failed = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("fp")).agg(F.collect_list("b").alias("failed"))
        known = known.join(failed, "fp", "left")
    placed = (
        rows.join(mixed, "key")
        .join(known, "fp")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(cells))).otherwise(F.col("key")))
        .select("key", "fp", "native", "c", "size", "sketch", "failed", "block", "blocks", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    return placed.groupBy("blocks", "cell", "i", "j").applyInArrow(_nearest(percent, most), "a long, b long")


def _links(docs: DataFrame, hashed: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(node, component) of every node but the least of its component."""
    spark = docs.sparkSession
    link = F.col("both") * 100 >= F.col("either") * percent
    costs = spark.sparkContext.broadcast(_costs(hashed))
    shingles = hashed.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.35 * shingles / RUN))
    buckets = written(_buckets(_index(docs, n, percent, costs, parts), parts), "buckets")
    costs.destroy()
    release(spark)  # the index has crossed the shuffle: nothing reads its files again
    classes = hashed.filter("sketch is not null").groupBy("fp").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    sketches = written(classes.join(buckets.select(F.col("node").alias("fp")).distinct(), "fp", "left_semi"), "sketches")
    # A leader has met every member of its bucket unless the bucket is hot; near copies share many keys: of equal buckets one is enough.
    members = buckets.filter("not whole or node <> leader").select("key", F.col("node").alias("fp"), "native")
    held = F.bit_xor(F.xxhash64("fp", "native")).alias("held")
    once = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), held).filter("size > 1").groupBy("held", "size").agg(F.min("key").alias("key"))
    members = members.join(once.select("key"), "key", "left_semi").distinct().join(sketches.select("fp", F.length("sketch").alias("bytes")), "fp")
    members = written(members, "members")
    count, size = members.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // CELL, (size or 0) // BLOCK_BYTES)
    first = buckets.filter("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    likely = written(_sieve(first, sketches, percent), "likely")
    drop_written(buckets)
    # Whoever has no likely pair proposes once, to find all nodes whose sets are needed at any time; the others stand for one component.
    paired = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.lit(-1).cast("long"))
    pairs = written(likely.unionByName(_propose(members, cells, paired, sketches, None, percent, block)).distinct(), "pairs")
    drop_written(likely)
    bits = spark.sparkContext.broadcast(_filter(pairs.select(F.explode(F.array("a", "b")).alias("fp")), "fp"))
    sets = written(_wanted(docs, n, bits).groupBy("fp").agg(F.first("h").alias("h")), "sets")
    bits.destroy()
    tested = [written(_verify(pairs, sets), "tested")]
    drop_written(pairs)
    stars = components(tested[0].filter(link).select("a", "b"))
    most = MORE * PROPOSALS
    while members.head(1):
        failed = functools.reduce(DataFrame.unionByName, tested).filter(~link)
        new = written(_verify(_propose(members, cells, stars, sketches, failed, percent, block, most).distinct(), sets), "tested")
        tested.append(new)
        if not new.head(1):
            break
        linked = new.filter(link).select("a", "b")
        if linked.head(1):
            old, stars = stars, components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked))
            drop_written(old)
        release(spark)
        most = min(block, MORE * most)
    drop_written(*tested, sets, members, sketches)
    release(spark)
    return stars


def _grouped(docs: DataFrame, n: int, percent: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, text_hash, n_shingles, component_id and class (of sets, null for empty ones) of every document, and the written tables behind them.

    docs have doc_id and text. Different classes share a component_id where different groups share an id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with shuffled_joins(spark):
        hashed = written(_documents(docs, n, percent), "documents")
        stars = _links(docs, hashed, n, percent, block)
        rows = hashed.filter("band is null").select("doc_id", "text_hash", "n_shingles", "fp")
        # Components over the least doc_id of each class of copies.
        reps = rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
        named = reps.join(stars, reps["fp"] == stars["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
        heads = named.groupBy("component").agg(F.min("rep").alias("head"))
        classes = written(named.join(heads, "component").select("fp", "head", F.col("component").alias("class")), "classes")
        drop_written(stars)
    # Empty sets stay out of the join: they would all meet in one task.
    full = rows.filter("fp is not null").join(classes, "fp").select("doc_id", "text_hash", "n_shingles", F.coalesce("head", "doc_id").alias("component_id"), "class")
    alone = rows.filter("fp is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class"))
    return full.unionByName(alone), [hashed, classes]


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _grouped(docs, n, percent, block)[0].select("doc_id", "n_shingles", "component_id")


def keep(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, the one with the least id; columns unchanged.

    Of rows that share this id one stays: the one whose text has the least hash, and of equal rows any. Rows
    without an id stay unless their text has a copy with an id.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grouped, behind = _grouped(narrow, n, percent, BLOCK)
    rows = written(grouped, "groups")
    drop_written(*behind)
    heads = rows.filter("doc_id = component_id and class is not null").groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("text_hash").alias("first"))
    again = written(heads.filter("rows > 1").select("class", "doc_id", "first"), "repeated")  # groups whose least id is not one row
    gone = rows.filter("not (doc_id <=> component_id)").select("doc_id", "text_hash")
    gone = gone.unionByName(rows.join(again, ["class", "doc_id"]).select("doc_id", "text_hash"))
    gone = written(gone.distinct(), "gone")
    one, two = fresh_name(docs, "gone_id"), fresh_name(docs, "gone_hash")
    named = gone.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two))
    here = docs["doc_id"].cast("long").eqNullSafe(named[one]) & (F.xxhash64(docs["text"]) == named[two])
    out = docs.join(named, here, "left_anti")
    if again.head(1):
        ids = again.select(F.col("doc_id").alias(one), F.col("first").alias(two)).distinct()
        back = docs.join(ids, (docs["doc_id"].cast("long") == ids[one]) & (F.xxhash64(docs["text"]) == ids[two]), "left_semi")
        out = out.unionByName(back.dropDuplicates(["doc_id", "text"]))
    else:
        drop_written(again)
    drop_written(rows)
    return out
