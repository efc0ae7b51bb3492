"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Encoding: each distinct piece of the pre-tokenizer starts as its bytes; a recursive query unfolds the
pieces into token-position rows, joins each row and its right neighbour to the merge table and contracts
every piece's leftmost pair of least rank, round after round, until no piece has a pair left. A piece that is itself a token needs no query, as in the library. Pieces
and the white-space separated units they make up are remembered per worker (bounded), so each query sees
only what is new.

A piece longer than ``LONG`` bytes stays token-position rows throughout: a second recursive query, keyed
by position, contracts all occurrences of the least pair in a round where that is the same as one after
the other: where no token that holds the merged one ranks before it, left to right without overlaps. Its time
grows with the piece's length times the number of different merges in it.

Decoding: the ids of every document, as id-position rows, join the vocabulary, and an ordered aggregation
concatenates their bytes. A long document is aggregated in spans of ``SPAN`` ids.

Edge cases: null and empty texts have no ids; texts of any length and white space are whole; repeated
rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, texts_of
from corvina.llm.units import PLAIN, make_room

#: Bytes of a piece above which rows are keyed by position; pieces, and bytes of long pieces, of one query; ids of a
#: span; units and pieces remembered per worker; characters of the texts that one round of queries serves.
LONG, PIECES, LONG_BYTES, SPAN, MAX_UNITS, MAX_PIECES, CHARS = 256, 40_000, 200_000, 1 << 18, 300_000, 1_000_000, 4_000_000

ENCODE = """
with recursive step(piece, ids, round) as (
    select piece, ids, 0 from start
    union all
    select s.piece, list_concat(list_append(ids[: (found & 65535) - 1], (found >> 16)::int), ids[(found & 65535) + 2 :]), round + 1
    from step s join (
        select piece, min(m.merged::bigint << 16 | pos) as found
        from (select piece, unnest(range(1, len(ids))) as pos, unnest(ids[: -2]) as a, unnest(ids[2 :]) as b from step) p
        join merges m on m.a = p.a and m.b = p.b
        group by piece) f on f.piece = s.piece
)
select piece, arg_max(ids, round) as ids from step group by piece
"""
ENCODE_LONG = """
with recursive tokens(piece, pos, tok) using key (piece, pos) as (
    select piece, pos, tok from start
    union
    select piece, unnest([pos, next_pos]), unnest([merged, -1])
    from (
        select *, row_number() over (partition by piece, run order by pos) as place, row_number() over (partition by piece order by pos) as nth
        from (
            select *, count(*) filter (where apart) over (partition by piece order by pos) as run
            from (
                select *, coalesce(lag(next_pos) over (partition by piece order by pos) <> pos, true) as apart
                from (
                    select t.piece, t.pos, t.next_pos, m.merged, m.single, min(m.merged) over (partition by t.piece) as least
                    from (
                        select piece, pos, tok, lead(tok) over w as next_tok, lead(pos) over w as next_pos
                        from recurring.tokens where tok >= 0 window w as (partition by piece order by pos)) t
                    join merges m on m.a = t.tok and m.b = t.next_tok)
                where merged = least)))
    where if(single, nth = 1, place % 2 = 1)
)
select piece, list(tok order by pos) as ids from tokens where tok >= 0 group by piece
"""
DECODE = """
select span, string_agg(v.symbols, '' order by pos) as symbols
from coded join vocabulary v using (tok)
group by span
"""


Table = dict[str, bytes]


class Codec:
    """One worker's encoder and decoder over an in-memory DuckDB."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import duckdb

        self.ranks = dict(ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect()
        self.db.execute("set threads = 1; set memory_limit = '700MB'; set temp_directory = ''; set preserve_insertion_order = false")
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in ranks for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        # Merged tokens that a lower-ranked token holds: their pairs are contracted one at a time.
        early = {x for a, b, r in merges for x in (a, b) if x > r}
        a, b, merged = zip(*merges)
        single = pa.array([r in early for r in merged])
        table = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "merged": pa.array(merged, pa.int32()), "single": single})
        # A byte is shown as the character of its number, so strings of any bytes can be aggregated.
        tokens = pa.table({"tok": pa.array([r for _, r in ranks], pa.int32()), "symbols": pa.array([t.decode("latin-1") for t, _ in ranks])})
        self.db.register("m", table)
        self.db.register("v", tokens)
        self.db.execute("create table merges as select * from m; create table vocabulary as select * from v")
        self.db.unregister("m")
        self.db.unregister("v")
        # Ids by piece and by unit, as bytes: plain bytes keep the collector out of them.
        self.pieces: Table = {}
        self.first: Table = {}
        self.later: Table = {}

    def _query(self, sql: str, start: pa.Table) -> pa.Table:
        self.db.register("start", start)
        got = self.db.sql(sql).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        return got

    def _encode(self, pieces: list[bytes]) -> Iterator[pa.Table]:
        """(piece number, ids) tables of distinct pieces."""
        done: list[tuple[int, list[int]]] = []
        rows: list[int] = []
        long: list[int] = []
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                done.append((k, [whole]))
            else:
                (long if len(p) > LONG else rows).append(k)
        yield pa.table({"piece": pa.array([k for k, _ in done], pa.int32()), "ids": pa.array([x for _, x in done], pa.list_(pa.int32()))})
        for c in range(0, len(rows), PIECES):
            part = rows[c : c + PIECES]
            offsets = np.concatenate([[0], np.cumsum([len(pieces[k]) for k in part])])
            data = np.frombuffer(b"".join([pieces[k] for k in part]), np.uint8)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.byte_ids[data], pa.int32()))
            yield self._query(ENCODE, pa.table({"piece": pa.array(part, pa.int32()), "ids": ids}))
        group: list[int] = []
        for n, k in enumerate(long):
            group.append(k)
            if n + 1 == len(long) or sum(len(pieces[x]) for x in group) >= LONG_BYTES:
                sizes = [len(pieces[x]) for x in group]
                data = np.frombuffer(b"".join([pieces[x] for x in group]), np.uint8)
                piece, pos = np.repeat(group, sizes), np.concatenate([np.arange(x) for x in sizes])
                yield self._query(ENCODE_LONG, pa.table({"piece": pa.array(piece, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(self.byte_ids[data], pa.int32())}))
                group = []

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of id strings (little-endian unsigned 32-bit integers)."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        out: list[list[bytes]] = [[] for _ in ids]
        # Spans never cross documents; a query takes a few spans at a time.
        owner, cuts, at = [], [], 0
        for k, x in enumerate(ids):
            n = len(x) // 4
            for a in range(0, n, SPAN):
                owner.append(k)
                cuts.append((at + a, at + min(a + SPAN, n)))
            at += n
        begin = 0
        while begin < len(cuts):
            end = begin + 1
            while end < len(cuts) and cuts[end][1] - cuts[begin][0] <= 4 * SPAN:
                end += 1
            first, last = cuts[begin][0], cuts[end - 1][1]
            span = np.repeat(np.arange(begin, end, dtype=np.int32), [b - a for a, b in cuts[begin:end]])
            coded = pa.table({"span": pa.array(span), "pos": pa.array(np.arange(last - first, dtype=np.int32)), "tok": pa.array(flat[first:last])})
            self.db.register("coded", coded)
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("coded")
            parts = dict(zip(got["span"].to_pylist(), got["symbols"].to_pylist()))
            for k in range(begin, end):
                out[owner[k]].append(parts[k].encode("latin-1"))
            begin = end
        return [b"".join(x) for x in out]

    def _learn(self, pieces: set[str]) -> None:
        ids = self.pieces
        new = [p for p in pieces if p not in ids]
        if not new:
            return
        for coded in self._encode([p.encode("utf-8", "surrogatepass") for p in new]):
            if not coded.num_rows:
                continue
            lists = coded["ids"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().to_numpy().astype("<u4").tobytes()
            ends = np.cumsum(lists.value_lengths().to_numpy()) * 4
            at = 0
            for k, end in zip(coded["piece"].to_pylist(), ends.tolist()):
                ids[new[k]] = flat[at:end]
                at = end

    def _cut(self, unit: str, lead: str) -> list[str]:
        m = PLAIN.fullmatch(unit)
        if m is None:
            return self.pattern.findall(lead + unit)
        return [lead + m[1], m[2]] if m[2] else [lead + m[1]]

    def _units(self, table: Table, units: set[str], lead: str) -> None:
        regular = [u for u in units if u and not u[0].isspace() and not u[-1].isspace()]
        new = [u for u in regular if u not in table]
        if make_room(table, len(new), MAX_UNITS):
            new = [u for u in regular if u not in table]
        cuts = [self._cut(u, lead) for u in new]
        needed = {p for c in cuts for p in c}
        make_room(self.pieces, len(needed), MAX_PIECES)
        self._learn(needed)
        ids = self.pieces
        for u, c in zip(new, cuts):
            table[u] = ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") if t else [] for t in texts]
        later: set[str] = set()
        for s in split:
            later.update(s[1:])
        self._units(self.first, {s[0] for s in split if s}, "")
        self._units(self.later, later, " ")
        out, get = [], self.later.__getitem__
        for text, s in zip(texts, split):
            if not s:
                out.append(b"")
                continue
            try:
                out.append(self.first[s[0]] + b"".join(map(get, s[1:])))
            except KeyError:  # white space at some unit's edge
                cut = self.pattern.findall(text)
                self._learn(set(cut))
                out.append(b"".join(map(self.pieces.__getitem__, cut)))
        return out


_WORKER: dict[int, Codec] = {}


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(t), int(r)) for t, r in map(bytes.split, f)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of several batches at a time: each query then serves more new pieces."""
    keys: list[pa.Array] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        keys.append(b.column(0))
        more = texts_of(b.column(1))
        texts += more
        size += sum(map(len, more))
        if size >= CHARS:
            yield pa.concat_arrays(keys), texts
            keys, texts, size = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), texts


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and decoded bytes themselves."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((read_ranks(ranks_file), pattern))  # a fixed file
    key = hash((ranks_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Codec(*shared.value)
        codec = _WORKER[key]
        for doc_ids, texts in _gathered(batches):
            coded = codec.encode(texts)
            raws = codec.decode(coded)
            cols = [
                doc_ids,
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raws], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([np.frombuffer(x, "<u4").tolist() for x in coded], pa.list_(pa.int64())), pa.array(raws, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)
