"""Token counts by finite-state tokenizer compilation.

The tokenizer (lower-casing byte-level BPE with word-end marks) is compiled, lazily, into a
deterministic transducer over the symbols of a word. After any prefix of a word exactly one token can
be last in its encoding: the longest listed suffix that is compatible with the token before it (two
tokens are compatible if the merges of their joined symbols give just these two). A state is what the
future can depend on: for each start inside the prefix from which a listed token may still grow, its
place in the token trie, the token that ends there and the count there relative to the count now. A
transition is annotated with the number of tokens it emits, negative where a longer token replaces
shorter ones; a word's count is the sum along its path.

The end mark of a word leads back to the start state, so a text is one stream of symbols, cut into chunks:
a word is a chunk, and a word of more than ``CHUNK`` symbols is several. A chunk's map takes the state before
it to the state behind it and the tokens emitted on the way. Maps compose, and composition is associative: a
long word's maps combine pairwise, level by level, as in a parallel prefix scan. The map of an inner chunk is
laid out for the states that the symbols just before it lead to from anywhere near; should another state turn
up in a composition, its entry is added then. Maps of whole words have the one entry start to start; composing
them adds their counts, and a worker remembers them.

Edge cases: null is empty (0 bytes, 0 tokens); texts and words of any length are cut into chunks; special
strings inside a text count as the library counts them (one token each); repeated rows are counted
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, texts_of

LIMIT = 2048
#: Symbols of a chunk inside a word, and symbols before it that its map's states are read from.
CHUNK, BEFORE = 256, (8, 16, 32)
#: Interned states, and words remembered, per worker; beyond these the tables start anew.
MAX_STATES, MAX_WORDS = 300_000, 500_000
#: White space of the tokenizer's patterns (Unicode White_Space).
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that Python's split() takes for white space and the tokenizer doesn't.
NOT_SPACES = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class StateMap:
    """A chunk's symbols, and (state behind, tokens emitted) by the state before."""

    __slots__ = ("symbols", "table")

    def __init__(self, symbols: list[str], table: dict[int, tuple[int, int]]):
        self.symbols, self.table = symbols, table


class Transducer:
    """Lazily determinised token-count transducer of one BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        self.alphabet = set(self.symbols) | {s + suffix for s in self.symbols}
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[str | None] = [None]
        self.parts: dict[str, tuple[str, ...]] = {}
        for token in vocab:
            self._list(token)
        self.compatible: dict[tuple[str, str], bool] = {}
        self._reset()

    def _list(self, token: str) -> None:
        body, end = (token[: -len(self.suffix)], True) if token.endswith(self.suffix) and token != self.suffix else (token, False)
        parts = tuple(body[:-1]) + (body[-1] + self.suffix if end else body[-1],) if body else (token,)
        if not set(parts) <= self.alphabet or (len(parts) > 1 and self._merge(parts) != [token]):
            return  # special strings, and tokens that the merges never make
        node = 0
        for s in parts:
            nxt = self.trie[node].get(s)
            if nxt is None:
                nxt = self.trie[node][s] = len(self.trie)
                self.trie.append({})
                self.token_at.append(None)
            node = nxt
        self.token_at[node], self.parts[token] = token, parts

    def _merge(self, parts: tuple[str, ...]) -> list[str]:
        """Plain BPE: join the leftmost pair of least rank until none is left."""
        out = list(parts)
        while len(out) > 1:
            k = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), 1 << 60))
            if (out[k], out[k + 1]) not in self.rank:
                break
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    def _fits(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        ok = self.compatible.get((a, b))
        if ok is None:
            ok = self.compatible[a, b] = self._merge(self.parts[a] + self.parts[b]) == [a, b]
        return ok

    def _reset(self) -> None:
        start = ((0, None, 0),)
        self.ids, self.states, self.moves = {start: 0}, [start], {}

    def _move(self, state: int, symbol: str) -> tuple[int, int]:
        """Next state and emitted count; computed once per state and symbol. A word's end leads to the start state."""
        grown, last, count = [], None, None
        for node, before, at in self.states[state]:  # longest first
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if count is None and token is not None and self._fits(before, token):
                last, count = token, at + 1
            grown.append((child, before, at))
        if count is None:
            raise ValueError(f"no token covers {symbol!r}")
        ended = symbol.endswith(self.suffix) and symbol != self.suffix
        nxt = ((0, None, 0),) if ended else tuple((n, b, c - count) for n, b, c in grown if self.trie[n]) + ((0, last, 0),)
        k = self.ids.get(nxt)
        if k is None:
            k = self.ids[nxt] = len(self.states)
            self.states.append(nxt)
        self.moves[state, symbol] = got = (k, count)
        return got

    def run(self, state: int, symbols: list[str]) -> tuple[int, int]:
        """State behind the symbols, and tokens emitted."""
        total, moves = 0, self.moves
        for s in symbols:
            state, emitted = moves.get((state, s)) or self._move(state, s)
            total += emitted
        return state, total

    def chunk(self, symbols: list[str], starts: set[int]) -> StateMap:
        return StateMap(symbols, {s: self.run(s, symbols) for s in starts})

    def apply(self, chunk: StateMap, state: int) -> tuple[int, int]:
        got = chunk.table.get(state)
        if got is None:
            got = chunk.table[state] = self.run(state, chunk.symbols)
        return got

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two neighbouring chunks."""
        table = {}
        for state, (middle, n) in a.table.items():
            end, m = self.apply(b, middle)
            table[state] = end, n + m
        return StateMap(a.symbols + b.symbols, table)

    def count(self, word: bytes, size: int = CHUNK) -> int:
        """Tokens of one word, by the maps of its chunks."""
        if len(self.states) > MAX_STATES:
            self._reset()
        symbols = [self.symbols[b] for b in word]
        symbols[-1] += self.suffix
        if len(symbols) <= size:
            return self.run(0, symbols)[1]
        maps = [self.chunk(symbols[:size], {0})]
        for k in range(size, len(symbols), size):
            starts = {self.run(0, symbols[max(0, k - n) : k])[0] for n in BEFORE}
            maps.append(self.chunk(symbols[k : k + size], starts))
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0].table[0][1]


class Counter:
    """Counts of texts by the maps of their words; one per worker."""

    def __init__(self, spec: dict):
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern, self.spaces = regex.compile(pattern), regex.compile(f"[{SPACES}]+")
        self.pieces: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def _plain(self, text: str, size: int) -> int:
        """Tokens of a stretch without special strings."""
        low = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        total = 0
        for piece in self.pattern.findall(low):
            n = self.pieces.get(piece) if size == CHUNK else None
            if n is None:
                n = self.transducer.count(piece.encode("utf-8", "surrogatepass"), size)
                if size == CHUNK and len(piece) < 200:
                    self.pieces[piece] = n
            total += n
        return total

    def fragment(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a stretch without white space."""
        n = self.known.get(text) if size == CHUNK else None
        if n is None:
            if len(self.known) > MAX_WORDS:
                self.known.clear()
            if len(self.pieces) > MAX_WORDS:
                self.pieces.clear()
            found = len(self.special.findall(text)) if self.special else 0
            n = found + sum(self._plain(x, size) for x in (self.special.split(text) if found else [text]))
            if size == CHUNK and len(text) < 200:
                self.known[text] = n
        return n

    def _words(self, text: str) -> list[str]:
        if any(c in text for c in NOT_SPACES):
            return [w for w in self.spaces.split(text) if w]
        return text.split()

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a text: the composition of its words' maps, which all lead from start to start."""
        known, n = self.known if size == CHUNK else {}, 0
        for w in self._words(text):
            k = known.get(w)
            n += self.fragment(w, size) if k is None else k
        return n


_COUNTERS: dict[str, Counter] = {}


def counter(spec_json: str) -> Counter:
    """The worker's counter of a tokenizer, compiled once."""
    if spec_json not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[spec_json] = Counter(json.loads(spec_json))
    return _COUNTERS[spec_json]


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; the tokenizer's file is read on the driver and broadcast (a fixed file)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(spec.value)
        for b in batches:
            texts = texts_of(b.column(1))
            n = [counts.count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
