"""Tokenizer operators against their libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

TEXTS = [None, "", " ", "plain words here", "a  b", "a \n b", "tab\tand\nline ", "it's we'll 'x 's", "x <|endoftext|> y<|endoftext|>", " a  b", "日本 語 12 3",
         "İstanbul ΣΑΣ", "éa  b", "a\x1c \x1cb", "ab" * 400, "🎉🎉 ok", "w " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 0), (None, "no id", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, part long")


def expected(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_bpe_matches_the_library_and_round_trips(docs):
    import tiktoken

    from corvina.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, P.PATTERN, keep_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        assert got[i].ids == ids and bytes(got[i].decoded) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_long_pieces_by_position(monkeypatch):
    """Both recursive queries give the library's ids, on pieces of any length and of any bytes."""
    import random

    import tiktoken

    from corvina.llm import bpe

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, P.PATTERN)
    rng = random.Random(5)
    pieces = [b"a" * 300, b"ab" * 400, b"thentioningable" * 30, "日本語の文章".encode() * 40, b"=" * 1000, bytes(rng.randrange(256) for _ in range(400))]
    pieces += [bytes(rng.choice(b"etaoinshrdlu") for _ in range(n)) for n in (2, 5, 40, 255, 256, 257, 700)]
    lib = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=dict(ranks), special_tokens={})
    want = [lib._encode_single_piece(p) for p in pieces]
    for long in (256, 1, 2000):
        monkeypatch.setattr(bpe, "LONG", long)
        got = {k: x for t in codec._encode(pieces) for k, x in zip(t["piece"].to_pylist(), t["ids"].to_pylist())}
        assert [got[k] for k in range(len(pieces))] == want


def test_decoding_reads_ids(monkeypatch):
    from corvina.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    texts = [t or "" for t in TEXTS]
    coded = codec.encode(texts)
    codec.pieces.clear()
    for span in (1 << 18, 7):
        monkeypatch.setattr(bpe, "SPAN", span)
        assert codec.decode(coded) == [t.encode() for t in texts]
    assert codec.decode(coded[::-1]) == [t.encode() for t in texts[::-1]] and codec.decode([]) == []


def test_counts_match_the_library(docs):
    from corvina.llm import token_counts

    ids = expected("word_bpe_49k.json")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), 2).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(ids(t)), len((t or "").encode())), t
        assert got[i].over_limit == (got[i].n_tokens > 2)


def test_chunk_maps_compose():
    import json
    import random

    from corvina.llm import token_counts
    from corvina.llm.token_counts import Counter

    c = Counter(json.load(open(P.path("word_bpe_49k.json"))))
    rng = random.Random(2)
    texts = [*filter(None, TEXTS), "".join(rng.choice("etaoinshrdlu") for _ in range(5000)), "日本語" * 300]
    ids = expected("word_bpe_49k.json")
    for t in texts:
        assert {c.count(t, n) for n in (1, 2, 3, 7, 100, token_counts.CHUNK, 10_000)} == {len(ids(t))}


def test_chunk_maps_are_associative():
    import json

    from corvina.llm.token_counts import Counter

    t = Counter(json.load(open(P.path("word_bpe_49k.json")))).transducer
    symbols = [t.symbols[b] for b in b"internationalisationalists"]
    a, b, c = (t.chunk(symbols[k : k + 9], {0}) for k in (0, 9, 18))
    left, right = t.compose(t.compose(a, b), c), t.compose(a, t.compose(b, c))
    assert left.table == right.table == {0: t.run(0, symbols)}
    whole = t.chunk(symbols + ["s" + t.suffix], {0})
    assert whole.table[0][0] == 0  # the end of a word leads back to the start


@pytest.mark.parametrize("bounds", [512, 1])
def test_token_files_lie_in_document_order(spark, tmp_path, monkeypatch, bounds):
    import glob

    import pyarrow.parquet as pq

    from corvina.llm import token_binary

    monkeypatch.setattr(token_binary, "PART_BYTES", 300)
    monkeypatch.setattr(token_binary, "MAX_BOUNDS", bounds)
    monkeypatch.setattr(token_binary, "BLOCK", 40)
    rows = [(k * 7 % 101, f"text number {k} " * (k % 5)) for k in range(101)] + [(None, "no id"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_binary.write(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))
    folders = sorted(glob.glob(f"{tmp_path}/t/blocks/part=*"))
    assert len(folders) > 3 and all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)
    ids = [i for f in folders for row in pq.read_table(glob.glob(f"{f}/*.parquet")[0], columns=["doc_ids"])["doc_ids"].to_pylist() for i in row]
    assert ids == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    got = sorted((r.start, r.n_tokens) for r in token_binary.read(spark, f"file://{tmp_path}/t").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and got[0][0] == 0 and len(got) == len(rows)


def test_token_file_round_trip(docs):
    from corvina.llm import token_binary

    ids = expected("byte_bpe_50k.json")
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_binary.round_trip(docs, P.path("byte_bpe_50k.json")).collect()))
    order = [(None, "no id"), *sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda x: x[0])]
    at = 0
    for (start, key, n, crc), (i, t) in zip(got, order, strict=True):
        want = np.array([*ids(t), 2], "<u4")
        assert (start, key, n, crc) == (at, i, len(want), zlib.crc32(want))
        at += n


@pytest.mark.parametrize("n", [1, 2, 17, 256, 257, 5000])
def test_huffman_blocks(n):
    from corvina.llm.token_binary import MAX_BITS, canonical_codes, decode_block, decode_table, encode_block, limited_lengths

    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 60_000)
    lengths = limited_lengths(np.bincount(ids, minlength=1 << 16))
    assert lengths.max() <= MAX_BITS and (2.0 ** -lengths[lengths > 0]).sum() <= 1
    payload, marks = encode_block(ids, canonical_codes(lengths), lengths)
    assert (decode_block(payload, marks, n, decode_table(lengths)) == ids).all()


def test_limited_lengths_are_optimal_under_the_limit():
    from corvina.llm.token_binary import limited_lengths

    assert limited_lengths(np.array([1, 1, 2, 4, 8, 0]), 16).tolist() == [4, 4, 3, 2, 1, 0]
    assert sorted(limited_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist()) == [1, 3, 3, 3, 3]


def test_packing(docs):
    from corvina.llm import packing

    ids = expected("byte_bpe_50k.json")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), length=64, group=5).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        want = np.array([*ids(t), 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)[:: 2 if i == 3 else 1]
        assert sum(r.length for r in pieces) == len(want)
        for r in pieces:
            assert zlib.crc32(want[r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(want)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_tournament_is_first_fit_decreasing():
    from corvina.llm.packing import first_fit_decreasing

    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 101, int(rng.integers(1, 60))).tolist()
        bins: list[int] = []
        want: dict[int, tuple[int, int]] = {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((k for k, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = b, bins[b]
            bins[b] += sizes[i]
        assert first_fit_decreasing(sizes, 100) == [want[i] for i in range(len(sizes))]


def test_empty_tables(spark, docs):
    from corvina.llm import bpe, packing, token_binary, token_counts

    none = docs.limit(0)
    assert bpe.encode_decode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, P.path("word_bpe_49k.json")).count() == 0
    assert token_binary.round_trip(none, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_units_learn_a_word_once_whatever_stands_beside_it():
    import public_tokenizers
    from corvina.llm.units import Units

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        units = Units(f.read())
    texts = ["zorblax, Zorblax.\nQuivern zorblax\nQuivern; größe.\nÉtude!\nzorblax Zorblax\n\nQuivern", "Quivern\nzorblax. x\n y \nz a\r\nb d.\n\n\ne it's\nIt's 12\n13 a\n.b <|endoftext|>\nx <|end\noftext|>", "a b\nc d e\ńf ʼn\nʼn ſ\nK", "\n", "a\n", "\na", " a\nb "]
    want = [e.ids for e in units.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in units.ids(texts)] == want
    calls, model = [], units.model

    class Counting:
        def tokenize(self, word):
            calls.append(word)
            return model.tokenize(word)

    units.model = Counting()
    whole = []
    encode = units.encode
    units.encode = lambda texts: whole.extend(texts) or encode(texts)
    text = "go vexillomat, vexillomat; vexillomat.\nThrumble vexillomat\nThrumble vexillomat!\nThrumble"
    assert np.frombuffer(units.ids([text])[0], "<u2").tolist() == units.tokenizer.encode(text, add_special_tokens=False).ids
    assert calls.count("Ġvexillomat") == 1 and calls.count("Thrumble") == 1 and not whole
