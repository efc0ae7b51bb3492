"""Whitening, exact top-k and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest


def taking_part(rows, shift):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return good, [(np.floor(64 * np.array(v)) + shift).astype(np.int64) for _, v in good]


def vectors(rng, n, dim):
    centres = rng.standard_normal((5, dim))
    rows = [(i, (centres[i % 5] + rng.standard_normal(dim) * 0.6 * np.arange(1, dim + 1) / dim).tolist()) for i in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, [None] + [0.0] * (dim - 1)), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] + [1.0] * (dim - 1))]
    copies = [(n + 5 + k, rows[7][1]) for k in range(40)]
    return rows + bad + copies


@pytest.mark.parametrize("n, dim", [(600, 24), (30, 5)])
def test_whitening(spark, n, dim):
    from corvina.llm import whitening

    rows = vectors(np.random.default_rng(n), n, dim) + [(3, [0.5] * dim), (None, [0.25] * dim)]
    good, x = taking_part(rows, 1_000_000)
    x = np.array(x)
    fit = np.unique(x, axis=0)
    m, s = len(fit), fit.sum(axis=0)
    centred = fit - s / m
    e, u = np.linalg.eigh(centred.T @ centred / m)
    e, u = e[::-1], u[:, ::-1]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x int, component int").repartition(40)
    got = whitening.whiten(df).collect()
    k = min(16, dim)
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    deviation = {}
    for (i, _), row in zip(good, x):
        deviation.setdefault(i, []).append(sum((m * int(a) - int(b)) ** 2 for a, b in zip(row, s)))
    for i, want in deviation.items():
        assert sorted(r.deviation for r in by[i][1]) == sorted(want)
    for c in range(1, k + 1):
        assert abs(by[0][c][0].explained - e[c - 1] / e.sum()) < 1e-9
        mine = np.array([by[i][c][0].whitened for i in range(n) if i != 3])
        want = (x[[i for i in range(n) if i != 3]] - s / m) @ u[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
    assert {r.n for r in got} == {m} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_without_spread(spark):
    from corvina.llm import whitening

    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in flat] == [(1, 1, 2, 128**2), (2, 1, 2, 128**2)]


def test_deviations_beyond_doubles():
    from corvina.llm.whitening import Fit

    n, sums = 3_000_001, [3 * 10**12 + 7, -5]
    f = Fit(n, sums, np.zeros((2, 0)), np.zeros(0))
    x = np.array([[10**6 + 40, 3], [10**6 + 2_000, 0], [10**9, 1]], np.int64)
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert f.deviation(x) == [v if v < 2**63 else None for v in want] and want[-1] >= 2**63


def best(rows, k, every):
    good, x = taking_part(rows, 0)
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        found = [(-int(np.dot(x[a].astype(object), x[b].astype(object))), j is None, j or 0, j) for b, (j, w) in enumerate(good) if a != b and len(w) == len(v)]
        out += [(i, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scale, parts", [(1.0, 3), (1e-3, 1), (1e4, 7)])
def test_top_k(spark, scale, parts):
    from corvina.llm import impact_index

    rows = [(i, None if v is None else [None if c is None else c * scale for c in v]) for i, v in vectors(np.random.default_rng(parts), 700, 16)]
    rows += [(40, rows[5][1]), (None, rows[9][1]), (60, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(parts)
    got = sorted((tuple(r) for r in impact_index.top_k(df, 20, 20).collect()), key=repr)
    assert got == best(rows, 20, 20)


def test_top_k_few_rows_lengths_and_rounds(spark, monkeypatch):
    from corvina.llm import impact_index

    schema = "vec_id long, embedding array<float>"
    assert impact_index.top_k(spark.createDataFrame([], schema)).collect() == []
    rows = [(20, [1.0, 2.0]), (40, [1.0]), (41, [0.5]), (60, [3.0, -1.0]), (80, [0.0, 0.0])]
    assert sorted((tuple(r) for r in impact_index.top_k(spark.createDataFrame(rows, schema)).collect()), key=repr) == best(rows, 20, 20)
    monkeypatch.setattr(impact_index, "QUERIES", 8)
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(120)]
    assert sorted((tuple(r) for r in impact_index.top_k(spark.createDataFrame(rows, schema), 5, 3).collect()), key=repr) == best(rows, 5, 3)


def test_top_k_reads_part_of_the_segments_only_on_proof():
    from corvina.llm import impact_index

    rng = np.random.default_rng(1)
    x = np.rint(rng.standard_normal((4096, 64)) * 8).astype(np.int64)
    x[:30] = np.rint(rng.standard_normal(64) * 8) + np.rint(rng.standard_normal((30, 64)))
    made = impact_index._segments(x)
    block = impact_index._opened({"dim": 64, "block": 0, "ids": list(range(4096)), "vectors": impact_index._narrow(x).tobytes()} | made)
    q = x[:8]
    read, known = [], impact_index._Best(8, 20)
    known.add(np.repeat(np.arange(8), 4096), (q @ x.T).ravel(), np.tile(np.arange(4096), 8), np.zeros(8 * 4096, bool))
    docs = block["docs"]

    class Docs:
        def __getitem__(self, s):
            read.append(s.stop)
            return docs[s]

    impact_index._scan(block | {"docs": Docs()}, q, np.full((8, 2), -1), known)
    assert max(read) < 0.7 * len(docs)
    sizes = np.abs(made["impacts"])
    assert (np.diff(sizes) <= 0).all()


def spelled(docs):
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                words[run] += 1
    words = {w: n for w, n in words.items() if n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    at = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        if at[w]:
            v = min(at[w], key=lambda v: (-words[v], v))
            if words[v] >= 10 * n:
                form[w] = v
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, n, len(at[w]), words[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("halves", [20_000, 12])
def test_spelling_variants(spark, halves):
    from corvina.llm import variants

    rng = random.Random(halves)
    letters = "abé×ÿ"
    docs = [(None, "Aaaaaaa aaaaaaa"), (1, None), (2, ""), (3, "short words"), (4, "İstanbul Kelvinnn " * 4), (5, "ÀÉÎABCD ÀÉÎabcd àÉÎabcd ÀÉÎabcd")]
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(30)]
    for i in range(10, 400):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = base[min(int(rng.expovariate(0.25)), 29)]
            for _ in range(rng.choice([0] * 12 + [1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        docs.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    docs += docs[20:24]
    docs += [(900 + k, "hugeword" * 3 + " " + " ".join(["stretch"] * 500) + " stretchh strech") for k in range(3)]
    docs += [(950, " ".join(["wordchain"] * 400 + ["wordchaim"] * 30 + ["wortchaim"] * 2))]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(5)
    got = {r.word: tuple(r) for r in variants.group_variants(df, halves).collect()}
    want = spelled(docs)
    assert got == want
    assert any(f for _, f, *_ in want.values()) and any(r != w and f != r for w, f, r, *_ in want.values())


def test_spelling_variants_of_no_words(spark):
    from corvina.llm import variants

    assert variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
