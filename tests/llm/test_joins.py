"""Similarity joins against brute force."""

import random
import re

import numpy as np
import pytest


def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    from corvina.llm import ngram_join

    rng = random.Random(n)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t", "one", "One", "one two three", "É é"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 8, 14, 30, 90, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("  ".join(copy + base[: rng.randint(0, 2)]))
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = groups(len(texts), links)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp long")
    got = {r.doc_id: r for r in ngram_join.join(df, n, percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_long_words_and_slices():
    from corvina.llm import ngram_join

    h = ngram_join.Hasher(2)
    text = " ".join(f"v{k % 97}" for k in range(600_000))
    assert len(h.words(text.encode())) == 600_000 and len(h.shingles(text)) == 97
    giant = "x" * (ngram_join.SLICE + 10)
    assert len(h.words(f"a {giant} b".encode())) == 3
    # A word's hash does not depend on where it stands, whatever its length.
    for n in (1, ngram_join.SLICE - 2, ngram_join.SLICE - 1, ngram_join.SLICE, ngram_join.SLICE + 1, 2 * ngram_join.SLICE + 3):
        word = b"Ab" * (n // 2) + b"C" * (n % 2)
        one = h.words(word)
        assert len(one) == 1
        for text in (b"a " + word, word + b" b", b"a b c " + word.lower() + b"\n" + word):
            assert one[0] in h.words(text)
    texts = [None or "", "a", "A a", "x y z x y z", " ", "é É e"] + ["w " * 400_000 + "end"] * 2
    assert [x.tolist() for x in h.sets(texts)] == [h.shingles(t).tolist() for t in texts]


def test_ngram_join_of_hot_keys_and_many_blocks(spark, monkeypatch):
    """A large group of near copies, of which many share keys, gives the links of brute force however it is dealt."""
    from corvina.llm import ngram_join

    rng = random.Random(11)
    words = [f"w{k}" for k in range(90)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(220):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(40)] + texts[:5]
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = groups(len(texts), links)
    assert len(set(want)) > 60  # the copies are no single group
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for hot, run, cell in ((64, 1 << 20, 10_000), (3, 2_000, 7)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "RUN", run)
        monkeypatch.setattr(ngram_join, "CELL", cell)
        got = {r.doc_id: r.component_id for r in ngram_join.join(df, 4, 85, block=16 if hot == 3 else 2048).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_segment_weights_follow_costs():
    from corvina.llm import ngram_join

    band = ngram_join.Band(0, 200, 250, 85)
    whole = int(band.weights.sum())
    meetings = np.zeros(band.m)
    meetings[[3, 7]] = 1e9
    band.allocate(None, meetings, 100.0)
    assert band.weights[3] == band.weights[7] == 0 and int(band.weights.sum()) == whole >= band.need + band.skip


def test_keep_takes_one_row_of_each_group(spark):
    from corvina.llm import ngram_join

    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, 0), (2, a, 0), (3, b, 0), (3, c, 1), (5, c.upper(), 2), (None, a, 3), (None, "alone in the world with no id", 4), (None, None, 5), (7, None, 6), (8, "", 7), (9, b, 8), (3, b, 9), (10, "x", 1), (11, "X ", 2)]
    df = spark.createDataFrame(rows, "doc_id int, text string, gone_id int").withColumnRenamed("gone_id", "gone")
    got = sorted(((r.doc_id or -1, r.text or "") for r in ngram_join.keep(df).collect()))
    assert got == sorted([(1, a), (3, b), (3, c), (-1, "alone in the world with no id"), (-1, ""), (7, ""), (8, ""), (10, "x")])
    assert ngram_join.keep(df).columns == ["doc_id", "text", "gone"]
    assert ngram_join.keep(df.limit(0)).count() == 0 and ngram_join.join(df.limit(0)).count() == 0


def test_components(spark):
    from corvina.llm.components import components

    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cap_filters(spark):
    from corvina.llm import cap_filters

    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((base + rng.standard_normal(64) * rng.choice([0.02, 0.3, 0.45])).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[1]]]
    plain = len(rows)
    rows += [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [3.0], [-3.0], [7.0]]
    x = np.array(rows[:plain], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T) >= 0.9
    links = [(i, j) for i in range(plain) for j in range(i) if near[i, j]] + [(len(rows) - 4, len(rows) - 5), (len(rows) - 1, len(rows) - 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n long")
    got = {r.vec_id: r for r in cap_filters.dedup(df, block_bytes=4096).collect()}
    assert [got[i].component_id for i in range(len(rows))] == groups(len(rows), links)
    assert [got[i].n_links for i in range(plain)] == (near.sum(1) - 1).tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(rows)))
    assert cap_filters.dedup(df.limit(0)).count() == 0


def test_cap_filters_ids_and_doubles(spark):
    from corvina.llm import cap_filters

    # Repeated and null ids, values beyond floats, and doubles whose floats would be equal.
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1e300, 1e299, 0.0]), (None, [0.0, 1.0, 1e-12]), (9, [0.0, 1.0, 2e-12]), (None, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id) for r in cap_filters.dedup(df).collect()), key=str)
    want = [(5, 1, 5), (5, 2, 5), (7, 1, 5), (-1, 2, 5), (9, 2, 5), (-1, 0, None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("dim", [2, 3, 8, 16, 64, 256])
def test_cap_recall(dim):
    """Of pairs exactly at the cosine, seen from queries against all rows, hardly any shares no cap."""
    from corvina.llm import cap_filters

    rng = np.random.default_rng(dim)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((800, dim)))
    z = rng.standard_normal((800, dim))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, 0.9 * x + (1 - 0.81) ** 0.5 * z])
    for count in (2_000, 1_000_000):
        found = cap_filters.Codes(dim, count, 0.9, cap_filters.SEED).decode(both)
        missed = sum(not np.intersect1d(a, b).size for a, b in zip(found[:800], found[800:]))
        assert missed <= 8  # 99 %
        assert np.mean([len(f) for f in found]) < 60


def test_cap_filters_recall_on_a_query_set(spark):
    from corvina.llm import cap_filters

    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 128))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0.0, 0.2, 0.3, 0.33)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in cap_filters.dedup(df).collect()}
    queries = [i for i in range(len(x)) if i % 50 == 0]
    assert all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got[i] for i in queries) >= 0.98 * sum(want[i] for i in queries) and sum(got.values()) >= 0.98 * want.sum()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [a + b + c for a in "ba co di fu ge".split() for b in "ma ne ro ti lu".split() for c in ("", "s", "na")]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(50)]
        if i % 4 == 0:
            for _ in range(6):
                text[rng.randrange(50)] = rng.choice(["vilething", "nastyword"])
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(500, rows[1][1], "en", "s", 0), (501, "few words", "en", "s", 0), (502, rows[2][1] + " write to bo.1@mail.example.com", "en", "s", 0), (503, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == {*range(240), 500, 502}
    assert kept[1] == {i for i in range(240) if i % 4} | {500, 502}
    assert kept[2] == kept[1] - {500, 502} == kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[3]


@pytest.mark.parametrize("chunk", [1 << 18, 7, 60])
def test_components_take_rounds_only_for_more_edges_than_a_task_holds(spark, monkeypatch, chunk):
    from corvina.llm import components as module

    rounds = []
    starry = module._starry
    monkeypatch.setattr(module, "_starry", lambda edges: rounds.append(1) or starry(edges))
    rng = np.random.default_rng(5)
    edges = [(k, k + 1) for k in range(40)] + [(200, k) for k in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(300, 380, (50, 2))] + [(7, 7), (None, 3), (5, None)]
    edges += edges[:30]
    least = {x: x for e in edges if None not in e for x in e}
    for _ in range(50):
        for a, b in edges:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame([edges[k] for k in rng.permutation(len(edges))], "x long, y long").repartition(5)
    got = sorted(tuple(r) for r in module.components(frame, "x", "y", chunk).collect())
    assert got == sorted((n, c) for n, c in least.items() if n != c)
    assert bool(rounds) == (chunk < 1000)
