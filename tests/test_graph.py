"""Components, lineage, resolution and themes against plain Python."""

import math
import random

from pyspark.sql import functions as F

from corvina.operators import entities, resolution, themes
from corvina.operators.components import components


def closure(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (2000, 2000)] + [(3000, 3001 + k) for k in range(200)]
    df = spark.createDataFrame([*pairs, (None, 5), (5, None)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == closure(pairs)
    assert components(df.limit(0)).collect() == []


def test_lineage_of_five_thousand_levels(spark):
    chain = spark.range(5001).select(F.col("id").alias("entity_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = entities.lineage(chain, chain.filter("entity_id in (5000, 3)")).collect()
    assert sorted((r.start_id, r.entity_id, r.depth) for r in got) == sorted([(5000, 5000 - d, d) for d in range(1, 5001)] + [(3, 3 - d, d) for d in range(1, 4)])


def test_lineage_on_a_cycle_and_by_two_ways(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "y"), ("z", "nobody"), ("d", "e"), ("d", "f"), ("f", "e"), ("e", None), ("a", "b")]
    df = spark.createDataFrame(rows, "entity_id string, parent_id string")
    got = {(r.start_id, r.entity_id): r.depth for r in entities.lineage(df, df).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("x", "a"): 1, ("x", "b"): 2, ("x", "c"): 3, ("d", "e"): 1, ("d", "f"): 1, ("f", "e"): 1}
    assert entities.lineage(df, df.limit(0)).collect() == []


def test_similar_sets(spark):
    rng = random.Random(8)
    sets = list({frozenset(rng.choices("abcdefghijklmnop", weights=[1 / (k + 1) for k in range(16)], k=rng.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(k, k % 2, sorted(s)) for k, s in enumerate(sets)], "set_id long, type int, tokens array<string>")
    for least in (0.55, 0.8):
        want = {(i, j): len(a & b) / len(a | b) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if i % 2 == j % 2 and len(a & b) >= least * len(a | b) - 1e-9}
        assert {(r.a, r.b): r.similarity for r in resolution.similar_sets(df, least).collect()} == want and want


def test_sets_that_share_only_common_words_do_not_meet(spark, monkeypatch):
    sizes, real = {}, resolution.written

    def seen(df, name, **how):
        out = real(df, name, **how)
        if name == "rare":
            sizes[name] = out
        return out

    monkeypatch.setattr(resolution, "written", seen)
    # Each has three words that all have and one of its own: equal sizes need all four words for 0.75.
    df = spark.createDataFrame([(k, 1, ["customer", "nation", "x", f"w{k}"]) for k in range(40)], "set_id long, type int, tokens array<string>")
    assert resolution.similar_sets(df, 0.75).collect() == []
    assert sizes["rare"].filter("few").count() == 40
    # With directions only sets near one another meet, across the edges of cells too.
    angles = [(k, 0.02 * k) for k in range(40)]
    with_spots = df.join(spark.createDataFrame([(k, [math.cos(t), math.sin(t)]) for k, t in angles] + [(99, [0.0, 0.0])], "set_id long, v array<double>"), "set_id")
    alike = math.cos(0.05)
    got = {(r.a, r.b) for r in resolution.similar_sets(with_spots.withColumn("spot", resolution.spot(F.col("v"), alike)), 0.55).collect()}
    assert {(i, j) for i in range(40) for j in range(i + 1, 40) if j - i <= 2} <= got and len(got) < 40 * 39 / 4


def test_resolution_passes(spark):
    rows = [
        (1, "firm", "Harbour & Sons", "harbour sons of lervik", [1.0, 0.0]), (2, "firm", "harbour and sons!", None, None), (3, "firm", None, "Lervik harbour, sons of", [0.0, 1.0]),
        (4, "firm", None, "harbour sons of lervik ltd", [0.0, 1.0]), (5, "firm", None, "harbour sons ltd dunmere", [0.0, 1.0]), (6, "boat", None, "harbour sons of lervik", [1.0, 0.0]),
        (7, "firm", "", "", []), (8, "firm", "", "", []), (9, "firm", None, "quay ltd dunmere sons", [0.0, 1.0]), (None, "firm", None, "quay", None), (10, "firm", None, "quay ltd dunmere", [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "entity_id long, type string, identity_key string, summary string, vector array<double>")
    got = {r.entity_id: r.canonical_id for r in resolution.resolve(df, 0.8, 0.55, 0.9).collect()}
    # 4 is similar enough without vectors, 9 to 5 by theirs, 10 to 9 is doubtful and its vector is another.
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 5, 10: 10}


def plain_communities(edges, rounds, levels):
    def links(es):
        out = {}
        for a, b, w in es:
            out[a, b] = out.get((a, b), 0) + w
            out[b, a] = out.get((b, a), 0) + w
        return out

    adj = links(edges)
    total = sum(adj.values())
    top = {a: a for a, _ in adj}
    for _ in range(levels):
        k = {}
        for (a, _), w in adj.items():
            k[a] = k.get(a, 0) + w
        label, moves, idle = {a: a for a in k}, 0, 0
        for n in range(rounds):
            size = {}
            for a in k:
                size[label[a]] = size.get(label[a], 0) + k[a]
            new, now = {}, 0
            for v in k:
                beside = {label[v]: 0}
                for (a, b), w in adj.items():
                    if a == v and b != v:
                        beside[label[b]] = beside.get(label[b], 0) + w
                best = min((-(total * w - k[v] * (size[c] - (k[v] if c == label[v] else 0))), c != label[v], c) for c, w in beside.items() if c == label[v] or (c < label[v] if n % 2 == 0 else c > label[v]))
                new[v], now = best[2], now + best[1]
            label, moves, idle = new, moves + now, 0 if now else idle + 1
            if idle == 2:
                break
        if not moves:
            break
        merged = {}
        for (a, b), w in adj.items():
            merged[label[a], label[b]] = merged.get((label[a], label[b]), 0) + w
        adj, top = merged, {v: label[c] for v, c in top.items()}
    return top


def plain_modularity(edges, label):
    both = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    m = sum(w for *_, w in both)
    tot, inside = {}, {}
    for a, b, w in both:
        tot[label[a]] = tot.get(label[a], 0) + w
        inside[label[a]] = inside.get(label[a], 0) + (w if label[a] == label[b] else 0)
    return sum(inside[c] / m - (tot[c] / m) ** 2 for c in tot)


def test_themes(spark):
    rng = random.Random(4)
    edges = [(f"n{g}_{rng.randrange(8)}", f"n{g}_{rng.randrange(8)}", rng.randint(1, 5)) for g in range(4) for _ in range(30)]
    edges += [(f"n{rng.randrange(4)}_{rng.randrange(8)}", f"n{rng.randrange(4)}_{rng.randrange(8)}", 1) for _ in range(12)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long").repartition(3)
    label = themes.communities(df)
    got = {r.node: r.community for r in label.collect()}
    assert got == plain_communities(edges, themes.ROUNDS, themes.LEVELS)
    q = themes.modularity(df, label).first().modularity
    assert abs(q - plain_modularity(edges, got)) < 1e-12 and q > 0.4
    ents = label.select(F.col("node").alias("entity_id"), F.substring("node", 1, 2).alias("type"), F.upper("node").alias("name"))
    rows = themes.summaries(label, ents, df).collect()
    assert sum(r.n_entities for r in rows) == len(got) and all(sum(r.by_type.values()) == r.n_entities and 1 <= len(r.leads) <= 3 for r in rows)
    assert sum(r.weight for r in rows) == sum(w for a, b, w in edges if got[a] == got[b])
    assert themes.communities(df.limit(0)).collect() == []


def test_themes_of_the_test_tables(spark):
    from corvina import catalog
    from corvina.model import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    edges = catalog._supply(t)
    got = {r.node: r.community for r in themes.communities(edges).collect()}
    assert got == plain_communities([tuple(r) for r in edges.collect()], themes.ROUNDS, themes.LEVELS)


def test_a_round_of_communities_joins_links_once(spark, monkeypatch):
    joins, real = [], themes.written

    def seen(df, name, **how):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return real(df, name, **how)

    monkeypatch.setattr(themes, "written", seen)
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "d", 3)], "src string, dst string, weight long")
    links = themes._both_ways(edges)
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    label = degree.select("node", F.col("node").alias("community"))
    new, moved = themes._moved(real(links, "links"), real(degree, "degrees"), real(label, "communities"), 14, True)
    assert {tuple(r) for r in new.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")} and moved == 2
    # The state of nodes takes three joins of rows of nodes, links take two with it, where they took part in four.
    assert joins == [3, 2]
