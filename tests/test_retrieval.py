import pytest
from pyspark.sql import functions as F

from corvina.operators import citations, fusion, lexical
from corvina.plans import search


def chunks(spark, texts):
    return spark.createDataFrame([(f"c{i}", f"d{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, document_id string, chunk_index int, content string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "qid long, query string")


def test_rare_term_wins(spark):
    c = chunks(spark, ["harbour notes", "harbour notes", "harbour plan", "harbour ledger of boats", "quayside lanternfish survey"])
    top = lexical.search(c, ask(spark, "harbour lanternfish"), 1).collect()
    assert [(r.chunk_id, r.terms) for r in top] == [("c4", ["lanternfish"])]


def test_typo(spark):
    top = lexical.search(chunks(spark, ["the mooring schedule of the ferries"]), ask(spark, "schedlue mooring"), 1).first()
    assert top.terms == ["mooring", "schedlue~schedule"]


def test_decompose_finds_both_topics(spark):
    c = chunks(spark, ["tidal gauges", "pilot rosters"])
    q = ask(spark, "Which docs mention tidal gauges and pilot rosters?")
    assert search.variants(q).count() >= 3
    assert {r.chunk_id for r in search.lexical_plan(c, q, 2).collect()} == {"c0", "c1"}


def test_mmr_prefers_the_different_text(spark):
    rows = [(1, "a", "alpha beta gamma", 1.0, 1), (1, "b", "alpha beta gamma", 0.99, 2), (1, "c", "delta epsilon zeta", 0.9, 3)]
    df = spark.createDataFrame(rows, "qid long, chunk_id string, content string, score double, rank int")
    assert [r.chunk_id for r in fusion.mmr(df, 3).orderBy("mmr_rank").collect()] == ["a", "c", "b"]


def test_cited_answer_and_refusal(spark):
    c = chunks(spark, ["Some opening words. The ferry to Lervik sails at dawn. More follows.", "An empty page."])
    got = {r.qid: r for r in search.cited_search(c, ask(spark, "ferry Lervik", "zzzqqq")).collect()}
    assert got[1].answer == "The ferry to Lervik sails at dawn. [1]" and got[1].status == "supported"
    assert got[2].answer.startswith("I cannot answer") and got[2].confidence == "none"


def test_texts_and_vectors_without_direction(spark):
    from corvina.operators import vector

    c = chunks(spark, ["", "of a", "tidal gauges"])
    asked = ask(spark, "gauges", "?").withColumn("mode", F.lit("semantic"))
    assert {r.chunk_id for r in search.route(c, asked, 3).filter("qid = 1").collect()} == {"c2"}
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [1.0]), (6, [2.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, [float("inf"), 0.0])], "qid long, query_vector array<double>")
    got = [(r.qid, r.id, r.rank) for r in vector.top_k(v, q, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 6, 2)]


def test_query_batches_of_any_size(spark, monkeypatch):
    from corvina.operators import vector

    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vector.query_blocks, "__defaults__", (2,))
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "id long, vector array<double>")
    q = v.select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))
    assert {(r.qid, r.id) for r in vector.top_k(v, q, 1).collect()} == {(k, k) for k in range(9)}


def test_rrf_scores(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "qid long, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in fusion.rrf({"a": a, "b": b}, 5).collect()}
    assert got == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61)}


def test_clamped_pages(spark):
    from pyspark.sql import functions as F

    first, last = citations.clamp_pages(F.lit(0), F.lit(-3))
    r = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    assert (r.a, r.b) == (1, 1)


def test_all_query_tokens_match_in_a_large_batch(spark):
    words = ["harbours", "moorings", "lanterns", "ferries", "rosters", "gauges"]
    got = lexical.bm25(chunks(spark, words), ask(spark, *words)).collect()
    assert {(r.qid, r.chunk_id) for r in got} >= {(i + 1, f"c{i}") for i in range(6)}


def vocabulary(rng, n):
    """Random tokens with many near ones: edits, suffixes, and tokens within tokens."""
    words = {"".join(rng.choice("abcde-1") for _ in range(rng.randint(2, 12))) for _ in range(n)}
    for w in list(words):
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w + rng.choice(["s", "ing", "ed", "ies", "abcd"]), w[::-1] + w}
        k = rng.randrange(len(w))
        words.add(w[:k] + rng.choice("ab") + w[k + 1 :] + rng.choice("cd"))
    return sorted(w for w in words if len(w) >= 3 and w[0] != "-") + ["x" * 300, "x" * 299 + "y"]


def test_near_tokens_by_keys_are_those_of_a_nested_loop(spark):
    import random

    from corvina.operators import vector

    from corvina.functions.text import similarity

    words = vocabulary(random.Random(5), 250)
    c = chunks(spark, [" ".join(words)])
    corpus = lexical.index(c)
    terms = spark.createDataFrame([(w,) for w in words[::3]] + [("x" * 301,), ("abc",), ("unknownword",)], "q string")
    near = lexical.near_tokens(corpus, terms)
    got = {(r.q, r.token, round(r.sim, 9)) for r in near.collect()}
    loop = corpus.vocabulary.crossJoin(terms).withColumn("sim", similarity(F.col("q"), F.col("token"))).filter(F.col("sim") >= lexical.FUZZY)
    assert got == {(r.q, r.token, round(r.sim, 9)) for r in loop.collect()} and len(got) > 1000
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    corpus.drop()


def test_best_reads_few_blocks_and_agrees_with_all(spark, monkeypatch):
    import random

    from corvina.operators import vector

    rng = random.Random(9)
    words = vocabulary(rng, 60)
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))) for _ in range(400)] + [None, "", words[70] * 2 + " rarestword"]
    texts[17] += " rarestword rarestword"
    c = chunks(spark, texts)
    monkeypatch.setattr(lexical, "BLOCK", 10)
    corpus = lexical.index(c)
    assert corpus.blocks == 41
    asked = ask(spark, *[" ".join(rng.sample(words, 3)) for _ in range(6)], words[0], "rarestword", "", "nothing-like-it")
    for fuzzy in (True, False):
        for k in (1, 7):
            rows = lambda df: sorted((r.qid, r["rank"], r.chunk_id, r.overlap, round(r.score, 9), tuple(r.terms)) for r in df.collect())
            assert rows(lexical.best(corpus, asked, k, fuzzy)) == rows(lexical.top(lexical.bm25(corpus, asked, fuzzy), k))
    scored = []
    real = lexical._of_blocks
    monkeypatch.setattr(lexical, "_of_blocks", lambda a, near, w, blocks: scored.append(blocks.count()) or real(a, near, w, blocks))
    assert lexical.best(corpus, ask(spark, "rarestword " + words[0]), 1).count() == 1
    assert sum(scored) <= 12
    corpus.drop()


def test_a_search_opens_few_files(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FOLDER", 20)
    monkeypatch.setattr(lexical, "FEW", 2)  # no row is held by the driver
    words = [f"word{k}x{k * k}" for k in range(900)]
    corpus = lexical.index(chunks(spark, [" ".join(words[k : k + 30]) for k in range(0, 900, 10)]))
    near = lexical._near(corpus, lexical.explode_queries(ask(spark, words[3], words[400], words[700])), False)
    read = lexical._within(corpus.postings, corpus.folders[0], near, "token")
    assert lexical.matches(corpus, near).count() == 9 - 2
    opened = [p for p in read._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in p]
    assert opened and read.select("folder").distinct().count() <= 3 < 0.1 * corpus.postings.select("folder").distinct().count()
    corpus.drop()


def test_scratch_is_empty_after_clear(spark, tmp_path, monkeypatch):
    import os

    from corvina import scratch

    scratch.clear(spark)
    monkeypatch.setattr(scratch, "_root", lambda spark: f"file://{tmp_path}")
    c = chunks(spark, ["tidal gauges", "pilot rosters"])
    search.cited_search(c, ask(spark, "gauges")).collect()
    assert os.listdir(tmp_path)
    scratch.clear(spark)
    assert not os.listdir(tmp_path)


def test_top_k_of_blocks_equals_scores_in_order(spark):
    import math
    import random

    from corvina.operators import vector

    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(6)]) for i in range(900)]
    rows += [(900 + i, v) for i, (_, v) in enumerate(rows[:300])] + [(2000, [1e200] * 6), (2001, [0.0] * 6), (2002, [1.0, 2.0]), (2003, [float("nan")] * 6), (2004, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    q = v.filter("id % 50 = 0").selectExpr("id as qid", "vector as query_vector")
    size = lambda x: math.sqrt(sum(a * a for a in x))
    good = {i: x for i, x in rows if i < 2000 and any(x)}
    for digits in (None, 3):
        want = set()
        for i in (i for i in good if i % 50 == 0):
            scored = [(sum(a * b for a, b in zip(good[i], x)) / (size(x) * size(good[i])), j) for j, x in good.items()]
            scored = [(s if digits is None else math.copysign(math.floor(abs(s) * 10**digits + 0.5) / 10**digits, s), j) for s, j in scored]
            want |= {(i, j, r) for r, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:7], 1)}
        found = vector.top_k(v.filter("id <> 2000"), q.filter("qid <> 2000"), 7, digits=digits)
        assert {(r.qid, r.id, r["rank"]) for r in found.collect()} == want
    # No pair is an evaluated row of the plan: blocks are.
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    texts = [f"harbour word{i} mooring{i % 7} ferries" for i in range(300)]
    monkeypatch.setattr(lexical, "SORTED", 20)
    monkeypatch.setattr(lexical, "FOLDER", 20)
    rows = lexical._dealt(lexical.counts(chunks(spark, texts)), "token", "chunk_id", 50, 300, 1200)
    assert rows.rdd.getNumPartitions() == 60 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = lexical.index(chunks(spark, texts))
    assert made.postings.count() == 1200 and len({f.rsplit("/", 1)[0] for f in made.postings.inputFiles()}) > 4


def test_counts_of_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TEXT", 40)
    texts = ["tidal gauges tidal", None, "", "pilot rosters " * 30, "one gauge of tidal pilots"] * 3
    got = {(r.token, r.chunk_id, r.len, r.tf, r.pos) for r in lexical.counts(chunks(spark, texts)).collect()}
    want = set()
    for i, t in enumerate(texts):
        found = [w for w in (t or "").split() if w not in lexical.STOP_WORDS and len(w) > 2]
        want |= {(w, f"c{i}", len(found), found.count(w), found.index(w)) for w in found}
    assert got == want
