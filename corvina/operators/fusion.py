"""Rank fusion, keyword rerank and diversity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import content_tokens, query_tokens

RRF, PLAN, BOOST, LAMBDA = 60, 80, 0.08, 0.82


def rrf(lists: dict[str, DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Any number of ranked lists (qid, chunk_id, rank from 1) fused by reciprocal rank: union and one aggregation."""
    tagged = [df.select("qid", "chunk_id", "rank", F.lit(name).alias("source")) for name, df in lists.items()]
    fused = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("qid", "chunk_id")
        .agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def plan_fusion(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(qid, source, chunk_id, score, rank): scores of all variants plus reciprocal ranks."""
    fused = ranked.groupBy("qid", "chunk_id").agg(
        F.sum(F.col("score") + 1 / (PLAN + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def keyword_rerank(results: DataFrame, k: int | None = None) -> DataFrame:
    """results(qid, query, chunk_id, content, score): boost by the share of query tokens in the text."""
    q = query_tokens(F.col("query"))
    overlap = F.size(F.array_intersect(q, content_tokens(F.col("content"))))
    boosted = results.withColumn("rerank_overlap", overlap).withColumn(
        "score", F.col("score") + F.when(F.size(q) > 0, overlap / F.size(q) * BOOST).otherwise(0.0)
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    out = boosted.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def mmr(results: DataFrame, k: int) -> DataFrame:
    """results(qid, chunk_id, content, score, rank), at most 50 a query: greedy maximal marginal relevance.

    Greedy selection depends on all earlier picks, so it is one small Python call per query.
    """
    capped = results.filter(F.col("rank") <= 50).select("qid", "chunk_id", "score", "rank", content_tokens(F.col("content")).alias("tokens"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        sets = [set(t) for t in rows["tokens"]]
        left, chosen, out = list(range(len(rows))), [], []

        def jaccard(a: set, b: set) -> float:
            both = len(a & b)
            return both / (len(a) + len(b) - both) if a and b else 0.0

        while left and len(chosen) < k:
            best, score = None, float("-inf")
            for i in left:
                s = LAMBDA * rows["score"][i] - (1 - LAMBDA) * max((jaccard(sets[i], sets[j]) for j in chosen), default=0.0)
                if s > score:
                    best, score = i, s
            left.remove(best)
            chosen.append(best)
            out.append((rows["qid"][0], rows["chunk_id"][best], score, len(chosen)))
        return pd.DataFrame(out, columns=["qid", "chunk_id", "mmr_score", "mmr_rank"])

    return capped.groupBy("qid").applyInPandas(pick, "qid long, chunk_id string, mmr_score double, mmr_rank int")
