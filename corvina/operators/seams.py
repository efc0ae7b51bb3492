"""Model calls on top of retrieval: reranking, written answers, verdicts. Each has guards and a fallback without the model."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import STOP_WORDS, TOKEN
from corvina.operators import fusion
from corvina.scratch import written
from corvina.session import share_code

#: Results, characters of each, evidence items and characters, and characters of an answer that a model sees or gives.
CANDIDATES, CONTEXT, ITEMS, EVIDENCE, ANSWER = 50, 4000, 5, 6000, 4000

#: Takes a question and texts, returns (place, score) of those it ranks.
Reranker = Callable[[str, list[str]], list[tuple[int, float]]]
#: Takes a prompt's parts and returns text.
Writer = Callable[[str, str], str]


def _words(text: str | None) -> list[str]:
    return list(dict.fromkeys(t for t in re.findall(TOKEN, (text or "").lower()) if t not in STOP_WORDS))


def overlap_model(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """The reranker without a network: the share of the query's words in each text."""
    q = _words(query)
    return [(k, len(set(q) & set(_words(t))) / len(q) if q else 0.0) for k, t in enumerate(texts)]


def neural_rerank(results: DataFrame, k: int, model: Reranker = overlap_model) -> DataFrame:
    """results(qid, query, chunk_id, content, score, rank) in the model's order: qid, chunk_id, score, rank, retrieval_score, how.

    A query's first ``CANDIDATES`` results go to the model in one call; places it doesn't know and scores that are no numbers
    are left out. Where the call fails or ranks nothing, the keyword rerank decides (how tells which). Calls run in the tasks, one
    group of at most ``CANDIDATES`` rows a query, and their results are written: nothing is asked twice.
    """
    share_code(results.sparkSession)
    given = results.filter(F.col("rank") <= CANDIDATES).select("qid", "query", "chunk_id", F.substring("content", 1, CONTEXT).alias("content"), "score", "rank")

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        try:
            said = model(rows["query"][0], list(rows["content"]))
            found = {int(p): float(s) for p, s in said if 0 <= int(p) < len(rows) and math.isfinite(float(s))}
            error = None if found else "empty response"
        except Exception as e:  # noqa: BLE001  the model is foreign code
            found, error = {}, f"{type(e).__name__}: {e}"[:160]
        out = rows[["qid", "chunk_id"]].assign(model_score=[found.get(n) for n in range(len(rows))], error=error)
        return out if error else out[out["model_score"].notna()]

    said = written(given.groupBy("qid").applyInPandas(ask, "qid long, chunk_id string, model_score double, error string"), "reranked")
    both = results.select("qid", "query", "chunk_id", "content", "score", "rank").join(said, ["qid", "chunk_id"])
    order = Window.partitionBy("qid").orderBy(F.desc("model_score"), "rank")
    ranked = both.filter("error is null").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    ranked = ranked.select("qid", "chunk_id", F.col("model_score").alias("score"), F.col("place").alias("rank"), F.col("score").alias("retrieval_score"), F.lit("model").alias("how"))
    fallback = fusion.keyword_rerank(both.filter("error is not null").withColumn("retrieval_score", F.col("score")).drop("rank", "model_score", "error"), k)
    return ranked.unionByName(fallback.select("qid", "chunk_id", "score", "rank", "retrieval_score", F.lit("keyword").alias("how")))


def _evidence(citations: list, retrieved: list) -> str:
    cited = [f"[{c['index']}] {c['excerpt']}" for c in list(citations)[:ITEMS]]
    return "\n".join([*cited, *(f"retrieved {k}: {t}" for k, t in enumerate(list(retrieved)[:ITEMS], 1))]).strip()[:EVIDENCE]


def _object(text: str) -> dict | None:
    """The JSON object that a text is, or the widest one in it."""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def written_answers(rows: DataFrame, model: Writer | None = None) -> DataFrame:
    """rows(qid, question, extractive, citations array<struct<index, excerpt>>, retrieved array<string>) to qid, answer, mode, fallback.

    The model's text stands only if it cites, and cites nothing but what is there; else the extractive answer does, and
    fallback says why. Without a model all answers are extractive.
    """
    share_code(rows.sparkSession)

    def one(question: str, extractive: str, citations: list, retrieved: list) -> tuple[str, str, str | None]:
        if model is None:
            return extractive, "extractive", None
        try:
            text = (model(question, _evidence(citations, retrieved)) or "").strip()
        except Exception as e:  # noqa: BLE001  the model is foreign code
            return extractive, "extractive", f"{type(e).__name__}: {e}"[:160]
        if text.startswith("{") and (value := _object(text)):
            text = next((v.strip() for v in map(value.get, ("answer", "response", "text")) if isinstance(v, str)), text)
        marks = {int(m) for m in re.findall(r"\[(\d{1,9})\]", text)}
        if not marks:
            return extractive, "extractive", "empty or uncited response"
        if marks - {int(c["index"]) for c in citations}:
            return extractive, "extractive", "cites what is not there"
        return text[:ANSWER], "model", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(*r) for r in zip(b["question"], b["extractive"], b["citations"], b["retrieved"])]
            yield pd.DataFrame([(q, *m) for q, m in zip(b["qid"], made)], columns=["qid", "answer", "mode", "fallback"])

    return rows.select("qid", "question", "extractive", "citations", "retrieved").mapInPandas(run, "qid long, answer string, mode string, fallback string")


def coverage_judge(question: str, evidence: str) -> str:
    """The judge without a network: by the share of the answer's words that the evidence has."""
    answer, evidence = json.loads(question)["answer"], set(re.findall(TOKEN, evidence.lower()))
    words = _words(answer)
    share = len([w for w in words if w in evidence]) / len(words) if words else 0.0
    status = "supported" if share >= 0.65 else "partial" if share >= 0.35 else "unsupported"
    return json.dumps({"status": status, "score": share})


def verdicts(rows: DataFrame, model: Writer = coverage_judge) -> DataFrame:
    """rows(id, question, answer, evidence) to id, status, score, error: a model's verdict on each answer.

    status is supported, partial or unsupported; score lies from 0 to 1. Anything else that a model says is an error, not a verdict.
    """
    share_code(rows.sparkSession)

    def one(question: str, answer: str, evidence: str) -> tuple[str | None, float | None, str | None]:
        try:
            value = _object(model(json.dumps({"question": question, "answer": answer}), (evidence or "")[:EVIDENCE]) or "")
        except Exception as e:  # noqa: BLE001  the model is foreign code
            return None, None, f"{type(e).__name__}: {e}"[:160]
        if value is None or value.get("status") not in ("supported", "partial", "unsupported"):
            return None, None, "no verdict"
        score = value.get("score")
        good = isinstance(score, (int, float)) and not isinstance(score, bool) and math.isfinite(score)
        return value["status"], min(1.0, max(0.0, float(score))) if good else None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(*r) for r in zip(b["question"], b["answer"], b["evidence"])]
            yield pd.DataFrame([(i, *m) for i, m in zip(b["id"], made)], columns=["id", "status", "score", "error"])

    return rows.select("id", "question", "answer", "evidence").mapInPandas(run, "id long, status string, score double, error string")
