"""Toxicity by maximum-scoring segments over token log-odds.

Fit: how many distinct labelled texts of either class have a word or word prefix gives its log-odds
under an informative Dirichlet prior (the pooled counts). Features whose odds are significant form the
lexicon; a word scores the log-odds of its own entry, else of its longest listed prefix, and every word costs
``DRIFT``. Score: a linear-time scan finds all maximal scoring segments of a document
(Ruzzo and Tompa), their scores are turned into extreme-value statistics (Karlin and Altschul, with the law of
the scores of the clean words that calibrate it) and aggregated, and a logistic curve fitted on documents that did
not feed the lexicon maps the statistic to a probability.

Edge cases: null and empty texts have no segment and get the score of a segment-free document; labels
that are null or missing are never learned from; repeated label rows of a document count once (toxic if
any says so); without any labelled document of both classes every score is the prior 0. Texts of any
length are scanned whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, texts_of

#: Documented bound of the model: labelled rows it is fitted on (what it keeps of them follows).
MAX_ROWS = 20_000
PREFIXES = range(4, 9)
#: Least number of toxic texts and least z-score of the log-odds for a lexicon entry.
MIN_COUNT, MIN_Z = 4, 3.0
#: Dirichlet prior: even mass per feature and mass shared out by pooled counts; what a word costs a segment.
PSEUDO, ALPHA, DRIFT = 0.5, 500.0, 0.083
#: Segments beyond this expected number of chance occurrences are not significant.
E_VALUE = 1.0
#: Units remembered per worker; beyond it the memory is cleared.
CACHE = 400_000
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # log-odds
    decay: float  # lambda of the extreme-value law
    scale: float  # K of the extreme-value law
    slope: float
    offset: float
    empty: float  # statistic of a document without a segment


def segments(weights: list[tuple[int, float]], background: float) -> list[float]:
    """Scores of all maximal scoring segments.

    weights: (position, positive score) in order; each other position scores ``background`` (below 0).
    One pass with a stack of candidate segments; runs of background are one step.
    """
    stack: list[tuple[float, float]] = []  # cumulative score left of the segment, and at its end
    total, at = 0.0, 0
    for pos, w in weights:
        total += background * (pos - at)
        left, right = total, total + w
        total, at = right, pos + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                break
            left = stack[j][0]
            del stack[j:]
        stack.append((left, right))
    return [r - l for l, r in stack]


class Scorer:
    """Per-worker lookup of unit weights with a bounded memory."""

    def __init__(self, weights: dict[str, float]):
        self.lexicon, self.known = weights, {}

    def _weigh(self, unit: str) -> float:
        best = 0.0
        for word in LETTERS.findall(unit.lower()):
            w = self.lexicon.get("=" + word)
            for n in () if w is not None else reversed(PREFIXES):
                if len(word) >= n and (w := self.lexicon.get(word[:n])) is not None:
                    break
            best = max(best, w or 0.0)
        return max(0.0, best - DRIFT)

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and (place, score) of those that score above 0."""
        known, units, found = self.known, text.split(), []
        for i, u in enumerate(units):
            w = known.get(u)
            if w is None:
                if len(known) >= CACHE:
                    known.clear()
                w = known[u] = self._weigh(u)
            if w:
                found.append((i, w))
        return len(units), found

    def statistics(self, text: str) -> tuple[int, list[float]]:
        """Number of words and the maximal segment scores."""
        n, found = self.hits(text)
        return n, segments(found, -DRIFT) if found else []


def _bits(n: int, found: list[float], decay: float, scale: float, empty: float) -> float:
    """Extreme-value statistic: the best segment's normalised score plus those of other significant ones."""
    if not found:
        return empty
    norm = sorted((decay * s - math.log(max(scale * n, 1e-9)) for s in found), reverse=True)
    return norm[0] + sum(x for x in norm[1:] if x > -math.log(E_VALUE))


def _counts(train: DataFrame) -> DataFrame:
    """feature, and how many distinct toxic and clean texts have it; words as "=word", prefixes as they are."""
    word = F.expr("array_distinct(regexp_extract_all(lower(text), '\\\\p{L}+', 0))").alias("words")
    cuts = ", ".join(f"if(length(w) >= {n}, substring(w, 1, {n}), null)" for n in PREFIXES)
    features = F.expr(f"array_distinct(flatten(transform(words, w -> array_compact(array(concat('=', w), {cuts})))))")
    once = train.dropDuplicates(["text"]).select("toxic", word).select("toxic", F.explode(features).alias("f"))
    return once.groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents outside the held-out fold: part, toxic, text."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("long").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    once = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # max_rows bounds the broadcast side
    return once.select((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))).alias("part"), "toxic", F.coalesce("text", F.lit("")).alias("text"))


def _law(scores: np.ndarray, words: float) -> float:
    """lambda > 0 with mean of exp(lambda * score) = 1 over clean words: scores above 0, and -DRIFT for the rest of ``words``.

    Half a word more scores the mean, so that there is a law even where no clean word scores.
    """
    ws, ps = np.append(scores, scores.mean() if len(scores) else 1.0), np.append(np.ones(len(scores)), 0.5) / (words + 0.5)
    rest = max(1e-9, 1 - ps.sum())
    f = lambda x: float((ps * np.exp(np.minimum(x * ws, 500))).sum() + rest * math.exp(-x * DRIFT) - 1)
    lo, hi = 1e-6, 0.01
    while f(hi) < 0 and hi < 1e6:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _probability(model: Model, n: int, found: list[float]) -> float:
    x = _squash(_bits(n, found, model.decay, model.scale, model.empty))
    return 1 / (1 + math.exp(-min(max(model.slope * x + model.offset, -700), 700)))


def _squash(x: float) -> float:
    """Statistics of long documents reach far; the curve is fitted on their logarithms, in order."""
    return math.copysign(math.log1p(abs(x)), x)


def _logistic(xs: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weakly regularised one-dimensional logistic fit (Newton steps)."""
    mean, sd = xs.mean(), xs.std() + 1e-9
    z, a, b = (xs - mean) / sd, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, e = p * (1 - p) + 1e-9, ys - p
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, np.array([(e * z).sum() - 0.1 * a, e.sum()]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-6)
    return a / sd, b - a * mean / sd


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Lexicon from one half of a bounded labelled sample, calibration from the other; None without both classes."""
    sample = _sample(docs, labels, max_rows)
    counts = _counts(sample.filter("part = 0")).persist()
    totals = counts.filter("f like '=%'").agg(F.sum("t"), F.sum("c")).first()
    n_t, n_c = float(totals[0] or 0), float(totals[1] or 0)
    if not n_t or not n_c:
        counts.unpersist()
        return None
    prior = PSEUDO + ALPHA * (F.col("t") + F.col("c")) / (n_t + n_c)
    y1, y2 = F.col("t") + prior, F.col("c") + prior
    odds = F.log(y1 / (n_t + ALPHA - y1)) - F.log(y2 / (n_c + ALPHA - y2))
    rows = counts.filter(F.col("t") >= MIN_COUNT).select("f", (odds / F.sqrt(1 / y1 + 1 / y2)).alias("z"), odds.alias("odds")).filter(F.col("z") >= MIN_Z).collect()
    counts.unpersist()  # max_rows bounds the rows collected
    weights = {r.f: r.odds for r in rows if r.odds > 1.0}

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for b in batches:
            hits = [scorer.hits(t) for t in texts_of(b.column(1))]
            lists = [[w for _, w in h] for _, h in hits]
            found = [segments(h, -DRIFT) if h else [] for _, h in hits]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in hits], pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.float64()))], ["toxic", "n", "s", "w"])

    bounded_batches(docs.sparkSession)
    held = sample.filter("part = 1").select("toxic", "text").mapInArrow(stats, "toxic long, n long, s array<double>, w array<double>").collect()  # at most max_rows
    ys = np.array([r.toxic for r in held], float)
    if not ys.any() or ys.all():
        return None
    clean = [r for r in held if not r.toxic]
    decay = _law(np.array([w for r in clean for w in r.w], float), float(sum(r.n for r in clean)))
    best = [(decay * max(r.s), r.n) for r in clean if r.s]
    # Gumbel law of clean maxima: mean of lambda * S - ln n is ln K + Euler's constant.
    scale = math.exp(np.mean([s - math.log(n) for s, n in best]) - 0.5772) if len(best) >= 30 else 0.1
    seen = [_bits(r.n, r.s, decay, scale, math.nan) for r in held]
    finite = [x for x in seen if not math.isnan(x)]
    empty = min([0.0, *finite]) - 1.0
    slope, offset = _logistic(np.array([_squash(empty if math.isnan(x) else x) for x in seen]), ys)
    return Model(weights, decay, scale, slope, offset, empty)


def score(docs: DataFrame, model: Model | None, keep_segments: bool = False) -> DataFrame:
    """doc_id, score and the number of significant segments of every document."""
    bounded_batches(docs.sparkSession)
    out = "doc_id long, score double, n_segments long" + (", segment_scores array<double>" if keep_segments else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.weights) if model else None
        for b in batches:
            scores, counts, lists = [], [], []
            for text in texts_of(b.column(1)):
                n, found = scorer.statistics(text) if scorer else (0, [])
                scores.append(_probability(model, n, found) if model else 0.0)
                floor = math.log(max(model.scale * n, 1e-9)) - math.log(E_VALUE) if model and found else 0
                sig = [s for s in found if model.decay * s > floor] if found else []
                counts.append(len(sig))
                lists.append(sig)
            cols = [b.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(lists, pa.list_(pa.float64()))] if keep_segments else []), ["doc_id", "score", "n_segments"] + (["segment_scores"] if keep_segments else []))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents scored below the threshold, rows and columns unchanged."""
    model = fit(docs, labels)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.weights) if model else None
        for b in batches:
            if not scorer:
                yield b
                continue
            ok = []
            for text in texts_of(b.column(at)):
                ok.append(_probability(model, *scorer.statistics(text)) < threshold)
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
