"""Embedding at scale: profiles, provider calls in checked batches, a cache by content, and vector tables by namespace."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import TOKEN, deterministic_id
from corvina.operators.vector import HASH_DIMENSIONS, usable
from corvina.scratch import written
from corvina.session import share_code

#: Texts of one provider call, retries when it is busy, and the first pause in seconds.
BATCH, RETRIES, PAUSE = 100, 2, 0.4


class Busy(Exception):
    """The provider asks to try again later."""

    def __init__(self, after: float | None = None):
        super().__init__("provider is busy")
        self.after = after


@dataclass(frozen=True)
class Model:
    """A catalogue entry."""

    name: str
    provider: str
    dimensions: int
    aliases: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Profile:
    """Where vectors of a dimension live; model is the one that a new index gets, kind is base or small."""

    key: str
    kind: str
    dimensions: int
    model: str | None = None


@dataclass(frozen=True)
class Resolved:
    profile: Profile
    model: str
    provider: str
    dimensions: int


def _model(catalog: list[Model], name: str) -> Model:
    found = next((m for m in catalog if name.strip() in (m.name, *m.aliases)), None)
    if found is None:
        raise ValueError(f"embedding model is not available: {name}")
    if not found.enabled:
        raise ValueError(f"embedding model is disabled: {name}")
    return found


def profile_for(profiles: list[Profile], dimensions: int) -> Profile:
    """The first profile of a dimension; none is an error, so no vector lands in a table of another size."""
    found = next((p for p in profiles if p.dimensions == dimensions), None)
    if found is None:
        raise ValueError(f"embedding dimensions {dimensions} do not match a configured profile")
    return found


def resolve_new(profiles: list[Profile], catalog: list[Model], kind: str | None = None, model: str | None = None, provider: str | None = None) -> Resolved:
    """What a new index embeds with: a named model, else that of the profile kind (base unless given)."""
    wanted = model or next((p.model for p in profiles if p.key == (kind or "base") and p.model), None)
    if wanted is None:
        raise ValueError(f"{kind or 'base'} embedding profile is not configured")
    chosen = _model(catalog, wanted)
    if provider and provider != chosen.provider:
        raise ValueError(f"embedding provider mismatch for {wanted}: expected {chosen.provider}")
    profile = profile_for(profiles, chosen.dimensions)
    if kind and kind != profile.kind:
        raise ValueError(f"embedding model {chosen.name} is not compatible with {kind} profile")
    return Resolved(profile, chosen.name, chosen.provider, chosen.dimensions)


def resolve_index(profiles: list[Profile], catalog: list[Model], dimensions: int, model: str | None, kind: str | None = None) -> Resolved:
    """What an existing index embeds with: its stored model; without one, the model of a profile that has its own."""
    profile = next((p for p in profiles if p.key == kind), None) if kind else profile_for(profiles, dimensions)
    if profile is None:
        raise ValueError(f"{kind} embedding profile is not configured")
    stored = model if model and dimensions == profile.dimensions else None
    if stored is None and profile.model is None:
        raise ValueError(f"the index has no stored embedding model for {dimensions} dimensions")
    chosen = _model(catalog, stored or profile.model)
    return Resolved(profile, chosen.name, chosen.provider, profile.dimensions)


#: Texts to vectors, each alone or with its place in the call.
Provider = Callable[[list[str]], list]


def offline(texts: list[str]) -> list[list[float]]:
    """The provider without a network: the counts that :func:`corvina.operators.vector.hashing_embedder` makes."""
    out = []
    for text in texts:
        counts = [0.0] * HASH_DIMENSIONS
        for t in re.findall(TOKEN, text.lower()):
            counts[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % HASH_DIMENSIONS] += 1.0
        out.append(counts)
    return out


def called(provider: Provider, texts: list[str], dimensions: int, pause: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One call, in the order of the texts; a wrong number of vectors, a wrong dimension or a component that is not finite is an error."""
    for attempt in range(RETRIES + 1):
        try:
            rows = provider(texts)
            break
        except Busy as e:
            if attempt == RETRIES:
                raise
            pause(min(e.after, 4.0) if e.after else PAUSE * 2**attempt)
    if len(rows) != len(texts):
        raise ValueError(f"embeddings count mismatch: got {len(rows)} for {len(texts)} inputs")
    placed = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
    vectors = [list(map(float, v)) for _, v in sorted(placed, key=lambda r: r[0])]
    for v in vectors:
        if len(v) != dimensions:
            raise ValueError(f"embedding dimension mismatch: expected {dimensions}, got {len(v)}")
        if not all(map(math.isfinite, v)):
            raise ValueError("embedding must contain only finite numbers")
    return vectors


def embed(rows: DataFrame, use: Resolved, provider: Provider = offline, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows(id, content) to (id, vector) and the new cache(key, vector).

    A text is embedded once, however often it occurs and whatever earlier runs did: its key, over model, dimension and text, is
    looked up first, only missing keys reach the provider, in calls of ``BATCH`` texts. The new entries are written before
    anything reads them, so a failure later repeats no call. Null contents count as empty.
    """
    share_code(rows.sparkSession)
    text = F.coalesce("content", F.lit(""))
    keyed = rows.select("id", text.alias("content"), F.sha2(F.concat_ws(":", F.lit(use.provider), F.lit(use.model), F.lit(str(use.dimensions)), text), 256).alias("key"))
    wanted = keyed.groupBy("key").agg(F.first("content").alias("content"))
    if cache is not None:
        wanted = wanted.join(cache.select("key"), "key", "left_anti")
    dimensions = use.dimensions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), BATCH):
                some = b.iloc[s : s + BATCH]
                yield pd.DataFrame({"key": some["key"], "vector": called(provider, list(some["content"]), dimensions)})

    new = written(wanted.mapInPandas(run, "key string, vector array<double>"), "embeddings")
    every = new if cache is None else cache.select("key", "vector").unionByName(new)
    return keyed.select("id", "key").join(every, "key").select("id", "vector"), every


def upsert_vectors(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """vectors(namespace, id, vector, ...) in a folder a namespace: incoming rows replace those of their namespace and id.

    Of incoming rows with one id the least stays, in every run. The old table can be dropped once the new one is there.
    """
    rest = [c for c in incoming.columns if c not in ("namespace", "id")]
    once = incoming.groupBy("namespace", "id").agg(F.min(F.struct(*rest)).alias("row")).select("namespace", "id", "row.*")
    kept = once if stored is None else stored.join(once.select("namespace", "id"), ["namespace", "id"], "left_anti").unionByName(once)
    return written(kept.hint("rebalance", "namespace"), "vectors", by="namespace")


def vector_chunks(chunks: DataFrame, documents: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks that come with vectors: (chunks, new documents, refused chunks with the problem).

    chunks(request, pos, id, document_id, content, embedding, chunk_index, document_content); documents(document_id). A chunk without
    index gets its place in its request. A request with a bad chunk is refused whole. A document that isn't there
    is created with the content that its first chunk brings, else with that chunk's own.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problem = (
        F.when(blank("id"), "chunk id is required").when(blank("document_id"), "document_id is required").when(blank("content"), "chunk content is required")
        .when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "embedding is required").when(F.size("embedding") != dimensions, "wrong dimensions")
        .when(~usable(F.col("embedding"), dimensions), "not finite")
    )
    marked = chunks.withColumn("problem", problem)
    bad = marked.filter("problem is not null")
    place = F.row_number().over(Window.partitionBy("request").orderBy("pos")) - 1
    good = marked.join(bad.select("request").distinct(), "request", "left_anti").withColumn("chunk_index", F.coalesce("chunk_index", place)).drop("problem")
    first = good.groupBy("document_id").agg(F.min_by(F.coalesce("document_content", "content"), F.struct("request", "pos")).alias("content"))
    return good, first.join(documents.select("document_id"), "document_id", "left_anti"), bad


def with_ids(docs: DataFrame, index_id: str, run: str) -> DataFrame:
    """docs(content, ...) with a document_id of their own: random to users, but the same when a lost task runs again.

    The id is made from the run's name and the text, and equal texts get ids by their number among them.
    """
    number = F.row_number().over(Window.partitionBy("content").orderBy(*[c for c in docs.columns if c != "content"] or ["content"]))
    return docs.withColumn("document_id", deterministic_id("doc_", F.concat_ws(":", F.lit(run), F.lit(index_id), number.cast("string"), "content")))


def backfill(rows: DataFrame, batch: int) -> DataFrame:
    """Exported chunks(id, vector, ...) with the number of the batch of about ``batch`` rows that they are sent in; several dimensions are an error."""
    sizes = [r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("exported vectors have several dimensions")
    batches = max(1, -(-rows.count() // batch))
    return rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
