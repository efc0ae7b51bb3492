"""Lexical retrieval: a sharded postings index, fuzzy matching by keys, BM25 and a top k that reads few blocks.

The index of a corpus is four written tables. Postings (one row per token and chunk, with the chunk's length) lie in
folders by the token's hash, sorted by token; a search reads only folders of tokens that it matches. Heads hold, per
token and block of about ``BLOCK`` chunks, how many postings there are and the largest BM25 term. The vocabulary has
one row per token. Keys lead from what a query token can look like to the vocabulary: its stem, the segments of which an
edit or two leave one whole, and five-character grams for containment; candidates are verified by the similarity itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvina.functions.text import DOTTED, STOP_WORDS, TOKEN, query_tokens, similarity, stem
from corvina.scratch import drop_written, written
from corvina.session import share_code

K1, B, FUZZY = 1.2, 0.75, 0.72
#: Chunks of a block, and postings or keys that a folder holds on average.
BLOCK, FOLDER = 65_536, 65_536
#: Most folders of a table (their list is planned on the driver), and chunks or tokens that a task of one folder takes.
FOLDERS, SLICE = 20_000, 1 << 22
#: Folders that are read whole rather than chosen from, and rows of terms or matched tokens that the driver may hold.
WHOLE, FEW = 4, 20_000
#: Characters of text a posting, to tell how many folders there should be.
CHARACTERS = 12
#: Best blocks of a query that are scored before the others are judged.
SEEDS = 2
#: Characters of texts that a Python task counts at once, and rows of postings or keys that a task sorts, about.
TEXT, SORTED = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Index:
    """postings(folder, token, block, chunk_id, chunk_index, tf, pos, len), heads(token, block, n, most), vocabulary(token, df) and keys(folder, key, token)."""

    postings: DataFrame
    heads: DataFrame
    vocabulary: DataFrame
    keys: DataFrame
    chunks: int
    average: float
    blocks: int
    folders: tuple[int, int]

    def drop(self) -> None:
        drop_written(self.postings, self.heads, self.vocabulary, self.keys)


def _folder(value: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folders)).cast("int")


def _folders(expected: int) -> int:
    return max(1, min(FOLDERS, -(-expected // FOLDER)))


def _dealt(rows: DataFrame, by: str, within: str, folders: int, count: int, expected: int) -> DataFrame:
    """rows with the folder of a column's hash, a task a folder; beyond ``SLICE`` values of the other column, a folder is dealt to more tasks by that.

    So a token in very many chunks, or a key of very many tokens, is shared out. There are as many tasks as the expected
    rows need, whatever the session's number of shuffle partitions, so what a task reads doesn't grow with the corpus.
    """
    slices = max(1, -(-count // SLICE))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(FOLDERS, -(-expected // SORTED)))
    return rows.withColumn("folder", _folder(F.col(by), folders)).repartition(tasks, "folder", F.pmod(F.xxhash64(within, F.lit(1)), F.lit(slices)))


def _within(table: DataFrame, folders: int, wanted: DataFrame, by: str) -> DataFrame:
    """The table's rows in the folders that the values of ``by`` in wanted lie in: the others are never opened."""
    if folders <= WHOLE:
        return table
    some = sorted(r[0] for r in wanted.select(_folder(F.col(by), folders)).distinct().collect())
    return table.filter(F.col("folder").isin(some)) if len(some) < folders else table


def _held(rows: DataFrame, name: str) -> DataFrame:
    """A few rows that several plans read: local up to ``FEW``, counted as they come, else a written table."""
    some = rows.limit(FEW + 1).toArrow()
    return written(rows, name) if some.num_rows > FEW else rows.sparkSession.createDataFrame(some).select(*[F.col(c).cast(t) for c, t in rows.dtypes])


def _spread(chunks: DataFrame) -> DataFrame:
    """A corpus in fewer files than there are cores is dealt to all of them: counting tokens costs far more than moving texts."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(cores) if chunks.rdd.getNumPartitions() < cores else chunks


def _norm(tf: Column, size: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def counts(chunks: DataFrame) -> DataFrame:
    """token, chunk_id, chunk_index, len, tf, pos of chunks(chunk_id, chunk_index, content): what :func:`sparse_tokens` gives, counted.

    A chunk's tokens are counted where its text is, so a row a token leaves the task, not one an occurrence. Python holds the counts of
    about ``TEXT`` characters at once, however many rows a batch has.
    """
    share_code(chunks.sparkSession)
    token, stop = re.compile(TOKEN), frozenset(STOP_WORDS)
    kinds = dict(chunks.dtypes)

    def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT, side="right")))
            yield b.slice(at, till - at)
            at = till

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            row, tokens, sizes, tfs, places = [], [], [], [], []
            for k, text in enumerate(b.column(2)):
                found = [t for t in token.findall((text.as_py() or "").replace(DOTTED, "i").lower()) if t not in stop]
                many = Counter(found)  # in the order of first occurrence
                row += [k] * len(many)
                tokens += many
                tfs += many.values()
                sizes += [len(found)] * len(many)
                first = dict(zip(reversed(found), range(len(found) - 1, -1, -1)))
                places += [first[t] for t in many]
            at = pa.array(row, pa.int64())
            ints = [pa.array(x, pa.int32()) for x in (sizes, tfs, places)]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), b.column(0).take(at), b.column(1).take(at), *ints], ["token", "chunk_id", "chunk_index", "len", "tf", "pos"])

    given = chunks.select("chunk_id", "chunk_index", "content")
    return given.mapInArrow(run, f"token string, chunk_id {kinds['chunk_id']}, chunk_index {kinds['chunk_index']}, len int, tf int, pos int")


def index(chunks: DataFrame) -> Index:
    """The written index: any number of searches reads it instead of texts. Counts are shuffled once, by folder."""
    n, characters = chunks.agg(F.count(F.lit(1)), F.sum(F.length("content"))).first()
    blocks, folders = max(1, -(-n // BLOCK)), _folders((characters or 0) // CHARACTERS)
    seen, block = Observation(), _folder(F.col("chunk_id"), blocks)
    rows = _dealt(counts(_spread(chunks.select("chunk_id", "chunk_index", "content"))), "token", "chunk_id", folders, n, (characters or 0) // CHARACTERS).withColumn("block", block)
    rows = rows.sortWithinPartitions("folder", "token", "block").observe(seen, F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    postings = written(rows, "postings", by="folder")
    average = max(1.0, seen.get["total"] / max(1, n))
    heads = written(postings.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n"), F.max(_norm(F.col("tf"), F.col("len"), average)).alias("most")), "heads")
    vocabulary = heads.select("token", F.col("n").alias("df")) if blocks == 1 else written(heads.groupBy("token").agg(F.sum("n").alias("df")), "vocabulary")
    words = vocabulary.count()
    key_folders = _folders(10 * words)
    keys = _dealt(vocabulary.select(F.explode(token_keys(F.col("token"))).alias("key"), "token"), "key", "token", key_folders, words, 10 * words)
    return Index(postings, heads, vocabulary, written(keys.sortWithinPartitions("folder", "key"), "keys", by="folder"), n, average, blocks, (folders, key_folders))


def first_chunks(chunks: DataFrame, most: int | None) -> DataFrame:
    """The corpus cap of the served index (a feature of parity mode); None keeps all chunks."""
    return chunks if most is None else chunks.orderBy("chunk_index", "chunk_id").limit(most)


def explode_queries(queries: DataFrame) -> DataFrame:
    """queries(qid, query) to qid, q."""
    return queries.select("qid", F.explode(query_tokens(F.col("query"))).alias("q"))


def _parts(size: Column) -> Column:
    """Into how many segments a token of a length is cut: one more than the edits it can differ by."""
    # Tokens of six characters can be two edits from ones of eight.
    return F.when(size <= 5, 2).otherwise(3)


def _grams(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t) - 4), lambda i: F.substring(t, i, F.lit(5)))


def token_keys(t: Column) -> Column:
    """The keys under which a vocabulary token is found: about ten for a token of usual length."""
    size = F.length(t)
    segments = F.transform(F.sequence(F.lit(0), _parts(size) - 1), lambda p: _shifted(t, size, p, F.lit(0)))
    grams = F.array_distinct(F.transform(_grams(t), lambda g: F.concat(F.lit("g:"), g)))
    both = F.array(F.concat(F.lit("s:"), stem(t)), F.concat(F.lit("f:"), F.substring(t, 1, 5)))
    return F.when(size < 5, F.slice(both, 1, 1)).otherwise(F.concat(both, grams, segments))


def query_keys(q: Column) -> Column:
    """The keys that lead to every vocabulary token that a query token can match.

    An equal stem; a token that holds the query token has its first gram; one that lies in it starts with one of its
    grams; one an edit or two away keeps a segment, at most two places from where it stands.
    """
    size = F.length(q)
    places = F.transform(F.sequence(F.lit(0), F.lit(74)), lambda n: F.struct((size + n % 5 - 2).alias("size"), F.floor(n / 5).cast("int").alias("rest")))
    edits = F.transform(places, lambda x: _shifted(q, x["size"], x["rest"] % 3, F.floor(x["rest"] / 3).cast("int") - 2))
    grams = F.transform(_grams(q), lambda g: F.concat(F.lit("f:"), g))
    both = F.array(F.concat(F.lit("s:"), stem(q)), F.concat(F.lit("g:"), F.substring(q, 1, 5)))
    return F.when(size < 5, F.slice(both, 1, 1)).otherwise(F.array_distinct(F.concat(both, grams, F.filter(edits, lambda k: k != ""))))


def _shifted(q: Column, size: Column, place: Column, shift: Column) -> Column:
    """The key of a segment of a token of ``size``, taken from where the query token would have it; empty where there is none."""
    parts = _parts(size)
    start = F.floor(size * place / parts).cast("int")
    length = F.floor(size * (place + 1) / parts).cast("int") - start
    fits = (size >= 5) & (place < parts) & (start + shift >= 0) & (start + shift + length <= F.length(q))
    return F.when(fits, F.concat_ws(":", F.lit("e"), size.cast("string"), place.cast("string"), F.substring(q, start + shift + 1, length))).otherwise("")


def near_tokens(corpus: Index, terms: DataFrame, fuzzy: bool = True) -> DataFrame:
    """token, q, sim of all pairs of a vocabulary token and a term (q) that match: an equi-join on keys, then the similarity."""
    if not fuzzy:
        return terms.select("q", F.col("q").alias("token"), F.lit(1.0).alias("sim"))
    asked = _held(terms.select("q", F.explode(query_keys(F.col("q"))).alias("key")), "asked")
    found = _within(corpus.keys, corpus.folders[1], asked, "key").join(asked, "key").select("q", "token")
    return found.withColumn("sim", similarity(F.col("q"), F.col("token"))).filter(F.col("sim") >= FUZZY).distinct()


def _near(corpus: Index, query_terms: DataFrame, fuzzy: bool) -> DataFrame:
    """The matched tokens: a few rows a term that every later step reads."""
    return _held(near_tokens(corpus, query_terms.select("q").distinct(), fuzzy), "near")


def matches(corpus: Index, near: DataFrame) -> DataFrame:
    """Best match of every term in every chunk: q, block, chunk_id, chunk_index, len, token, tf, sim."""
    some = _within(corpus.postings, corpus.folders[0], near, "token")
    order = F.struct("sim", F.when(F.col("sim") == 1, 0).otherwise(F.col("tf")), -F.col("pos"))
    best = some.join(near, "token").groupBy("q", "block", "chunk_id", "chunk_index", "len").agg(F.max_by(F.struct("token", "tf", "sim"), order).alias("m"))
    return best.select("q", "block", "chunk_id", "chunk_index", "len", "m.token", "m.tf", "m.sim")


def _scored(corpus: Index, found: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of the chunks of found; weights(qid, q, idf)."""
    part = F.col("idf") * _norm(F.col("tf"), F.col("len"), corpus.average) * F.col("sim")
    term = F.when(F.col("token") == F.col("q"), F.col("q")).otherwise(F.concat_ws("~", "q", "token"))
    return (
        found.join(weights, [c for c in ("q", "qid") if c in found.columns])
        .groupBy("qid", "chunk_id", "chunk_index")
        .agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("overlap"), F.array_sort(F.collect_set(term)).alias("terms"))
        .filter("score > 0")
    )


def _weights(corpus: Index, query_terms: DataFrame, df: DataFrame) -> DataFrame:
    """qid, q, idf from df(q, df)."""
    return query_terms.join(df, "q").select("qid", "q", F.log(1 + (corpus.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(corpus: DataFrame | Index, queries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """qid, chunk_id, chunk_index, score, overlap, terms for every chunk with a match; corpus: chunks, or their index."""
    corpus = corpus if isinstance(corpus, Index) else index(corpus)
    asked = explode_queries(queries)
    found = matches(corpus, _near(corpus, asked, fuzzy))
    df = found.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    return _scored(corpus, found, _weights(corpus, asked, df))


def top(scored: DataFrame, k: int) -> DataFrame:
    """Ranked top k per query under a total order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("overlap"), "chunk_index", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _document_counts(corpus: Index, near: DataFrame) -> DataFrame:
    """q, df: in how many chunks any matched token stands. One token's count is in the heads; more need their chunk ids."""
    n = Window.partitionBy("q")
    each = near.withColumn("tokens", F.count(F.lit(1)).over(n))
    one = corpus.heads.join(each.filter("tokens = 1").select("q", "token"), "token").groupBy("q").agg(F.sum("n").alias("df"))
    more = each.filter("tokens > 1").select("q", "token")
    ids = _within(corpus.postings, corpus.folders[0], more, "token").join(more, "token").select("q", "chunk_id").distinct()
    return one.unionByName(ids.groupBy("q").agg(F.count(F.lit(1)).alias("df")))


def bounds(corpus: Index, near: DataFrame, weights: DataFrame) -> DataFrame:
    """qid, block, bound: no chunk of the block scores more for the query."""
    most = corpus.heads.join(near, "token").groupBy("q", "block").agg(F.max(F.col("sim") * F.col("most")).alias("most"))
    return most.join(weights, "q").groupBy("qid", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))


def best(corpus: DataFrame | Index, queries: DataFrame, k: int, fuzzy: bool = True) -> DataFrame:
    """The same rows as ``top(bm25(...), k)``, from the blocks that can hold them.

    Per query the blocks of the highest bounds are scored first; their k-th best score is a threshold, and only blocks
    whose bound reaches it are scored besides. With a single block everything is scored at once.
    """
    corpus = corpus if isinstance(corpus, Index) else index(corpus)
    if corpus.blocks == 1:
        return top(bm25(corpus, queries, fuzzy), k)
    asked = explode_queries(queries)
    near = _near(corpus, asked, fuzzy)
    weights = written(_weights(corpus, asked, _document_counts(corpus, near)), "weights")
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
    bound = written(bounds(corpus, near, weights).withColumn("place", F.row_number().over(order)), "bounds")
    first = written(top(_of_blocks(corpus, near, weights, bound.filter(F.col("place") <= SEEDS)), k), "seeds")
    least = first.filter(F.col("rank") == k).select("qid", "score")
    # Sums of doubles in another order may differ in the last places: bounds count as reached a little earlier.
    rest = bound.filter(F.col("place") > SEEDS).join(least, "qid", "left").filter(F.col("score").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("score")))
    rest = written(rest.select("qid", "block"), "rest")
    scored = first.drop("rank").unionByName(_of_blocks(corpus, near, weights, rest)) if rest.head(1) else first.drop("rank")
    return top(scored, k)


def _of_blocks(corpus: Index, near: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Scores of the chunks in blocks(qid, block): postings of other blocks are dropped before they are matched."""
    wanted = blocks.select("qid", "block").join(weights.select("qid", "q"), "qid").join(near, "q").select("token", "block").distinct()
    reads = Index(corpus.postings.join(wanted, ["token", "block"], "left_semi"), corpus.heads, corpus.vocabulary, corpus.keys, corpus.chunks, corpus.average, corpus.blocks, corpus.folders)
    found = matches(reads, near).join(weights.select("qid", "q"), "q").join(blocks.select("qid", "block"), ["qid", "block"])
    return _scored(corpus, found, weights)


def search(chunks: DataFrame, queries: DataFrame, k: int = 5, fuzzy: bool = True, most_chunks: int | None = None, corpus: Index | None = None) -> DataFrame:
    """Top k chunks per query; text joins late, after the ranking. corpus: the index of the chunks, if there is one."""
    ranked = best(corpus or first_chunks(chunks, most_chunks), queries, max(1, min(k, 50)), fuzzy)
    return ranked.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id")


def prefilter(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Chunks that contain terms as substrings, by number of terms."""
    content = F.lower("content")
    score = sum((content.contains(t).cast("int") for t in terms), F.lit(0))
    return chunks.select("chunk_id", "chunk_index", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(k)


def fast_path(ranked: DataFrame) -> DataFrame:
    """Per query: whether the best lexical hit is strong enough to skip dense retrieval."""
    best = ranked.filter("rank = 1")
    return best.select("qid", ((F.col("score") >= 2) & (F.col("overlap") >= 2)).alias("fast_path"))
