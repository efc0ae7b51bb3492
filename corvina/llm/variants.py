"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of all words.

A word is cut in the middle. If another word differs by one inserted, deleted or replaced code point, one of the two
halves stands in it unchanged: the first at its start, or the second at its end. Shards of the words' halves of
bounded size become automata. Every word is scanned by the shards that its starts and ends of fitting length belong
to; a match counts if it lies at the start (first halves) or the end (second halves) and the lengths differ by one at
most. Whether the rest of both words is one edit apart is then read from the shard's keys: the rest itself, the rest
without one code point, and the rest with one place left open. A key holds how many words have it and the two
best of them, so a half that very many words share costs a lookup like any other, and pairs are never listed.

A half that more than ``HALVES`` words share is dealt into shards by word, and the words that ask for it into as many
blocks; partial counts of a word add up. A shard's halves come before its words in a sorted partition, so a task
holds one automaton at a time and words stream through it. Roots are found by pointer doubling over written rounds.

Edge cases: null and empty texts have no words; the key of an occurrence with a null document id is ":" and the run.
Rows repeated with their id count as often as they occur. Ties go to the word that is smaller in code-point order. An empty
table gives no rows; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvina.llm.common import drop_written, release, written
from corvina.session import share_code

LETTERS, SHORTEST, LEAST, MORE, DELETED = "A-Za-zÀ-ÿ", 7, 2, 10, 31
#: Halves of a shard.
HALVES = 20_000
#: Words that leave a task at a time.
ROWS = 8192


def _lowered(run: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(run.rlike("[À-Þ]"), F.translate(run, capitals, capitals.lower())).otherwise(F.lower(run))


def occurrences(docs: DataFrame) -> DataFrame:
    """word: one row per run of letters that is long enough, with the deletion that its hash asks for."""
    # A shorter run is no word, and losing a code point makes none longer.
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    found = found.select("doc_id", _lowered(F.col("run")).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= SHORTEST)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words found ``LEAST`` times or more."""
    return occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def _first(word: Column, length: Column) -> Column:
    """The first half of a word of ``length``, as it would stand at the start of ``word``."""
    return F.concat(F.lit("<"), F.substring(word, F.lit(1), F.floor(length / 2).cast("int")))


def _second(word: Column, length: Column) -> Column:
    size = (length - F.floor(length / 2)).cast("int")
    return F.concat(F.lit(">"), F.substring(word, F.length(word) - size + 1, size))


def _cells(words: DataFrame, halves: int) -> DataFrame:
    """cell, side (0: a half of the word belongs to the cell, 1: the word is scanned there), word, n, half."""
    length = F.length("word")
    own = words.select("word", "n", F.explode(F.array(_first(F.col("word"), length), _second(F.col("word"), length))).alias("half"))
    asked = F.array(*[f(F.col("word"), length + k) for f in (_first, _second) for k in (-1, 0, 1)])
    lengths = F.array(*[length + k for _ in range(2) for k in (-1, 0, 1)])
    asked = F.array_distinct(F.filter(F.zip_with(asked, lengths, lambda h, n: F.when(n >= SHORTEST, h)), lambda h: h.isNotNull()))
    asking = words.select("word", "n", F.explode(asked).alias("half"))
    hot = own.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > halves).select("half", F.ceil(F.col("c") / halves).alias("parts"))
    hot = written(hot, "hot")
    count = words.count()
    shards = max(1, -(-2 * count // halves))
    shard = F.pmod(F.xxhash64("half"), F.lit(shards))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("parts")))
    every = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    split = F.col("parts").isNotNull()
    # A hot half has its own cells: parts of its words by blocks of the words that ask.
    name = lambda p, t: F.xxhash64(F.when(split, F.col("half")), F.when(~split, shard), p, t)
    own = own.join(hot, "half", "left").withColumn("t", F.explode(every)).select(name(part, F.col("t")).alias("cell"), F.lit(0).alias("side"), "word", "n", "half")
    asking = asking.join(hot, "half", "left").withColumn("p", F.explode(every)).select(name(F.col("p"), part).alias("cell"), "word").distinct()
    return own.unionByName(asking.select("cell", F.lit(1).alias("side"), "word", F.lit(0).cast("long").alias("n"), F.lit("").alias("half")))


class _Shard:
    """An automaton over halves; each half holds keys of the other halves, by kind and word length."""

    def __init__(self) -> None:
        self.halves: dict[str, dict] = {}
        self.automaton = None

    def hold(self, kind: str, half: str, word: str, n: int) -> None:
        rest = word[len(half) :] if kind == "<" else word[: -len(half)]
        keys = self.halves.setdefault(half, {}).setdefault((kind, len(word)), {})
        names = {rest, *((k, rest[:k] + rest[k + 1 :]) for k in range(len(rest))), *(("", rest[:k] + rest[k + 1 :]) for k in range(len(rest)))}
        for name in names:
            old = keys.get(name)
            if old is None:
                keys[name] = (1, n, word, 0, "")
            else:
                c, n1, w1, n2, w2 = old
                if (-n, word) < (-n1, w1):
                    keys[name] = (c + 1, n, word, n1, w1)
                elif not w2 or (-n, word) < (-n2, w2):
                    keys[name] = (c + 1, n1, w1, n, word)
                else:
                    keys[name] = (c + 1, n1, w1, n2, w2)

    def near(self, word: str) -> tuple[int, int, str]:
        """How many of the shard's words are one edit away, and the best of them."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for half, kinds in self.halves.items():
                self.automaton.add_word(half, (len(half), kinds))
            self.automaton.make_automaton()
        count, best_n, best, size = 0, 0, "", len(word)
        for end, (length, kinds) in self.automaton.iter(word):
            at_start, at_end = end + 1 == length, end + 1 == size
            for kind, there in (("<", at_start), (">", at_end)):
                if not there or length == size:
                    continue
                rest = word[length:] if kind == "<" else word[: size - length]
                for delta in (-1, 0, 1):
                    keys = kinds.get((kind, size + delta))
                    if not keys:
                        continue
                    for found, without in self._fitting(keys, kind, delta, rest, word, length):
                        c, n1, w1, n2, w2 = found
                        if without is not None:
                            c -= 1
                            if w1 == without:
                                n1, w1 = n2, w2
                        if c <= 0:
                            continue
                        count += c
                        if not best or (-n1, w1) < (-best_n, best):
                            best_n, best = n1, w1
        return count, best_n, best

    @staticmethod
    def _fitting(keys: dict, kind: str, delta: int, rest: str, word: str, length: int) -> Iterator[tuple[tuple, str | None]]:
        """Entries of words at one edit, each with the word in it that does not count.

        A word found by both halves counts at the first: in second halves, words whose first half starts ``word`` are left out.
        """
        if delta == 0:
            own = word if rest in keys else None
            for k in range(len(rest)):
                if found := keys.get((k, rest[:k] + rest[k + 1 :])):
                    yield found, own
        elif delta < 0:
            for shorter in {rest[:k] + rest[k + 1 :] for k in range(len(rest))}:
                if not (kind == ">" and shorter == rest[:-1]) and (found := keys.get(shorter)):
                    yield found, None
        elif found := keys.get(("", rest)):
            both = rest + word[len(rest)] + word[len(rest) :]
            yield found, both if kind == ">" and rest + word[len(rest)] in keys else None


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell, shard, out = None, _Shard(), []
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    for b in batches:
        for c, side, word, n, half in zip(*(b.column(k).to_pylist() for k in range(5))):
            if c != cell:
                cell, shard = c, _Shard()
            if side == 0:
                shard.hold(half[0], half[1:], word, n)
            elif (found := shard.near(word))[0]:
                out.append((word, *found))
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def neighbours(words: DataFrame, halves: int = HALVES) -> DataFrame:
    """word, n_near, best, best_n for each of the written words(word, n) that has a near word."""
    share_code(words.sparkSession)
    cells = _cells(words, halves).repartition("cell").sortWithinPartitions("cell", "side")
    found = cells.mapInArrow(_scanned, "word string, near long, best_n long, best string")
    place = F.struct(-F.col("best_n"), F.col("best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(place).alias("m")).select("word", "n_near", F.col("m.best").alias("best"), (-F.col("m.col1")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from forms(word, form): the end of each chain. Counts rise along a chain, so it has an end."""
    old, more = written(forms.select("word", F.col("form").alias("root")), "roots"), True
    while more:
        seen = Observation()
        on = old.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = old.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = written(step.observe(seen, F.coalesce(F.max("moved"), F.lit(False)).alias("more")), "roots")
        more = seen.get["more"]
        drop_written(old)
        old = new.select("word", "root")
    return old


def group_variants(docs: DataFrame, halves: int = HALVES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of documents."""
    words = written(vocabulary(docs), "words")
    near = neighbours(words, halves)
    keeps = F.col("best_n") >= MORE * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", F.when(keeps, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(keeps, F.col("best_n")).alias("form_n")
    )
    rows = written(rows, "variants")
    drop_written(words)
    ends = roots(rows.filter(F.col("form").isNotNull()).select("word", "form"))
    release(docs.sparkSession)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
