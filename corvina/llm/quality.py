"""Quality rules as a bitmask ledger (native: DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit k
is set when rule k fails. A policy is a named, versioned mask over those bits, so a verdict, a policy
change or an ablation never reads a text again.

Edge cases: null text counts as empty (no words, the base rule fails it); repeated rows each get their
own ledger row; tables may carry any other columns, only ``doc_id`` and ``text`` are read; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
#: Words of a repetition window.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` reads ledger measurements only; bit is the rule's place in the mask."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(3, "upper_case_share", "10 * n_upper > 4 * word_chars"),
    Rule(4, "exclamations_per_word", "10 * n_exclamations > 3 * n_words"),
    Rule(5, "echoed_words", "100 * n_echo_words > 20 * n_words"),
    Rule(6, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(7, "long_words", "word_chars > 20 * n_words"),
)
BASE = 0b11
#: Versioned policies: name to the mask of rules that reject.
POLICIES = {
    "base-1": BASE,
    "clean-1": BASE | 0b0001_1100,
    "clean-2": BASE | 0b1111_1100,
}
CURRENT = "clean-2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclamations", "n_echo_words", "n_lines")


def _covered(windows: str, words: str) -> str:
    """Words inside windows that occur twice or more, first occurrences included.

    Windows are sorted by hash; equal neighbours are confirmed on the words themselves. ``transform``
    over a one-element array names the sorted array once, so it is computed once.
    """
    same = "{o}.h = x.h and slice({words}, {o}.i + 1, {w}) = slice({words}, x.i + 1, {w})"
    near = " or ".join(f"({same.format(o=f'get(s, j {d} 1)', words=words, w=WINDOW)})" for d in "-+")
    return f"""element_at(transform(array(array_sort(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))), s ->
        aggregate(array_sort(filter(transform(s, (x, j) -> if({near}, x.i, null)), p -> p is not null)),
            named_struct('last', -{WINDOW}, 'total', 0L),
            (a, p) -> named_struct('last', p, 'total', a.total + least({WINDOW}, p - a.last)),
            a -> a.total)), 1)"""


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement the rules read."""
    count = lambda cls: f"cast(length(text) - length(regexp_replace(text, '{cls}+', '')) as bigint)"
    space = SPACE.replace("\\", "\\\\")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = base.selectExpr(
        "doc_id",
        "text",
        f"filter(split(text, '{space}+'), w -> w <> '') as words",
        f"filter(split(text, '\\n'), l -> l rlike '{space.replace('[', '[^')}') as lines",
    )
    hashed = split.selectExpr(
        "doc_id",
        "words",
        "transform(words, w -> xxhash64(w)) as h",
        "cast(size(words) as bigint) as n_words",
        f"cast(length(regexp_replace(text, '{space}+', '')) as bigint) as word_chars",
        f"{count('[#*$%&|<>]')} as n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        "cast(size(lines) as bigint) as n_lines",
        "cast(length(regexp_replace(text, '\\\\P{Lu}+', '')) as bigint) as n_upper",
        "cast(length(text) - length(replace(text, '!', '')) as bigint) as n_exclamations",
    )
    gets = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    windowed = hashed.selectExpr(
        "*",
        f"if(size(h) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({gets}))) as win",
    )
    return windowed.selectExpr(
        "doc_id",
        *[m for m in MEASURES if m not in ("n_repeat_words", "n_echo_words")],
        f"case when size(array_distinct(win)) = size(win) then 0L else {_covered('win', 'words')} end as n_repeat_words",
        "cast(size(filter(h, (x, i) -> x = get(h, i - 1))) as bigint) as n_echo_words",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements and ``fail_bits``.

    The generator at the end is a barrier: a filter on a verdict pushed below it would be evaluated with
    the splitting of the text inlined into every lambda.
    """
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in RULES)
    rows = measure(docs, id_col, text_col).selectExpr("doc_id", *MEASURES, f"{bits} as fail_bits")
    return rows.select("doc_id", F.explode(F.array(F.struct(*MEASURES, "fail_bits"))).alias("m")).select("doc_id", "m.*")


def rejects(policy: str = CURRENT) -> Column:
    """Whether a ledger row is rejected under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def judge(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return led.select("doc_id", *MEASURES, "fail_bits", base.alias("base_failed"), (~base & ~rejects(policy)).alias("kept"))


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    Documents collapse to their distinct bit patterns first (at most 2^rules rows); the rest is
    bitwise work on that table.
    """
    mask = POLICIES[policy]
    rules = [r for r in RULES if mask >> r.bit & 1]
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        patterns.select("bits", "n", named)
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Documents that a policy accepts, rows and columns unchanged.

    The verdict travels with its row: each row's text is measured under a row-local alias and dropped
    again, so repeated or null ids need no join.
    """
    judged = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row"), F.col("text")), "doc_row")
    return judged.filter(~rejects(policy)).select("doc_id.*")
