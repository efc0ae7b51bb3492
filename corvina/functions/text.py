"""Text expressions: every function takes and returns Columns, so all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9][a-z0-9-]{2,}"
#: Words that queries and postings ignore.
STOP_WORDS = ["a", "an", "and", "are", "for", "from", "how", "the", "this", "that", "what", "when", "where", "which", "with"]
#: Question words and corpus words that a rewritten query drops.
QUESTION_WORDS = r"please|show|find|tell me|list|give me|what|which|where|when|who|how|does|do|did|are|is|was|were|the|a|an"
CORPUS_WORDS = r"document|documents|docs|file|files|corpus|domain|about|mention|mentions|mentioned|discuss|discusses|documented"
#: Fixed value: words that separate the parts of a compound question.
CONJUNCTIONS = r"\b(?:and|or|versus|vs|compare(?:d)?(?:\s+to)?)\b|[;?]"
MAX_QUERY_TOKENS, EXCERPT = 8, 420
#: White space that is collapsed, and the space separators that are trimmed at ends, as DuckDB's ``\s`` and ``trim`` have them.
WHITE = r"[\t\n\f\r ]+"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: The one letter whose lower case would be two characters; it becomes a plain i.
DOTTED = "\u0130"


def js_round(x: Column, digits: int) -> Column:
    """Half-up rounding on the binary value."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit(DOTTED), F.lit("i"))), F.lit(TOKEN), F.lit(0))


def sparse_tokens(text: Column) -> Column:
    """Tokens without stop words, repeats kept."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def quality_tokens(text: Column) -> Column:
    return F.array_distinct(sparse_tokens(text))


def query_tokens(text: Column) -> Column:
    return F.slice(quality_tokens(text), 1, MAX_QUERY_TOKENS)


def content_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def stem(t: Column) -> Column:
    """The first suffix rule that applies."""
    n = F.length(t)
    cut = lambda k: F.substring(t, 1, n - k)
    return (
        F.when(t.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ing") & (n > 6), cut(3))
        .when(t.endswith("ed") & (n > 5), cut(2))
        .when(t.endswith("s") & (n > 4), cut(1))
        .otherwise(t)
    )


def trigrams(t: Column) -> Column:
    """Character trigrams of tokens of six characters or more, stop words left out."""
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(F.length(t) >= 6, F.array_distinct(F.filter(grams, lambda g: ~g.isin(STOP_WORDS)))).otherwise(F.array().cast("array<string>"))


def similarity(q: Column, t: Column) -> Column:
    """Fuzzy similarity of a query token and a posting token."""
    longest = F.greatest(F.length(q), F.length(t))
    most = F.when(longest <= 7, 1).otherwise(2)
    # The largest bound that any pair can have keeps the banded distance; the pair's own bound follows.
    distance = F.levenshtein(q, t, 2)
    short = (F.length(q) < 5) | (F.length(t) < 5)
    return (
        F.when(q == t, 1.0)
        .when(stem(q) == stem(t), 0.92)
        .when(~short & (q.contains(t) | t.contains(q)), 0.82)
        .when(short, 0.0)
        .when((distance < 0) | (distance > most), 0.0)
        .otherwise(1 - distance / longest)
    )


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, WHITE, " "), F.lit(SPACES))


def shortened(one: Column, most: int = EXCERPT) -> Column:
    """A line, cut with an ellipsis."""
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 3), F.lit(SPACES)), F.lit("...")))


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """One line, cut with an ellipsis."""
    return shortened(collapse(text), most)


def sentences(text: Column) -> Column:
    """Sentences of the collapsed text; U+0001 divides like a sentence's end, and is left out with it."""
    return F.filter(F.split(collapse(text), rf"(?<=[.!?]){WHITE}|\x01"), lambda s: s != "")


def normalize_query(q: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(q)), r"[?!.,;:]+$", ""), r"\s+", " ")


def compact_query(q: Column) -> Column:
    """A question without brackets, question words, corpus words and punctuation."""
    x = F.regexp_replace(q, r"\([^)]*\)", " ")
    x = F.regexp_replace(x, rf"(?i)\b(?:{QUESTION_WORDS})\b", " ")
    x = F.regexp_replace(x, rf"(?i)\b(?:{CORPUS_WORDS})\b", " ")
    x = F.regexp_replace(x, r"[^a-zA-Z0-9_\- ]+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    x = F.regexp_replace(text, r"\r", "\n")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    x = F.regexp_replace(x, r"[ \t]{2,}", " ")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def decode_entities(text: Column) -> Column:
    """The five named entities in their fixed order; numeric references follow in :func:`decode_numeric`."""
    x = F.regexp_replace(text, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return decode_numeric(x)


def decode_numeric(text: Column) -> Column:
    """Decimal and hexadecimal character references; a reference to no character becomes U+FFFD."""
    pieces = F.split(text, r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);", -1)
    refs = F.regexp_extract_all(text, F.lit(r"&#((?:[0-9]+|[xX][0-9a-fA-F]+));"), F.lit(1))
    digits = lambda r: F.regexp_replace(r, "^[xX]?0*(?=.)", "")
    # No character has more than seven digits, so longer runs need no number.
    code = lambda r: F.when(F.length(digits(r)) <= 7, F.when(r.rlike("^[xX]"), F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("int"))
    valid = lambda n: F.when(((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF)), n).otherwise(0xFFFD)
    # char() covers one byte only; a code point is its UTF-32 bytes decoded.
    chars = F.transform(refs, lambda r: F.decode(F.unhex(F.lpad(F.hex(valid(code(r))), 8, "0")), "UTF-32"))
    whole = F.array_join(F.zip_with(pieces, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);"), whole).otherwise(text)


def strip_html(html: Column) -> Column:
    x = html
    for tag in ("script", "style", "noscript"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return normalize_text(decode_entities(F.regexp_replace(x, r"<[^>]+>", " ")))


def canonical_identity(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(x)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "")


def deterministic_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 32))


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "corpus").otherwise(s)


def pascal(x: Column) -> Column:
    """Pascal case of a slug, singular."""
    words = F.filter(F.split(slug(x), "[-_]+"), lambda w: w != "")
    base = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    base = F.when(base == "", "Corpus").otherwise(base)
    return F.when(base.endswith("s") & (F.length(base) > 3), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def field_name(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(x), "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(s, "^[0-9]+", "")
    return F.when(s == "", "field").otherwise(s)


def safe_key(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z0-9._-]+", "_")


#: Two consecutive table lines or more.
MARKDOWN_TABLE = r"(?m)(?:^\|.*\|[^\S\n]*$\n?){2,}"


def markdown_tables(text: Column, most: int = 100) -> Column:
    """The markdown tables of a text, normalised."""
    return F.filter(F.transform(F.slice(F.regexp_extract_all(text, F.lit(MARKDOWN_TABLE), F.lit(0)), 1, most), normalize_text), lambda x: x != "")


def stable_json(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
