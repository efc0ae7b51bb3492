"""PII surrogates (native: DataFrame and SQL functions only).

Detected entities get keyed, type-consistent replacements: a surrogate is a function of (key, type,
canonical entity, attempt), so equal entities get equal surrogates everywhere (coreference) and nothing
about the original can be read off without the key. Formats are kept: e-mail addresses stay addresses
(under a reserved top-level domain), telephone numbers keep their country code and punctuation,
addresses of hosts stay in a private range, card numbers stay Luhn-valid and account numbers keep country and a
valid checksum, national numbers take a range that is not given out, secrets keep length, letter
case and alphabet, and personal names keep gender and script.

Persons are found by their titles, each name word on its own, so that "Mrs Ada Stone" and "Mrs Stone" still share
a surname. A given name is one entity whatever stands before it: of the genders that titles give it in the
corpus the most frequent one shapes its surrogate ("Dr" gives none). Where a text has named a person with a title,
the same name words standing alone in it are replaced alike. Names in Latin, Cyrillic, Greek, Hebrew, Arabic,
Devanagari and Han script take surrogates of that script.

A telephone number is its country code, where one is set apart, and its other digits; its surrogate is the
very digits that are written out, code included.

Collision check: surrogates of all distinct entities are compared; of entities that would share one, and
of those whose surrogate is itself some entity of the corpus, all but the least take the next attempt,
until none is left (names grow by a syllable an attempt). Only these exceptions, and given names of several
genders, are joined back to their texts.

The key comes from the caller or from the setting ``spark.corvina.surrogate.key``; without either one is drawn for
the call, and surrogates hold within its result. It reaches the expressions as a value read at run time, so no plan
shows it, and keys two nested hashes.

Edge cases: null and empty texts stay as they are; texts of any length are searched whole; digit runs
that fail the Luhn check, as all of their sub-runs of groups do, are not card numbers; repeated rows get equal surrogates; an empty table gives
an empty table; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import drop_written, fresh_name, written

#: Rounds of the collision check without progress after which a surrogate space counts as exhausted.
STALLED = 20
KEY_SETTING = "spark.corvina.surrogate.key"
#: Titles before personal names, by gender; scripts with capital letters.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Господин", "г-н", "Κύριος", "Κύριε", "Κος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mademoiselle", "Mlle", "Signora", "Госпожа", "г-жа", "Κυρία", "Κα"],
    "n": ["Dr", "Prof", "Professor", "Доктор", "Δρ"],
}
#: Titles before names of scripts without capital letters, and behind names in Han script.
PLAIN_TITLES = {"m": ["מר", "السيد", "श्री"], "f": ["גברת", "השופטת", "السيدة", "श्रीमती"], "n": ["הרב", "الدكتور", "डॉ"]}
BEHIND = {"m": ["先生"], "f": ["女士", "小姐"], "n": ["さん", "様", "氏"]}
#: Syllables of names, endings of given names by gender, and of surnames by gender where the script has such.
SYLLABLES = {
    "latin": ["bar", "ben", "cal", "dor", "fen", "gar", "hal", "kel", "lin", "mar", "nor", "per", "ros", "sel", "tor", "win"],
    "cyrillic": ["бар", "бел", "вал", "гор", "дан", "зор", "кал", "лин", "мар", "нор", "пер", "рос", "сел", "тор", "фед", "хол"],
    "greek": ["βαρ", "γαλ", "δαν", "ζερ", "θαλ", "καρ", "λαμ", "μαν", "νικ", "παρ", "ριν", "σαλ", "τιμ", "φαν", "χαρ", "ψαλ"],
    "hebrew": ["בר", "גל", "דן", "הר", "זל", "חן", "טל", "ים", "כר", "לב", "מן", "נר", "סל", "פן", "רן", "שר"],
    "arabic": ["بار", "تال", "جان", "حار", "دال", "رام", "زان", "سال", "شام", "صار", "طال", "فان", "كار", "لام", "مان", "نار"],
    "devanagari": ["कर", "गल", "चन", "जय", "तर", "दल", "नर", "पल", "बर", "मन", "यश", "रज", "लव", "वर", "सर", "हर"],
    "han": ["安", "白", "辰", "德", "恩", "方", "高", "海", "江", "康", "林", "明", "南", "平", "若", "文"],
}
GIVEN_ENDINGS = {
    "latin": {"m": ["us", "on", "ard", "rik"], "f": ["a", "ia", "ella", "ine"], "n": ["is", "en", "y", "el"]},
    "cyrillic": {"m": ["ий", "ан", "ор", "ей"], "f": ["а", "ия", "ина", "я"], "n": ["ень", "ик", "ель", "ур"]},
    "greek": {"m": ["ος", "ης", "ας", "ων"], "f": ["α", "η", "ια", "ω"], "n": ["ι", "υ", "ις", "εν"]},
    "devanagari": {"m": ["ेश", "न", "ित", "राज"], "f": ["ा", "ी", "िका", "िनी"], "n": ["ु", "ि", "ल", "म"]},
}
SURNAME_ENDINGS = {"cyrillic": {"m": "ов", "f": "ова"}, "greek": {"m": "ης", "f": "η"}}
FEMININE = {"cyrillic": "(ова|ева|ёва|ина|ая)$", "greek": "(η|ή|α|ά|ου|ού|ω|ώ)$"}
#: Fixed value: a non-character that parts texts and matches; texts that hold it are split another way.
MARK = "\ufdd0"


def _patterns() -> dict[str, str]:
    titles = "|".join(t for ts in TITLES.values() for t in ts)
    plain, behind = ("|".join(t for ts in by.values() for t in ts) for by in (PLAIN_TITLES, BEHIND))
    name = r"\p{Lu}[\p{L}\p{M}'’-]*+"
    octet = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    hexes = "[0-9a-fA-F]{1,4}"
    return {
        # Possessive runs after a look-behind: each run of characters is walked once, however long.
        "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
        "ip": rf"(?<![\w.])(?:{octet}\.){{3}}{octet}(?!\w|\.[0-9])",
        "ipv6": rf"(?<![\w:.])(?=[0-9a-fA-F:]{{2,39}}(?![\w:]))(?=[a-fA-F:]*+[0-9])(?:(?:{hexes}:){{7}}{hexes}|(?:{hexes}:){{1,6}}(?::{hexes}){{1,6}}|(?:{hexes}:){{1,7}}:)(?![\w:])",
        "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
        "national": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
        "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<![\w.])\+[0-9]{8,14}(?!\w)"
        r"|(?<![\w.])\+(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,3}(?:[ .()-]{1,2}[0-9]{1,5}){2,6}(?!\w)",
        # A whole run of digit groups; _parts finds the cards and telephone numbers in it.
        "card": r"(?<![\w.-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?!\w)(?:[ -][0-9]++(?!\w))*+",
        "secret": r"""(?<!\w)(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[^\s"']{8,}+|(?<!\w)[0-9a-fA-F]{32,}+(?!\w)""",
        "person": rf"(?<![\p{{L}}\p{{M}}])(?:{titles})\.?[ \x{{A0}}]{name}(?: {name}){{0,2}}|(?<![\p{{L}}\p{{M}}])(?:{plain})[ \x{{A0}}]\p{{Lo}}[\p{{L}}\p{{M}}]*+"
        rf"|(?<![\p{{IsHan}}])\p{{IsHan}}{{1,4}}?(?:{behind})",
    }


PATTERNS = _patterns()
#: What stands before a secret in its match.
SECRET_KEY = r"""^(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?"""
#: Groupings of card numbers, as sought in runs of more digits than one card has.
CARD_SHAPE = r"^(?:[0-9]{13,19}|(?:2[2-7]|[3-6][0-9])[0-9]{2}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: All kinds at once, in order of precedence. None starts inside a word, so most places of a text are passed at one glance.
ANY = r"(?<!\w)(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "ip", "ipv6", "iban", "national", "card", "phone", "person")) + ")"


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _bind(value: str, name: str, body: str) -> str:
    """SQL: a body in which a name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _when(*parts: str) -> str:
    """SQL: condition, value, condition, value ... and the value otherwise, as ``case`` has it.

    The driver's parser looks ahead through all of ``case when``, a ``struct`` with names and ``substr``, and keeps
    what it saw for good; it reads the call of a quoted function as it comes.
    """
    return f"`when`({', '.join(parts)})"


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of a digit string."""
    return f"""aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 0, int(c), if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))), 0, (a, x) -> a + x)"""


def _mod97(text: str) -> str:
    """SQL: remainder of a digit and capital letter string, letters standing for 10 to 35."""
    return f"aggregate(split({text}, ''), 0, (a, c) -> if(c rlike '[0-9]', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _kind(m: str) -> str:
    """SQL: the type of a match, null for a digit run that is no card or account number."""
    digits, packed = f"regexp_replace({m}, '[^0-9]', '')", f"replace({m}, ' ', '')"
    return _when(
        f"{m} rlike '{_sql(SECRET_KEY)}' or {m} rlike '^[0-9a-fA-F]{{32,}}$'", "'secret'",
        f"contains({m}, '@')", "'email'",
        f"{m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$'", "'ip'",
        f"{m} rlike '^[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:]*$'", "'ipv6'",
        f"{m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'", "'national'",
        f"{m} rlike '^[A-Z]{{2}}[0-9]{{2}}'", f"if({_mod97(f"concat(`substr`({packed}, 5), `substr`({packed}, 1, 4))")} = 1, 'iban', null)",
        f"{m} rlike '^[0-9]([ -]?[0-9]){{12,18}}$'", f"if({_luhn(digits)} % 10 = 0, 'card', null)",
        f"{m} rlike '^[+(0-9 -]'", f"if({m} rlike '^(?:{_sql(PATTERNS["phone"])})$', 'phone', null)",
        "'person'",
    )


def _parts(m: str) -> str:
    """SQL: a match as parts that make it up; a run of digit groups falls into cards, telephone numbers and the rest.

    A run of at most 19 digits is one card if it passes the Luhn check, else its best sub-run that does is:
    one grouped as cards are, or else the longest. Longer runs hold cards in the usual groupings.
    """
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '')"
    bare = lambda x: f"regexp_replace({x}, '[ -]$', '')"
    window = f"array_join(slice(gs, wi + 1, wj - wi + 1), '')"  # noqa: F541
    passes = f"length({digits('w.s')}) between 13 and 19 and (w.shape or length({digits(m)}) <= 19) and {_luhn(digits('w.s'))} % 10 = 0"
    windows = f"""filter(flatten(transform(sequence(0, size(gs) - 1), wi -> transform(sequence(wi, least(wi + 18, size(gs) - 1)),
        wj -> named_struct('s', {bare(window)}, 'i', wi, 'j', wj, 'shape', {bare(window)} rlike '{_sql(CARD_SHAPE)}')))), w -> {passes})"""
    order = _when(
        f"a.shape and not b.shape and length(b.s) < length({m}) or length(a.s) = length({m})", "-1",
        f"b.shape and not a.shape and length(a.s) < length({m}) or length(b.s) = length({m})", "1",
        f"length({digits('a.s')}) <> length({digits('b.s')})", f"length({digits('b.s')}) - length({digits('a.s')})",
        "a.i - b.i",
    )
    best = f"""if(length({digits(m)}) > 19, ws, slice(array_sort(ws, (a, b) -> {order}), 1, 1))"""
    # From left to right, without overlaps: (next free group, spans).
    spans = f"""aggregate({best}, named_struct('free', 0, 'got', cast(array() as array<struct<i:int,j:int>>)),
        (acc, w) -> if(w.i >= acc.free, named_struct('free', w.j + 1, 'got', array_append(acc.got, named_struct('i', w.i, 'j', w.j))), acc), acc -> acc.got)"""
    marked = f"""array_join(transform(gs, (g, k) -> concat(if(exists(ss, s -> s.i = k), '\\u0001', ''), {digits('g')},
        if(exists(ss, s -> s.j = k), '\\u0001', ''), regexp_replace(g, '[0-9]', ''))), '')"""
    phone = _sql(PATTERNS["phone"])
    phones = f"filter(flatten(zip_with(split(x, '{phone}', -1), regexp_extract_all(x, '{phone}', 0), (a, b) -> array(a, b))), y -> y is not null)"
    pieces = f"flatten(transform(split({marked}, '\\u0001', -1), (x, k) -> if(k % 2 = 1, array(x), {phones})))"
    run = _bind(f"regexp_extract_all({m}, '[0-9]+[ -]?', 0)", "gs", _bind(windows, "ws", _bind(spans, "ss", pieces)))
    return f"if({m} rlike '^[0-9]([ -]?[0-9]){{12,}}$', {run}, array({m}))"


def _cut(text: str) -> str:
    """SQL: stretches of a text, every second one a match. One pass marks the matches; splitting at marks is cheap."""
    other = f"slice(flatten(zip_with(split({text}, '{_sql(ANY)}', -1), regexp_extract_all({text}, '{_sql(ANY)}', 0), (a, b) -> array(a, coalesce(b, '')))), 1, 2 * size(split({text}, '{_sql(ANY)}', -1)) - 1)"
    return f"if(contains({text}, '{MARK}'), {other}, split(regexp_replace({text}, '{_sql(ANY)}', '{MARK}$0{MARK}'), '{MARK}', -1))"


def _matches(cut: str) -> str:
    """SQL: the parts of all matches of a cut text."""
    return f"flatten(transform(filter({cut}, (x, i) -> i % 2 = 1), q -> {_parts('q')}))"


def _script(word: str) -> str:
    """SQL: the script of a name."""
    named = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "hebrew": "IsHebrew", "arabic": "IsArabic", "devanagari": "IsDevanagari", "han": "IsHan"}
    return _when(*[x for s, p in named.items() for x in (f"{word} rlike '\\\\p{{{p}}}'", f"'{s}'")], "'latin'")


def _entities(m: str) -> str:
    """SQL: array of (kind, canon, form) of one match; a person is one entity per name word, a given name's form its gender."""
    behind = "|".join(t for ts in BEHIND.values() for t in ts)
    han = f"{m} rlike '({behind})$'"
    title = f"if({han}, regexp_extract({m}, '({behind})$', 1), regexp_extract({m}, '^[^ .\\u00a0]+', 0))"
    genders = {g: [t for by in (TITLES, PLAIN_TITLES, BEHIND) for t in by[g]] for g in "mfn"}
    gender = _when(*[x for g, ts in genders.items() for x in (f"title in ({', '.join(repr(t) for t in ts)})", f"'{g}'")], "'n'")
    words = f"if({han}, array(regexp_replace({m}, '({behind})$', '')), slice(split({m}, '[ \\u00a0]'), 2, 9))"
    feminine = " ".join(f"when '{s}' then if(lower(w) rlike '{p}', 'f', 'm')" for s, p in FEMININE.items())
    one = _bind(_script("w"), "s", f"named_struct('kind', concat(if(i < size(ws) - 1, 'given-', 'surname-'), s), 'canon', lower(w), 'form', if(i < size(ws) - 1, {gender}, case s {feminine} else '' end))")
    people = _bind(title, "title", _bind(words, "ws", f"transform(ws, (w, i) -> {one})"))
    prefix = f"{m} rlike '^[+][0-9]{{1,3}}[ .(-]'"
    canon = _when(
        "kind = 'email'", f"lower({m})",
        "kind = 'secret'", f"regexp_replace({m}, '{_sql(SECRET_KEY)}', '')",
        "kind = 'ip'", m,
        "kind = 'ipv6'", f"lower({m})",
        "kind = 'iban'", f"replace({m}, ' ', '')",
        "kind = 'phone'", f"concat(regexp_extract({m}, '^([+][0-9]{{1,3}})[ .(-]', 1), if({prefix}, ' ', ''), regexp_replace(regexp_replace({m}, '^[+][0-9]{{1,3}}(?=[ .(-])', ''), '[^0-9]', ''))",
        f"regexp_replace({m}, '[^0-9]', '')",
    )
    return _bind(_kind(m), "kind", _when("kind = 'person'", people, "kind is null", "array()", f"array(named_struct('kind', kind, 'canon', {canon}, 'form', ''))"))


def _spread(text: str, hexes: str, other: str = "c") -> str:
    """SQL: digits and letters of a text replaced by keyed ones of the same class; all else stays, or is ``other``."""
    at = f"`substr`({hexes}, i % 128 + 1, 1)"
    digit = f"translate({at}, 'abcdef', '135790')"
    lower = f"translate({at}, '0123456789abcdef', 'abcdefghijklmnop')"
    letter = _when("c rlike '[0-9]'", digit, "c rlike '\\\\p{Lu}'", f"upper({lower})", "c rlike '\\\\p{L}'", lower, other)
    return f"array_join(transform(split({text}, ''), (c, i) -> {letter}), '')"


def _surrogate(kind: str, canon: str, attempt: str, form: str, key: str) -> str:
    """SQL: canonical surrogate of an entity; key is a struct of two keys, the digest is bound once."""
    message = f"concat_ws('|', {kind}, {canon}, string({attempt}))"
    keyed = lambda more: f"sha2(concat({key}.outer, sha2(concat({key}.inner, {message}, '{more}'), 256)), 256)"
    digest = f"concat({keyed('|1')}, {keyed('|2')})"
    pick = lambda names, at: f"element_at(array({', '.join(repr(n) for n in names)}), int(conv(`substr`(x, {at}, 1), 16, 10)) % {len(names)} + 1)"
    # Every further attempt adds a syllable, so the space of names grows until all differ.
    stem = lambda s, n: f"array_join(transform(sequence(1, {n} + {attempt}), i -> {pick(SYLLABLES[s], '(i + 3) % 128 + 1')}), '')"
    by_form = lambda endings: "case " + form + " " + " ".join(f"when '{g}' then {pick(e, 1) if isinstance(e, list) else repr(e)}" for g, e in endings.items()) + " else '' end"
    given = [x for s in SYLLABLES for x in (f"{kind} = 'given-{s}'", f"initcap(concat({stem(s, 3)}, {by_form(GIVEN_ENDINGS[s]) if s in GIVEN_ENDINGS else repr('')}))")]
    surname = [x for s in SYLLABLES for x in (f"{kind} = 'surname-{s}'", f"initcap(concat({stem(s, 2 if s == 'han' else 4)}, {by_form(SURNAME_ENDINGS[s]) if s in SURNAME_ENDINGS else repr('')}))")]
    groups = ", ".join(f"`substr`(x, {4 * k}, 4)" for k in range(1, 8))
    body = _when(
        f"{kind} = 'email'", f"concat({_spread(f"substring_index({canon}, '@', 1)", 'x')}, '@', translate(`substr`(x, 100, 10), '0123456789abcdef', 'bcdfghklmnprstvz'), '.example')",
        f"{kind} = 'ip'", "concat_ws('.', '10', conv(`substr`(x, 1, 2), 16, 10), conv(`substr`(x, 3, 2), 16, 10), conv(`substr`(x, 5, 2), 16, 10))",
        f"{kind} = 'ipv6'", f"concat_ws(':', concat('fd', `substr`(x, 1, 2)), {groups})",
        f"{kind} = 'iban'", _bind(f"concat(`substr`({canon}, 1, 2), {_spread(f'`substr`({canon}, 5)', 'x')})", "a", f"concat(`substr`(a, 1, 2), lpad(string(98 - {_mod97("concat(`substr`(a, 3), `substr`(a, 1, 2), '00')")}), 2, '0'), `substr`(a, 3))"),
        f"{kind} = 'national'", f"concat('9', `substr`({_spread(canon, 'x')}, 2))",
        f"{kind} = 'card'", _card(canon),
        f"{kind} = 'phone'", f"concat(regexp_extract({canon}, '^[+]([0-9]+) ', 1), {_spread(f"regexp_replace({canon}, '^[+][0-9]+ ', '')", 'x')})",
        f"{kind} = 'secret'", _secret(canon, attempt),
        *given, *surname,
    )
    return _bind(digest, "x", body)


def _secret(canon: str, attempt: str) -> str:
    """SQL: hexadecimal secrets stay hexadecimal, others keep character classes.

    Punctuation stays, but not where it is all there is or where too few letters and digits leave clashes.
    """
    at = "`substr`(x, i % 128 + 1, 1)"
    hexes = f"array_join(transform(split({canon}, ''), (c, i) -> if(c rlike '[A-F]', upper({at}), {at})), '')"
    hexes = f"if({canon} rlike '[A-F]', upper({hexes}), {hexes})"
    signs = f"translate({at}, '0123456789abcdef', '!#$%&*+,-.;<>?@^')"
    plain = f"{attempt} < 4 and {canon} rlike '[0-9\\\\p{{L}}]'"
    return f"if({canon} rlike '^([0-9a-f]+|[0-9A-F]+)$', {hexes}, {_spread(canon, 'x', f'if({plain}, c, {signs})')})"


def _card(canon: str) -> str:
    """SQL: first digit kept, then keyed digits, then the check digit."""
    stem = f"concat(`substr`({canon}, 1, 1), translate(`substr`(x, 1, length({canon}) - 2), 'abcdef', '135790'))"
    return f"concat({stem}, string(mod(10 - {_luhn(f'concat({stem}, {chr(39)}0{chr(39)})')} % 10, 10)))"


def _shape(m: str, kind: str, made: str) -> str:
    """SQL: a match rewritten with its canonical surrogate ``made`` in the match's own punctuation."""
    at = lambda cls: f"""array_join(transform(split({m}, ''), (c, i) -> if(c rlike '{cls}', `substr`({made}, length(regexp_replace(`substr`({m}, 1, i + 1), '[^{cls[1:-1]}]', '')), 1), c)), '')"""
    return f"""case {kind} when 'email' then {made} when 'ip' then {made} when 'ipv6' then {made}
        when 'secret' then concat(`substr`({m}, 1, length({m}) - length({made})), {made})
        when 'iban' then {at('[A-Z0-9]')}
        else {at('[0-9]')} end"""


def _key(df: DataFrame, key: str | None) -> Column:
    """Two keys derived from the caller's, as a scalar read at run time: plans show that there is one, not what it is."""
    spark = df.sparkSession
    key = key or spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    inner, outer = (hashlib.sha256(f"{key}|{part}".encode()).hexdigest() for part in ("inner", "outer"))
    return spark.createDataFrame([((inner, outer),)], "k struct<inner:string,outer:string>").scalar()


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, canon, form, n: the distinct entities of all texts and how often they occur (pre-aggregated before the shuffle)."""
    text = f"`{text_col}`"
    # No filter on the cut: it would be pushed below and cut every text again.
    cut = docs.select(F.expr(_cut(text)).alias("cut"))
    hit = cut.select(F.explode(F.expr(_matches("cut"))).alias("m"))
    return hit.select(F.explode(F.expr(_entities("m"))).alias("e")).groupBy("e.kind", "e.canon", "e.form").agg(F.count(F.lit(1)).alias("n"))


def settled(found: DataFrame) -> DataFrame:
    """kind, canon, form, several: one row per entity; a name's form is its most frequent gender, none only where no title tells."""
    known = F.struct((F.col("form") != "n"), F.col("n"), F.col("form"))
    return found.groupBy("kind", "canon").agg(F.max_by("form", known).alias("form"), (F.count(F.lit(1)) > 1).alias("several"))


def exceptions(entities: DataFrame, key: Column) -> DataFrame | None:
    """kind, canon, attempt, form of entities whose first surrogate is taken or whose form differs between mentions; None if there are none.

    Raises an error where a surrogate space can't hold the entities.
    """
    now = entities.withColumn("attempt", F.lit(0))
    least, stalled = None, 0
    while True:
        made = now.withColumn("k", key).withColumn("made", F.expr(_surrogate("kind", "canon", "attempt", "form", "k"))).drop("k")
        made = written(made, "surrogates")
        taken = made.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("first")).filter("n > 1")
        shared = made.join(taken, ["kind", "made"]).filter("canon <> first").select("kind", "canon")
        real = made.alias("a").join(entities.alias("b"), F.expr("a.kind = b.kind and lower(a.made) = if(b.kind = 'phone', regexp_replace(b.canon, '[^0-9]', ''), lower(b.canon))"), "left_semi")
        losers = written(shared.unionByName(real.select("kind", "canon")).distinct(), "losers")
        left = losers.count()
        if not left:
            drop_written(losers)
            break
        least, stalled = (left, 0) if least is None or left < least else (least, stalled + 1)
        if stalled >= STALLED:
            raise RuntimeError(f"surrogate space exhausted: {left} entities share a surrogate, as of {[tuple(r) for r in losers.groupBy('kind').count().collect()]}")
        now = made.drop("made").join(losers.withColumn("again", F.lit(1)), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again")
        old, now = (made, losers), written(now, "attempts")
        drop_written(*old)
    moved = written(made.filter("attempt > 0 or several").select("kind", "canon", "attempt", "form"), "exceptions")
    drop_written(made)
    return moved if moved.head(1) else None


def _rewrite(cut: str, key: str, moved: str | None) -> str:
    """SQL: a cut text joined again, every match rewritten, and so the names of its persons where they stand alone."""
    of = lambda e, part, other: f"coalesce(element_at({moved}, concat({e}.kind, '|', {e}.canon)).{part}, {other})" if moved else other
    made = lambda e: _surrogate(f"{e}.kind", f"{e}.canon", of(e, "attempt", "0"), of(e, "form", f"{e}.form"), key)
    title = "regexp_extract(m, '^[^ \\u00a0]+[ \\u00a0]', 0)"
    behind = f"regexp_extract(m, '({'|'.join(t for ts in BEHIND.values() for t in ts)})$', 1)"
    person = f"concat({title}, array_join(transform(es, e -> {made('e')}), ' '), {behind})"
    shaped = _bind(made("es[0]"), "y", _shape("m", "es[0].kind", "y"))
    one = _bind(_entities("m"), "es", _when("size(es) = 0", "m", "es[0].kind rlike '^(given|surname)'", person, shaped))
    # Of a name, the mention whose title tells a gender comes first.
    people = f"array_sort(filter(flatten(transform({_matches(cut)}, m -> {_entities('m')})), e -> e.kind rlike '^(given|surname)'), (a, b) -> if(a.form = 'n', 1, 0) - if(b.form = 'n', 1, 0))"
    bare, tail = "regexp_replace(w, \"['’]s$\", '')", "regexp_extract(w, \"['’]s$\", 0)"
    alone = f"if(w rlike '^\\\\p{{Lu}}' and exists(people, e -> e.canon = lower({bare})), concat({_bind(f'element_at(filter(people, e -> e.canon = lower({bare})), 1)', 'e', made('e'))}, {tail}), w)"
    plain = f"if(size(people) = 0, x, array_join(transform(regexp_extract_all(x, \"[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}'’-]++|[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}'’-]++\", 0), w -> {alone}), ''))"
    whole = f"array_join(transform({cut}, (x, i) -> if(i % 2 = 1, array_join(transform({_parts('x')}, m -> {one}), ''), {plain})), '')"
    return _bind(people, "people", whole)


def replace(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with surrogates in the text."""
    secret = _key(docs, key)
    entities = written(settled(detect(docs, text_col)), "entities")
    moved = exceptions(entities, secret)
    drop_written(entities)
    cut, k = fresh_name(docs, "cut"), fresh_name(docs, "surrogate_key")
    marked = docs.withColumn(cut, F.expr(_cut(f"`{text_col}`"))).withColumn(k, secret)
    if moved is None:
        new = F.when(F.size(cut) > 1, F.expr(_rewrite(cut, k, None))).otherwise(F.col(text_col))
        return marked.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in docs.columns])
    # Texts that hold an exception get its attempts as a map; texts are joined by hash, not by id.
    h, attempts = fresh_name(docs, "text_hash"), fresh_name(docs, "attempts")
    found = docs.select(F.xxhash64(text_col).alias(h), F.expr(_cut(f"`{text_col}`")).alias("cut")).select(h, F.explode(F.expr(_matches("cut"))).alias("m"))
    found = found.select(h, F.explode(F.expr(_entities("m"))).alias("e")).select(h, "e.kind", "e.canon").distinct()
    maps = found.join(moved, ["kind", "canon"]).groupBy(h).agg(
        F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), F.struct("attempt", "form")))).alias(attempts)
    )
    maps = written(maps, "attempts")
    drop_written(moved)
    joined = marked.withColumn(h, F.xxhash64(text_col)).join(maps, h, "left")
    new = F.when(F.size(cut) > 1, F.expr(_rewrite(cut, k, f"coalesce({attempts}, map())"))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in docs.columns])
