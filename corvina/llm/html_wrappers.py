"""Main-text extraction by union-free regular expressions inferred per host.

A page's token stream is read into nested block elements; a host's pages are aligned one after the
other into one wrapper, a union-free expression over element signatures: equal elements align, in the order of
their mean places; elements that a page has more than once become repeated groups, elements that some page lacks
become optional groups, and texts that differ between pages become slots, while texts that most pages share are
constants. Counts, places and flags only add up, so a wrapper does not depend on the order or the partitions
of its pages. Where a node has too many kinds of children, its rare ones share a general signature per tag. Each
partition folds its pages of a host into one partial wrapper before wrappers are shuffled, so a host with a third
of all pages costs one small row per partition. All pages take part.

Extraction parses a page along its host's wrapper: the content root is the wrapper's article or main
element, or else the element with most slot text; chrome below it is left out, constants of the wrapper
outside an article or the element of the slot texts are template text and left out too. Pages of one host
with the same text vote once, so copies make no constants. A page that its wrapper doesn't describe (no
content root found, or nothing but constants) is aligned on its own.

Edge cases: null and empty html give an empty text; unclosed or stray tags, comments, quotes and
truncated entities are tolerated; pages without a url share a wrapper of the empty host; repeated rows
are extracted each; pages of any length and depth are read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, texts_of, written

#: Bytes of all wrappers up to which they are broadcast; beyond it pages join them.
MAX_BROADCAST = 32 << 20
#: Pages that must agree on a text before it is a constant.
AGREE = 3
#: Depth and kinds of siblings kept of one wrapper (not of a page), characters of a text that a wrapper holds (longer
#: ones are held by digest), and texts of a node kept for each that its fullest page has: wrappers stay small whatever
#: the pages. A text of most pages is never among the rest.
DEPTH, SIBLINGS, SHOWN, TEXTS = 64, 200, 48, 4
#: HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe template noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = set("nav footer aside form button select option input dialog menu svg canvas video audio object head script style textarea noscript iframe template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
SIBLING_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KNOWN = CHROME | HEADINGS | CLOSES_P | set("center td th tr thead tbody tfoot caption figure figcaption details summary search hgroup".split())
CONTAINERS = set("div section table tbody tr td center".split())
SCOPES = set("ul ol dl table article section div main body aside nav header footer form blockquote".split())
#: Words of class, id and role attributes that mark chrome.
MARKS = set("ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar comment comments discussion disqus replies respond reader-comments tags".split())

#: Words that such a word may be joined with; beside any other it says nothing ("related-work").
BESIDE = set("0 area articles aside bar block body bottom box button buttons center column container content desktop element float footer form global group header holder icon icons inline inner item items label layer left link links list main mobile module outer overlay page panel posts primary right row rail secondary section site slot sticky stories text title top unit wrap wrapper zone".split())
#: Elements that no class makes chrome.
TEXTUAL = HEADINGS | {"article", "main", "p", "body"}

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Node:
    """An element: signature, children and text pieces in page order."""

    __slots__ = ("tag", "sig", "chrome", "items")

    def __init__(self, tag: str, sig: str, chrome: bool):
        self.tag, self.sig, self.chrome, self.items = tag, sig, chrome, []


def _node(tag: str, attributes: str) -> Node:
    marks: list[str] = []
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
        marks += re.split(r"[\s_]+", (m[2] or m[3] or m[4] or "").lower())
    marks = [re.sub(r"\d+", "0", x) for x in marks if x]
    told = any(x in MARKS or (ws := set(x.split("-")) - {""}) & MARKS and ws <= MARKS | BESIDE for x in marks)
    return Node(tag, ".".join([tag, *sorted(marks)[:4]]), tag in CHROME or told and tag not in TEXTUAL)


def parse(page: str) -> Node:
    """The page's block structure; inline tags vanish, line breaks are blanks."""
    root = Node("body", "body", False)
    stack, at, size = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # where each tag is open in the stack, so deep pages take no scans
    raw_end: dict[str, re.Pattern] = {}

    def text(s: str) -> None:
        if s:
            items = stack[-1].items
            if items and isinstance(items[-1], str):
                items[-1] += s
            else:
                items.append(s)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    pieces: list[str] = []
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        pieces.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue  # comment, declaration or cut-off tag
        closing = bool(m[1] or m[4])
        if name in INLINE:
            if name == "br" or name == "img":
                pieces.append(" ")
            continue
        text("".join(pieces))
        pieces = []
        if name in ("html", "body"):
            continue
        if closing:
            if places.get(name):
                close(places[name][-1])
            continue
        if name in RAW:
            end = raw_end.setdefault(name, re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I)).search(page, at)
            at = end.end() if end else size
            continue
        if name in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        sibling = last(SIBLING_CLOSES.get(name, ()))
        if sibling > 0 and sibling > last(SCOPES):
            close(sibling)
        node = _node(name, m[3] or m[6] or "")
        stack[-1].items.append(node)
        if name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    text("".join(pieces))
    return root


def clean(s: str) -> str:
    return " ".join(entities.unescape(s).split())


# A wrapper node has a signature s, whether it is chrome c, its pages n, repeated r, the sum of its places p among its
# siblings, items k (child wrapper nodes), texts t (constant candidates: pages that have each as direct text of the
# element; a slot is a text that no two pages share, so it never reaches AGREE), the most texts m of a page, and the
# length z of all its texts. An item is optional where it has fewer pages than its node.


def shown(text: str) -> str:
    """What a wrapper holds of a text: itself, or its length and digest."""
    return text if len(text) <= SHOWN else f"\0{len(text)}:{hashlib.md5(text.encode('utf-8', 'replace')).hexdigest()}"


def length(held: str) -> int:
    return int(held[1:].split(":")[0]) if held[:1] == "\0" else len(held)


def flat(node: Node) -> Iterator[Node | str]:
    """Texts and outermost article and main elements below a node, in page order, chrome left out."""
    todo = node.items[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.tag in ("article", "main") and not x.chrome:
            yield x
        elif not x.chrome:
            todo += x.items[::-1]


def infer(node: Node, depth: int = 1, place: int = 0) -> dict:
    """The wrapper of one page: equal siblings folded into repeated groups.

    Below DEPTH all text counts for the deepest node kept; extraction reads pages at any depth.
    """
    items: dict[str, dict] = {}
    texts: dict[str, int] = {}
    size = 0
    if depth >= DEPTH:
        todo = [*flat(node)]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                size += len(clean(x))
            else:
                todo += flat(x)
    else:
        for x in node.items:
            if isinstance(x, str):
                t = clean(x)
                if t:
                    size += len(t)
                    texts[shown(t)] = 1
                continue
            child = infer(x, depth + 1, len(items))
            if child["s"] in items:
                child = {**merge(items[child["s"]], child, same_page=True), "r": 1}
            items[child["s"]] = child
    return {"s": node.sig, "c": int(node.chrome), "n": 1, "r": 0, "p": place, "k": general(list(items.values()), SIBLINGS, 1), "t": texts, "m": len(texts), "z": size}


def kind_of(sig: str) -> str:
    """The general signature that stands for rare ones of a tag; unknown tags share one."""
    tag = sig.split(".")[0]
    return (tag if tag in KNOWN else "*") + ".*"


def look_up(kids: dict[str, dict], sig: str) -> dict | None:
    return kids.get(sig) or kids.get(kind_of(sig))


def general(items: list[dict], most: int, pages: int) -> list[dict]:
    """Items of a wrapper node in bounded space: no text or page count is lost, signatures of rare items are.

    Beyond ``most`` items, those of the fewest pages become one group per tag. Article and main elements and items of
    most pages go last.
    """
    if len(items) <= most:
        return items
    worth = lambda x: (x["s"].endswith(".*"), x["s"].split(".")[0] in ("article", "main"), x["n"], x["s"])
    kept = {x["s"] for x in sorted(items, key=worth, reverse=True)[: most // 2]}
    groups: dict[str, dict] = {}
    for x in items:
        sig = x["s"] if x["s"] in kept else kind_of(x["s"])
        x = {**x, "s": sig}
        if sig in groups:
            whole = merge(groups[sig], x, same_page=pages == 1)
            whole["n"] = min(whole["n"], pages)
            x = {**whole, "t": {t: min(n, pages) for t, n in whole["t"].items()}, "r": 1}
        groups[sig] = x
    return list(groups.values())


def merge(a: dict, b: dict, same_page: bool = False) -> dict:
    """Two wrappers of one signature as one: equal items align, all counts add up, in whatever order pages come.

    same_page: both are of one page, where a repeated element and its texts count once.
    """
    items = {x["s"]: x for x in a["k"]}
    for y in b["k"]:
        x = items.get(y["s"])
        items[y["s"]] = y if x is None else merge(x, y, same_page)
    n = a["n"] if same_page else a["n"] + b["n"]
    texts = dict(a["t"])
    for t, k in b["t"].items():
        texts[t] = max(texts.get(t, 0), k) if same_page else texts.get(t, 0) + k
    fullest = len(texts) if same_page else max(a["m"], b["m"])
    if not same_page and len(texts) > TEXTS * max(fullest, SIBLINGS):  # rare texts are slots
        texts = dict(sorted(texts.items(), key=lambda kv: (-kv[1], kv[0]))[: TEXTS * max(fullest, SIBLINGS)])
    kept = sorted(items.values(), key=lambda x: (x["p"] / x["n"], x["s"]))
    return {
        "s": a["s"], "c": a["c"], "n": n, "r": a["r"] | b["r"], "p": a["p"] if same_page else a["p"] + b["p"], "k": general(kept, 2 * SIBLINGS, n),
        "t": texts, "m": fullest, "z": a["z"] + b["z"],
    }


def constants(w: dict) -> dict[str, int]:
    return {t: n for t, n in w["t"].items() if n >= AGREE and n > 0.5 * w["n"]}


def slots(w: dict) -> int:
    """Length of the slot texts of an element and all below it, chrome left out."""
    if w["c"]:
        return 0
    return max(0, w["z"] - sum(length(t) * n for t, n in constants(w).items())) + sum(map(slots, w["k"]))


def content_root(w: dict) -> list[str]:
    """Signatures from the body to the content root."""
    best: list[tuple[float, list[str]]] = []
    total = slots
    def walk(p: dict, path: list[str]) -> None:
        tag = p["s"].split(".")[0]
        if p["c"]:
            return
        for k in p["k"]:
            walk(k, [*path, k["s"]])
        rank = 2 if tag == "article" else 1 if tag == "main" or "main" in p["s"].split(".") else 0
        if rank:
            best.append((rank * 1e15 + total(p), path))

    walk(w, [])
    if best:
        return max(best)[1]
    path: list[str] = []
    while True:  # descend while one child holds nearly all slot text
        whole = total(w)
        top = max(w["k"], key=total, default=None)
        if top is None or top["s"].split(".")[0] not in CONTAINERS or total(top) < 0.8 * whole:
            return path
        path.append(top["s"])
        w = top


def mark_core(w: dict, path: list[str]) -> None:
    """Mark the element below the content root that holds the slot texts: all of its text is content."""
    p = w
    for sig in path:
        p = next((k for k in p["k"] if k["s"] == sig), None)
        if p is None:
            return
    while True:
        whole = slots(p)
        top = max(p["k"], key=slots, default=None)
        alone = top is not None and not top["r"]
        if not whole or not alone or top["s"].split(".")[0] not in CONTAINERS or slots(top) < 0.8 * whole:
            break
        p = top
    prose = whole - sum(slots(k) for k in p["k"] if k["s"].split(".")[0] in CONTAINERS)
    if p is not w and whole and prose >= 0.5 * whole:
        p["core"] = 1


def extract(page: Node, w: dict | None) -> str:
    """The page's main text along a wrapper (None: its own)."""
    w = w or infer(page)
    if "path" not in w:
        w["path"] = content_root(w)
        mark_core(w, w["path"])
    path = w["path"]
    roots, patterns = [page], [w]
    for sig in path:
        kids = {k["s"] for p in patterns for k in p["k"]}
        roots = [x for r in roots for x in r.items if isinstance(x, Node) and (x.sig if x.sig in kids else kind_of(x.sig)) == sig]
        patterns = [k for p in patterns for k in p["k"] if k["s"] == sig]
    if path and not roots:
        own = infer(page)
        return extract(page, own) if own is not w and content_root(own) != path else extract_from([page], None, False)
    inside = any(s.split(".")[0] in ("article", "main") for s in path)
    if not inside:  # an article too deep for any wrapper
        for tag in ("article", "main"):
            deep = [x for r in roots for x in flat(r) if isinstance(x, Node) and x.tag == tag]
            if deep:
                return extract_from(deep, None, True)
    return extract_from(roots, patterns[0], inside) or extract_from(roots, None, inside)


def extract_from(roots: list[Node], pattern: dict | None, inside: bool) -> str:
    blocks: list[str] = []

    def level(node: Node, p: dict | None, inside: bool, only: bool) -> tuple:
        p = None if inside or p and "core" in p else p
        fixed = constants(p) if p else ()
        return iter(node.items), fixed, {k["s"]: k for k in p["k"]} if p else {}, inside, only, node.tag

    for r in roots:
        levels = [level(r, pattern, inside, False)]  # no recursion: pages nest to any depth
        while levels:
            items, fixed, kids, within, only, tag = levels[-1]
            x = next(items, None)
            if x is None:
                levels.pop()
            elif isinstance(x, str):
                t = clean(x)
                if t and shown(t) not in fixed and (not only or tag in HEADINGS):
                    blocks.append(t)
            elif not x.chrome:
                header = x.tag == "header"
                if header and not within:
                    continue
                levels.append(level(x, look_up(kids, x.sig), within or x.tag in ("article", "main"), only or header))
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON)."""
    bounded_batches(pages.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict] = {}
        seen: set[bytes] = set()
        for b in batches:
            for url, page, vote in zip(b.column(0).to_pylist(), texts_of(b.column(1)), texts_of(b.column(2))):
                host = host_of(url)
                vote = hashlib.md5(f"{host} {vote}".encode("utf-8", "replace")).digest()
                if vote in seen:
                    continue
                seen.add(vote)
                w = infer(parse(page))
                found[host] = merge(found[host], w) if host in found else w
            if len(found) > 5_000:
                yield pack(found)
                found = {}
        if found:
            yield pack(found)

    def pack(found: dict[str, dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([json.dumps(w) for w in found.values()])], ["host", "wrapper"])

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        done: dict | None = None
        for x in sorted(table["wrapper"].to_pylist()):
            w = json.loads(x)
            done = merge(done, w) if done else w
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(done)]})

    # Pages of one text meet in one partition, where they vote once for a host.
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+", "")
    voters = pages.select("url", "html", F.md5(body).alias("vote")).repartition("vote")
    parts = voters.mapInArrow(partial, "host string, wrapper string")
    # Two rounds: a host on every partition is first folded in 64 places.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    once = salted.groupBy("host", "salt").applyInArrow(fold, "host string, wrapper string")
    return once.groupBy("host").applyInArrow(fold, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    made = written(wrappers(pages), "wrappers")

    def rows(b: pa.RecordBatch, of) -> pa.RecordBatch:
        texts = [extract(parse(page), of(k)) if page else "" for k, page in enumerate(texts_of(b.column(2)))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = "page_id long, url string, text string, n_chars long"
    if (made.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= MAX_BROADCAST:
        shared = spark.sparkContext.broadcast({r.host: slim(r.wrapper) for r in made.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict] = {}
            for b in batches:
                urls = b.column(1).to_pylist()

                def of(k: int) -> dict | None:
                    host = host_of(urls[k])
                    if host not in known:
                        known[host] = json.loads(shared.value[host])
                    return known[host]

                yield rows(b, of)

        return pages.mapInArrow(run, out)

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())], ["page_id", "url", "html", "host"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = b.column(3).to_pylist()
            yield rows(b, lambda k: json.loads(ws[k]) if ws[k] else None)

    both = pages.mapInArrow(hosts, "page_id long, url string, html string, host string").join(made, "host", "left").select("page_id", "url", "html", "wrapper")
    return both.mapInArrow(joined, out)


def slim(wrapper: str) -> str:
    """A wrapper with constants only, as extraction needs it."""

    def cut(w: dict) -> dict:
        return {**w, "t": constants(w), "k": [] if w["c"] else [cut(k) for k in w["k"]]}

    return json.dumps(cut(json.loads(wrapper)))
