"""Chunks that end where the text does: cut points at headings and sentence ends, chosen for a whole text at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvina.session import share_code

SIZE, BAND = 2000, 0.2
#: What ending a chunk before this kind of place costs, in shares of a chunk's size squared: heading, paragraph, sentence, anywhere.
COSTS = {"heading": 0.0, "paragraph": 0.05, "sentence": 0.15, "cut": 1.0}
HEADING = re.compile(r"(?m)^(?:#{1,6} \S.*|[A-Z0-9][^\n.!?]{0,78})$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
PARAGRAPH = re.compile(r"\n\s*\n\s*")


def places(text: str, size: int) -> list[tuple[int, str]]:
    """Offsets at which a chunk may begin, with the best kind of each; the text's end is one of them.

    Where two natural places are further apart than a chunk may be long, places in steps of ``size`` lie between.
    """
    found = {m.end(): "sentence" for m in SENTENCE.finditer(text)}
    found |= {m.end(): "paragraph" for m in PARAGRAPH.finditer(text)}
    lines = {m.start() for m in HEADING.finditer(text)}
    # A line is a heading if a blank line, or the text's start, is before it and text follows.
    found |= {at: "heading" for at in lines if at in found and found[at] == "paragraph" and text.find("\n", at) >= 0}
    found = {at: k for at, k in found.items() if 0 < at < len(text)}
    out, before = [], 0
    for at in [*sorted(found), len(text)]:
        while at - before > size:
            before += size
            out.append((before, "cut"))
        if at > before:
            out.append((at, found.get(at, "heading")))
        before = at
    return out


def cuts(text: str, size: int = SIZE, band: float = BAND) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of the chunks of a text with the least cost; of equal costs the longest first chunks.

    A chunk between places costs what its end costs and the square of its length's distance from ``size``, in sizes, beyond
    the band; none is longer than (1 + band) * size. The last chunk may be short. Dynamic programming from the end:
    a place looks only as far ahead as a chunk may reach.
    """
    if not text:
        return []
    at = [(0, "heading"), *places(text, size)]
    n, most = len(at) - 1, size * (1 + band)
    best: list[float] = [0.0] * (n + 1)
    following = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = float("inf")
        j = i + 1
        while j <= n and (at[j][0] - at[i][0] <= most or j == i + 1):
            cost = _cost(at[j][0] - at[i][0], at[j][1], j == n, size, band) + best[j]
            if cost <= best[i]:
                best[i], following[i] = cost, j
            j += 1
    out, i = [], 0
    while i < n:
        j = following[i]
        out.append((at[i][0], at[j][0], "end" if j == n else at[j][1]))
        i = j
    return out


def _cost(length: int, kind: str, last: bool, size: int, band: float) -> float:
    off = abs(length - size) / size - band
    if last and length <= size:
        off = 0.0
    return max(0.0, off) ** 2 + (0.0 if last else COSTS[kind])


def chunk_at_boundaries(docs: DataFrame, size: int = SIZE, band: float = BAND) -> DataFrame:
    """docs(doc_id, text) to doc_id, chunk_index, start, end, section (the heading it or an earlier chunk begins with), boundary, content.

    Texts are cut whole and independently, a batch at a time. Chunks put together are the text; null and empty texts have none.
    """
    share_code(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for k, text in enumerate(b.column(1).to_pylist()):
                section, begins = None, "heading"
                for number, (start, end, boundary) in enumerate(cuts(text or "", size, band)):
                    content = text[start:end]
                    line, more, _ = content.partition("\n")
                    if begins == "heading" and more and HEADING.fullmatch(line):
                        section = line.lstrip("# ").strip()
                    begins = boundary
                    for column, value in zip(rows, (k, number, start, end, section, boundary, content)):
                        column.append(value)
            ids = b.column(0).take(pa.array(rows[0], pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(rows[1:], kinds)]], ["doc_id", "chunk_index", "start", "end", "section", "boundary", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_index int, start int, end int, section string, boundary string, content string")
