"""Images inside PDF files, and text from images by models that are plugged in."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import share_code
from corvina.sources.parsers import format_of

#: Images of a PDF that are looked at, the least side and area of a page-like one, and the least bytes of one of unknown size.
MOST, SIDE, AREA, BYTES = 5, 128, 65_536, 8192
#: Image formats that models take as they are, by extension.
DIRECT = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}


@dataclass(frozen=True)
class Image:
    """place: which of the file's images it is, from 1."""

    place: int
    mime: str
    width: int | None
    height: int | None
    content: bytes


def _number(header: bytes, name: str) -> int | None:
    m = re.search(rb"/" + name.encode() + rb"\s+(\d+)", header)
    return int(m[1]) if m else None


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes, width: int, height: int, gray: bool) -> bytes | None:
    """Eight-bit samples as a PNG. Rows that a PDF has filtered the PNG way begin with their filter's number and are kept so; others get filter 0."""
    row = width * (1 if gray else 3)
    if len(raw) >= height * (row + 1) and all(raw[k * (row + 1)] <= 4 for k in range(height)):
        lines = raw[: height * (row + 1)]
    elif len(raw) >= height * row:
        lines = b"".join(b"\0" + raw[k * row : (k + 1) * row] for k in range(height))
    else:
        return None
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if gray else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def pdf_images(raw: bytes) -> list[Image]:
    """The images of a PDF: JPEG and JPEG 2000 as they are, deflated gray and RGB samples as PNG; others are passed over."""
    out: list[Image] = []
    for m in re.finditer(rb"<<((?:(?!endobj|>>\s*stream).)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", raw, re.S):
        header, data = m[1], m[2]
        if not re.search(rb"/Subtype\s*/Image\b", header):
            continue
        width, height = _number(header, "Width"), _number(header, "Height")
        if b"/DCTDecode" in header:
            out.append(Image(len(out) + 1, "image/jpeg", width, height, data))
        elif b"/JPXDecode" in header:
            out.append(Image(len(out) + 1, "image/jp2", width, height, data))
        elif re.search(rb"/Fl(?:ateDecode)?\b", header) and width and height and (_number(header, "BitsPerComponent") or 8) == 8:
            space = re.search(rb"/ColorSpace\s*/(\w+)", header)
            if space and space[1] not in (b"DeviceGray", b"DeviceRGB"):
                continue
            try:
                png = to_png(zlib.decompress(data), width, height, bool(space) and space[1] == b"DeviceGray")
            except zlib.error:
                png = None
            if png:
                out.append(Image(len(out) + 1, "image/png", width, height, png))
    return out


def page_like(images: list[Image], most: int = MOST) -> list[Image]:
    """The largest images that can be a page, in their order; where none can, the largest of all."""
    area = lambda i: (i.width or 0) * (i.height or 0)
    likely = [i for i in images if (min(i.width, i.height) >= SIDE and area(i) >= AREA if area(i) else len(i.content) >= BYTES)]
    best = sorted(likely or images, key=lambda i: (-(area(i) or len(i.content)), i.place))[:most]
    return sorted(best, key=lambda i: i.place)


#: Takes an image's bytes and media type and returns its text.
Reader = Callable[[bytes, str], str]


def _images(path: str, raw: bytes, mime: str | None) -> list[Image]:
    if format_of(path, mime) == "pdf":
        return page_like(pdf_images(raw))
    kind = (mime or "").split(";")[0].strip().lower()
    kind = kind if kind in DIRECT.values() else DIRECT.get(path.rsplit(".", 1)[-1].lower(), "")
    return [Image(1, kind, None, None, raw)] if kind else []


def read_images(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """binaryFile rows (path, content, and mime if there is one) to path, place, mime, width, height, bytes, model, text, warning.

    A row an image. The models are asked in their order until one gives text; what the others said or how they failed is the
    warning. Without models, images are listed with the warning that none is there.
    """
    share_code(files.sparkSession)

    def text_of(image: Image) -> tuple[str | None, str | None, str | None]:
        said = []
        for name, model in (readers or {}).items():
            try:
                text = (model(image.content, image.mime) or "").strip()
            except Exception as e:  # noqa: BLE001  the model is foreign code
                said.append(f"{name}: {type(e).__name__}")
                continue
            if text:
                return name, text, "; ".join(said) or None
            said.append(f"{name}: no text")
        return None, None, "; ".join(said) or "no model"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i.place, i.mime, i.width, i.height, len(i.content), *text_of(i)) for p, m, c in zip(b["path"], b["mime"], b["content"]) for i in _images(p, bytes(c or b""), m)]
            yield pd.DataFrame(rows, columns=["path", "place", "mime", "width", "height", "bytes", "model", "text", "warning"]).astype({"width": "Int32", "height": "Int32"})

    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    return files.select("path", mime.alias("mime"), "content").mapInPandas(run, "path string, place int, mime string, width int, height int, bytes long, model string, text string, warning string")
