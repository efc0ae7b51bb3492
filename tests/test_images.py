import struct
import zlib

from corvina.sources import images


def stream(header, data):
    return b"1 0 obj\n<< /Type /XObject /Subtype /Image " + header + b" >>\nstream\n" + data + b"\nendstream\nendobj\n"


def pixels(png):
    """Width, height, colour type and the unfiltered first column of a PNG."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    width, height, _, colour = struct.unpack(">IIBB", png[16:26])
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    return width, height, colour, zlib.decompress(png[at + 4 : at + 4 + size])


def test_pdf_images():
    gray = bytes(range(6))
    filtered = b"".join(bytes([2]) + bytes(9) for _ in range(2))
    raw = b"%PDF\n<< /Length 3 >>\nstream\nBT \nendstream\n"
    raw += stream(b"/Width 3 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(gray))
    raw += stream(b"/Width 3 /Height 2 /Filter [/FlateDecode] /DecodeParms << /Predictor 15 >>", zlib.compress(filtered))
    raw += stream(b"/Filter /DCTDecode /Width 400 /Height 300", b"\xff\xd8jpeg") + stream(b"/Filter /JPXDecode", b"jp2")
    raw += stream(b"/Width 9 /Height 9 /Filter /FlateDecode", zlib.compress(b"short")) + stream(b"/Width 1 /Height 1 /Filter /FlateDecode", b"broken")
    raw += stream(b"/Width 1 /Height 1 /ColorSpace /DeviceCMYK /Filter /FlateDecode", zlib.compress(b"1234"))
    found = images.pdf_images(raw)
    assert [(i.place, i.mime, i.width) for i in found] == [(1, "image/png", 3), (2, "image/png", 3), (3, "image/jpeg", 400), (4, "image/jp2", None)]
    assert pixels(found[0].content) == (3, 2, 0, b"\0\0\1\2" + b"\0\3\4\5")
    assert pixels(found[1].content) == (3, 2, 2, filtered)
    assert found[2].content == b"\xff\xd8jpeg"
    assert [i.place for i in images.page_like(found)] == [3]
    assert [i.place for i in images.page_like(found[:2] + found[3:])] == [1, 2, 4]


def test_read_images(spark):
    page = stream(b"/Filter /DCTDecode /Width 400 /Height 300", b"\xff\xd8jpeg")
    files = [("a.pdf", None, page), ("b.PNG", None, b"\x89"), ("c", "image/webp", b"webp"), ("d.txt", None, b"text"), ("e.pdf", None, None)]
    df = spark.createDataFrame(files, "path string, mime string, content binary")

    def broken(content, mime):
        raise RuntimeError("busy")

    readers = {"first": broken, "second": lambda c, m: " " if m == "image/webp" else f"{m} {len(c)}"}
    got = {r.path: (r.place, r.model, r.text, r.warning) for r in images.read_images(df, readers).collect()}
    assert got == {"a.pdf": (1, "second", "image/jpeg 6", "first: RuntimeError"), "b.PNG": (1, "second", "image/png 1", "first: RuntimeError"), "c": (1, None, None, "first: RuntimeError; second: no text")}
    assert {r.warning for r in images.read_images(df).collect()} == {"no model"}
