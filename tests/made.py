"""PDFs built byte by byte, with a classic table."""

from __future__ import annotations


def pdf(objects: list[bytes], extra: bytes = b"", pad: bytes = b"") -> bytes:
    out, at = bytearray(b"%PDF-1.4\n" + pad), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, extra, start))


def stream(entries: bytes, raw: bytes, before_end: bytes = b"\n") -> bytes:
    return b"<<" + entries + b"/Length %d>>\nstream\n" % len(raw) + raw + before_end + b"endstream"


def page(contents: int = 4, more: bytes = b"") -> list[bytes]:
    return [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 64 64]/Contents %d 0 R%s>>" % (contents, more)]


def image(bits: int, space: bytes, extra: bytes, raw: bytes, size: tuple[int, int] = (64, 64)) -> bytes:
    """A page that draws object 5, an image."""
    shape = b"/Type/XObject/Subtype/Image/Width %d/Height %d/BitsPerComponent %d/ColorSpace%s%s" % (*size, bits, space, extra)
    return pdf([*page(4, b"/Resources<</XObject<</I 5 0 R>>>>"), stream(b"", b"/I Do"), stream(shape, raw)])
