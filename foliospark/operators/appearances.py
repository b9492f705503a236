"""Appearances for annotations that have none, drawn from their own entries (ISO 32000-2, 12.5.6): shapes, lines, marks
over text, ink, and text fields. What these entries don't say is not made up; such annotations stay without."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from foliospark.pdf.model import Document, Name, Ref, Stream

from .archive import bare_annotations

PAINT = {1: "g", 3: "rg", 4: "k"}
CIRCLE = 0.5522847498  # of a radius, from an arc's end to its control point


def _numbers(doc: Document, value: Any) -> list[float]:
    found = [doc.deref(x) for x in doc.deref(value)] if isinstance(doc.deref(value), list) else []
    return [float(x) for x in found] if all(isinstance(x, (int, float)) for x in found) else []


def _color(doc: Document, d: dict, key: bytes, stroke: bool) -> str:
    values = _numbers(doc, d.get(key))
    op = PAINT.get(len(values), "")
    return " ".join(f"{x:g}" for x in values) + f" {op.upper() if stroke else op}\n" if op else ""


def _width(doc: Document, d: dict) -> float:
    given = doc.get(doc.get(d, b"BS"), b"W")
    border = _numbers(doc, d.get(b"Border"))
    return float(given) if isinstance(given, (int, float)) else border[2] if len(border) > 2 else 1.0


def _path(points: list[float], closed: bool) -> str:
    pairs = list(zip(points[::2], points[1::2]))
    return "".join(f"{x:g} {y:g} {'l' if i else 'm'}\n" for i, (x, y) in enumerate(pairs)) + ("h\n" if closed else "")


def _ellipse(x0: float, y0: float, x1: float, y1: float) -> str:
    cx, cy, rx, ry = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
    arcs = [(1, CIRCLE, CIRCLE, 1, 0, 1), (-CIRCLE, 1, -1, CIRCLE, -1, 0), (-1, -CIRCLE, -CIRCLE, -1, 0, -1), (CIRCLE, -1, 1, -CIRCLE, 1, 0)]
    return f"{cx + rx:g} {cy:g} m\n" + "".join(" ".join(f"{cx + rx * v if i % 2 == 0 else cy + ry * v:g}" for i, v in enumerate(a)) + " c\n" for a in arcs)


def _shape(doc: Document, d: dict, rect: list[float]) -> str:
    """Outlines within the rectangle, and paths of points; filled where an inner color is given."""
    kind, w = doc.name(d, b"Subtype"), _width(doc, d)
    inside = [rect[0] + w / 2, rect[1] + w / 2, rect[2] - w / 2, rect[3] - w / 2]
    fill = _color(doc, d, b"IC", False)
    if kind == b"Square":
        path = f"{inside[0]:g} {inside[1]:g} {inside[2] - inside[0]:g} {inside[3] - inside[1]:g} re\n"
    elif kind == b"Circle":
        path = _ellipse(*inside)
    elif kind == b"Line":
        path = _path(_numbers(doc, d.get(b"L")), False)
    elif kind == b"Ink":
        strokes = doc.get(d, b"InkList")
        path = "".join(_path(_numbers(doc, s), False) for s in strokes) if isinstance(strokes, list) else ""
    else:
        path = _path(_numbers(doc, d.get(b"Vertices")), kind == b"Polygon")
    stroke = _color(doc, d, b"C", True) if w else ""
    paint = {(True, True): "B", (True, False): "f", (False, True): "S"}.get((bool(fill) and kind not in (b"Line", b"Ink", b"PolyLine"), bool(stroke)))
    return f"{stroke}{fill}{w:g} w\n{path}{paint}\n" if path and paint else ""


def _mark(doc: Document, d: dict, rect: list[float]) -> str:
    """Highlights, lines under and through text, by quadrilaterals."""
    quads, kind = _numbers(doc, d.get(b"QuadPoints")), doc.name(d, b"Subtype")
    out = ""
    for i in range(0, len(quads) - 7, 8):
        x, y = quads[i : i + 8 : 2], quads[i + 1 : i + 8 : 2]
        left, right, low, high = min(x), max(x), min(y), max(y)
        if kind == b"Highlight":
            out += f"{left:g} {low:g} {right - left:g} {high - low:g} re f\n"
        else:
            at = low + (high - low) * (0.45 if kind == b"StrikeOut" else 0.08)
            out += f"{left:g} {at:g} m {right:g} {at:g} l S\n"
    color = _color(doc, d, b"C", kind != b"Highlight") or ("1 1 0 rg\n" if kind == b"Highlight" else "0 G\n")
    return color + ("/M gs\n" if kind == b"Highlight" else "") + out if out else ""


def _field(doc: Document, d: dict, rect: list[float]) -> str:
    """A text field's value in its default appearance."""
    value = doc.inherited(d, b"V", 100)
    given = doc.inherited(d, b"DA", 100) or doc.get(doc.get(doc.root, b"AcroForm"), b"DA")
    if doc.inherited(d, b"FT", 100) != b"Tx" or not isinstance(value, bytes) or isinstance(value, Name) or not isinstance(given, bytes):
        return ""
    text = bytes(value).decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else bytes(value).decode("latin-1")
    size = next((float(x) for x, op in zip(given.split(), given.split()[1:]) if op == b"Tf" and x.replace(b".", b"").isdigit()), 0.0) or min(12.0, max(4.0, (rect[3] - rect[1]) * 0.7))
    shown = bytes(given).decode("latin-1")
    words = shown.split()
    if "Tf" in words and words.index("Tf") > 0:
        words[words.index("Tf") - 1] = f"{size:g}"
    lines = "".join(f"<{line.encode('cp1252', 'replace').hex()}> Tj T*\n" for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    y = rect[3] - size if "\n" in text else rect[1] + (rect[3] - rect[1] - size) / 2 + size * 0.2
    return f"/Tx BMC q BT {' '.join(words)} {size * 1.15:g} TL {rect[0] + 2:g} {y:g} Td\n{lines}ET Q EMC\n"


KINDS: dict[bytes, Callable[[Document, dict, list[float]], str]] = dict.fromkeys(b"Square Circle Line Ink Polygon PolyLine".split(), _shape) | dict.fromkeys(b"Highlight Underline StrikeOut Squiggly".split(), _mark) | {b"Widget": _field}


def generate(doc: Document) -> int:
    """Gives annotations without an appearance one, where their entries say what they show; how many got one."""
    made = 0
    for d in bare_annotations(doc):
        rect = _numbers(doc, d.get(b"Rect"))
        draw = KINDS.get(doc.name(d, b"Subtype") or b"")
        if draw is None or len(rect) != 4:
            continue
        rect = [min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3])]
        content = draw(doc, d, rect)
        if not content:
            continue
        resources: dict = {}
        if doc.name(d, b"Subtype") == b"Highlight":
            resources[b"ExtGState"] = {b"M": {b"BM": Name(b"Multiply")}}
        if doc.name(d, b"Subtype") == b"Widget":
            shared = doc.get(doc.get(doc.root, b"AcroForm"), b"DR")
            resources |= shared if isinstance(shared, dict) else {}
        form = Ref(max((x.num for x in doc.objects), default=0) + 1, 0)
        doc.objects[form] = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": rect, b"Resources": resources}, content.encode("latin-1"))
        ap = doc.get(d, b"AP")
        d[b"AP"] = (ap if isinstance(ap, dict) else {}) | {b"N": form}
        made += 1
    return made
