"""Attachments, output intents and identification of archival levels. Results are unverified.

Attachments are three tables: mentions (where a document names a file specification), files (each specification once)
and labels (the name tree). They are read by one pass each, joined by reference, and written back.
"""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from xml.sax.saxutils import escape

from foliospark.pdf.model import Document, Name, PdfError, Ref, Stream, Text

from .archive import PDFAID, Level, annotations, walk
from .usage import device_families, starts

# Classes and spaces of profiles that may state an output, and their channels.
PROFILE_CLASSES = {b"mntr", b"prtr"}
PROFILE_SPACES = {b"GRAY": ("Gray", 1), b"RGB ": ("RGB", 3), b"CMYK": ("CMYK", 4)}
MOST_PROFILE = 64 << 20
XMP = {b"Title": "dc:title", b"Author": "dc:creator", b"Subject": "dc:description", b"Keywords": "pdf:Keywords", b"Creator": "xmp:CreatorTool", b"Producer": "pdf:Producer"}


def _new(doc: Document, value: Any) -> Ref:
    r = Ref(max((x.num for x in doc.objects), default=0) + 1, 0)
    doc.objects[r] = value
    return r


def profile_space(data: bytes) -> tuple[str, int]:
    """Family and channels of a profile that can state an output."""
    if len(data) < 128 or len(data) > MOST_PROFILE:
        raise PdfError("color profile is cut short or too large")
    if data[12:16] not in PROFILE_CLASSES or data[16:20] not in PROFILE_SPACES:
        raise PdfError("color profile is not one of a display or an output in Gray, RGB or CMYK")
    return PROFILE_SPACES[data[16:20]]


def set_output_intent(doc: Document, profile: bytes, rgb: bytes | None = None) -> list[str]:
    """States the output by a profile; RGB content under another profile needs an RGB profile as its default space."""
    family, n = profile_space(profile)
    used, notes = device_families(doc), [f"output intent {family}"]
    if "CMYK" in used and family != "CMYK":
        raise PdfError("the document draws in CMYK, which needs a CMYK profile")
    stream = _new(doc, Stream({b"N": n}, profile))
    intent = {b"Type": Name(b"OutputIntent"), b"S": Name(b"GTS_PDFA1"), b"OutputConditionIdentifier": Text(b"Custom"), b"Info": Text(b"Custom"), b"DestOutputProfile": stream}
    doc.root[b"OutputIntents"] = [_new(doc, intent)]
    if "RGB" in used and family != "RGB":
        if rgb is None or profile_space(rgb)[0] != "RGB":
            raise PdfError("the document draws in RGB, which needs an RGB profile as its default")
        default = _new(doc, [Name(b"ICCBased"), _new(doc, Stream({b"N": 3}, rgb))])
        for c in starts(doc):
            if isinstance(c.resources, dict):
                spaces = doc.get(c.resources, b"ColorSpace")
                spaces = spaces if isinstance(spaces, dict) else {}
                spaces.setdefault(b"DefaultRGB", default)
                c.resources[b"ColorSpace"] = spaces
        notes.append("default RGB space")
    return notes


def name_tree(doc: Document, root: Any) -> Iterator[tuple[bytes, Any]]:
    """Names and values of a tree, in the order of its leaves; a node that comes again is passed over."""
    for node in walk(doc, [root], lambda d: list(doc.get(d, b"Kids") or [])):
        leaves = doc.get(node, b"Names")
        if isinstance(leaves, list):
            names = (doc.deref(x) for x in leaves[::2])
            yield from ((bytes(k), v) for k, v in zip(names, leaves[1::2]) if isinstance(k, bytes))


@dataclass
class Mention:
    """A place that names a file specification: a leaf of the name tree, an association, or an annotation."""

    by: str
    holder: dict
    label: bytes
    value: Any


def mentions(doc: Document) -> list[Mention]:
    names = doc.get(doc.root, b"Names")
    tree = names.get(b"EmbeddedFiles") if isinstance(names, dict) else None
    out = [Mention("label", names, k, v) for k, v in name_tree(doc, tree)] if tree is not None else []
    for value in doc.objects.values():
        holder = value.dict if isinstance(value, Stream) else value
        if isinstance(holder, dict) and b"AF" in holder:
            given = doc.deref(holder[b"AF"])
            out += [Mention("association", holder, b"", x) for x in (given if isinstance(given, list) else [holder[b"AF"]])]
    out += [Mention("annotation", d, b"", d[b"FS"]) for d in annotations(doc) if doc.name(d, b"Subtype") == b"FileAttachment" and b"FS" in d]
    return out


def file_table(doc: Document) -> tuple[dict[Ref, dict], list[Mention]]:
    """Specifications that hold files, each once, and their mentions; a direct specification becomes an object."""
    files: dict[Ref, dict] = {}
    numbers: dict[int, Ref] = {}
    told = mentions(doc)
    for m in told:
        spec = doc.deref(m.value)
        if isinstance(spec, dict) and b"EF" in spec:
            if not isinstance(m.value, Ref):
                m.value = numbers[id(spec)] = numbers.get(id(spec)) or _new(doc, spec)
            files[m.value] = spec
    return files, told


def _title(doc: Document, spec: dict, number: int) -> bytes:
    """The file's own name: the Unicode one, else the other, else one of its number."""
    strings = [v for k in (b"UF", b"F") if isinstance(v := doc.get(spec, k), bytes) and not isinstance(v, Name)]
    return strings[0] if strings else Text(b"file %d" % number)


def settle_attachments(doc: Document, level: Level) -> int:
    """Names, kinds and relations of attached files as ISO 19005 wants them at a level; how many there are."""
    files, told = file_table(doc)
    if files and level.attachments == "refused":
        raise PdfError(f"the level allows no attachment that isn't archival itself, and there are {len(files)}; strip attachments")
    if not files:
        return 0
    titles = {r: _title(doc, spec, i) for i, (r, spec) in enumerate(files.items(), 1)}
    for r, spec in files.items():
        spec |= {b"F": titles[r], b"UF": titles[r], b"AFRelationship": spec.get(b"AFRelationship", Name(b"Unspecified"))}
        guess = mimetypes.guess_type(bytes(titles[r]).decode("latin-1"))[0] or "application/octet-stream"
        streams = [s for s in map(doc.deref, (doc.get(spec, b"EF") or {}).values()) if isinstance(s, Stream)]
        for s in streams:
            s.dict[b"Subtype"] = s.dict.get(b"Subtype", Name(guess.encode()))
    labels = {m.label: m.value for m in told if m.by == "label"}
    listed = {v for v in labels.values() if isinstance(v, Ref)}
    for r in (r for r in files if r not in listed):
        free = (k for i in range(len(labels) + 2) if (k := bytes(titles[r]) + (b" %d" % (i + 1) if i else b"")) not in labels)
        labels[next(free)] = r
    tree = {b"Names": [x for k in sorted(labels) for x in (Text(k), labels[k])]}
    names = doc.get(doc.root, b"Names")
    doc.root[b"Names"] = (names if isinstance(names, dict) else {}) | {b"EmbeddedFiles": tree}
    linked: dict[int, tuple[dict, list]] = {}
    for m in told:
        if m.by == "association":
            linked.setdefault(id(m.holder), (m.holder, []))[1].append(m.value)
        elif m.by == "annotation":
            m.holder[b"FS"] = m.value
            if level.attachments == "associated" and isinstance(m.value, Ref) and m.value in files:
                linked.setdefault(id(m.holder), (m.holder, []))[1].append(m.value)
    if level.attachments == "associated" and (loose := sorted(files.keys() - {r for _, rs in linked.values() for r in rs if isinstance(r, Ref)})):
        linked.setdefault(id(doc.root), (doc.root, []))[1].extend(loose)
    for holder, values in linked.values():
        holder[b"AF"] = [v for i, v in enumerate(values) if v not in values[:i]]
    return len(files)


def _unicode(value: Any) -> str:
    raw = bytes(value) if isinstance(value, bytes) else b""
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def identify(doc: Document, level: Level, attachments: bool = False) -> None:
    """A fresh packet of metadata that names the level; the newest part has no information dictionary."""
    info = doc.deref(doc.trailer.get(b"Info"))
    said = {XMP[k]: escape(_unicode(v)) for k, v in (info or {}).items() if k in XMP and isinstance(doc.deref(v), bytes)}
    body = "".join(
        f"<{k}><rdf:Alt><rdf:li xml:lang=\"x-default\">{v}</rdf:li></rdf:Alt></{k}>" if k in ("dc:title", "dc:description") else f"<{k}><rdf:Seq><rdf:li>{v}</rdf:li></rdf:Seq></{k}>" if k == "dc:creator" else f"<{k}>{v}</{k}>"
        for k, v in said.items()
    )
    conformance = level.conformance or ("F" if attachments else "")
    body += f"<pdfaid:part>{level.part}</pdfaid:part>" + (f"<pdfaid:conformance>{conformance}</pdfaid:conformance>" if conformance else "") + ("<pdfaid:rev>2020</pdfaid:rev>" if level.part == 4 else "")
    packet = (
        '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        f'<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:pdfaid="{PDFAID}">{body}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    )
    doc.root[b"Metadata"] = _new(doc, Stream({b"Type": Name(b"Metadata"), b"Subtype": Name(b"XML")}, packet.encode()))
    if level.part == 4:
        doc.trailer.pop(b"Info", None)
