from __future__ import annotations

import pytest

from foliospark.operators import archive, attached
from foliospark.pdf.model import PdfError, Ref
from foliospark.pdf.reader import load
from foliospark.pdf.writer import write

from .made import page, pdf, stream

PROFILE = bytes(12) + b"prtr" + b"%s" + bytes(120)


def profile(space):
    return PROFILE.replace(b"%s", space)


def test_output_intents():
    def made(content):
        return load(pdf([*page(4, b"/Resources<<>>"), stream(b"", content)]))

    doc = made(b"1 0 0 rg")
    assert attached.set_output_intent(doc, profile(b"RGB ")) == ["output intent RGB"]
    again = load(write(doc))
    assert again.get(again.deref(again.root[b"OutputIntents"][0]), b"DestOutputProfile").dict[b"N"] == 3
    with pytest.raises(PdfError, match="CMYK"):
        attached.set_output_intent(made(b"0 0 0 1 k"), profile(b"RGB "))
    doc = made(b"1 0 0 rg")
    with pytest.raises(PdfError, match="RGB"):
        attached.set_output_intent(doc, profile(b"CMYK"))
    assert attached.set_output_intent(made(b"1 0 0 rg"), profile(b"CMYK"), profile(b"RGB "))[1] == "default RGB space"
    for bad in (b"", profile(b"Lab "), profile(b"RGB ").replace(b"prtr", b"link")):
        with pytest.raises(PdfError):
            attached.profile_space(bad)


FILES = [
    b"<</Type/Catalog/Pages 2 0 R/Names<</EmbeddedFiles<</Kids[<</Names[(a)<</EF<</F 5 0 R>>/F(note.txt)>>]>>]>>>>>>",
    b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
    b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Annots[6 0 R]/AF 7 0 R>>",
    stream(b"", b""),
    stream(b"", b"note"),
    b"<</Subtype/FileAttachment/FS 7 0 R>>",
    b"<</EF<</F 5 0 R>>/UF(a)>>",
]


def test_attachments():
    doc = load(pdf(FILES))
    assert attached.settle_attachments(doc, archive.LEVELS["3b"]) == 2
    tree = dict(attached.name_tree(doc, doc.get(doc.root, b"Names")[b"EmbeddedFiles"]))
    assert sorted(tree) == [b"a", b"a 2"] and tree[b"a 2"] == Ref(7, 0)
    note = doc.deref(tree[b"a"])
    assert note[b"UF"] == b"note.txt" and note[b"AFRelationship"] == b"Unspecified" and doc.objects[Ref(5, 0)].dict[b"Subtype"] == b"text/plain"
    assert doc.root[b"AF"] == [tree[b"a"]] and doc.objects[Ref(6, 0)][b"AF"] == [Ref(7, 0)]
    assert attached.settle_attachments(load(write(doc)), archive.LEVELS["4"]) == 2
    with pytest.raises(PdfError):
        attached.settle_attachments(load(pdf(FILES)), archive.LEVELS["2b"])
    assert attached.settle_attachments(load(pdf([*page(), stream(b"", b"")])), archive.LEVELS["2b"]) == 0


@pytest.mark.parametrize(("level", "files", "flavour"), [("2b", False, "2b"), ("3b", True, "3b"), ("4", False, "4"), ("4", True, "4f")])
def test_identification(level, files, flavour):
    doc = load(pdf([*page(), stream(b"", b""), b"<</Title(a & b)/Author<FEFF00E9>>>"], b"/Info 5 0 R"))
    attached.identify(doc, archive.LEVELS[level], files)
    again = load(write(doc))
    assert archive.declared_flavour(again) == flavour and (b"Info" in again.trailer) == (level != "4")
    assert "a &amp; b" in again.get(again.root, b"Metadata").raw.decode() and "é" in again.get(again.root, b"Metadata").raw.decode()
