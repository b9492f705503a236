from __future__ import annotations

import contextlib
import stat
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import appearances, archive, extraction, usage
from foliospark.pdf.model import Ref
from foliospark.pdf.reader import load
from foliospark.plans import tools
from foliospark.plans.options import Options, resolve

from .made import page, pdf, stream


def script(path, text):
    path.write_text("#!/bin/sh\n" + text)
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


def test_child_processes(tmp_path):
    done = tools.run(["sh", "-c", "cat; echo no >&2; exit 3"], b"given")
    assert (done.code, done.output, done.messages, done.late, done.cut) == (3, b"given", "no\n", False, False)
    done = tools.run(["sh", "-c", "head -c 100000 /dev/zero"], most=1000)
    assert len(done.output) == 1000 and done.cut and done.code == 0
    with pytest.raises(tools.ToolError, match="not installed"):
        tools.run(["no-such-tool-here"])


def test_late_processes_end_with_their_children(tmp_path):
    began = time.monotonic()
    done = tools.run(["sh", "-c", f"trap '' TERM; (trap '' TERM; sleep 60) & echo $! > {tmp_path}/pid; sleep 60"], seconds=0.3, grace=0.5)
    assert done.late and done.code < 0 and time.monotonic() - began < 10
    state = f"/proc/{int((tmp_path / 'pid').read_text())}/stat"
    time.sleep(0.2)
    with contextlib.suppress(FileNotFoundError):  # ended, though nobody may have asked for its status yet
        assert open(state).read().rsplit(")", 1)[1].split()[0] == "Z"


def test_rewrites_by_a_tool(spark, tmp_path):
    good = script(tmp_path / "good", 'test "$1" = -q || exit 9\ncat\n')
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.4 x")), ("b", bytearray(b"no"))], "doc_id string, content binary")
    got = {r.doc_id: (r.output and bytes(r.output), bool(r.error)) for r in tools.rewrite(files, Options(), good).collect()}
    assert got == {"a": (b"%PDF-1.4 x", False), "b": (None, True)}
    assert "not installed" in tools.rewrite(files, Options(), "no-such-tool-here").first().error
    slow = script(tmp_path / "slow", "sleep 60\n")
    assert "too long" in tools.rewrite(files.limit(1), Options(), slow, seconds=0.2).first().error
    command = tools.ghostscript_command(resolve({"engine": "ghostscript", "quality": "printer", "dpi": 150}))
    assert "-dPDFSETTINGS=/printer" in command and "-dColorImageResolution=150" in command and command[-1] == "-"


def test_validator_batches(spark, tmp_path):
    """40 files of one flavour make two batches; a batch with a file that breaks the tool is repeated one by one."""
    tool = script(tmp_path / "tool", f"""echo $# >> {tmp_path}/calls
shift 2
echo "<report><jobs>"
for f in "$@"; do
  case $f in *bad*) exit 1;; esac
  case $f in *7) ok=false; rule='<rule clause="6.1" status="failed"/>';; *) ok=true; rule='';; esac
  echo "<job><item><name>$f</name></item><validationReport isCompliant=\\"$ok\\">$rule</validationReport></job>"
done
echo "</jobs></report>"
""".replace('\\\\"', '\\"'))
    rows = [(str(i), f"/in/{i:02}", "2b") for i in range(40)] + [("x", "/in/zbad", "2b"), ("y", "/in/y", "4")]
    got = {r.doc_id: (r.state, r.clauses) for r in tools.validate(spark.createDataFrame(rows, "doc_id string, path string, flavour string"), [tool]).collect()}
    assert len(got) == 42 and got["7"] == ("rejected", ["6.1"]) and got["8"] == ("compliant", []) and got["x"][0] == "failed" and got["y"][0] == "compliant"
    calls = sorted(int(x) - 2 for x in (tmp_path / "calls").read_text().split())
    assert calls == sorted([32, 9, *[1] * 9, 1])


def test_prefixed_messages(spark):
    df = spark.createDataFrame([("a.pdf", "one\r\ntwo\n"), ("b.pdf", "")], "path string, text string")
    assert [r[0] for r in df.select(tools.prefixed(F.col("path"), F.col("text"))).collect()] == ["a.pdf: one\na.pdf: two", "b.pdf: "]


def test_appearances():
    kinds = [
        b"<</Subtype/Square/Rect[0 0 10 20]/C[1 0 0]/IC[0.5]/BS<</W 2>>>>", b"<</Subtype/Circle/Rect[0 0 10 10]/C[0 0 0 1]>>", b"<</Subtype/Line/Rect[0 0 9 9]/L[1 2 3 4]/C[0]>>",
        b"<</Subtype/Ink/Rect[0 0 9 9]/InkList[[1 1 2 2 3 1][5 5 6 6]]/C[0]>>", b"<</Subtype/Polygon/Rect[0 0 9 9]/Vertices[1 1 5 1 3 4]/IC[0 1 0]/C[]>>", b"<</Subtype/Highlight/Rect[0 0 50 9]/QuadPoints[0 9 50 9 0 0 50 0]>>",
        b"<</Subtype/Underline/Rect[0 0 50 9]/QuadPoints[0 9 50 9 0 0 50 0]/C[0 0 1]>>", b"<</Subtype/Widget/FT/Tx/V(typed)/DA(/Helv 0 Tf 0 g)/Rect[0 0 50 12]>>", b"<</Subtype/Stamp/Rect[0 0 9 9]>>", b"<</Subtype/Square/Rect[0 0 9 9]>>",
    ]
    refs = b" ".join(b"%d 0 R" % (5 + i) for i in range(len(kinds)))
    doc = load(pdf([*page(4, b"/Annots[" + refs + b"]"), stream(b"", b""), *kinds]))
    assert appearances.generate(doc) == 8 and len(archive.bare_annotations(doc)) == 2
    shown = [doc.deref(doc.get(doc.objects[Ref(5 + i, 0)], b"AP")[b"N"]) for i in range(8)]
    said = [s.raw.decode() for s in shown]
    assert said[0] == "1 0 0 RG\n0.5 g\n2 w\n1 1 8 18 re\nB\n" and said[1].count(" c\n") == 4 and said[1].startswith("0 0 0 1 K")
    assert said[2].endswith("1 2 m\n3 4 l\nS\n") and said[3].count(" m\n") == 2 and said[4].endswith("h\nf\n")
    assert "0 0 50 9 re f" in said[5] and doc.get(shown[5], b"Resources")[b"ExtGState"][b"M"][b"BM"] == b"Multiply" and " l S" in said[6]
    assert b"typed".hex() in said[7] and "/Helv 8.4 Tf" in said[7]
    assert all(s.dict[b"Subtype"] == b"Form" for s in shown) and appearances.generate(doc) == 0


def test_forms_under_several_resources_are_separated():
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2>>", b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</XObject<</F 6 0 R>>/Font<</A 7 0 R>>>>>>", b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Resources<</XObject<</F 6 0 R>>/Font<</A 8 0 R>>>>>>", stream(b"", b"/F Do")]
    fonts = [b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/%s]>>>>" % n for n in (b"x", b"y")]
    doc = load(pdf([*objects, stream(b"/Subtype/Form", b"BT /A 9 Tf (A) Tj ET"), *fonts]))
    before = [extraction.page_text(doc, p) for p in doc.pages()]
    assert usage.separate(doc) == 1 and usage.separate(doc) == 0
    forms = [doc.get(doc.inherited(p, b"Resources"), b"XObject")[b"F"] for p in doc.pages()]
    assert forms[0] != forms[1] and doc.get(doc.deref(forms[1]), b"Resources")[b"Font"][b"A"] == Ref(8, 0)
    assert [extraction.page_text(doc, p) for p in doc.pages()] == before == ["x\n", "y\n"]
    same = load(pdf([*objects, stream(b"/Subtype/Form/Resources<<>>", b"q Q"), *fonts]))
    assert usage.separate(same) == 0


def test_violations_and_font_files(spark, tmp_path):
    rows = [("a", "rejected", ["6.2.4.1", "6.1", "6.1"]), ("b", "rejected", ["6.1"]), ("c", "compliant", []), ("d", "failed", ["6.9"])]
    got = tools.violations(spark.createDataFrame(rows, "doc_id string, state string, clauses array<string>")).collect()
    assert [tuple(r) for r in got] == [("structure", "6.1", 2), ("color", "6.2.4.1", 1)]
    (tmp_path / "x.ttf").write_bytes(b"font")
    lookup = script(tmp_path / "lookup", f'printf "Other Sans,Deja Vu\\n{tmp_path}/x.ttf"\n')
    assert tools.font_file("DejaVu", program=lookup) == f"{tmp_path}/x.ttf" and tools.font_file("Nothing", program=lookup) is None
    assert tools.font_file("A", [f"A={tmp_path}/x.ttf"]) == f"{tmp_path}/x.ttf" and tools.font_file("A", program="no-such-tool-here") is None
    with pytest.raises(tools.ToolError):
        tools.font_file("A", [f"A={tmp_path}/none"])
