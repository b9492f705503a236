"""Tools that are not part of Spark: child processes in tasks, Ghostscript's rewrite, and a validator's verdicts.

A tool is named by its command. What isn't installed is an error that says so; nothing stands in for it.
"""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import threading
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.archive import verdicts
from foliospark.operators.relational import chunks, first_reason
from foliospark.pdf.model import PdfError

from .options import Options

#: Seconds between asking a process group to end and ending it, bytes of output that are kept, files a validator gets at once.
GRACE = 5.0
MOST_OUTPUT = 64 << 20
MOST_MESSAGES = 64 << 10
BATCH = 32

# Families of clauses, longest prefix first.
CLAUSES = [("6.2.10", "fonts"), ("6.2.11", "fonts"), ("6.2.3", "color"), ("6.2.4", "color"), ("6.2.9", "color"), ("6.2", "graphics"), ("6.3", "annotations"), ("6.4", "forms"), ("6.5", "actions"), ("6.6", "actions or metadata"), ("6.7", "metadata"), ("6.8", "attachments"), ("6.9", "attachments"), ("6.1", "structure"), ("6", "structure")]


class ToolError(PdfError):
    """A tool that is missing, failed, or took too long."""


@dataclass
class Ended:
    code: int
    output: bytes
    messages: str
    late: bool  # ended because its time was over
    cut: bool  # more output than was kept


def _drain(pipe, most: int, out: bytearray, cut: list[bool]) -> None:
    """Reads to the end, so that the process is never held up, and keeps the first bytes."""
    while block := pipe.read(1 << 16):
        cut[0] |= len(out) + len(block) > most
        out += block[: most - len(out)]


def run(command: Sequence[str], given: bytes = b"", seconds: float | None = None, most: int = MOST_OUTPUT, grace: float = GRACE) -> Ended:
    """Runs a command in a process group of its own, with bounded output. After its time the group is asked to end, and
    `grace` seconds later it is ended; so it is when the caller is interrupted."""
    if shutil.which(command[0]) is None:
        raise ToolError(f"{command[0]} is not installed")
    child = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    out, err, cut = bytearray(), bytearray(), [False]

    def feed() -> None:
        try:
            child.stdin.write(given)
            child.stdin.close()
        except OSError:  # the process read less than it was given
            pass

    threads = [threading.Thread(target=feed), threading.Thread(target=_drain, args=(child.stdout, most, out, cut)), threading.Thread(target=_drain, args=(child.stderr, MOST_MESSAGES, err, [False]))]
    for t in threads:
        t.daemon = True
        t.start()
    late = False
    try:
        child.wait(seconds)
    except subprocess.TimeoutExpired:
        late = True
    finally:
        _end(child, grace)
    for t in threads:
        t.join(grace)
    return Ended(child.returncode, bytes(out), err.decode("utf-8", "replace"), late, cut[0])


def _end(child: subprocess.Popen, grace: float) -> None:
    """No process of the group is left, whether or not the first has ended."""
    for sign, wait in ((signal.SIGTERM, grace), (signal.SIGKILL, grace)):
        try:
            os.killpg(child.pid, sign)
        except (ProcessLookupError, PermissionError):
            break
        until = time.monotonic() + wait
        while child.poll() is None and time.monotonic() < until:
            time.sleep(0.01)
    child.wait()


def ghostscript_command(o: Options, program: str = "gs") -> list[str]:
    """Arguments of a rewrite from standard input to standard output, by the options' settings."""
    out = [program, "-q", "-dSAFER", "-dBATCH", "-dNOPAUSE", "-dAutoRotatePages=/None", "-sDEVICE=pdfwrite", f"-dPDFSETTINGS=/{o.quality or 'ebook'}"]
    if o.gray:
        out += ["-sColorConversionStrategy=Gray", "-sProcessColorModel=DeviceGray"]
    if o.cff_fonts:
        out += ["-dConvertTrueTypeToCFF=true"]
    for name, dpi in (("Color", o.dpi), ("Gray", o.gray_dpi or o.dpi), ("Mono", o.mono_dpi)):
        if dpi:
            out += [f"-dDownsample{name}Images=true", f"-d{name}ImageResolution={dpi}", f"-d{name}ImageDownsampleThreshold={o.dpi_threshold:g}"]
    return [*out, "-sOutputFile=%stdout%", "-"]


def rewrite(files: DataFrame, o: Options, program: str = "gs", seconds: float = 900) -> DataFrame:
    """doc_id, output, error of files (doc_id, content) after Ghostscript's rewrite, one process a document."""
    command = ghostscript_command(o, program)
    schema = pa.schema([("doc_id", pa.string()), ("output", pa.binary()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content in zip(b.column(0), b.column(1)):
                try:
                    done = run(command, content.as_py() or b"", seconds)
                    good = done.code == 0 and not done.late and not done.cut and done.output.startswith(b"%PDF-")
                    why = None if good else "took too long" if done.late else "wrote too much" if done.cut else done.messages.strip() or f"ended with {done.code}"
                except ToolError as e:
                    good, why = False, str(e)
                yield pa.RecordBatch.from_pylist([{"doc_id": key.as_py(), "output": done.output if good else None, "error": why and f"{program}: {why}"}], schema=schema)

    return files.select("doc_id", "content").mapInArrow(work, "doc_id string, output binary, error string")


def validate(files: DataFrame, command: Sequence[str], seconds: float = 900) -> DataFrame:
    """doc_id, state (compliant, rejected, failed), clauses of files (doc_id, path, flavour), by a validator that takes
    the flavour and paths and writes a report.

    Files of one flavour go BATCH at a time to one process; where a process fails, its files go one by one.
    """
    schema = pa.schema([("doc_id", pa.string()), ("state", pa.string()), ("clauses", pa.list_(pa.string()))])

    def judged(flavour: str, paths: list[str]) -> dict[str, tuple[str, list[str]]]:
        try:
            done = run([*command, "--flavour", flavour, *paths], seconds=seconds)
            if done.late or done.cut:
                raise ToolError("took too long" if done.late else "wrote too much")
            return verdicts(done.output.decode("utf-8", "replace"), paths)
        except (ToolError, SyntaxError) as e:  # a report that isn't XML is a syntax error of its parser
            if len(paths) == 1:
                return {paths[0]: ("failed", [str(e)])}
            return {p: v for path in paths for p, v in judged(flavour, [path]).items()}

    def work(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        found = judged(rows[0]["flavour"], [r["path"] for r in rows])
        return pa.Table.from_pylist([{"doc_id": r["doc_id"], "state": found[r["path"]][0], "clauses": found[r["path"]][1]} for r in rows], schema=schema)

    dealt = chunks(files.select("doc_id", "path", "flavour"), ["flavour"], ["path"], BATCH)
    return dealt.groupBy("flavour", "batch").applyInArrow(work, "doc_id string, state string, clauses array<string>")


def decision(flavour: Column, converted: Column, output: Column, source: Column) -> Column:
    """publish, warn (publish with a warning) or error, of the validator's states of an output and its input."""
    unconverted = F.when(output == "missing", "warn").when(output == "failed", "error").when(source == "rejected", "warn").otherwise("error")
    return F.when((flavour == "") | (output == "compliant"), "publish").when(converted, "error").otherwise(unconverted)


def prefixed(path: Column, text: Column) -> Column:
    """Every line of a tool's messages after the file that they are about."""
    return F.array_join(F.transform(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n"), lambda line: F.concat(path, F.lit(": "), line)), "\n")


def category(clause: Column) -> Column:
    """What a violated clause is about, by the longest family that it belongs to."""
    return first_reason([((clause == p) | clause.startswith(p + "."), c) for p, c in CLAUSES], "other")


def violations(validated: DataFrame) -> DataFrame:
    """category, clause, files of validate()'s rejections, the most common first."""
    each = validated.where(F.col("state") == "rejected").select("doc_id", F.explode(F.array_distinct("clauses")).alias("clause"))
    return each.groupBy(category(F.col("clause")).alias("category"), "clause").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "clause")


def font_file(name: str, given: Sequence[str] = (), program: str = "fc-match", seconds: float = 60) -> str | None:
    """The file of a font by its name: as given by NAME=PATH, else what the system's lookup finds under that very name."""
    named = dict(g.split("=", 1) for g in given)
    if name in named:
        if not os.path.isfile(named[name]):
            raise ToolError(f"{named[name]}: no such font file")
        return named[name]
    try:
        done = run([program, "--format", "%{family}\n%{file}", name], seconds=seconds)
    except ToolError:
        return None
    family, _, path = done.output.decode("utf-8", "replace").partition("\n")
    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    return path if done.code == 0 and any(plain(f) == plain(name) for f in family.split(",")) and os.path.isfile(path) else None
