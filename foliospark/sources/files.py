"""Files in: listing as a DataFrame. Files out: publishing that never replaces."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.pdf.model import PdfError

MAGIC = b"%PDF-"
LARGEST_U32 = (1 << 32) - 1
#: Files that a task reads, together.
TASK_BYTES = 128 << 20


#: What stands before .pdf in the names of outputs.
SUFFIX = "compressed"


def is_own_output(name: str, suffix: str = SUFFIX) -> bool:
    """NAME.SUFFIX.pdf or NAME.SUFFIX.N.pdf of an earlier run, N within 32 bits."""
    m = re.search(rf"\.{re.escape(suffix)}(?:\.(\d+))?\.pdf\Z", name, re.I | re.ASCII)
    return bool(m) and (m[1] is None or int(m[1]) <= LARGEST_U32)


def walk(root: Path, recursive: bool) -> Iterator[Path]:
    """PDF files below a folder, in byte order; hidden names, links and special files below it are passed over."""
    for entry in sorted(os.scandir(root), key=lambda e: os.fsencode(e.name)):
        if entry.name.startswith(".") or entry.is_symlink():
            continue
        if entry.is_dir():
            if recursive:
                yield from walk(Path(entry.path), recursive)
        elif entry.is_file() and entry.name.lower().endswith(".pdf") and not is_own_output(entry.name):
            yield Path(entry.path)


def expand(inputs: Iterable[str], recursive: bool = False) -> list[tuple[str, str]]:
    """(path, path under its root) of the inputs in order; a file that is named again counts once."""
    out, seen = [], set()
    for i in inputs:
        p = Path(i)
        if not p.exists():
            raise PdfError(f"{i}: no such file")
        for f in walk(p, recursive) if p.is_dir() else [p]:
            if (real := f.resolve()) not in seen:
                seen.add(real)
                out.append((str(f), str(f.relative_to(p)) if p.is_dir() else f.name))
    if not out:
        raise PdfError("no PDF files")
    return out


def read_files(spark: SparkSession, inputs: Iterable[str], recursive: bool = False) -> DataFrame:
    """doc_id, ordinal, path, relative, length, mtime, content, error of the inputs.

    Paths are listed on the driver and read by the tasks, one row a file, so the folder must be shared. What isn't a
    regular file or doesn't start like a PDF is a row with an error.
    """
    rows = [(path, i, path, relative) for i, (path, relative) in enumerate(expand(inputs, recursive))]
    schema = pa.schema([("doc_id", pa.string()), ("ordinal", pa.int64()), ("path", pa.string()), ("relative", pa.string()), ("length", pa.int64()), ("mtime", pa.float64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                row |= {"length": None, "mtime": None, "content": None, "error": None}
                try:
                    fd = os.open(row["path"], os.O_RDONLY | os.O_NONBLOCK)
                    with os.fdopen(fd, "rb") as f:
                        stat = os.fstat(fd)
                        if not os.path.isfile(row["path"]):
                            raise OSError("not a regular file")
                        data = f.read()
                    row |= {"length": len(data), "mtime": stat.st_mtime, "content": data}
                    if not data.startswith(MAGIC):
                        row |= {"content": None, "error": "not a PDF"}
                except OSError as e:
                    row["error"] = e.strerror or str(e)
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    frame = spark.createDataFrame(rows, "doc_id string, ordinal long, path string, relative string")
    size = sum(os.stat(r[0]).st_size if os.path.isfile(r[0]) else 0 for r in rows)
    slices = min(len(rows), max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    return frame.repartition(slices, F.col("ordinal")).mapInArrow(run, "doc_id string, ordinal long, path string, relative string, length long, mtime double, content binary, error string")


def default_output(path: str) -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}.{SUFFIX}{p.suffix or '.pdf'}"))


def free_name(path: str, collision: str, reserved: set[str]) -> str:
    """The path, or with collision "number" the first of path.1, path.2 … that is neither there nor reserved."""
    taken = lambda p: p in reserved or os.path.lexists(p)
    if not taken(path):
        return path
    if collision == "error":
        raise PdfError(f"{path}: already exists")
    p, n = Path(path), 1
    while taken(str(q := p.with_name(f"{p.stem}.{n}{p.suffix}"))):
        n += 1
    return str(q)


def reserve(paths: Iterable[str], outputs: tuple[str, ...], collision: str) -> list[str]:
    """Every destination, before anything is written."""
    paths, reserved, out = list(paths), set(), []
    if outputs and len(outputs) not in (1, len(paths)):
        raise PdfError("one output, or one for each input")
    if len(outputs) == 1 and len(paths) > 1 and not os.path.isdir(outputs[0]):
        raise PdfError("several inputs need a folder as output")
    for i, p in enumerate(paths):
        named = outputs[i] if len(outputs) == len(paths) else os.path.join(outputs[0], os.path.basename(p)) if outputs else default_output(p)
        if os.path.isdir(named):
            named = os.path.join(named, os.path.basename(default_output(p)))
        found = free_name(named, collision, reserved)
        reserved.add(found)
        out.append(found)
    return out


def publish(data: bytes, path: str, mtime: float | None = None, again: bool = False) -> None:
    """Writes next to the destination and links it there; an existing file is never replaced.

    again: a file of the same bytes counts as published, as by a task that ran before and was lost.
    """
    stage = f"{path}.{uuid4().hex}.part"
    try:
        with os.fdopen(os.open(stage, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if mtime is not None:
            os.utime(stage, (mtime, mtime))
        os.link(stage, path)
    except FileExistsError:
        if not (again and os.path.isfile(path) and Path(path).read_bytes() == data):
            raise PdfError(f"{path}: already exists") from None
    finally:
        if os.path.exists(stage):
            os.unlink(stage)
