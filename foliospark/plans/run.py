"""A run over files: list, reserve destinations, compress and publish in tasks, report in input order."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import extraction
from foliospark.operators.inline import externalize
from foliospark.operators.relational import cut
from foliospark.pdf.model import PdfError
from foliospark.pdf.reader import load
from foliospark.sources import files

from . import legacy, pipeline
from .options import DEFAULTS, OptionError, Options, load_profiles, parse_bool, parse_int, read_password, resolve, runnable, save_profile

#: Passwords come from files only.
SECRETS = {"password-file": "password", "encrypt-user-file": "encrypt_user", "encrypt-owner-file": "encrypt_owner"}
SHORT = {"o": "outputs", "output": "outputs", "mono-dpi": "mono_dpi", "convert-fonts-cff": "cff_fonts"}


def run(spark: SparkSession, inputs: Iterable[str], options: Options, out: TextIO | None = None) -> list[str]:
    """Compresses files, publishes outputs in the order of the inputs and writes a line for each; the failures.

    A file that fails does not stop the others. Destinations are settled before anything is written.
    """
    runnable(options)
    out = out or sys.stdout
    listed = files.expand(inputs, options.recursive)
    paths = [p for p, _ in listed]
    if options.extract:
        return extract(spark, paths, options, out)
    targets = files.reserve(paths, options.outputs, options.collision)
    read = files.read_files(spark, paths)
    done = pipeline.compress_files(read.where("error is null"), options).select("ordinal", "output", "before", "after", "error")
    rows = read.select("ordinal", "mtime", F.col("error").alias("unread")).join(done, "ordinal", "left")
    line = pipeline.report_line(F.col("target"), F.col("before"), F.col("after"), options.required_output, options.images)
    named = spark.createDataFrame(list(enumerate(targets)), "ordinal long, target string")
    ready = rows.join(named, "ordinal").select("ordinal", F.coalesce("unread", "error").alias("error"), "output", "target", F.col("mtime") if options.timestamps == "preserve" else F.lit(None).cast("double"), line.alias("line"))
    return _told(_published(ready), paths, out)


def _published(ready: DataFrame) -> DataFrame:
    """ordinal, line, error of results (ordinal, error, output, target, mtime, line), which the tasks write to their
    targets; no content comes to the driver. A task that runs again finds its own file, and that is no error."""

    def work(row: dict) -> Iterator[dict]:
        if not row["error"]:
            try:
                files.publish(row["output"], row["target"], row["mtime"], again=True)
            except (PdfError, OSError) as e:
                row["error"] = str(e)
        yield {k: row[k] for k in ("ordinal", "line", "error")}

    return ready.mapInArrow(pipeline.batches(["ordinal", "line", "error"], [pa.int64(), pa.string(), pa.string()], work, 64), "ordinal long, line string, error string")


def _told(done: DataFrame, paths: list[str], out: TextIO) -> list[str]:
    """Prints the lines in input order and returns the failures; rows of a line each come some at a time."""
    failures = []
    for r in cut(done).orderBy("ordinal").toLocalIterator():
        if r["error"]:
            failures.append(f"{paths[r['ordinal']]}: {r['error']}")
        else:
            print(r["line"], file=out)
    return failures


def extract(spark: SparkSession, paths: list[str], options: Options, out: TextIO) -> list[str]:
    """Text to NAME.txt, images to a new folder NAME-images; the tasks write them."""
    kind, inline = options.extract, options.inline_images
    named, failures, taken = [], [], set()
    for i, path in enumerate(paths):
        wanted = options.outputs[0] if options.outputs else os.path.splitext(path)[0] + (".txt" if kind == "text" else "-images")
        try:
            target = files.free_name(wanted, options.collision, taken)
        except PdfError as e:
            failures.append(f"{path}: {e}")
            continue
        taken.add(target)
        named.append((i, target))
    if not named:
        return failures

    def work(row: dict) -> Iterator[dict]:
        n, error = 0, row["error"]
        try:
            if not error:
                doc = load(row["content"])
                if kind == "text":
                    pages = [extraction.page_text(doc, p) for p in doc.pages()]
                    files.publish("".join(t + "\f" for t in pages).encode(), row["target"], again=True)
                    n = len(pages)
                else:
                    if inline:
                        externalize(doc)
                    made = list(extraction.images(doc))
                    os.makedirs(row["target"], 0o700, exist_ok=True)
                    for name, data in made:
                        files.publish(data, os.path.join(row["target"], name), again=True)
                    n = len(made)
        except (PdfError, OSError) as e:
            error = str(e)
        yield {"ordinal": row["ordinal"], "line": f"{row['target']}: {n} {'pages' if kind == 'text' else 'images'}", "error": error}

    read = files.read_files(spark, paths).select("ordinal", "content", "error").join(spark.createDataFrame(named, "ordinal long, target string"), "ordinal")
    done = read.mapInArrow(pipeline.batches(["ordinal", "line", "error"], [pa.int64(), pa.string(), pa.string()], work, 64), "ordinal long, line string, error string")
    return failures + _told(done, paths, out)


def parse_arguments(arguments: list[str]) -> tuple[dict[str, object], list[str], dict[str, object]]:
    """Options, inputs and the profile, from flags anywhere: one or two dashes, =value or the next argument, -- ends them."""
    flags: dict[str, object] = {}
    inputs: list[str] = []
    extra = {"profile": [], "profile-entry": "", "save-profile": ""}
    todo = list(arguments)
    while todo:
        a = todo.pop(0)
        if a == "--":
            inputs += todo
            break
        if not a.startswith("-") or a == "-":
            inputs.append(a)
            continue
        name, has, value = a.lstrip("-").partition("=")
        field = SHORT.get(name, name.replace("-", "_"))
        if name in SECRETS:
            if not has:
                value = todo.pop(0) if todo else ""
            flags[SECRETS[name]] = read_password(value)
            continue
        if name not in extra and (not hasattr(DEFAULTS, field) or field in SECRETS.values()):
            raise OptionError(f"unknown option {a}")
        kind = "" if name in extra else getattr(DEFAULTS, field)
        if isinstance(kind, bool):
            flags[field] = parse_bool(value) if has else True
            continue
        if not has:
            if not todo:
                raise OptionError(f"{a} needs a value")
            value = todo.pop(0)
        if name == "profile":
            extra["profile"].append(value)
        elif name in extra:
            extra[name] = value
        elif field == "metadata":
            key, eq, v = value.partition("=")
            if not eq:
                raise OptionError("metadata: KEY=VALUE")
            flags[field] = (*flags.get(field, ()), (key, v))
        elif field in ("outputs", "font_files"):
            flags[field] = (*flags.get(field, ()), value)
        elif isinstance(kind, tuple):
            flags[field] = tuple(value.split(",")) if value else ()
        else:
            try:
                flags[field] = parse_int(value) if isinstance(kind, int) else float(value) if isinstance(kind, float) else value
            except ValueError:
                raise OptionError(f"{a}: not a number") from None
    return flags, inputs, extra


def main(arguments: list[str], session: Callable[[int], SparkSession]) -> int:
    """Exit status: 0, 1 if some files failed, 2 for wrong options."""
    try:
        flags, inputs, extra = parse_arguments(arguments)
        profile: dict[str, object] = {}
        for p in extra["profile"]:
            profile |= (legacy.load if p.lower().endswith(".pdfscp") else load_profiles)(p, extra["profile-entry"])
        options = resolve(flags, profile)
        if extra["save-profile"]:
            save_profile(extra["save-profile"], {**profile, **flags})
        if not inputs:
            if extra["save-profile"]:
                return 0
            raise OptionError("no input files")
        failures = run(session(options.jobs), inputs, replace(options))
    except (OptionError, PdfError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    for f in failures:
        print(f, file=sys.stderr)
    return int(bool(failures))
