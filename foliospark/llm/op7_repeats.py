"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier.

Each string of LENGTH bytes (a window) belongs to the position of its least K-byte hash. Successive windows with the
same position form a run, about one for every 39 bytes, and equal windows lie in runs with equal K bytes there.

1. Where the documents are read, runs are cut and their K bytes are hashed. One record for each distinct K of a batch
   goes to the bucket of that hash; runs whose K occurs twice in the batch need no answer.
2. A bucket tells which runs share their K bytes with another run. All others can't hold a repeat and are done; no
   bytes have moved so far. This is all that hashes decide: they choose what is compared, and where.
3. The bytes of shared runs, cut from the documents, go to the buckets of their K bytes; equal strings, compared byte by
   byte, travel once for each batch. Over the distinct strings of a bucket's groups a run-length index is built (see
   rlindex), all are streamed through it, and a window is a repeat if its matching statistic reaches LENGTH at an earlier
   place. Of equal strings the first is indexed; the matches of the others are that string itself. Strings that share no
   81 bytes around K with another of their group match nowhere and are left out.
4. Repeats are joined to their documents, and the bytes that they cover are cut out.

No group has to fit a task: K bytes with more than WIDE distinct strings are routed by 91 instead of K common bytes
(runs are cut into stretches of windows that share them), those with more than NARROW by whole windows. The index does
the same work at every width. Nothing is sampled or capped.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH keep all; of equal strings the one of the
smaller doc_id, then the earlier start stays; rows that repeat a doc_id and its text count as one document, so neither
is earlier than the other; rows of one doc_id but different texts are different documents, ordered by a hash of the
text; rows with a null doc_id take no part and lose nothing; very long texts are cut into overlapping segments; an
empty table gives no rows; extra columns, whatever their names, pass through repeats() and without_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, materialize, parts_for, text_bytes
from .rlindex import RunLengthIndex
from .wordbpe import SpanHash

LENGTH = 100
K = 24
#: Distinct strings of a group beyond which its runs are cut to stretches that share 91 bytes, and to single windows.
WIDE, NARROW = 512, 16384
#: Windows of a stretch at each of these levels; level 0 is a whole run.
WIDTHS = (LENGTH - K + 1, 10, 1)
FLUSH_BYTES = 12 << 20
BATCH_BYTES = 3 << 18
SEGMENT = 1 << 20
PLACE_BITS = 21  # of a place within a batch; the least K-byte hash is the least of the bits above
PART_BYTES = 12 << 20
INDEX_BYTES = 1 << 19
REPEAT, RUNS, STRINGS, ASK, HOT = range(5)
SCHEMA = "kind int, bucket long, n long, blob binary"
RUN = np.dtype([("k", "<u8"), ("row", "<i8"), ("start", "<u4"), ("h", "<u4"), ("m", "<u2"), ("n", "u1"), ("p", "u1"), ("twice", "u1")])
STRING = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("n", "u1"), ("p", "u1")])
SPAN = np.dtype([("row", "<i8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u4")])

_HASH = SpanHash()


def cut_runs(data: np.ndarray, size: np.ndarray, length: int = LENGTH, k: int = K) -> dict[str, np.ndarray]:
    """Runs of a batch of texts, given as bytes one after another and their lengths; at most 2 ** PLACE_BITS bytes.

    text, start (in the text), n (windows), p (place of the K bytes from start), k (their hash), h (hash of the string of
    n + length - 1 bytes).
    """
    n = len(data)
    assert n <= 1 << PLACE_BITS
    empty = {x: np.empty(0, np.int64) for x in ("text", "start", "n", "p")} | {x: np.empty(0, np.uint64) for x in ("k", "h")}
    if n < length:
        return empty
    begin = np.cumsum(size) - size
    place = np.arange(n - k + 1)
    gram = _HASH(data, place, place + k)
    bits = np.uint64(PLACE_BITS)
    low = gram >> bits << bits | place.view(np.uint64)  # the position breaks ties: the leftmost
    span = length - k + 1
    least, width = low, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[: len(least)]
    valid = place[: len(least)] + length <= (begin + size)[owner]
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    del low, least
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return empty
    ends = np.flatnonzero(valid & np.append(first[1:] | ~valid[1:], True)) + 1
    count = ends - start
    return {"text": owner[start], "start": start - begin[owner[start]], "n": count, "p": at[start] - start, "k": gram[at[start]], "h": _HASH(data, start, start + count + length - 1)}


def stretches(n: int, p: int, width: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """Of a run of n windows with its K bytes at p: number, first window and windows of each stretch, and from where to
    where its windows share all bytes. Windows of a stretch start nearly as far before K, within width."""
    for i in range((p - n + 1) // width, p // width + 1):
        at = p - width * i
        a, b = max(0, at - width + 1), min(n - 1, at)
        yield i, a, b - a + 1, at, at - width + 1 + length


def spans_of(spans: np.ndarray) -> np.ndarray:
    """Spans (row, doc, start, size) merged within each document."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"], spans["row"]))]
    start = spans["start"].astype(np.int64)
    end = start + spans["size"]
    other = (spans["row"][1:] != spans["row"][:-1]) | (spans["doc"][1:] != spans["doc"][:-1])
    group = np.cumsum(np.append(True, other))
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    fresh_ = np.append(True, other | (start[1:] > reach[:-1]))
    at = np.flatnonzero(fresh_)
    out = spans[at]
    out["size"] = reach[np.append(at[1:], len(spans)) - 1] - start[at]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, n, blob = zip(*rows) if rows else ((),) * 4
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["kind", "bucket", "n", "blob"])


def _by_bucket(kind: int, runs: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """One row for each bucket that these records go to."""
    order = np.argsort(bucket, kind="stable")
    runs, bucket = runs[order], bucket[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(runs) else []
    return [(kind, int(bucket[a]), b - a, runs[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(runs)])]


def _spread(kind: int, records: np.ndarray, buckets: int) -> list[tuple]:
    """Records that any bucket may take."""
    return [(kind, int(records["row"][i]) % buckets, len(records[i : i + 65536]), records[i : i + 65536].tobytes()) for i in range(0, len(records), 65536)]


def _each(column: pa.Array) -> Iterator:
    """A column's values one at a time: a batch of texts isn't held twice."""
    return (x.as_py() for x in column)


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs as offsets and one array for each field; null lists are empty."""
    values = column.values
    return column.offsets.to_numpy(), {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}


class _Texts:
    """Documents gathered to batches of bytes; long ones come in segments that share LENGTH - 1 bytes."""

    def __init__(self) -> None:
        self.rows, self.base, self.raw, self.size = [], [], [], 0

    def add(self, row: int, base: int, raw: bytes) -> bool:
        self.rows.append(row)
        self.base.append(base)
        self.raw.append(raw)
        self.size += len(raw)
        return self.size >= BATCH_BYTES


def _segments(text: str | None, length: int) -> Iterator[tuple[int, bytes]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    for at in range(0, len(raw) - length + 1, SEGMENT):
        yield at, raw[at : at + SEGMENT + length - 1]


def runs_of(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Step 1 on row, text: a record of each K and batch for its bucket, and the other runs of the same K."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, texts = [], 0, _Texts()

        def cut() -> None:
            if texts.rows:
                got = cut_runs(np.frombuffer(b"".join(texts.raw), np.uint8), np.array([len(r) for r in texts.raw]), length)
                runs = np.zeros(len(got["k"]), RUN)
                runs["k"], runs["n"], runs["p"], runs["h"] = got["k"], got["n"], got["p"], (got["h"] >> np.uint64(32)).astype(np.uint32)
                runs["row"], runs["start"] = np.array(texts.rows)[got["text"]], got["start"] + np.array(texts.base)[got["text"]]
                held.append(runs)

        def flush() -> pa.RecordBatch:
            runs = np.concatenate(held) if held else np.empty(0, RUN)
            held.clear()
            runs = runs[np.lexsort((runs["h"], runs["k"]))]
            new = np.ones(len(runs), bool)
            new[1:] = runs["k"][1:] != runs["k"][:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(runs)))
            differs = np.append(True, runs["h"][1:] != runs["h"][:-1])[: len(runs)] | new
            first = runs[at]
            first["m"] = np.minimum(np.add.reduceat(differs, at, dtype=np.int64), 65535) if len(at) else 0
            first["twice"] = count > 1
            return _batch(_by_bucket(RUNS, first, (first["k"] >> np.uint64(8)) % np.uint64(buckets)) + _spread(ASK, runs[~new], buckets))

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), _each(b.column(1))):
                for base, raw in _segments(text, length):
                    if texts.add(row, base, raw):
                        cut()
                        n += texts.size
                        texts = _Texts()
                    if n >= FLUSH_BYTES:
                        yield flush()
                        n = 0
        cut()
        yield flush()
        give_back()

    return docs.mapInArrow(run, SCHEMA)


def _asked(runs: np.ndarray, kind: int, level: np.ndarray | int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(runs), 65536):
        s = runs[i : i + 65536]
        levels = level[i : i + 65536] if isinstance(level, np.ndarray) else np.full(len(s), level)
        columns = (np.full(len(s), kind, np.int32), s["row"], s["start"].astype(np.int64), s["n"].astype(np.int32) | s["p"].astype(np.int32) << 8, s["k"].view(np.int64), levels.astype(np.int32))
        yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in columns], ["kind", "row", "start", "n", "k", "level"])


def meet(runs: DataFrame) -> DataFrame:
    """Step 2 on the rows of a bucket: the runs whose bytes are wanted.

    n: windows, and above 8 bits the place of K; kind RUNS: with the level of their group; ASK: the level is that of the group's row of kind HOT, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if kind == ASK:
                    yield from _asked(np.frombuffer(blob, RUN), ASK, 0)
                else:
                    held.append(np.frombuffer(blob, RUN))
        runs = np.concatenate(held) if held else np.empty(0, RUN)
        held.clear()
        runs = runs[np.lexsort((runs["h"], runs["k"]))]
        new = np.ones(len(runs), bool)
        new[1:] = runs["k"][1:] != runs["k"][:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return
        group = np.cumsum(new) - 1
        shared = (np.diff(np.append(at, len(runs))) > 1) | (np.maximum.reduceat(runs["twice"], at) > 0)
        different = np.append(True, runs["h"][1:] != runs["h"][:-1]) | new
        # no fewer than the distinct strings of the group
        size = np.add.reduceat(different, at, dtype=np.int64) + np.add.reduceat(runs["m"].astype(np.int64) - 1, at)
        level = (size > WIDE).astype(np.int32) + (size > NARROW)
        hot = shared & (level > 0)
        yield from _asked(runs[at[hot]], HOT, level[hot])
        yield from _asked(runs[shared[group]], RUNS, level[group][shared[group]])

    return runs.mapInArrow(run, "kind int, row long, start long, n int, k long, level int")


class _Strings:
    """Distinct strings by routing key and bytes, with their first place; the places of the others are repeats."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, bytes], tuple] = {}
        self.repeats: list[tuple] = []
        self.size = 0

    def add(self, key: int, part: bytes, place: tuple[int, int, int, int]) -> None:
        """place: doc, row, start, place of K."""
        known = self.first.setdefault((key, part), place)
        if known is place:
            self.size += len(part) + 64
        elif known != place:  # else a row that repeats a document
            if place < known:
                self.first[key, part], place = place, known
            self.repeats.append((place[1], place[0], place[2], len(part)))
            self.size += 24

    def spans(self) -> np.ndarray:
        out = spans_of(np.array(self.repeats, SPAN))
        self.repeats = []
        return out


def strings_of(asked: DataFrame, row: str, spans: str, buckets: int, length: int) -> DataFrame:
    """Step 3, first half, on the documents with their number and lists (start, n, k, level): the bytes, by bucket."""
    at_doc, at_row, at_text, at_spans = (asked.columns.index(x) for x in ("doc_id", row, "text", spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Strings()

        def flush() -> pa.RecordBatch:
            by: dict[int, tuple[list, list]] = {}
            for (key, part), place in held.first.items():
                heads, parts = by.setdefault((key >> 8) % buckets, ([], []))
                heads.append((key, *place[:3], len(part) - length + 1, place[3]))
                parts.append(part)
            rows = [(STRINGS, bucket, len(heads), np.array(heads, STRING).tobytes() + b"".join(parts)) for bucket, (heads, parts) in by.items()]
            return _batch(rows + _spread(REPEAT, held.spans(), buckets))

        for b in batches:
            at, lists = _lists(b.column(at_spans))
            for i in np.flatnonzero(np.diff(at)).tolist():
                doc, number, raw = b.column(at_doc)[i].as_py(), b.column(at_row)[i].as_py(), (b.column(at_text)[i].as_py() or "").encode("utf-8", "surrogatepass")
                if doc is None:
                    continue
                doc, own = int(doc), slice(int(at[i]), int(at[i + 1]))
                for start, n, k, level in zip(*(lists[x][own].tolist() for x in ("start", "n", "k", "level"))):
                    n, p, k = n & 255, n >> 8, k & (1 << 64) - 1
                    part = raw[start : start + n + length - 1]
                    if level == 0:
                        held.add(k, part, (doc, number, start, p))
                        continue
                    for j, a, m, x, y in stretches(n, p, WIDTHS[level], length):
                        shared = hashlib.blake2b(part[x:y], digest_size=8, key=k.to_bytes(8, "little") + j.to_bytes(2, "little"))
                        held.add(int.from_bytes(shared.digest(), "little"), part[a : a + m + length - 1], (doc, number, start + a, p - a))
                if held.size >= FLUSH_BYTES // 2:
                    yield flush()
                    held = _Strings()
        yield flush()
        del held
        give_back()

    return asked.mapInArrow(run, SCHEMA)


def alike(some: list[tuple], length: int, width: int = 20) -> list[tuple]:
    """Of the strings (place, part) of a group those that share the bytes of a stretch with another of them."""
    met: dict[tuple[int, bytes], int] = {}
    keep = [False] * len(some)
    for i, ((*_, p), part) in enumerate(some):
        for j, _, _, x, y in stretches(len(part) - length + 1, p, width, length):
            first = met.setdefault((j, part[x:y]), i)
            if first != i:
                keep[first] = keep[i] = True
    return [x for x, k in zip(some, keep) if k]


def index_strings(strings: DataFrame, length: int) -> DataFrame:
    """Step 3, second half, on the rows of buckets: repeats (row, doc, start, size)."""

    def groups(held: _Strings) -> Iterator[list[tuple]]:
        """Strings of whole groups (equal routing keys), about INDEX_BYTES at a time, in order of place."""
        by: dict[int, list[tuple]] = {}
        for (key, part), place in held.first.items():
            by.setdefault(key, []).append((place, part))
        some, size = [], 0
        for group in by.values():
            if len(group) > 1 and (group := alike(group, length)):
                some += group
                size += sum(len(part) for _, part in group)
                if size >= INDEX_BYTES:
                    yield sorted(some)
                    some, size = [], 0
        if some:
            yield sorted(some)

    def found(some: list[tuple]) -> np.ndarray:
        size = np.array([len(part) for _, part in some])
        which, offset = RunLengthIndex(np.frombuffer(b"".join(part for _, part in some), np.uint8), size).repeated(length)
        doc, row, start = (np.array([place[i] for place, _ in some], np.int64) for i in range(3))
        out = np.empty(len(which), SPAN)
        out["row"], out["doc"], out["start"], out["size"] = row[which], doc[which], start[which] + offset, length
        return spans_of(out)

    def emit(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(spans), 65536):
            s = spans[i : i + 65536]
            yield pa.record_batch([pa.array(s[x].astype(np.int64)) for x in ("row", "doc", "start", "size")], ["row", "doc", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Strings()
        for b in batches:
            for kind, n, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if kind == REPEAT:
                    yield from emit(np.frombuffer(blob, SPAN))
                    continue
                heads, at = np.frombuffer(blob, STRING, n).tolist(), n * STRING.itemsize
                for key, doc, row, start, windows, p in heads:
                    held.add(key, blob[at : at + windows + length - 1], (doc, row, start, p))
                    at += windows + length - 1
            if len(held.repeats) >= 65536:
                yield from emit(held.spans())
        yield from emit(held.spans())
        out = [found(some) for some in groups(held)]
        yield from emit(spans_of(np.concatenate(out)) if out else np.empty(0, SPAN))
        del held, out
        give_back()

    return strings.mapInArrow(run, "row long, doc long, start long, size long")


def merged(start: np.ndarray, size: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches in order, joined where they touch, within n bytes."""
    if not len(start):
        return []
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(np.minimum(n, start + size)[order])
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist()))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents and, in a last column, the stretches (start, size; in bytes) that earlier strings cover."""
    n = parts_for(docs.sparkSession, text_bytes(docs), PART_BYTES)
    row, spans = fresh(docs, "row"), fresh(docs, "spans")
    placed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    wanted = runs_of(placed.where(F.col("doc_id").isNotNull()).select(row, "text"), n, length).repartitionById(n, F.col("bucket").cast("int"))
    wanted = materialize(meet(wanted), "repeat-runs")
    hot = wanted.where(F.col("kind") == HOT).select("k", F.col("level").alias("hot"))
    asked = wanted.where(F.col("kind") == ASK).join(hot, "k", "left").select("row", "start", "n", "k", F.coalesce("hot", "level").alias("level"))
    asked = asked.union(wanted.where(F.col("kind") == RUNS).select("row", "start", "n", "k", "level"))
    by_row = lambda df, *cols: df.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct(*cols)).alias(spans))
    placed = placed.repartition(n, row)  # both joins read this exchange, so both take all columns
    strings = strings_of(placed.join(by_row(asked, "start", "n", "k", "level"), row, "left"), row, spans, n, length).repartitionById(n, F.col("bucket").cast("int"))
    found = placed.join(by_row(index_strings(strings, length), "doc", "start", "size"), row, "left")
    own = F.transform(F.filter(spans, lambda x: x["doc"] == F.col("doc_id").cast("long")), lambda x: F.struct(x["start"], x["size"]))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], own.alias(spans))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, without their repeated stretches; texts that lose all are dropped.

    Stretches shrink to whole UTF-8 characters; n_chars, if there, follows the text.
    """
    found = repeats(docs, length)
    at = found.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            begin, spans = _lists(b.column(b.num_columns - 1))
            for text, i, j in zip(_each(b.column(at)), begin[:-1].tolist(), begin[1:].tolist()):
                if j > i and text:
                    raw, parts, last = text.encode("utf-8", "surrogatepass"), [], 0
                    for x, y in merged(spans["start"][i:j], spans["size"][i:j], len(raw)):
                        while x < y and raw[x] & 0xC0 == 0x80:
                            x += 1
                        while x < y < len(raw) and raw[y] & 0xC0 == 0x80:
                            y -= 1
                        parts.append(raw[last:x])
                        last = y
                    text = b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")
                    keep.append(bool(text))
                else:
                    keep.append(True)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.record_batch(columns, b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    out = found.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the result of repeats()."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            begin, spans = _lists(b.column(2))
            for text, i, j in zip(_each(b.column(1)), begin[:-1].tolist(), begin[1:].tolist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone, at, sha = merged(spans["start"][i:j], spans["size"][i:j], len(raw)), 0, hashlib.sha256()
                for x, y in gone:
                    sha.update(raw[at:x])
                    at = y
                sha.update(raw[at:])
                rows.append((len(raw), sum(y - x for x, y in gone), len(gone), sha.hexdigest()))
            n, removed, count, digest = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select(F.col("doc_id").cast("long"), "text", found.columns[-1]).mapInArrow(run, schema)
