"""BPE encoding and decoding over a minimal acyclic transducer lexicon (see wordbpe).

Defined cases: null and empty texts have no ids and decode to the empty text; a special token's string inside
a text is that token's id; texts of any length are encoded whole, in runs cut at white space, where no word
and no normalisation crosses; repeated rows are encoded each; an empty table gives no rows; extra columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced
from .wordbpe import Encoder, compile_lexicon, encoder

RUN_CHARS = 1 << 20
OUT_BYTES = 8 << 20
GAP = re.compile("[ \t\n\r]")


def runs(text: str, size: int | None = None) -> Iterator[str]:
    """The text in runs of about size (RUN_CHARS) characters, cut before white space."""
    at, size = 0, size or RUN_CHARS
    while len(text) - at > size and (cut := GAP.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_texts(enc: Encoder, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text, in order; at most some runs are in hand at a time."""
    group: list[str | None] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            ids, at = enc.batch(group)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                yield ids[a:b]
            group.clear()

    for t in texts:
        if t and len(t) > RUN_CHARS:
            yield from flush()
            yield np.concatenate([enc.batch([r])[0] for r in runs(t)])
            size = 0
            continue
        group.append(t)
        size += len(t or "")
        if size >= RUN_CHARS:
            yield from flush()
            size = 0
    yield from flush()


def _emit(schema: pa.Schema, rows: Iterator[tuple[object, bytes | str]]) -> Iterator[pa.RecordBatch]:
    keys: list = []
    values: list = []
    size = 0
    for key, value in rows:
        keys.append(key)
        values.append(value)
        size += len(value)
        if size >= OUT_BYTES:
            yield pa.record_batch([pa.array(keys, schema[0].type), pa.array(values, schema[1].type)], schema=schema)
            keys, values, size = [], [], 0
    if keys:
        yield pa.record_batch([pa.array(keys, schema[0].type), pa.array(values, schema[1].type)], schema=schema)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids: little-endian unsigned 32-bit ids of the whole text."""
    block = docs.sparkSession.sparkContext.broadcast(compile_lexicon(tokenizer))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(block.value)
        rows = ((k, ids.astype("<u4").tobytes()) for b in sliced(batches) for k, ids in zip(b.column(0).to_pylist(), encode_texts(enc, b.column(1).to_pylist())))
        yield from _emit(schema, rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text: the token strings of ids joined by spaces, specials kept."""
    block = encoded.sparkSession.sparkContext.broadcast(compile_lexicon(tokenizer))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(block.value)
        yield from _emit(schema, ((k, enc.decode(np.frombuffer(x or b"", "<u4"))) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text in one pass over the documents."""
    block = docs.sparkSession.sparkContext.broadcast(compile_lexicon(tokenizer))
    names = ["doc_id", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, size = encoder(block.value), ([], [], []), 0
        for b in sliced(batches):
            for k, ids in zip(b.column(0).to_pylist(), encode_texts(enc, b.column(1).to_pylist())):
                raw = ids.astype("<u4").tobytes()
                text = enc.decode(np.frombuffer(raw, "<u4"))
                for column, value in zip(out, (k, raw, text)):
                    column.append(value)
                size += len(raw) + len(text)
                if size >= OUT_BYTES:
                    yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], names)
                    out, size = ([], [], []), 0
        if out[0]:
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
