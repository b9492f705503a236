"""Cost-balanced packing of token documents into sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays within a piece). Groups of documents
are packed where they are tokenized, without a shuffle: full sequences are cut from long documents, and what
remains is assigned in descending order to the sequence of lowest cost that has room for it. What fits nowhere
is cut at the room that is left. The capacities of a group add up to its tokens: all are the limit, except that
the rest is split into powers of two, which need no padding.

Defined cases: null and empty texts are one end token; texts of any length are packed whole; ties go to the
earlier document and sequence; repeated rows are packed each; an empty table gives no rows; extra columns of
the input, whatever their names, are ignored. Which documents share a sequence, and its id, depend on how the table is
partitioned; the pieces' ids and checks don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import sliced
from .op8_wordbpe import encode_texts
from .wordbpe import compile_lexicon, encoder

LIMIT = 4096
END_ID = 2
LINEAR = 1.0
QUADRATIC = 1.0 / LIMIT
#: Tokens of the documents that are packed together; bounds a task's memory.
GROUP_TOKENS = 2 << 20


def capacities(tokens: int, limit: int) -> list[int]:
    """Full sequences and powers of two that add up to tokens."""
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these lengths."""
    out, left, sequences = [], [], 0
    for k, n in enumerate(lengths):
        for at in range(0, n - n % limit, limit):
            out.append((k, at, limit, sequences, 0))
            sequences += 1
        if n % limit:
            left.append((n % limit, k, n - n % limit))
    size = np.array(capacities(sum(x[0] for x in left), limit), np.int64)
    room, cost = size.copy(), np.zeros(len(size))

    def put(n: int, k: int, at: int, to: int) -> None:
        out.append((k, at, n, sequences + to, int(size[to] - room[to])))
        room[to] -= n
        cost[to] += LINEAR * n + QUADRATIC * n * n

    cut = []
    for n, k, at in sorted(left, key=lambda x: (-x[0], x[1])):
        cheapest = np.where(room >= n, cost, np.inf)
        to = int(cheapest.argmin())
        if cheapest[to] < np.inf:
            put(n, k, at, to)
        else:
            cut.append((n, k, at))
    for n, k, at in cut:
        while n:
            cheapest = np.where(room > 0, cost, np.inf)
            to = int(cheapest.argmin())
            part = min(n, int(room[to]))
            put(part, k, at, to)
            n, at = n - part, at + part
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, limit: int = LIMIT) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    block = docs.sparkSession.sparkContext.broadcast(compile_lexicon(tokenizer))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def packed(keys: list, ids: list[np.ndarray], first: int) -> tuple[Iterator[pa.RecordBatch], int]:
        pieces = sorted(assign([len(x) for x in ids], limit), key=lambda x: (x[3], x[4]))
        batches = []
        for i in range(0, len(pieces), 4096):
            rows = [(keys[k], at, n, ids[k][at : at + n].astype("<u4").tobytes(), len(ids[k]), first + s, o) for k, at, n, s, o in pieces[i : i + 4096]]
            batches.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))
        return batches, first + (pieces[-1][3] + 1 if pieces else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = encoder(block.value), TaskContext.get().partitionId() << 40
        keys, ids, size = [], [], 0
        for b in sliced(batches):
            for k, x in zip(b.column(0).to_pylist(), encode_texts(enc, b.column(1).to_pylist())):
                keys.append(k)
                ids.append(np.append(x, np.array([end_id], x.dtype)))
                size += len(x) + 1
                if size >= GROUP_TOKENS:
                    out, first = packed(keys, ids, first)
                    yield from out
                    keys, ids, size = [], [], 0
        out, _ = packed(keys, ids, first)
        yield from out

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
