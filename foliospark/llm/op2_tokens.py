"""Token counts of documents in flat token files, by a separator scan.

A flat file is a run of fixed-width little-endian token ids in which every document ends with a separator id; there is
no index. Files are cut into blocks without regard to documents. Each block is searched for the separator with one
vector comparison. Blocks are then stitched with an exclusive prefix scan over their summaries: how many tokens and
separators precede a block, and where the last separator before it was. The scan has two levels, of FAN blocks each,
so that no task orders all blocks of a large file. Only summaries of blocks (tokens, separators, place of the last one)
go through the scan; the places of separators meet its result at the end.

Defined cases: two separators in a row are a document of no tokens; tokens after a file's last separator are a last
document that is marked as not ended; an empty file has no documents; an empty table gives no rows. For the tables:
null ids, null and empty texts are documents (of no tokens), texts of any length are encoded whole, repeated rows are
counted each, extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sliced

BLOCK_TOKENS = 1 << 17
FAN = 1024
MANIFEST_IDS = 1 << 16
#: Larger files are read by ranges of so many blocks; one row holds at most 2 GB.
WHOLE_BYTES = 1 << 30
RANGE_BLOCKS = 256
BLOCK, MANIFEST = 0, 1


def token_files(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the documents of each partition into one flat file, as rows of blocks.

    kind BLOCK: file, number of the block, ids of id_width() bytes; kind MANIFEST: which doc_ids went into the file, in order,
    from the ordinal `number` on (64-bit). The manifest only names documents; it holds no lengths or places.
    """

    schema = "kind int, file long, number long, data binary"
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    unsigned = f"<u{id_width(ranks.value, separator)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = encoding(ranks.value, pattern), TaskContext.get().partitionId()
        parts, size, block, ids, ordinal = [], 0, 0, [], 0

        def row(kind: int, number: int, data: bytes) -> pa.RecordBatch:
            return pa.record_batch([pa.array([kind], pa.int32()), pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["kind", "file", "number", "data"])

        for b in sliced(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = enc.encode_ordinary(text or "")
                tokens.append(separator)
                parts.append(np.array(tokens, unsigned))
                size += len(tokens)
                ids.append(key if key is not None else -(1 << 63))
                if size >= block_tokens:
                    whole = np.concatenate(parts)
                    full = size - size % block_tokens
                    for i in range(0, full, block_tokens):
                        yield row(BLOCK, block, whole[i : i + block_tokens].tobytes())
                        block += 1
                    parts, size = [whole[full:]], size - full
                if len(ids) >= MANIFEST_IDS:
                    yield row(MANIFEST, ordinal, np.array(ids, "<i8").tobytes())
                    ordinal += len(ids)
                    ids = []
        if size:
            yield row(BLOCK, block, np.concatenate(parts).tobytes())
        if ids:
            yield row(MANIFEST, ordinal, np.array(ids, "<i8").tobytes())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def id_width(ranks: bytes, separator: int) -> int:
    """Bytes that an id of the vocabulary or the separator takes: 2 or 4."""
    most = max([separator, *(int(line.split()[1]) for line in ranks.splitlines() if line)])
    return 2 if most < 1 << 16 else 4


_ENCODINGS: dict[int, object] = {}


def encoding(ranks: bytes, pattern: str):
    import tiktoken

    if (key := hash((ranks, pattern))) not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def read_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, whole: int = WHOLE_BYTES) -> DataFrame:
    """Blocks (kind, file, number, data) of the flat files at a path; file is the hash of its path.

    Files of up to `whole` bytes are read by Spark, each as one row. Of larger ones only the length is; their blocks are
    read by range in as many tasks as they fill, through the file systems that pyarrow knows.
    """
    step, schema = width * block_tokens, "kind int, file long, number long, data binary"
    names = ["kind", "file", "number", "data"]

    def block(file: int, number: int, data: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([BLOCK], pa.int32()), pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i in range(0, len(data), step):
                    yield block(file, i // step, data[i : i + step])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for file, name, first, length in zip(*(c.to_pylist() for c in b.columns)):
                store, at = FileSystem.from_uri("file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name)
                with store.open_input_file(at) as f:
                    for number in range(first, min(first + RANGE_BLOCKS, -(-length // step))):
                        yield block(file, number, f.read_at(min(step, length - number * step), number * step))

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select(F.xxhash64("path").alias("file"), "content").mapInArrow(cut, schema)
    last = F.floor((F.col("length") - 1) / (step * RANGE_BLOCKS))
    large = files.where(F.col("length") > whole).select(F.xxhash64("path").alias("file"), "path", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * RANGE_BLOCKS)).alias("first"), "length")
    return small.union(large.repartition("file", "first").mapInArrow(ranges, schema))


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """For each block its tokens and the places of its separators; manifests pass with their ids."""
    schema = "kind int, file long, number long, n long, places array<int>, ids array<long>"
    kind_of = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places, ids = [], [], []
            for kind, data in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                tokens = np.frombuffer(data, kind_of) if kind == BLOCK else np.empty(0, kind_of)
                n.append(len(tokens))
                places.append(np.flatnonzero(tokens == separator).astype(np.int32))
                ids.append(np.frombuffer(data, "<i8") if kind == MANIFEST else np.empty(0, np.int64))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))], ["kind", "file", "number", "n", "places", "ids"])

    return blocks.mapInArrow(run, schema)


def before(df: DataFrame, **values: tuple) -> DataFrame:
    """Adds, for each name: (aggregate, column), the aggregate over all blocks of the file before this one."""
    top = F.floor(F.col("number") / FAN)
    part = df.withColumn("top", top).groupBy("file", "top").agg(*[f(c).alias(k) for k, (f, c) in values.items()])
    past = Window.partitionBy("file").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("file", "top", *[f(k).over(past).alias(f"top_{k}") for k, (f, _) in values.items()])
    inner = Window.partitionBy("file", "top").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("top", top)
    for k, (f, c) in values.items():
        out = out.withColumn(k, f(c).over(inner))
    both = lambda k, f: (F.coalesce(k, F.lit(0)) + F.coalesce(f"top_{k}", F.lit(0))) if f is F.sum else F.greatest(k, f"top_{k}")
    return out.join(part, ["file", "top"]).withColumns({k: both(k, f) for k, (f, _) in values.items()}).drop("top", *[f"top_{k}" for k in values])


def documents(scanned: DataFrame) -> DataFrame:
    """file, ordinal, start, n_tokens, ended of every document of the files."""
    own = scanned.where(F.col("kind") == BLOCK).select("file", "number", "n", "places")
    count = F.size("places")
    blocks = own.select("file", "number", "n", count.alias("count"), F.get("places", count - 1).alias("last"))
    placed = before(blocks, base=(F.sum, "n"), earlier=(F.sum, "count"))
    known = before(placed.withColumn("last", F.col("base") + F.col("last") + 1), begin=(F.max, "last")).withColumn("begin", F.coalesce("begin", F.lit(0).cast("long")))
    total = known.groupBy("file").agg(F.sum("n").alias("tokens"), F.sum("count").alias("ordinal"), F.max(F.greatest("last", "begin")).alias("start"))
    open_ = total.where("tokens > start").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    ends = own.where(count > 0).join(known.select("file", "number", "base", "earlier", "begin"), ["file", "number"]).select("file", "base", "earlier", "begin", "places", F.posexplode("places").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("begin")).otherwise(F.col("base") + F.get("places", F.col("i") - 1) + 1)
    ended = ends.select("file", (F.col("earlier") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("at") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    return ended.unionByName(open_)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, separator: int) -> DataFrame:
    """doc_id, file, start, n_tokens of the documents, found by scanning the flat files made of them."""
    with open(vocabulary, "rb") as f:
        width = id_width(f.read(), separator)
    scanned = materialize(scan_blocks(token_files(docs, vocabulary, pattern, separator), separator, width), "token-blocks")
    named = scanned.where(F.col("kind") == MANIFEST).select("file", "number", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("number") + F.col("i")).alias("ordinal"), F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    return documents(scanned).join(named, ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
