"""Near-duplicate classes with ProbMinHash signatures, banding and exact verification.

A document is the weighted set of its five-word shingles (words are runs without white space, in lower case); a
shingle weighs as often as it occurs. Every element sends a Poisson process of arrivals to random registers, at the
rate of its weight; a register keeps the earliest one, and a document stops once no element's next arrival can come
first. Two documents agree in a register with the probability of their probability Jaccard similarity; at 0.8 they share
no band of registers with a probability of 2e-5. Where no shingle repeats it is the Jaccard similarity of the sets; a
document with repeats is signed twice, with its weights and with all weights 1, so that both similarities are covered.
Bands give candidates; a candidate is a link if either similarity, computed exactly from whole 64-bit hashes and
weights, is at least THRESHOLD. Classes are the connected components of the links.

Documents with equal weighted shingles are one node from the start. Candidates grow in proportion to the documents,
whatever the size of a group: a member of a bucket meets the bucket's leader (least by a hash). First, every document
is held against the leader with which it shares most bands; pairs that are then in one class already need no check. The
rest follow: all other leaders, all pairs of buckets up to SMALL, and for members of larger buckets the leaders of the
parts into which SPLITS other bands cut them. What large buckets then still hold in different classes is checked pair
by pair, in cells of BLOCK by BLOCK members, so that in the end every two documents of a bucket were compared or share
a class. These last pairs grow with the square of a family whose members are alike but below the threshold.

Defined cases: a null text, or one without a word, is a class of its own; a text of one to four words has one
shingle, of all of them; very long texts are hashed in runs; rows with a null doc_id are returned with a null class;
repeated rows share a class; rows of one doc_id but different texts are different documents, which may be in different
classes; ties go to the smaller id, and a class is named by its least doc_id; an empty table gives no rows; extra
columns of the input, whatever their names, are ignored by classes() and kept by one_of_each().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, sliced
from .shingles import shingles
from .wordbpe import mixed

THRESHOLD = 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
SMALL = 6
SPLITS = 8
BLOCK = 256
COLUMNS = 4096
CHUNK_CHARS = 2 << 20


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each of n documents the element that arrives first in each register (0 if it has none)."""
    first = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    rate, time, step = 1.0 / weight, np.zeros(len(value)), 0
    while len(value):
        step += 1
        r = mixed(value + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        at = owner * registers + (mixed(r) % np.uint64(registers)).astype(np.int64)
        early = time < first[at]
        i, t, v = at[early], time[early], value[early]
        np.minimum.at(first, i, t)
        won = t == first[i]
        out[i[won]] = v[won]
        last = first.reshape(n, registers).max(1)
        alive = time < last[owner]
        if not alive.all():
            owner, value, rate, time = owner[alive], value[alive], rate[alive], time[alive]
    return out.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Documents by bands: one 64-bit key for the registers of a band and its number."""
    s = signature.reshape(len(signature), BANDS, ROWS)
    key = np.full(s.shape[:2], 0, np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        key = mixed(key + s[:, :, i])
    return key.view(np.int64)


def _chunks(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and j - i < 4096 and (j == i or n + len(texts[j] or "") <= size):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _bytes_of(value: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted hashes with their counts; counts of 1 are left out."""
    many = np.flatnonzero(count > 1)
    return np.array([len(many)], "<u4").tobytes() + value.astype("<u8").tobytes() + many.astype("<u4").tobytes() + count[many].astype("<u4").tobytes()


def _set(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(block[:4], "little")
    n = (len(block) - 4 - 8 * m) // 8
    count = np.ones(n, np.int64)
    count[np.frombuffer(block, "<u4", m, 4 + 8 * n)] = np.frombuffer(block, "<u4", m, 4 + 8 * n + 4 * m)
    return np.frombuffer(block, "<u8", n, 4), count


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum, over common elements i, of 1 / sum over all j of max(x[j] / x[i], y[j] / y[i])."""
    (a, v), (b, w) = x, y
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    v_both, w_both = v[i], w[j]
    v_rest, w_rest = int(v.sum() - v_both.sum()), int(w.sum() - w_both.sum())
    ratio, total = v_both / w_both, 0.0
    for r in np.unique(ratio):
        total += v_both[ratio == r].sum() / (v_rest + r * w_rest + np.maximum(v_both, r * w_both).sum())
    return total


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of the Jaccard similarity of the sets and the probability Jaccard similarity."""
    common = len(np.intersect1d(x[0], y[0], assume_unique=True))
    sets = common / (len(x[0]) + len(y[0]) - common)
    return sets if (x[1] == 1).all() and (y[1] == 1).all() else max(sets, probability_jaccard(x, y))


def _bands(owner: np.ndarray, value: np.ndarray, count: np.ndarray, n: int) -> pa.ListArray:
    """BANDS keys for each of n documents, and as many more for the sets of those with repeats."""
    keys = [band_keys(signatures(owner, value, count.astype(np.float64), n))]
    repeats = np.bincount(owner, count > 1, n) > 0
    again = repeats[owner]
    place = np.cumsum(repeats) - 1
    keys.append(band_keys(signatures(place[owner[again]], value[again], np.ones(int(again.sum())), int(repeats.sum()))))
    whose = np.concatenate([np.repeat(np.arange(n), BANDS), np.repeat(np.flatnonzero(repeats), BANDS)])
    flat = np.concatenate([k.reshape(-1) for k in keys])[np.argsort(whose, kind="stable")]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(BANDS * (1 + repeats.astype(np.int64)))]), pa.int32()), pa.array(flat))


def _signed(docs: DataFrame, with_sets: bool) -> DataFrame:
    """doc_id, key, content (digest of the weighted shingles, null if there are none), and their bands or themselves."""
    names = ["doc_id", "key", "content", "shingles" if with_sets else "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            texts = b.column(2).to_pylist()
            for i, j in _chunks(texts):
                owner, value, count = shingles(texts[i:j])
                n = np.bincount(owner, minlength=j - i)
                at = np.cumsum(n) - n
                blocks = [_bytes_of(value[a : a + m], count[a : a + m]) for a, m in zip(at.tolist(), n.tolist())]
                digest = [hashlib.blake2b(x, digest_size=16).digest() if m else None for x, m in zip(blocks, n.tolist())]
                if with_sets:
                    last = pa.array(blocks, pa.binary())
                else:
                    last = _bands(owner, value, count, j - i)
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(digest, pa.binary()), last], names)

    return docs.mapInArrow(run, f"doc_id long, key long, content binary, {names[3]} {'binary' if with_sets else 'array<long>'}")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; the key tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b of nodes whose similarity is at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            keep = [similarity(_set(x), _set(y)) >= threshold - 1e-9 for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, class_id: the least id of each connected component, for ids that have a link.

    Least labels spread along links and jump to their label's label until nothing changes; each round is written
    to shared storage, and only its count of changes comes to the driver.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("class_id").alias("least"))
        spread = labels.join(near, labels.id == near.a).select("id", "class_id", F.least("class_id", "least").alias("now"))
        up = labels.select(F.col("id").alias("now"), F.col("class_id").alias("jump"))
        after = materialize(spread.join(up, "now", "left").select("id", F.least("now", "jump").alias("class_id"), (F.least("now", "jump") < F.col("class_id")).alias("changed")), "labels")
        labels = after.select("id", "class_id")
        if not after.where("changed").limit(1).count():
            return labels


def roots(parents: DataFrame) -> DataFrame:
    """id, root of a forest of pointers (id, to): every pointer jumps over the one it leads to until none changes."""
    now = materialize(parents.select("id", "to"), "roots")
    while True:
        up = now.select(F.col("id").alias("to"), F.col("to").alias("above"))
        after = materialize(now.join(up, "to", "left").select("id", F.coalesce("above", "to").alias("to"), F.col("above").isNotNull().alias("changed")), "roots")
        now = after.select("id", "to")
        if not after.where("changed").limit(1).count():
            return now.select("id", F.col("to").alias("root"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def last_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: tops that a link joins, from all pairs of members (key, node, top) of one key but different tops.

    Members of a key fall into blocks of about BLOCK, and each two blocks meet in a cell of their own, where the
    shingles that several members hold become columns and a matrix product counts what each pair shares. That count
    gives the similarity of the sets; where shingles repeat, pairs that the shared weight allows are computed.
    """
    apart = members.groupBy("key").agg(F.count("*").alias("size"), F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo != hi")
    cut = members.join(apart.select("key", F.ceil(F.col("size") / BLOCK).alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "top", "node").join(sets, "node")

    def run(cell: pa.Table) -> pa.Table:
        top, block, held = cell["top"].to_numpy(), cell["block"].to_numpy(), [_set(x) for x in cell["shingles"].to_pylist()]
        one, two = (np.flatnonzero(block == cell[x][0].as_py()) for x in ("i", "j"))
        size = np.array([len(v) for v, _ in held])
        flat = np.array([bool((w == 1).all()) for _, w in held])
        values, owner = np.concatenate([v for v, _ in held]), np.repeat(np.arange(len(held)), size)
        share = np.concatenate([w / w.sum() for _, w in held])
        order = np.argsort(values, kind="stable")
        values, owner, share = values[order], owner[order], share[order]
        column = np.cumsum(np.append(False, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
        several = np.bincount(column)[column] > 1
        owner, share, column = owner[several], share[several], np.unique(column[several], return_inverse=True)[1]
        # common elements, and the share of either side's weight that they hold, which the similarity can't exceed
        common, mine, its = (np.zeros((len(one), len(two))) for _ in range(3))
        edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + COLUMNS + 1, COLUMNS))
        for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
            has, weighs = np.zeros((len(held), COLUMNS), np.float32), np.zeros((len(held), COLUMNS), np.float32)
            has[owner[x:y], column[x:y] - k * COLUMNS] = 1
            common += has[one] @ has[two].T
            if not flat.all():
                weighs[owner[x:y], column[x:y] - k * COLUMNS] = share[x:y]
                mine += weighs[one] @ has[two].T
                its += has[one] @ weighs[two].T
        other = top[one][:, None] != top[two]
        sure = flat[one][:, None] & flat[two]
        link = other & (common >= threshold * (size[one][:, None] + size[two] - common) - 1e-9)
        for x, y in zip(*np.nonzero(other & ~link & ~sure & (np.minimum(mine, its) >= threshold - 1e-3))):
            link[x, y] = probability_jaccard(held[one[x]], held[two[y]]) >= threshold - 1e-9
        found = np.unique(np.sort(np.stack([top[one][np.nonzero(link)[0]], top[two][np.nonzero(link)[1]]], 1), axis=1), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, key, content) of docs with an id, and content, class_id of those that have shingles."""
    keyed = _keyed(docs.where(F.col("doc_id").isNotNull()))
    signed = materialize(_signed(keyed, False).withColumn("row", F.monotonically_increasing_id()), "signatures")
    held = signed.where(F.col("content").isNotNull())
    # a node is a class of equal shingles, named by one of its rows
    contents = materialize(held.groupBy("content").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "contents")
    nodes = held.select(F.col("row").alias("node"), "doc_id", "bands").join(contents.select("node"), "node", "left_semi")
    rank = F.xxhash64("node")
    member = nodes.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(rank.alias("h"), "node")).alias("m")).where("size > 1")
    kept = materialize(member.join(buckets.select("key", "size", F.col("m.node").alias("leader")), "key"), "buckets")
    star = materialize(kept.where(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(F.count("*").alias("shared")), "star")
    wanted = nodes.join(kept.select("node").distinct(), "node", "left_semi").select("doc_id").distinct()
    again = _signed(keyed.join(wanted, "doc_id", "left_semi"), True).select("content", "shingles")
    sets = materialize(again.join(contents.select("content", "node"), "content").select("node", "shingles").dropDuplicates(["node"]), "shingles")
    # leaders come before their members by hash, so these pointers make a forest
    best = star.groupBy("node").agg(F.max(F.struct("shared", -F.col("leader"))).alias("m")).select(F.col("node").alias("a"), (-F.col("m.col2")).alias("b"))
    found = roots(verify(best, sets, threshold).select(F.col("a").alias("id"), F.col("b").alias("to")))

    small = kept.where(f"size <= {SMALL}").select("key", "node")
    other = small.select("key", F.col("node").alias("leader"))
    pairs = star.select("node", "leader").union(small.join(other, "key").where(F.col("node") < F.col("leader")).select("node", "leader"))
    # large buckets whose members are one class by now have no pair left to check
    rooted = kept.where(f"size > {SMALL}").join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    divided = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    # by node, so that joins see each node of a large family once and not once for each of its buckets
    large = materialize(rooted.join(divided, "key", "left_semi").groupBy("node").agg(F.first("root").alias("root"), F.collect_list("key").alias("keys")), "large")
    turn = lambda key: F.transform(F.sequence(F.lit(1), F.lit(SPLITS)), lambda i: F.xxhash64(F.get("bands", F.pmod(F.array_position("bands", key).cast("int") - 1 + i, F.size("bands"))), key))
    parts = large.join(nodes.select("node", "bands"), "node").select("node", "root", F.explode(F.flatten(F.transform("keys", turn))).alias("part"))
    # one leader a part, so a member makes one row a part at most, and none where it shares the leader's class
    tops = parts.groupBy("part").agg(F.min(F.struct(rank.alias("h"), "node", "root")).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    met = parts.join(tops.select("part", F.col("m.node").alias("leader"), F.col("m.root").alias("its")), "part").where(F.col("root") != F.col("its"))
    pairs = pairs.union(met.select("node", "leader")).select(*_pair("node", "leader")).distinct()
    one, two = found.select(F.col("id").alias("a"), F.col("root").alias("c")), found.select(F.col("id").alias("b"), F.col("root").alias("d"))
    apart = pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("c", "a").alias("c"), F.coalesce("d", "b").alias("d")).where("c != d")
    apart = materialize(apart, "apart")
    new = verify(apart.select("a", "b"), sets, threshold).join(apart, ["a", "b"]).select(F.col("c").alias("a"), F.col("d").alias("b"))
    merged = components(new).select(F.col("id").alias("root"), F.col("class_id").alias("top"))
    reps = contents.join(found.withColumnRenamed("id", "node"), "node", "left").select("content", "least", "node", F.coalesce("root", "node").alias("root"))
    reps = materialize(reps.join(merged, "root", "left").select("content", "least", "node", F.coalesce("top", "root").alias("top")), "classes")
    late = components(last_links(large.join(reps.select("node", "top"), "node").select(F.explode("keys").alias("key"), "node", "top"), sets, threshold))
    reps = reps.join(late.select(F.col("id").alias("top"), F.col("class_id").alias("joined")), "top", "left").select("content", "least", F.coalesce("joined", "top").alias("top"))
    reps = materialize(reps, "classes")
    least = reps.groupBy("top").agg(F.min("least").alias("class_id"))
    return signed.select("doc_id", "key", "content"), materialize(reps.join(least, "top").select("content", "top", "class_id"), "named")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), is_copy (not that document)."""
    signed, named = _classified(docs, threshold)
    out = signed.where(F.col("content").isNotNull()).join(named, "content").select("doc_id", "class_id")
    out = out.union(signed.where(F.col("content").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))
    out = out.union(docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id")))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(False)).alias("is_copy"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, one of each class: that of the least doc_id; rows with a null id all stay.

    Of rows of one class that share that id, the least text by its hash stays; of rows that repeat both, the least by
    a hash of the other columns.
    """
    signed, named = _classified(docs, threshold)
    own = signed.where(F.col("content").isNull()).select("doc_id", "key").distinct()
    first = signed.where(F.col("content").isNotNull()).join(named, "content").groupBy("top").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("m.doc_id", "m.key")
    mark, key = fresh(docs, "keep"), fresh(docs, "key")
    keep = own.union(first).select(F.col("doc_id").alias(mark), F.col("key").alias(key))
    marked = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.xxhash64("doc_id", "text"))
    kept = marked.join(keep, (F.col("doc_id").cast("long") == keep[mark]) & (marked[key] == keep[key]), "left_semi")
    same = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]))
    kept = kept.withColumn(mark, F.row_number().over(same)).where(F.col(mark) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where(F.col("doc_id").isNull()))
