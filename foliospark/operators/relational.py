"""Relational forms of the graph and choice operators, for tables of any collection.

Each works on columns named by its arguments, shuffles on its keys alone, and settles groups by map-side aggregates.
"""

from __future__ import annotations

import atexit
from collections.abc import Sequence
from functools import reduce
from shutil import rmtree
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that the driver and all executors share: below spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; a cluster is refused, as its executors share none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("foliospark.local.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = mkdtemp(prefix="foliospark-")
        atexit.register(rmtree, root, ignore_errors=True)
        spark.conf.set("foliospark.local.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has cut; DataFrames over it can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _written(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of an iteration with a table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has them in fewer partitions (few large row groups) than there are cores.

    Partitions are counted from the files' own row counts; no column is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.count("*").alias("parts"), F.sum("count").alias("rows")).first()
    return df.repartition(2 * cores) if held["parts"] < cores and (held["rows"] or 0) > cores else df


def reachable(edges: DataFrame, roots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node: what edges (src, dst, and those of the keys that tell edges apart) lead to from roots (keys, node).
    Cycles end.

    Each round writes the nodes that it finds and no others; what is known is all that rounds have written.
    """
    keys, spark = list(keys), edges.sparkSession
    start = roots.select(*keys, "node").distinct()
    parts = [_written(start)]
    while True:
        frontier, known = (spark.read.schema(start.schema).parquet(*some) for some in (parts[-1:], parts))
        step = frontier.join(edges, [*(frontier[k] == edges[k] for k in keys if k in edges.columns), frontier["node"] == edges["src"]]).select(*(frontier[k] for k in keys), F.col("dst").alias("node")).distinct()
        parts.append(_written(step.join(known, [*keys, "node"], "left_anti")))
        if not spark.read.schema(start.schema).parquet(parts[-1]).limit(1).count():
            return known


def dangling(edges: DataFrame, objects: DataFrame, on: Sequence[str]) -> DataFrame:
    """Edges whose target isn't among the objects."""
    return edges.join(objects.select(*on).distinct(), list(on), "left_anti")


def _doubled(links: DataFrame, reach: int) -> DataFrame:
    """id, at, value over links of these columns (at: the next): the first value among `reach` successive nodes from id
    on. Each round doubles the nodes that an entry looks past, so there are few joins; reach is a power of two."""
    now = links.select("id", "at", "value")
    for _ in range(reach.bit_length() - 1):
        past = now.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("value").alias("further"))
        now = now.join(past, "at", "left").select("id", F.col("beyond").alias("at"), F.coalesce("value", "further").alias("value"))
    return now


def follow(links: DataFrame, start: DataFrame, hops: int = 32) -> DataFrame:
    """id, value: the end of each start's chain through links (id, next, value); null if missing or beyond hops."""
    ends = _doubled(links.select("id", F.col("next").alias("at"), "value"), hops)
    return start.select("id").join(ends.select("id", "value"), "id", "left")


def nearest(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """id, value: an entry's value at the node or its nearest ancestor, over nodes (id, parent, value); depth nodes are
    looked at."""
    return _doubled(nodes.select("id", F.col("parent").alias("at"), "value"), depth).select("id", "value")


def ordinals(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Adds the place of each row from 1 in the order of a column: rows are dealt by range, numbered within their part,
    and moved on by the counts of the parts before; only the counts meet in one task."""
    held = cut(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = held.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("past"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return held.withColumn(name, own.cast("long")).join(F.broadcast(count), "part").withColumn(name, F.col(name) + F.col("past")).drop("part", "past")


def smallest(candidates: DataFrame, by: Sequence[str], size: str, rank: str, what: str) -> DataFrame:
    """For each key the candidate of least size; of equals the one of least rank."""
    return candidates.groupBy(*by).agg(F.min_by(what, F.struct(size, rank)).alias(what), F.min(size).alias(size))


def first_reason(rules: Sequence[tuple[Column, str]], otherwise: str = "") -> Column:
    """The reason of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(otherwise))


def chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Adds batch: rows of a key in order, size at a time."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def numbered(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds output: the name, and .1, .2 … for names that came before."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("output", F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("."), n.cast("string"))))


def uses(df: DataFrame, by: str, code: Column, unknown: Column) -> DataFrame:
    """by, codes (in order; null if unknown): unknown use of one row makes all of a key's use unknown."""
    found = df.groupBy(by).agg(F.array_sort(F.collect_set(code)).alias("codes"), F.bool_or(unknown).alias("unknown"))
    return found.select(by, F.when(~F.col("unknown"), F.col("codes")).alias("codes"), "unknown")


def bounds(df: DataFrame, by: str) -> DataFrame:
    """Union of rectangles u0, v0, u1, v1 and the least resolution of each key."""
    return df.groupBy(by).agg(F.min("u0").alias("u0"), F.min("v0").alias("v0"), F.max("u1").alias("u1"), F.max("v1").alias("v1"), F.min("dpi_x").alias("dpi_x"), F.min("dpi_y").alias("dpi_y"))
