"""Compression of files as they come into a folder (an extension: the batch mode reads a fixed list)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans.options import Options
from foliospark.plans.pipeline import compress_files


def watch(spark: SparkSession, folder: str, options: Options, files_per_batch: int = 64) -> DataFrame:
    """A streaming DataFrame of results for every .pdf that appears below the folder."""
    source = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = source.select(F.col("path").alias("doc_id"), F.unix_millis("modificationTime").alias("ordinal"), "content")
    return compress_files(files, options)
