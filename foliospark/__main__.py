"""python -m foliospark [options] file.pdf | folder …"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from foliospark.plans.run import main


def session(jobs: int) -> SparkSession:
    spark = SparkSession.builder.master(f"local[{jobs}]").appName("foliospark").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], session))
