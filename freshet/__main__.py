"""``python -m freshet CONFIG``, or the same file under ``spark-submit``."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from freshet.plans.pipeline import run
from freshet.sources.config import Config


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m freshet CONFIG", file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("freshet").getOrCreate()
    lines = [x.value for x in spark.read.text(args[0], wholetext=True).selectExpr("explode(split(value, '\\r?\\n')) AS value").collect()]  # a few lines of options
    run(spark, Config.parse(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
