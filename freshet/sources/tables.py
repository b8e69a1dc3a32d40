"""Text inputs: flow forecasts, rating curves and stage tables.

Files are read line by line in splits.  A line's number is the number of lines in the earlier splits
of its file and its place in its own split, so that the last line of a cell or a reach can win whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.staging import written



def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)``; lines of a file count from 0."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    raw = written(spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")), "lines")
    splits = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))  # a row for each split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.withColumn("before", before), ["file", "start"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line, cells)`` without headers and blank lines."""
    lines = numbered(spark, path).where((F.col("line_no") > 0) & (F.trim("line") != ""))
    return lines.select("line_no", F.trim("line").alias("line"), F.split(F.trim("line"), ",").alias("cells"))


def number(i: int, kind: str):
    return F.get("cells", F.lit(i)).try_cast(kind)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, comid, q0, q1, ...)``; the first data line tells how many events there are."""
    lines = numbered_lines(spark, path)
    first = lines.orderBy("line_no").first()
    events = len(first.cells) - 1 if first else 0
    return lines.select("line_no", number(0, "long").alias("comid"), *[number(1 + i, "double").alias(f"q{i}") for i in range(events)]).where("comid IS NOT NULL")


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """A rating-curve file by its header's names; cells may be quoted."""
    header = spark.read.text(path).first()
    names = [x.strip().strip('"') for x in header.value.split(",")] if header else []
    kinds = {"COMID": ("comid", "long"), "Row": ("r", "int"), "Col": ("c", "int"), "BaseElev": ("base_elev", "double"), "depth_a": ("depth_a", "double"), "depth_b": ("depth_b", "double"), "tw_a": ("tw_a", "double"), "tw_b": ("tw_b", "double")}
    missing = set(kinds) - set(names)
    if missing:
        raise ValueError(f"the curve file lacks {sorted(missing)}")
    row = F.from_csv("line", ", ".join(f"x{i} string" for i in range(len(names))), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    lines = numbered_lines(spark, path).select("line_no", row.alias("row"))
    return lines.select("line_no", *[F.col(f"row.x{names.index(k)}").try_cast(kind).alias(name) for k, (name, kind) in kinds.items()])


def rising_stages(vdt: DataFrame) -> DataFrame:
    """Lines whose flows don't fall from step to step, as the lookup takes them to."""
    return vdt.where(F.exists(F.sequence(F.lit(1), F.size("steps") - 1), lambda i: F.get("steps", i)["q"] > F.get("steps", i - 1)["q"]) & (F.size("steps") > 1))


def falling(vdt: DataFrame) -> DataFrame:
    """The same lines, their steps in order of falling flow."""
    return vdt.withColumn("steps", F.reverse(F.array_sort("steps")))


def read_vdt(spark: SparkSession, path: str) -> DataFrame:
    """A stage table: five fixed cells, then four for each step; lines without a step are dropped."""
    lines = numbered_lines(spark, path).withColumn("n", F.floor((F.size("cells") - 5) / 4).cast("int")).where("n > 0")
    cell = lambda j, k: F.get("cells", 5 + 4 * j + k).try_cast("float")
    steps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(cell(j, 0).alias("q"), cell(j, 1).alias("v"), cell(j, 2).alias("tw"), cell(j, 3).alias("wse")))
    return lines.select("line_no", number(0, "long").alias("comid"), number(1, "int").alias("r"), number(2, "int").alias("c"), number(3, "double").alias("elev"), number(4, "double").alias("qb"), steps.alias("steps"))
