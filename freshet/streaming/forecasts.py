"""Floods of forecasts as their files arrive.

Ground, streams and rating curves of an area stand still; forecast files come into a folder.  Each
file is a micro-batch, whose events go through the same plan as in a whole run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet.operators import flood, hydraulics
from freshet.sources import tables


@dataclass
class Area:
    """What doesn't change from forecast to forecast; relations should be tables or written out."""

    dem: DataFrame
    curve: DataFrame
    dx: float
    dy: float
    factor: float = 3.0
    limit: float = 2500.0


def flood_of(area: Area, flow: DataFrame) -> DataFrame:
    """``(r, c, pct)``: the share of a forecast's events that flood a cell."""
    events = len([c for c in flow.columns if c not in ("line_no", "comid")])
    stream = hydraulics.stream_cells(area.curve)
    rf = hydraulics.reach_flow(stream, flow, events)
    h = hydraulics.cleaned_curve(area.curve, rf)
    seed = flood.seeds(stream, area.dem, hydraulics.curve_cells(h, area.factor), hydraulics.curve_reaches(h, rf), area.limit, area.dx, area.dy)
    return flood.ensemble(flood.flooded(flood.stamped(seed, area.dem, area.dx, area.dy), stream, events), events)


def watch(spark: SparkSession, folder: str, area: Area, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes the ensemble of each forecast file to ``<out>/forecast=<its name>``.

    A micro-batch that runs again after a failure replaces what it wrote.  A file without events writes nothing.
    """
    names = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1).load(folder).select(F.col("_metadata.file_path").alias("path"))

    def run(batch: DataFrame, _: int) -> None:
        for x in batch.distinct().collect():  # one file
            path = unquote(x.path)
            flow = tables.read_flow(spark, path)
            if len(flow.columns) > 2:
                name = re.sub(r"[^A-Za-z0-9_.-]", "_", path.rsplit("/", 1)[1])
                flood_of(area, flow).write.mode("overwrite").parquet(f"{out}/forecast={name}")

    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
