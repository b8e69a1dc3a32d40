"""Seeds, stamping, flood maps of events, and their ensemble."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.kernel import cells_of_width, stamp_of
from freshet.operators.hydraulics import width_cap
from freshet.operators.tiles import TILE, on_tiles
from freshet.staging import shuffled


def seeds(stream: DataFrame, dem: DataFrame, cell_hyd: DataFrame, reach_hyd: DataFrame, limit: float, dx: float, dy: float) -> DataFrame:
    """``(event, r, c, wse, tw, k)`` of the stream cells that flood around themselves."""
    cap = width_cap(reach_hyd, limit)
    at = stream.join(shuffled(dem), ["r", "c"]).join(reach_hyd.withColumnRenamed("tw", "reach_tw"), "comid")
    at = at.join(shuffled(cell_hyd.select("event", "r", "c", F.col("tw").alias("cell_tw"), F.col("wse").alias("cell_wse"))), ["event", "r", "c"], "left")
    own = (F.col("cell_wse") >= 0.001) & (F.col("cell_tw") >= 1e-5)
    wse = F.when(own, F.col("cell_wse")).otherwise(F.col("z") + F.col("depth"))
    tw = F.when(own, F.col("cell_tw")).otherwise(F.col("reach_tw"))
    return _sized(at.select("event", "r", "c", wse.alias("wse"), tw.alias("tw")), cap, dx, dy)


def fixed_depth_seeds(stream: DataFrame, dem: DataFrame, depth: float, limit: float, dx: float, dy: float) -> DataFrame:
    """Seeds of the mode with one depth everywhere; a single event."""
    at = stream.join(shuffled(dem), ["r", "c"]).select(F.lit(0).alias("event"), "r", "c", (F.col("z") + depth).alias("wse"), F.lit(float(limit)).alias("tw"))
    return at.where("wse >= 0.001 AND tw >= 0.00001").withColumn("k", cells_of_width(F.least("tw", F.lit(float(limit))), dx, dy))


def _sized(at: DataFrame, cap: DataFrame, dx: float, dy: float) -> DataFrame:
    kept = at.where("wse >= 0.001 AND tw >= 0.00001").join(F.broadcast(cap), "event")  # a row for each event, which are columns of one table
    return kept.select("event", "r", "c", "wse", "tw", cells_of_width(F.least("tw", "cap"), dx, dy).alias("k"))


def relocated(seed: DataFrame, dem: DataFrame, radius: int) -> DataFrame:
    """Move each seed to the lowest ground above 0.1 within ``radius``; the first in row order wins ties."""
    if radius <= 0:
        return seed.select("*", F.col("r").alias("to_r"), F.col("c").alias("to_c"))
    ground = dem.where("z > 0.1").select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").alias("nz"))
    offsets = seed.select("*", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dr")).select("*", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dc"))
    near = offsets.select("*", (F.col("r") + F.col("dr")).alias("nr"), (F.col("c") + F.col("dc")).alias("nc")).join(shuffled(ground), ["nr", "nc"])
    best = near.groupBy("event", "r", "c").agg(F.min(F.struct("nz", "nr", "nc")).alias("b"))
    return seed.join(shuffled(best), ["event", "r", "c"], "left").select(seed["*"], F.coalesce("b.nr", seed["r"]).alias("to_r"), F.coalesce("b.nc", seed["c"]).alias("to_c"))


def offsets_of(seed: DataFrame) -> DataFrame:
    """A row for each offset of the box of ``k`` cells."""
    span = F.sequence(-F.col("k"), F.col("k"))
    return seed.select("*", F.explode(span).alias("dr")).select("*", F.explode(span).alias("dc"))


def stamped(seed: DataFrame, dem: DataFrame, dx: float, dy: float, tile: int = TILE) -> DataFrame:
    """``(event, r, c, z, swz, sw)``: weighted sums over the seeds that reach a cell of the ground.

    A seed goes to the tiles that its box meets, where its weights are added to arrays; nothing is exploded
    to cells before they are summed.  A column ``fill`` of packed bits, row by row
    over the seed's box, takes the place of the ellipse's outline within it.
    """
    schema = "event int, r int, c int, swz double, sw double"
    columns = ["event", "r", "c", "wse", "k", *[c for c in seed.columns if c == "fill"]]

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        event, tr, tc = (int(x) for x in key)
        r0, c0 = tr * tile, tc * tile
        swz, sw = np.zeros((tile, tile)), np.zeros((tile, tile))
        for row in own.sort_values(["r", "c", "wse", "k"]).itertuples(index=False):
            k, top, left = int(row.k), int(row.r) - int(row.k) - r0, int(row.c) - int(row.k) - c0
            weights = stamp_of(k, dx, dy)
            if "fill" in columns:
                weights = weights * np.unpackbits(np.frombuffer(row.fill, np.uint8), count=weights.size).reshape(weights.shape)
            rows, cols = slice(max(0, -top), max(0, tile - top)), slice(max(0, -left), max(0, tile - left))
            part = weights[rows, cols]
            here = np.s_[max(0, top) : max(0, top) + part.shape[0], max(0, left) : max(0, left) + part.shape[1]]
            sw[here] += part
            swz[here] += row.wse * part
        i, j = np.nonzero(sw)
        return pd.DataFrame({"event": event, "r": i + r0, "c": j + c0, "swz": swz[i, j], "sw": sw[i, j]})

    sums = on_tiles(seed.select(*columns), F.col("k"), tile).groupBy("event", "tr", "tc").applyInPandas(run, schema)
    return sums.join(shuffled(dem.select("r", "c", "z")), ["r", "c"]).select("event", "r", "c", "z", "swz", "sw")


def flooded(sums: DataFrame, stream: DataFrame, events: int) -> DataFrame:
    """``(event, r, c)`` of wet cells: mean water surface above ground, and all stream cells."""
    wet = sums.where(F.try_divide("swz", "sw") > F.col("z")).select("event", "r", "c")
    forced = stream.select(F.explode(F.sequence(F.lit(0), F.lit(events - 1))).alias("event"), "r", "c")
    return wet.unionByName(forced).distinct()


def ensemble(flood: DataFrame, events: int) -> DataFrame:
    """``(r, c, pct)``: whole percent of the events in which a cell is wet; dry cells are absent."""
    return flood.groupBy("r", "c").agg(F.count("*").alias("n")).select("r", "c", F.expr(f"CAST((100 * n) div {events} AS INT)").alias("pct"))
