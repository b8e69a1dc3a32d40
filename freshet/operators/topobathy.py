"""Bathymetry within a water mask, with gaps filled from what lies near."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.kernel import inverse_square_of, stamp_of
from freshet.operators.tiles import TILE, array_of, on_tiles, tile_at
from freshet.staging import shuffled

RADIUS = 19
OUTSIDE = -99.0


def masked(bathy: DataFrame, watermask: DataFrame) -> DataFrame:
    """``(r, c, v)``: bed values within the mask, -99 outside."""
    return bathy.join(shuffled(watermask), ["r", "c"]).select("r", "c", F.when(F.col("m") > 0, F.col("v")).otherwise(F.lit(OUTSIDE)).alias("v"))


def targets(bed: DataFrame) -> DataFrame:
    return bed.where("v = 0").select("r", "c")


def sources(bed: DataFrame) -> DataFrame:
    return bed.where("v > 0")


def offsets(radius: int, dx: float, dy: float) -> list[tuple[int, int, int]]:
    """``(ring, dr, dc)`` of the ellipse's cells, nearest ring first."""
    weights = stamp_of(radius, dx, dy)
    return sorted((int(np.ceil(np.sqrt(dr * dr + dc * dc))), dr, dc) for dr, dc in (np.argwhere(weights > 0) - radius).tolist())


def neighbour_mean(bed: DataFrame, dx: float, dy: float, radius: int = RADIUS, weight_origin: str = "target", kernel_cells: int = 20, nearest_ring: bool = False, tile: int = TILE) -> DataFrame:
    """``(r, c, v)`` of the targets that have sources within ``radius`` cells.

    Weights fall with the square of the distance from the target, or
    ("corner") from the corner of the search box.  ``nearest_ring`` stops at the first
    radius that has sources.  Only tiles with targets get their cells and margin, and all
    targets of a tile are summed at once, an offset at a time.
    """
    kept = bed.where("v >= 0").select("r", "c", "v")
    wanted = targets(bed).select(tile_at("r", tile).alias("tr"), tile_at("c", tile).alias("tc")).distinct()
    placed = on_tiles(kept, radius, tile).join(wanted, ["tr", "tc"], "left_semi")
    around = offsets(radius, dx, dy)

    def from_corner(at: np.ndarray, d: int) -> np.ndarray:
        """Distance in cells of an offset from the box's corner, which the grid's edge cuts; beyond the kernel it counts from its far end."""
        own = at + d - np.maximum(at - radius, 0)
        return np.where(own <= kernel_cells, own, 2 * kernel_cells + 1 - own)

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        side = tile + 2 * radius
        v = array_of(cells, "v", r0 - radius, c0 - radius, side, side)
        i, j = np.nonzero(v[radius : radius + tile, radius : radius + tile] == 0)
        value, present = np.where(v > 0, v, 0.0), (v > 0).astype(float)
        total, weight = np.zeros(len(i)), np.zeros(len(i))
        last, done = -1, np.zeros(len(i), dtype=bool)
        for ring, dr, dc in around:
            if nearest_ring and ring != last:
                last, done = ring, weight > 0
            y, x = (dr, dc) if weight_origin == "target" else (from_corner(i + r0, dr), from_corner(j + c0, dc))
            w = inverse_square_of(np.asarray(x * dx), np.asarray(y * dy)) * np.where(done, 0.0, present[i + radius + dr, j + radius + dc])
            total += w * value[i + radius + dr, j + radius + dc]
            weight += w
        have = weight > 0
        return pd.DataFrame({"r": i[have] + r0, "c": j[have] + c0, "v": total[have] / weight[have]})

    return placed.groupBy("tr", "tc").applyInPandas(run, "r int, c int, v double")


def topobathy(dem: DataFrame, bed: DataFrame, filled: DataFrame) -> DataFrame:
    """``(r, c, z)``: bed where it is above zero, filled targets, else ground."""
    joined = dem.join(shuffled(bed), ["r", "c"], "left").join(shuffled(filled.withColumnRenamed("v", "f")), ["r", "c"], "left")
    z = F.when(F.col("v") > 0, F.col("v")).when((F.col("v") == 0) & (F.col("f") > 0), F.col("f")).otherwise(F.col("z"))
    return joined.select("r", "c", z.alias("z"))
