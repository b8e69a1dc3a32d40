"""Outlines of connected areas as rings of cell corners.

The sides between cells of one area cancel in an aggregation over all sides, so
only outlines reach the step that strings them together, one area at a time.  That step holds
an area's outline in memory, as any writer of its polygon must.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))  # east, south, west, north: a right turn is the next one


def sides(labelled: DataFrame) -> DataFrame:
    """``(label, value, r, c, d)``: outline sides from corner (r, c) in direction ``d``, the area on the right."""
    at = lambda dr, dc, d, r, c: F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit(d).alias("d"), (F.col("r") + r).alias("kr"), (F.col("c") + c).alias("kc"))
    # kr, kc: the upper or left end, which both cells at a side agree on
    four = F.array(at(0, 0, 0, 0, 0), at(0, 1, 1, 0, 1), at(1, 1, 2, 1, 0), at(1, 0, 3, 0, 0))
    every = labelled.select("label", "value", F.explode(four).alias("s")).select("label", "value", "s.*")
    once = every.groupBy("label", "value", "kr", "kc", (F.col("d") % 2).alias("upright")).agg(F.count("*").alias("n"), F.first("r").alias("r"), F.first("c").alias("c"), F.first("d").alias("d"))
    return once.where("n = 1").select("label", "value", "r", "c", "d")


def rings_of(own: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings, clockwise around the area and counter-clockwise around holes; straight runs are one edge.

    Where two cells touch at a corner only, a ring turns right and stays at its cell.
    """
    left = set(own)
    rings = []
    for start in sorted(own):
        if start not in left:
            continue
        ring, (r, c, d) = [], start
        while (r, c, d) in left:
            left.remove((r, c, d))
            if not ring or ring[-1][2] != d:
                ring.append((r, c, d))
            r, c = r + STEPS[d][0], c + STEPS[d][1]
            d = next((t for t in ((d + 1) % 4, d, (d - 1) % 4) if (r, c, t) in left), d)
        if len(ring) > 4 and ring[0][2] == ring[-1][2]:
            del ring[0]
        corners = [(r, c) for r, c, _ in ring]
        rings.append([*corners, corners[0]])
    return rings


def outlines(labelled: DataFrame) -> DataFrame:
    """``(label, value, rings)`` of ``(r, c, value, label)``."""
    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = rings_of(list(zip(own["r"].tolist(), own["c"].tolist(), own["d"].tolist())))
        rings = [[{"r": r, "c": c} for r, c in ring] for ring in found]
        return pd.DataFrame({"label": [key[0]], "value": [key[1]], "rings": [rings]})

    return sides(labelled).groupBy("label", "value").applyInPandas(run, "label long, value int, rings array<array<struct<r: int, c: int>>>")
