"""Connected areas of equal value, and their join with stream lines.

Cells are labelled within tiles of bounded size; only pairs of labels that touch
across tile borders go on to a graph, whose components are found by repeated
minimum steps, each written out to cut lineage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.tiles import TILE
from freshet.staging import shuffled, written


def label_tile(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Four-connected labels within a tile: the least cell number of each area.

    Runs of equal value along rows are joined where they touch the row above.
    """
    cells = cells.sort_values(["r", "c"], kind="stable")[["r", "c", "value"]]
    r, c, value = (cells[n].to_numpy("int64") for n in ("r", "c", "value"))
    starts = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1) | (value[1:] != value[:-1])]
    run = np.cumsum(starts) - 1
    number = r * 2**31 + c
    above = np.minimum(np.searchsorted(number, number - 2**31), len(number) - 1)
    touch = (number[above] == number - 2**31) & (value[above] == value)
    pairs = np.unique(np.column_stack([run[above[touch]], run[touch]]), axis=0)
    up = list(range(int(run[-1]) + 1))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    first = number[starts]
    return cells.assign(label=first[[root(x) for x in range(len(up))]][run])


def areas(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``(r, c, value, label)`` of ``(r, c, value)``: label is the least r * 2^31 + c of the area."""
    tiled = cells.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    local = written(tiled.groupBy("tr", "tc").applyInPandas(label_tile, "r int, c int, value int, label long"), "tiles")
    edge = local.where(f"r % {tile} = 0 OR c % {tile} = 0").select("r", "c", "value", "label")
    other = local.where(f"r % {tile} = {tile - 1} OR c % {tile} = {tile - 1}").select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("value").alias("v2"), F.col("label").alias("l2"))
    up = edge.select(F.explode(F.array(F.struct((F.col("r") - 1).alias("r2"), F.col("c").alias("c2")), F.struct(F.col("r").alias("r2"), (F.col("c") - 1).alias("c2")))).alias("n"), "value", "label")
    touching = up.select("n.r2", "n.c2", "value", "label").join(shuffled(other), ["r2", "c2"]).where("value = v2 AND label <> l2")
    pairs = written(touching.select(F.greatest("label", "l2").alias("u"), F.least("label", "l2").alias("v")).distinct(), "borders")
    roots = min_components(pairs)
    out = local.join(shuffled(roots), local["label"] == roots["node"], "left")
    return out.select("r", "c", "value", F.coalesce("root", "label").alias("label"))


def min_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for nodes with edges: minimum over neighbours, then over the neighbour's root.

    Each turn writes which roots have changed, and ends when none has.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    roots = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "roots")
    while True:
        near = both.join(roots, both["v"] == roots["node"]).groupBy("u").agg(F.min("root").alias("m"))
        step = roots.join(near, roots["node"] == near["u"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        new = written(new, "roots")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def crossed_cells(segment: DataFrame) -> DataFrame:
    """``(stream_id, r, c)`` of the closed cells that a segment meets, by clipping it to each."""
    span = lambda a, b: F.sequence((F.ceil(F.least(a, b)) - 1).cast("int"), F.floor(F.greatest(a, b)).cast("int"))
    boxed = segment.select("*", F.explode(span("x0", "x1")).alias("c")).select("*", F.explode(span("y0", "y1")).alias("r"))

    def limits(start: str, end: str, cell: str):
        d = F.col(end) - F.col(start)
        a, b = F.try_divide(F.col(cell) - F.col(start), d), F.try_divide(F.col(cell) + 1 - F.col(start), d)
        inside = (F.col(start) >= F.col(cell)) & (F.col(start) <= F.col(cell) + 1)
        low = F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0))
        high = F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))
        return low, high

    (xl, xh), (yl, yh) = limits("x0", "x1", "c"), limits("y0", "y1", "r")
    hit = boxed.where(F.greatest(xl, yl, F.lit(0.0)) <= F.least(xh, yh, F.lit(1.0)))
    return hit.select("stream_id", "r", "c")


def areas_on_streams(labelled: DataFrame, segment: DataFrame) -> DataFrame:
    """``(label, value, stream_id)``: one row for each pair that meets."""
    return labelled.join(shuffled(crossed_cells(segment)), ["r", "c"]).select("label", "value", "stream_id").distinct()
