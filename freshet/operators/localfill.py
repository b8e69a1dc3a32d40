"""Cells of a seed's box that its water reaches over wet ground.

Two fills: the full eight-neighbour closure, and three ordered sweeps, which miss what can be reached
only against the last sweep's direction.  Seeds meet the ground of their tile and its margin as an
array, which is bounded by the tile and the widest box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.tiles import TILE, array_of, on_tiles, tile_at

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def closure(wet: np.ndarray, r: int, c: int) -> np.ndarray:
    """Cells joined to the seed by neighbours of eight; the seed counts even if dry."""
    rows, cols = wet.shape
    wide = cols + 2
    open_ = np.zeros((rows + 2, wide), dtype=bool)  # a dry rim, so no neighbour leaves the array
    open_[1:-1, 1:-1] = wet
    open_, mark = open_.ravel(), np.zeros((rows + 2) * wide, dtype=bool)
    edge = np.array([(r + 1) * wide + c + 1])
    steps = np.array([i * wide + j for i, j in AROUND])
    while len(edge):
        mark[edge] = True
        open_[edge] = False
        near = (edge[:, None] + steps).ravel()
        edge = np.unique(near[open_[near]])
    return mark.reshape(rows + 2, wide)[1:-1, 1:-1]


def sweep(mark: np.ndarray, wet: np.ndarray, r: int, c: int) -> None:
    """Rows from ``r`` down, each from ``c`` to the right: a marked cell marks its wet neighbours, in place.

    Within a row a mark runs on over wet cells until the first dry one.
    """
    at = np.arange(wet.shape[1] - c)
    for i in range(r, len(wet)):
        own = mark[i, c:]
        last = np.maximum.accumulate(np.where(own, at, -1))
        dry = np.maximum.accumulate(np.where(wet[i, c:], -1, at))
        acts = own | ((last >= 0) & (dry <= last))
        if not acts.any():
            continue
        wide = np.zeros(wet.shape[1], dtype=bool)
        wide[c:] = acts
        wide[c:-1] |= acts[1:] if c + 1 <= wet.shape[1] else acts
        wide[c + 1 :] |= acts[:-1]
        if c and acts[0]:
            wide[c - 1] = True
        near = slice(max(0, i - 1), i + 2)
        mark[near] |= wet[near] & wide


def passes(wet: np.ndarray, r: int, c: int) -> np.ndarray:
    """Marks spread in three sweeps: down from the seed, up from it, then over all."""
    mark = np.zeros(wet.shape, dtype=bool)
    mark[r, c] = True
    sweep(mark, wet, r, c)
    sweep(mark[::-1, ::-1], wet[::-1, ::-1], wet.shape[0] - 1 - r, wet.shape[1] - 1 - c)
    sweep(mark, wet, 0, 0)
    return mark


FILLS = {"connected": closure, "passes": passes}


def local_fill(seed: DataFrame, dem: DataFrame, mode: str = "connected", tile: int = TILE) -> DataFrame:
    """The seeds with ``fill``: packed bits, row by row, of the cells of their box that are filled."""
    fill = FILLS[mode]
    widest = seed.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    placed = seed.withColumns({"tr": tile_at("r", tile), "tc": tile_at("c", tile)})
    ground = on_tiles(dem.select("r", "c", "z"), widest, tile).join(placed.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
    names = seed.columns

    def run(key: tuple, own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        side = tile + 2 * widest
        r0, c0 = int(key[0]) * tile - widest, int(key[1]) * tile - widest
        z = array_of(cells, "z", r0, c0, side, side)
        packed = []
        for r, c, wse, k in own[["r", "c", "wse", "k"]].itertuples(index=False):
            k, i, j = int(k), int(r) - r0, int(c) - c0
            wet = z[i - k : i + k + 1, j - k : j + k + 1] <= wse
            packed.append(np.packbits(fill(wet, k, k)).tobytes())
        return own[names].assign(fill=packed)

    schema = ", ".join(f"{n} {t}" for n, t in seed.dtypes)
    return placed.groupBy("tr", "tc").cogroup(ground.groupBy("tr", "tc")).applyInPandas(run, f"{schema}, fill binary")


def filled_cells(filled: DataFrame) -> DataFrame:
    """``(event, seed_r, seed_c, dr, dc)`` of the cells filled from each seed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for event, r, c, k, bits in batch.itertuples(index=False):
                side = 2 * k + 1
                i, j = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=side * side).reshape(side, side))
                yield pd.DataFrame({"event": event, "seed_r": r, "seed_c": c, "dr": i - k, "dc": j - k})

    return filled.select("event", "r", "c", "k", "fill").mapInPandas(run, "event int, seed_r int, seed_c int, dr int, dc int")
