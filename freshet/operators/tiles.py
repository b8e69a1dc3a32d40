"""Square tiles of a grid, with margins, so that work on neighbourhoods runs on arrays.

A tile and its margin hold a bounded number of cells, whatever the grid's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256


def tile_at(column: str, tile: int = TILE, offset: Column | int = 0) -> Column:
    return F.floor((F.col(column) + offset) / tile).cast("int")


def on_tiles(cells: DataFrame, reach: Column | int, tile: int = TILE) -> DataFrame:
    """A row for each tile ``(tr, tc)`` that the square of ``reach`` cells around a cell meets."""
    reach = F.lit(reach) if isinstance(reach, int) else reach
    rows, cols = (F.sequence(tile_at(c, tile, -reach), tile_at(c, tile, reach)) for c in ("r", "c"))
    return cells.select("*", F.explode(rows).alias("tr")).select("*", F.explode(cols).alias("tc"))


def array_of(cells: pd.DataFrame, column: str, r0: int, c0: int, rows: int, cols: int, empty: float = np.nan) -> np.ndarray:
    """Values of cells within a window, ``empty`` where there is none."""
    out = np.full((rows, cols), empty)
    r, c = cells["r"].to_numpy() - r0, cells["c"].to_numpy() - c0
    inside = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
    out[r[inside], c[inside]] = cells[column].to_numpy()[inside]
    return out
