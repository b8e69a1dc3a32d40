"""Column expressions of the stamping kernel and of cell sizes."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres of a degree at the two ends of each latitude band: lower bound,
#: latitude at its lower and upper end, longitude at its lower and upper end (fixed values).
LATITUDE_BANDS = (
    (0, 110.57, 110.61, 111.32, 109.64),
    (10, 110.61, 110.70, 109.64, 104.64),
    (20, 110.70, 110.85, 104.65, 96.49),
    (30, 110.85, 111.03, 96.49, 85.39),
    (40, 111.03, 111.23, 85.39, 71.70),
    (50, 111.23, 111.41, 71.70, 55.80),
    (60, 111.41, 111.56, 55.80, 38.19),
    (70, 111.56, 111.66, 38.19, 19.39),
    (80, 111.66, 111.69, 19.39, 0.00),
)


def in_ellipse(k: Column, dr: Column, dc: Column, dx: float, dy: float) -> Column:
    """Whether an offset lies in the ellipse of ``k`` cells; left to right, for its edges depend on rounding."""
    x, y = dc * F.lit(dx), dr * F.lit(dy)
    return (x * x) / ((k * F.lit(dx)) * (k * F.lit(dx))) + (y * y) / ((k * F.lit(dy)) * (k * F.lit(dy))) <= 1


def inverse_square(dr: Column, dc: Column, dx: float, dy: float) -> Column:
    """1 / distance², with one millimetre in place of a zero distance."""
    x, y = dc * F.lit(dx), dr * F.lit(dy)
    z = F.sqrt(x * x + y * y)
    z = F.when(z < 1e-4, F.lit(1e-3)).otherwise(z)
    return F.lit(1.0) / (z * z)


@functools.lru_cache(16)
def stamp_of(k: int, dx: float, dy: float) -> np.ndarray:
    """Weights of the box of ``k`` cells as an array, zero outside the ellipse; the same arithmetic as the two above."""
    d = np.arange(-k, k + 1)
    x, y = (d * dx)[None, :], (d * dy)[:, None]
    inside = (x * x) / ((k * dx) * (k * dx)) + (y * y) / ((k * dy) * (k * dy)) <= 1
    return np.where(inside, inverse_square_of(x, y), 0.0)


def inverse_square_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = np.sqrt(x * x + y * y)
    z = np.where(z < 1e-4, 1e-3, z)
    return 1.0 / (z * z)


def cells_of_width(width: Column, dx: float, dy: float) -> Column:
    """Top width in cells, rounded half to even, two at least."""
    k = F.greatest(F.rint(width / F.lit(dx)), F.rint(width / F.lit(dy))).cast("int")
    return F.when(k <= 1, F.lit(2)).otherwise(k)


def metric_cell_size(cell: Column, latitude: Column) -> tuple[Column, Column]:
    """Cell size in metres along x and y; cells above half a unit are metric already.

    Null where the latitude exceeds 90 degrees.
    """
    lat = F.abs(latitude)
    x = y = None
    for base, lat_lo, lat_hi, lon_lo, lon_hi in LATITUDE_BANDS:
        inside = (lat <= base + 10) & ((lat >= base) if base == 0 else (lat > base))
        part = (lat - base) / F.lit(10.0)
        lat_km = F.lit(lat_lo) + F.lit(lat_hi - lat_lo) * part
        lon_km = F.lit(lon_lo) + F.lit(lon_hi - lon_lo) * part
        x = F.when(inside, cell * lon_km * 1000.0) if x is None else x.when(inside, cell * lon_km * 1000.0)
        y = F.when(inside, cell * lat_km * 1000.0) if y is None else y.when(inside, cell * lat_km * 1000.0)
    metric = cell > 0.5
    return F.when(metric, cell).otherwise(x), F.when(metric, cell).otherwise(y)
