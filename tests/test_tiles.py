"""Array operators on tiles against plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from freshet.operators import components, flood, localfill, topobathy


def plain_passes(wet, r, c):
    """Three sweeps, one cell at a time."""
    rows, cols = wet.shape
    mark = np.zeros(wet.shape, dtype=bool)
    mark[r, c] = True
    orders = [
        [(i, j) for i in range(r, rows) for j in range(c, cols)],
        [(i, j) for i in range(r, -1, -1) for j in range(c, -1, -1)],
        [(i, j) for i in range(rows) for j in range(cols)],
    ]
    for order in orders:
        for i, j in order:
            if mark[i, j]:
                mark[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2] |= wet[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
    return mark


def plain_closure(wet, r, c):
    found, todo = {(r, c)}, [(r, c)]
    while todo:
        i, j = todo.pop()
        for a in range(max(0, i - 1), min(wet.shape[0], i + 2)):
            for b in range(max(0, j - 1), min(wet.shape[1], j + 2)):
                if wet[a, b] and (a, b) not in found:
                    found.add((a, b))
                    todo.append((a, b))
    return found


def test_fills_by_plain_loops():
    rng = np.random.default_rng(2)
    differ = 0
    for n in range(300):
        rows, cols = rng.integers(1, 14, 2)
        wet = rng.random((rows, cols)) < rng.choice([0.3, 0.5, 0.7, 1.0])
        r, c = int(rng.integers(rows)), int(rng.integers(cols))
        swept, joined = localfill.passes(wet, r, c), localfill.closure(wet, r, c)
        assert (swept == plain_passes(wet, r, c)).all()
        assert set(zip(*np.nonzero(joined))) == plain_closure(wet, r, c)
        differ += int((swept != joined).any())
    assert differ > 10


def test_labels_by_plain_search():
    rng = random.Random(1)
    for n in range(40):
        cells = {(r, c): rng.randint(1, 3) for r in range(300, 312) for c in range(-2 + 2, 14) if rng.random() < 0.8}
        frame = pd.DataFrame([(r, c, v) for (r, c), v in rng.sample(sorted(cells.items()), len(cells))], columns=["r", "c", "value"])
        got = {(x.r, x.c): x.label for x in components.label_tile((0, 0), frame).itertuples()}
        for start in cells:
            seen, todo = {start}, [start]
            while todo:
                r, c = todo.pop()
                for x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if x not in seen and cells.get(x) == cells[start]:
                        seen.add(x)
                        todo.append(x)
            assert got[start] == min(r * 2**31 + c for r, c in seen)


@pytest.mark.parametrize("tile", [4, 16, 256])
def test_stamps_by_plain_sums(spark, tile):
    rng = random.Random(3)
    ground = {(r, c): rng.random() * 5 for r in range(30) for c in range(25) if rng.random() < 0.95}
    seeds = sorted({(rng.randint(0, 1), *rng.choice(sorted(ground)), rng.random() * 6, rng.randint(2, 9)) for _ in range(25)})
    dem = spark.createDataFrame([(*k, z) for k, z in ground.items()], "r int, c int, z double")
    seed = spark.createDataFrame([(e, r, c, w, 1.0, k) for e, r, c, w, k in seeds], "event int, r int, c int, wse double, tw double, k int")
    dx, dy = 30.87, 23.65

    def sums(allowed=None):
        out = {}
        for e, r, c, wse, k in seeds:
            for i in range(-k, k + 1):
                for j in range(-k, k + 1):
                    x, y = j * dx, i * dy
                    if (r + i, c + j) in ground and (x * x) / ((k * dx) * (k * dx)) + (y * y) / ((k * dy) * (k * dy)) <= 1 and (allowed is None or allowed(r, c, k, wse)[i + k, j + k]):
                        z = math.sqrt(x * x + y * y)
                        w = 1 / (1e-3 if z < 1e-4 else z) ** 2
                        a, b = out.get((e, r + i, c + j), (0.0, 0.0))
                        out[e, r + i, c + j] = a + wse * w, b + w
        return out

    def same(frame, want):
        got = {(x.event, x.r, x.c): (x.swz, x.sw) for x in frame.collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(a, b, rel_tol=1e-12) for k in want for a, b in zip(got[k], want[k]))

    same(flood.stamped(seed, dem, dx, dy, tile), sums())

    def allowed(r, c, k, wse):
        wet = np.array([[ground.get((r + i, c + j), math.inf) <= wse for j in range(-k, k + 1)] for i in range(-k, k + 1)])
        return localfill.closure(wet, k, k)

    filled = localfill.local_fill(seed, dem, tile=tile)
    assert filled.columns == [*seed.columns, "fill"]
    same(flood.stamped(filled, dem, dx, dy, tile), sums(allowed))
    assert flood.stamped(seed.limit(0), dem, dx, dy, tile).count() == 0 and localfill.local_fill(seed.limit(0), dem, tile=tile).count() == 0


@pytest.mark.parametrize("how", [{}, {"weight_origin": "corner"}, {"nearest_ring": True}])
@pytest.mark.parametrize("tile", [8, 256])
def test_infill_by_plain_means(spark, how, tile):
    rng, radius, dx, dy = random.Random(5), 4, 10.0, 7.0
    bed = {(r, c): rng.choice([0.0, 0.0, 0.0, 2.5, 3.5, -99.0]) for r in range(14) for c in range(20)}
    bed |= {(40, c): 0.0 for c in range(5)}
    frame = spark.createDataFrame([(*k, v) for k, v in bed.items()], "r int, c int, v double")
    want = {}
    for (r, c), v in bed.items():
        if v:
            continue
        near = []
        for i in range(-radius, radius + 1):
            for j in range(-radius, radius + 1):
                s = bed.get((r + i, c + j), 0)
                if s > 0 and (j * dx) ** 2 / (radius * dx) ** 2 + (i * dy) ** 2 / (radius * dy) ** 2 <= 1:
                    y, x = i, j
                    if "weight_origin" in how:
                        y, x = (d if d <= 5 else 11 - d for d in (r + i - max(r - radius, 0), c + j - max(c - radius, 0)))
                    z = math.sqrt((x * dx) ** 2 + (y * dy) ** 2)
                    near.append((math.ceil(math.sqrt(i * i + j * j)), s, 1 / (1e-3 if z < 1e-4 else z) ** 2))
        if "nearest_ring" in how:
            near = [x for x in near if x[0] == min(near)[0]]
        if near:
            want[r, c] = sum(s * w for _, s, w in near) / sum(w for _, _, w in near)
    got = {(x.r, x.c): x.v for x in topobathy.neighbour_mean(frame, dx, dy, radius, kernel_cells=5, tile=tile, **how).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
