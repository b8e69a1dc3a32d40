"""Hand-worked fixtures of single operators."""

import numpy as np
from pyspark.sql import functions as F

from freshet.functions.kernel import cells_of_width, in_ellipse, inverse_square, metric_cell_size
from freshet.operators import components, flood, hydraulics, localfill, topobathy
from freshet.sources.config import Config
from freshet.staging import written


def test_ellipse_and_centre_weight(spark):
    seed = spark.createDataFrame([(2,)], "k int")
    box = flood.offsets_of(seed).where(in_ellipse(F.col("k"), F.col("dr"), F.col("dc"), 10.0, 10.0))
    assert box.count() == 13
    assert abs(box.where("dr = 0 AND dc = 0").select(inverse_square(F.col("dr"), F.col("dc"), 10.0, 10.0)).first()[0] - 1e6) < 1e-3


def test_half_even_cells(spark):
    df = spark.createDataFrame([(25.0,), (35.0,), (4.0,)], "tw double").select(cells_of_width(F.col("tw"), 10.0, 10.0).alias("k"))
    assert [r.k for r in df.collect()] == [2, 4, 2]


def test_latitude_bands(spark):
    df = spark.createDataFrame([(0.0, 0.0003), (90.0, 0.0003), (91.0, 0.0003), (45.0, 30.0)], "lat double, cell double")
    x, y = metric_cell_size(F.col("cell"), F.col("lat"))
    got = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(got[0].x - 0.0003 * 111320) < 1e-6 and abs(got[1].x) < 1e-6
    assert got[2].x is None and got[3].x == 30.0 and got[3].y == 30.0


def test_single_row_has_no_deviation(spark):
    one = spark.createDataFrame([(0, 1.0)], "event int, tw double")
    assert hydraulics.within_two_sigma(one, "tw").count() == 0


def test_flow_last_line_wins_and_null_is_zero(spark):
    flow = spark.createDataFrame([(1, 7, 1.0, None), (2, 7, 2.0, 5.0), (3, 8, None, 1.0)], "line_no long, comid long, q0 double, q1 double")
    got = {(r.event, r.comid): r.q for r in hydraulics.flow_long(flow).collect()}
    assert got == {(0, 7): 2.0, (1, 7): 5.0, (0, 8): 0.0, (1, 8): 1.0}


def test_percent_is_cut(spark):
    rows = spark.createDataFrame([(e, 0, 0) for e in range(7)], "event int, r int, c int")
    assert flood.ensemble(rows, 9).first().pct == 77


def test_fills_differ_on_a_spiral():
    wet = np.array([[int(x) for x in row] for row in ("1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111")], dtype=bool)
    full, swept = localfill.closure(wet, 0, 0), localfill.passes(wet, 0, 0)
    assert full.sum() == wet.sum() and (swept <= full).all()


def test_diagonal_cells_are_two_areas_and_tiles_join(spark):
    cells = spark.createDataFrame([(0, 0, 5), (1, 1, 5), (0, 3, 5), (0, 4, 5), (1, 4, 5)], "r int, c int, value int")
    for tile in (2, 256):
        got = {(r.r, r.c): r.label for r in components.areas(cells, tile).collect()}
        assert got[0, 0] != got[1, 1] and got[0, 3] == got[0, 4] == got[1, 4] == 3


def test_segment_touching_a_corner_counts(spark):
    s = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0)], "stream_id long, x0 double, y0 double, x1 double, y1 double")
    cells = {(r.r, r.c) for r in components.crossed_cells(s).collect()}
    assert (1, 1) in cells and (0, 0) in cells and (2, 2) in cells


def test_config_first_value_wins():
    c = Config.parse(["DEM_File a b.tif", "DEM_File c.tif", "Set_Depth 0.5", "LocalFloodOption False", "Q_Fraction"])
    assert c.dem_file == "a b.tif" and c.set_depth == 0.5 and c.localfloodoption is False and c.q_fraction == 1.0


def test_cells_are_never_broadcast(spark):
    """However small their files: a million cells of a mask pack into a few kilobytes."""
    cells = written(spark.range(1_000_000).selectExpr("CAST(id div 1000 AS INT) AS r", "CAST(id % 1000 AS INT) AS c", "1 AS m"), "mask")
    ground = cells.selectExpr("r", "c", "CAST(r AS DOUBLE) AS z")
    bed = topobathy.masked(ground.withColumnRenamed("z", "v"), cells)
    few = written(spark.createDataFrame([(0, 0, 7)], "r int, c int, comid long"), "few")
    seed = flood.fixed_depth_seeds(few, ground, 1.0, 50.0, 10.0, 10.0)
    made = {"bed": bed, "surface": topobathy.topobathy(ground, written(bed, "bed"), ground.withColumnRenamed("z", "v").where("r < 9")), "seeds": seed, "stamps": flood.stamped(written(seed, "seeds"), ground, 10.0, 10.0)}
    for name, df in made.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
    assert bed.count() == 1_000_000 and bed.where("v = r").count() == 1_000_000
