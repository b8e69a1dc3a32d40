"""Text inputs and rasters."""

import numpy as np
import pytest

from freshet.sources import raster, tables


def test_flow_and_stage_tables(spark, tmp_path):
    (tmp_path / "flow.csv").write_text("COMID,a,b\n7,1.5,x\n\nbad,1,2\n8,2,3\n")
    rows = [tuple(r) for r in tables.read_flow(spark, str(tmp_path / "flow.csv")).orderBy("line_no").collect()]
    assert rows == [(1, 7, 1.5, None), (4, 8, 2.0, 3.0)]
    (tmp_path / "vdt.csv").write_text("h\n7,1,2,10.5,3,100,1,20,12,50,1,10,11\n8,1,2,10.5,3\n")
    (row,) = tables.read_vdt(spark, str(tmp_path / "vdt.csv")).collect()
    assert (row.comid, row.r, row.c, row.elev, row.qb, len(row.steps), row.steps[1].tw) == (7, 1, 2, 10.5, 3.0, 2, 10.0)
    (tmp_path / "curve.csv").write_text("COMID,Row,Col,BaseElev,depth_a,depth_b,tw_a,tw_b\n7,1,2,10,0.1,0.2,3,0.4\n")
    assert tables.read_curve(spark, str(tmp_path / "curve.csv")).first().tw_a == 3.0


@pytest.mark.parametrize("kind,deflate", [("i4", True), ("f4", False), ("f8", True)])
def test_rasters_round_trip(spark, tmp_path, kind, deflate):
    grid = np.arange(35).reshape(5, 7).astype(kind)
    data = raster.encode(grid, (1000.0, 10.0, 0.0, 5000.0, 0.0, -10.0), deflate)
    back, place = raster.decode(data)
    assert (back == grid).all() and place == (1000.0, 10.0, 0.0, 5000.0, 0.0, -10.0)
    (tmp_path / "a.tif").write_bytes(data)
    cells = {(r.r, r.c): r.v for r in raster.read_cells(spark, str(tmp_path / "a.tif")).collect()}
    assert cells == {(i, j): float(grid[i, j]) for i in range(5) for j in range(7)}
