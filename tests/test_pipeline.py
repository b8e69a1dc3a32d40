"""A whole run over files, held against the same relations computed plainly."""

import struct

import numpy as np

from freshet.operators.outlines import outlines, rings_of
from freshet.plans.pipeline import run
from freshet.sources import raster, vector
from freshet.sources.config import Config

PLACE = (1000.0, 10.0, 0.0, 5000.0, 0.0, -10.0)


def shapefile(path, lines):
    body = b""
    for i, points in enumerate(lines):
        xy = np.array(points, "<f8")
        data = struct.pack("<i4d2ii", 3, *xy.min(axis=0), *xy.max(axis=0), 1, len(xy), 0) + xy.tobytes()
        body += struct.pack(">2i", i + 1, len(data) // 2) + data
    path.write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8) + body)


def inputs(folder, rows=40, cols=30):
    r, c = np.indices((rows, cols))
    (folder / "dem.tif").write_bytes(raster.encode((10 + np.abs(c - 15) * 0.5 + r * 0.01).astype("f4"), PLACE))
    (folder / "stream.tif").write_bytes(raster.encode(np.where(c == 15, 7, 0).astype("i4"), PLACE))
    (folder / "bathy.tif").write_bytes(raster.encode(np.where(c == 15, np.where(r % 2, 9.0, 0.0), 0.0).astype("f4"), PLACE))
    lines = ["COMID,Row,Col,BaseElev,depth_a,depth_b,tw_a,tw_b"] + [f"{7 + (i > 20)},{i},15,{10 + i * 0.01},0.5,0.3,20,0.1" for i in range(rows)]
    (folder / "curve.csv").write_text("\n".join(lines) + "\n")
    (folder / "flow.csv").write_text("COMID,a,b\n7,10,200\n8,20,400\n")
    shapefile(folder / "lines.shp", [[(1155.0, 4999.0), (1155.0, 4800.0)], [(1005.0, 4999.0), (1006.0, 4990.0)]])
    return {k: str(folder / v) for k, v in {"dem_file": "dem.tif", "stream_file": "stream.tif", "strmshp_file": "lines.shp", "comid_flow_file": "flow.csv", "print_curve_file": "curve.csv", "bathy_out_file": "bathy.tif", "outfld": "flood.tif", "fsoutbathy": "topo.tif"}.items()}


def test_run_writes_what_it_computes(spark, tmp_path):
    made = run(spark, Config(topwidthplausiblelimit=200.0, **inputs(tmp_path)))
    grid, place = raster.decode((tmp_path / "flood.tif").read_bytes())
    want = np.zeros((40, 30), "i4")
    for x in made["ensemble"].collect():
        want[x.r, x.c] = x.pct
    assert place == PLACE and (grid == want).all() and (grid[:, 15] == 100).all() and {0, 50, 100} == set(np.unique(grid).tolist())
    topo, _ = raster.decode((tmp_path / "topo.tif").read_bytes())
    assert topo.dtype == "<f4" and (topo[:, 15] == 9.0).all() and topo[0, 0] == 17.5
    polygons = made["polygons"].collect()
    assert {x.stream_id for x in polygons} == {0} and 100 in {x.value for x in polygons}
    pieces = vector.read_segments(spark, str(tmp_path / "flood.shp")).collect()
    assert sum((s.x0 * s.y1 - s.x1 * s.y0) / 2 for s in pieces) < 0  # clockwise
    area = -sum((s.x0 * s.y1 - s.x1 * s.y0) / 2 for s in pieces)
    labels = {(x.label, x.value) for x in polygons}
    assert area > 0 and len(polygons) == len(labels)
    assert (tmp_path / "flood.dbf").stat().st_size == 33 + 64 + 41 * len(polygons) + 1
    assert (tmp_path / "flood.shx").stat().st_size == 100 + 8 * len(polygons)


def test_fixed_depth_and_first_event(spark, tmp_path):
    paths = inputs(tmp_path) | {"strmshp_file": "", "bathy_out_file": "", "fsoutbathy": ""}
    run(spark, Config(set_depth=1.2, topwidthplausiblelimit=60.0, localfloodoption=True, **paths))
    grid, _ = raster.decode((tmp_path / "flood.tif").read_bytes())
    assert set(np.unique(grid).tolist()) == {0, 100} and (grid[20, 13:18] == 100).all() and grid[20, 10] == 0
    run(spark, Config(set_depth=0.0, topwidthplausiblelimit=200.0, **paths))
    grid, _ = raster.decode((tmp_path / "flood.tif").read_bytes())
    assert set(np.unique(grid).tolist()) == {0, 100}


def test_rings_keep_holes_and_corners(spark):
    cells = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    table = spark.createDataFrame([(r, c, 5, 0) for r, c in cells] + [(3, 3, 5, 9)], "r int, c int, value int, label long")
    out = {x.label: [[tuple(p) for p in ring] for ring in x.rings] for x in outlines(table).collect()}
    assert sorted(map(len, out[0])) == [5, 5] and len(out[9]) == 1
    signed = lambda ring: sum(a[1] * -b[0] - b[1] * -a[0] for a, b in zip(ring, ring[1:])) / 2
    assert sorted(map(signed, out[0])) == [-9.0, 1.0] and signed(out[9][0]) == -1.0
    # two cells that touch at a corner are two rings
    two = [(0, 0, 0), (0, 1, 1), (1, 1, 2), (1, 0, 3), (1, 1, 0), (1, 2, 1), (2, 2, 2), (2, 1, 3)]
    assert sorted(map(len, rings_of(two))) == [5, 5]


def test_tiles_and_differences(tmp_path):
    grid = np.arange(20 * 20).reshape(20, 20).astype("u2")
    import zlib

    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            block = np.zeros((16, 16), "u2")
            part = grid[r : r + 16, c : c + 16]
            block[: part.shape[0], : part.shape[1]] = part
            block[:, 1:] = block[:, 1:] - block[:, :-1]
            tiles.append(zlib.compress(block.tobytes()))
    fields = {256: (4, (20,)), 257: (4, (20,)), 258: (3, (16,)), 259: (3, (8,)), 317: (3, (2,)), 322: (3, (16,)), 323: (3, (16,)), 324: (4, None), 325: (4, tuple(map(len, tiles)))}
    first = 8 + 2 + 12 * len(fields) + 4 + 32
    fields[324] = (4, tuple(first + sum(map(len, tiles[:i])) for i in range(4)))
    entries, more = b"", b""
    for tag, (kind, values) in fields.items():
        data = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(values), *values)
        entries += struct.pack("<HHI", tag, kind, len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", first - 32 + len(more)))
        more += data if len(data) > 4 else b""
    data = struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + entries + b"\0" * 4 + more + b"".join(tiles)
    assert (raster.decode(data)[0] == grid).all()


def test_config_takes_any_white_space():
    cfg = Config.parse(["DEM_File\ta.tif", "Comid_Flow_File  b.csv", "LocalFloodOption True", "Set_Depth 0.5", "DEM_File other"])
    assert (cfg.dem_file, cfg.comid_flow_file, cfg.localfloodoption, cfg.set_depth) == ("a.tif", "b.csv", True, 0.5)
