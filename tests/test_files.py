"""Packed rasters, split text, attributes, reference systems and options of a run."""

import json
import lzma
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from freshet.operators import outlines
from freshet.plans.pipeline import run
from freshet.sources import projection, raster, tables, vector
from freshet.sources.config import Config
from tests.test_pipeline import PLACE, inputs, shapefile


def lzw(data):
    """Codes as the format has them: high bit first, 256 clears, 257 ends, one code early."""
    bits, table, width, word = [], {bytes([i]): i for i in range(256)}, 9, b""
    emit = lambda code: bits.append(f"{code:0{width}b}")
    emit(256)
    n = 258
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        emit(table[word])
        table[longer], n = n, n + 1
        if n == 4095:
            emit(256)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        elif n >= (1 << width) - 1 + 1 and width < 12:
            width += 1
        word = bytes([byte])
    emit(table[word])
    n += 1
    if n >= (1 << width) and width < 12:
        width += 1
    emit(257)
    text = "".join(bits)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def packbits(data):
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out


def tiff(grid, packed, pack, predictor=1, strip=7, depth=1, nodata=None, order="<"):
    """A file in strips, by hand."""
    rows, cols = grid.shape
    strips = []
    for r in range(0, rows, strip):
        part = np.repeat(grid[r : r + strip, :, None], depth, axis=2).astype(grid.dtype.newbyteorder(order))
        if predictor == 2:
            part[:, 1:] = part[:, 1:] - part[:, :-1].copy()
        data = part.tobytes()
        if predictor == 3:
            size = grid.dtype.itemsize
            planes = np.frombuffer(part.astype(f">f{size}").tobytes(), "u1").reshape(len(part), cols * depth, size).transpose(0, 2, 1).reshape(len(part), -1, depth)
            planes = planes.copy()
            planes[:, 1:] = planes[:, 1:] - planes[:, :-1].copy()
            data = planes.tobytes()
        strips.append(pack(data))
    form = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    fields = {256: (4, [cols]), 257: (4, [rows]), 258: (3, [grid.dtype.itemsize * 8]), 259: (3, [packed]), 273: (4, [0] * len(strips)), 277: (3, [depth]), 278: (4, [strip]), 279: (4, [len(x) for x in strips]), 317: (3, [predictor]), 339: (3, [form])}
    if nodata is not None:
        fields[42113] = (2, [f"{nodata}".encode() + b"\0"])
    size = lambda kind, v: len(v[0]) if kind == 2 else struct.calcsize({3: "H", 4: "I"}[kind]) * len(v)
    first = 8 + 2 + 12 * len(fields) + 4
    body = first + sum(size(*f) + size(*f) % 2 for f in fields.values() if size(*f) > 4)
    fields[273] = (4, [body + sum(map(len, strips[:i])) for i in range(len(strips))])
    entries, more = b"", b""
    for tag in sorted(fields):
        kind, v = fields[tag]
        data = v[0] if kind == 2 else struct.pack(order + {3: "H", 4: "I"}[kind] * len(v), *v)
        entries += struct.pack(order + "HHI", tag, kind, len(data) if kind == 2 else len(v))
        if len(data) <= 4:
            entries += data.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "I", first + len(more))
            more += data + b"\0" * (len(data) % 2)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(fields)) + entries + b"\0" * 4 + more + b"".join(strips)


PACKERS = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits, 34925: lzma.compress, 50000: lambda x: zstandard.ZstdCompressor().compress(x)}


@pytest.mark.parametrize("packed", PACKERS)
@pytest.mark.parametrize("kind,predictor,depth,order", [("f4", 1, 1, "<"), ("f4", 3, 1, "<"), ("f8", 3, 2, ">"), ("i2", 2, 3, ">"), ("u1", 2, 1, "<")])
def test_compressions_and_differences(packed, kind, predictor, depth, order):
    rng = np.random.default_rng(packed)
    grid = (rng.integers(0, 90, (40, 61)) if kind != "f4" else rng.normal(size=(40, 61)) * 100).astype(kind)
    grid[5:20] = 3
    back, _ = raster.decode(tiff(grid, packed, PACKERS[packed], predictor, depth=depth, order=order))
    assert (back == grid).all()


def test_lzw_of_long_data():
    data = np.random.default_rng(0).integers(0, 7, 60_000).astype("u1").tobytes()
    assert raster.unpack_lzw(lzw(data)) == data
    assert raster.unpack_lzw(lzw(b"a" * 50_000)) == b"a" * 50_000


def test_cells_are_decoded_block_by_block_and_empty_ones_left_out(spark, tmp_path):
    grid = np.arange(35, dtype="f4").reshape(5, 7)
    (tmp_path / "a.tif").write_bytes(tiff(grid, 8, zlib.compress, strip=2, nodata=9))
    cells = {(x.r, x.c): x.v for x in raster.read_cells(spark, str(tmp_path / "a.tif")).collect()}
    assert cells == {(i, j): float(grid[i, j]) for i in range(5) for j in range(7)}
    kept = raster.read_cells(spark, str(tmp_path / "a.tif"), nodata=True)
    assert kept.count() == 34 and kept.where("v = 9").count() == 0


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"{i % 50},{'x' * (i % 37)}" if i % 11 else "" for i in range(20_000)]
    (tmp_path / "one.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.txt").write_text("h\r\na\r\nb")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {(x.file.rsplit("/", 1)[1], x.line_no): x.line for x in tables.numbered(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("one.txt", i): x for i, x in enumerate(lines)} | {("two.txt", i): x for i, x in enumerate("hab")}


def test_quoted_cells_of_a_curve_file(spark, tmp_path):
    (tmp_path / "curve.csv").write_text('Name,COMID,Row,Col,BaseElev,depth_a,depth_b,tw_a,tw_b\n"a, b",7,1,2,10,0.1,0.2,3, 0.4\n\nc,"8",3,4,x,1,2,3,4\n')
    rows = sorted(tuple(x) for x in tables.read_curve(spark, str(tmp_path / "curve.csv")).collect())
    assert rows == [(1, 7, 1, 2, 10.0, 0.1, 0.2, 3.0, 0.4), (3, 8, 3, 4, None, 1.0, 2.0, 3.0, 4.0)]


def test_stages_out_of_order(spark, tmp_path):
    (tmp_path / "vdt.csv").write_text("h\n7,1,2,10.5,3,100,1,20,12,50,1,10,11\n8,1,2,10.5,3,50,1,10,11,100,1,20,12\n9,1,2,10.5,3,5,1,1,1\n")
    table = tables.read_vdt(spark, str(tmp_path / "vdt.csv"))
    assert [x.comid for x in tables.rising_stages(table).collect()] == [8]
    assert tables.rising_stages(tables.falling(table)).count() == 0
    steps = {x.comid: [s.q for s in x.steps] for x in tables.falling(table).collect()}
    assert steps == {7: [100.0, 50.0], 8: [100.0, 50.0], 9: [5.0]}


def dbf(path, fields, rows):
    """A table by hand: fields are (name, type, width, decimals)."""
    head = 33 + 32 * len(fields)
    data = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), head, 1 + sum(f[2] for f in fields))
    data += b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    for row in rows:
        data += b" " + b"".join(x.encode().ljust(f[2]) if f[1] == "C" else x.encode().rjust(f[2]) for x, f in zip(row, fields))
    path.write_bytes(data + b"\x1a")


def test_polygons_carry_the_streams_attributes(spark, tmp_path):
    paths = inputs(tmp_path)
    dbf(tmp_path / "lines.dbf", [("COMID", "N", 10, 0), ("slope", "N", 12, 5), ("name_of_the", "C", 20, 0), ("seen", "D", 8, 0), ("main", "L", 1, 0)], [("714", "0.00125", "Été river", "20230115", "T"), ("715", "", "", "", "?")])
    (tmp_path / "lines.prj").write_text(projection.text_of(32612))
    run(spark, Config(topwidthplausiblelimit=200.0, filter_raster=True, **paths))
    table, names = vector.read_attributes(spark, str(tmp_path / "flood.shp"))
    shown = dict(names)
    rows = [{shown[c]: x[c] for c in shown} for x in table.collect()]
    assert list(shown.values()) == ["Value", "index_righ", "COMID", "slope", "name_of_th", "seen", "main"]
    assert rows and all((x["COMID"], x["slope"], x["name_of_th"], str(x["seen"]), x["main"]) == (714, 0.00125, "Été river", "2023-01-15", True) for x in rows)
    assert projection.code_of_text((tmp_path / "flood.prj").read_text()) == 32612
    assert table.count() == vector.read_segments(spark, str(tmp_path / "flood.shp")).select("stream_id").distinct().count()


def test_geojson_lines_and_attributes(spark, tmp_path):
    shapes = [{"type": "LineString", "coordinates": [[0, 1], [2, 3, 9], [4, 5]]}, None, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 6]]]]}]
    features = [{"type": "Feature", "geometry": g, "properties": {"id": i, "q": i / 2, "name": None if i else "a"}} for i, g in enumerate(shapes)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = sorted((x.stream_id, x.x0, x.y0, x.x1, x.y1) for x in vector.read_segments(spark, str(tmp_path / "a.geojson")).collect())
    assert got == [(0, 0, 1, 2, 3), (0, 2, 3, 4, 5), (2, 0, 0, 1, 0), (2, 1, 0, 0, 0), (2, 5, 5, 6, 6)]
    table, names = vector.read_attributes(spark, str(tmp_path / "a.geojson"))
    assert [n for _, n in names] == ["id", "q", "name"] and sorted(tuple(x) for x in table.collect()) == [(0, 0, 0.0, "a"), (1, 1, 0.5, None), (2, 2, 1.0, None)]


def test_reference_systems():
    keys = lambda model, key, code: {34735: (3, (1, 1, 0, 2, 1024, 0, 1, model, key, 0, 1, code))}
    assert projection.code_of_raster(keys(1, 3072, 32612)) == 32612 and projection.code_of_raster(keys(2, 2048, 4326)) == 4326
    assert projection.code_of_raster(keys(1, 3072, 32767)) is None and projection.code_of_raster({}) is None
    for code in (4326, 4269, 32601, 32760, 26912):
        assert projection.code_of_text(projection.text_of(code)) == code
    assert projection.code_of_text('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","5070"]]') == 5070
    assert projection.code_of_text("nothing") is None and projection.text_of(5070) is None


def test_differing_reference_systems_are_refused(spark, tmp_path):
    paths = inputs(tmp_path) | {"bathy_out_file": "", "fsoutbathy": ""}
    grid, _ = raster.decode((tmp_path / "dem.tif").read_bytes())
    data = np.ascontiguousarray(grid, "<f4").tobytes()
    head = raster.file_head(grid.shape, np.dtype("<f4"), PLACE, grid.shape[0], [len(data)], False, {34735: (3, (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32612))})
    (tmp_path / "dem.tif").write_bytes(head + data)
    (tmp_path / "lines.prj").write_text(projection.text_of(4326))
    with pytest.raises(ValueError, match="EPSG:4326"):
        run(spark, Config(set_depth=1.0, topwidthplausiblelimit=60.0, **paths))


def test_unreadable_optional_rasters(spark, tmp_path):
    paths = inputs(tmp_path) | {"strmshp_file": ""}
    (tmp_path / "broken.tif").write_bytes(b"no raster")
    made = run(spark, Config(set_depth=1.0, topwidthplausiblelimit=60.0, bathywatermask=str(tmp_path / "broken.tif"), **paths))
    assert (tmp_path / "topo.tif").exists() and "topobathy" in made
    (tmp_path / "topo.tif").unlink()
    made = run(spark, Config(set_depth=1.0, topwidthplausiblelimit=60.0, **(paths | {"bathy_out_file": str(tmp_path / "missing.tif")})))
    assert "topobathy" not in made and not (tmp_path / "topo.tif").exists() and (tmp_path / "flood.tif").exists()


def test_polygons_with_holes_of_other_lengths(spark, tmp_path):
    """Rings of 9, 5 and 7 corners in one record enclose the area's cells."""
    picture = ["1111100", "1011111", "1111111", "1011111", "1001111", "1111110"]
    cells = [(i, j, 1, 0) for i, row in enumerate(picture) for j, x in enumerate(row) if x == "1"]
    rings = outlines.outlines(spark.createDataFrame(cells, "r int, c int, value int, label long"))
    assert sorted(len(x) for x in rings.first().rings) == [5, 7, 9]
    vector.write_polygons(rings.withColumn("stream_id", F.lit(4)), str(tmp_path / "flood"), PLACE)
    pieces = vector.read_segments(spark, str(tmp_path / "flood.shp")).collect()
    assert -sum((s.x0 * s.y1 - s.x1 * s.y0) / 2 for s in pieces) == 100 * len(cells)
    assert {s.stream_id for s in pieces} == {0} and max(s.x1 for s in pieces) == 1070.0 and min(s.y1 for s in pieces) == 4940.0


def test_large_shapefiles_are_read_in_spans(spark, tmp_path, monkeypatch):
    """Each span holds whole records; numbers, parts and all pieces are those of a reading at once."""
    rng = np.random.default_rng(3)
    shapefile(tmp_path / "lines.shp", [rng.normal(size=(int(n), 2)).tolist() for n in rng.integers(2, 90, 200)])
    cells = spark.createDataFrame([(i, 2 * j, 1, j) for i in range(4) for j in range(50)], "r int, c int, value int, label long")
    vector.write_polygons(outlines.outlines(cells).withColumn("stream_id", F.lit(1)), str(tmp_path / "areas"), PLACE)
    for name, n in (("lines", 200), ("areas", 50)):
        path = str(tmp_path / f"{name}.shp")
        size = (tmp_path / f"{name}.shp").stat().st_size
        spans = list(vector.record_spans("file:" + path, 1000))
        assert len(spans) > 3 and spans[0][::2] == (100, 0) and sum(x[1] for x in spans) == size - 100
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and sum(x[1] for x in vector.record_spans("file:" + path, size)) == size - 100
        monkeypatch.setattr(vector, "SPAN", 1000)
        monkeypatch.setattr(vector, "PIECES", 50)
        asked = lambda large: sorted(tuple(x) for x in vector.read_segments(spark, path, large).collect())
        assert asked(1) == asked(1 << 30) and len({x[1] for x in asked(1)}) == n
        batches = list(vector.pieces_of(f"file:{path}", vector.shapefile_parts((tmp_path / f"{name}.shp").read_bytes())))
        assert len(batches) > 3 and sorted(tuple(x.values()) for b in batches for x in b.to_pylist()) == asked(1 << 30)
        monkeypatch.undo()
    assert not vector.can_open("viewfs://store/a.shp")


def test_records_of_one_area_share_its_rings(spark, tmp_path):
    """A shape is sent once, whatever the number of its records; each record still holds all of it."""
    rings = outlines.outlines(spark.createDataFrame([(0, 0, 5, 0), (0, 1, 5, 0), (7, 7, 6, 9), (3, 3, 7, 4)], "r int, c int, value int, label long"))
    told = spark.createDataFrame([(9, 6, 1)] + [(0, 5, i) for i in range(300)], "label long, value int, stream_id long")
    vector.write_polygons(rings.select("label", "rings"), str(tmp_path / "flood"), PLACE, told=told)
    vector.write_polygons(rings.select("label", "rings").join(told, "label"), str(tmp_path / "plain"), PLACE)
    for end in ("shp", "shx", "dbf"):
        assert (tmp_path / f"flood.{end}").read_bytes() == (tmp_path / f"plain.{end}").read_bytes()
    area = vector.read_segments(spark, str(tmp_path / "flood.shp")).groupBy("stream_id").agg((F.sum(F.expr("x1 * y0 - x0 * y1")) / 200).alias("n"))
    assert sorted(x.n for x in area.collect()) == [1.0] + [2.0] * 300
    table, names = vector.read_attributes(spark, str(tmp_path / "flood.shp"))
    assert sorted((int(x.a0), int(x.a1)) for x in table.collect()) == [(5, i) for i in range(300)] + [(6, 1)]
    with pytest.raises(ValueError, match="no rings"):
        vector.write_polygons(rings.where("label = 0").select("label", "rings"), str(tmp_path / "other"), PLACE, told=spark.createDataFrame([(0, 5, 1), (-3, 5, 1)], "label long, value int, stream_id long"))
