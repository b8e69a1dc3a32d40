"""Vector files: stream lines as segments with their attributes, flood areas as polygons.

Shapefiles (with the table beside them) and GeoJSON are read, through ``binaryFile``, and decoded in the executors; large
shapefiles in spans of whole records.  Polygons, each once, and their table's rows are encoded in the executors too; the driver
strings the records together.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources.raster import open_output
from freshet.staging import shuffled, written

#: Shape types of the format (fixed values); the last two of each kind carry heights and measures.
LINES, POLYGONS = (3, 13, 23), (5, 15, 25)
CODE, VERSION = 9994, 1000
#: Bytes of a span of records, and segments sent on at once.
SPAN, PIECES = 1 << 23, 1 << 18
#: Columns of a table by what a relation holds: type, width, decimals (fixed values).
KINDS = {"bigint": (b"N", 20, 0), "int": (b"N", 20, 0), "double": (b"N", 24, 15), "string": (b"C", 254, 0), "boolean": (b"L", 1, 0), "date": (b"D", 8, 0)}


def shapefile_parts(data: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Number of each record with lines or outlines, and its parts."""
    yield from record_parts(data, 100, 0, min(len(data), 2 * struct.unpack_from(">i", data, 24)[0]))


def record_parts(data: bytes, at: int, number: int, end: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The same of the records from ``at``, the first of which has the number given."""
    while at + 8 <= end:
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0] if size >= 4 else 0
        if kind in LINES + POLYGONS:
            n_parts, n_points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, at + 52), n_points]
            xy = np.frombuffer(data, "<f8", 2 * n_points, at + 52 + 4 * n_parts).reshape(-1, 2)
            yield number, [xy[a:b] for a, b in zip(starts, starts[1:])]
        at, number = at + 8 + size, number + 1


def geojson_features(data: bytes) -> list[dict]:
    top = json.loads(data)
    return top["features"] if top.get("type") == "FeatureCollection" else [top if top.get("type") == "Feature" else {"geometry": top}]


def geojson_parts(data: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    def lines(shape: dict | None) -> list:
        if not shape:
            return []
        if shape["type"] == "GeometryCollection":
            return [x for s in shape["geometries"] for x in lines(s)]
        depth = {"LineString": 0, "MultiLineString": 1, "Polygon": 1, "MultiPolygon": 2}.get(shape["type"])
        found = [] if depth is None else [shape["coordinates"]]
        for _ in range(depth or 0):
            found = [x for part in found for x in part]
        return found

    for number, feature in enumerate(geojson_features(data)):
        if parts := [np.array([p[:2] for p in x], dtype=float).reshape(-1, 2) for x in lines(feature.get("geometry"))]:
            yield number, parts


def is_geojson(name: str) -> bool:
    return name.lower().endswith((".geojson", ".json"))


def open_input(name: str):
    """A stream that seeks, of a path as Spark's readers name it."""
    from pyarrow import fs

    store, inner = (fs.LocalFileSystem(), "/" + name[5:].lstrip("/")) if name.startswith("file:") else fs.FileSystem.from_uri(name)
    return store.open_input_file(inner)


def can_open(name: str) -> bool:
    try:
        open_input(name).close()
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def record_spans(name: str, span: int) -> Iterator[tuple[int, int, int]]:
    """Place, size and first record's number of the spans of a shapefile; none is cut within a record."""
    with open_input(name) as file:
        end = min(file.size(), 2 * struct.unpack(">i", file.read(28)[24:])[0])
        start = at = 100
        first = number = 0
        while at + 8 <= end:
            file.seek(at + 4)
            at, number = at + 8 + 2 * struct.unpack(">i", file.read(4))[0], number + 1
            if at - start >= span or at + 8 > end:
                yield start, min(at, end) - start, first
                start, first = at, number


def pieces_of(name: str, records: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        numbers = np.repeat([number for number, _ in held], [len(xy) - 1 for _, xy in held]).astype("int64")
        ends = [np.concatenate([xy[part, i] for _, xy in held]) for part in (slice(None, -1), slice(1, None)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.repeat(name, len(numbers)), *map(pa.array, (numbers, *ends))], ["path", "stream_id", "x0", "y0", "x1", "y1"])

    for number, parts in records:
        for whole in parts:
            for at in range(0, len(whole) - 1, PIECES):
                xy = whole[at : at + PIECES + 1]
                held.append((number, xy))
                n += len(xy) - 1
                if n >= PIECES:
                    yield out()
                    held, n = [], 0
    if held:
        yield out()


def read_segments(spark: SparkSession, path: str, large: int = 1 << 26) -> DataFrame:
    """``(path, stream_id, x0, y0, x1, y1)``: pieces of the lines or outlines; ids count a file's records from 0.

    Shapefiles of ``large`` bytes or more are read in spans, if they can be opened other than by Spark.
    """
    schema = "path string, stream_id long, x0 double, y0 double, x1 double, y1 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                yield from pieces_of(name, geojson_parts(data) if is_geojson(name) else shapefile_parts(data))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                yield pd.DataFrame([(name, *x) for x in record_spans(name, SPAN)], columns=["path", "start", "size", "first"])

    def run_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                with open_input(x["path"]) as file:
                    file.seek(x["start"])
                    data = file.read(x["size"])
                yield from pieces_of(x["path"], record_parts(data, 0, x["first"], len(data)))

    files = spark.read.format("binaryFile").load(path)
    long = files.where(F.col("length") >= large).select("path", "length").collect()  # a row for each large file
    if not long or any(is_geojson(x.path) or not can_open(x.path) for x in long):
        return files.select("path", "content").mapInArrow(run, schema)
    cut = files.where(F.col("length") >= large).select("path").mapInPandas(spans, "path string, start long, size long, first long")
    cut = cut.repartition(1 + sum(x.length for x in long) // SPAN, F.col("path"), F.col("start"))  # rows so small would come together in one task
    rest = files.where(F.col("length") < large).select("path", "content")  # by length files are left out unread
    return cut.mapInArrow(run_spans, schema).unionByName(rest.mapInArrow(run, schema))


def table_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """Name, kind, place and width of each column of a shapefile's table."""
    (head,) = struct.unpack_from("<H", data, 8)
    out, place = [], 1
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        letter, width, decimals = chr(data[at + 11]), data[at + 16], data[at + 17]
        kind = {"L": "boolean", "D": "date"}.get(letter, "string")
        if letter in "NF":
            kind = "double" if decimals or letter == "F" or width > 18 else "bigint"
        out.append((name, kind, place, width))
        place += width
    return out


def table_rows(data: bytes) -> Iterator[list[str | None]]:
    """Cells of each record as text that casts to its kind."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = table_fields(data)
    for i in range(n):
        row = data[head + i * size : head + (i + 1) * size]
        cells: list[str | None] = []
        for _, kind, place, width in fields:
            raw = row[place : place + width]
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            text = text.strip(" \0")
            if kind == "date":
                text = f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 else ""
            elif kind == "boolean":
                text = {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(text.upper(), "")
            cells.append(text or None)
        yield cells


def json_kind(values: list) -> str:
    known = [type(v) for v in values if v is not None]
    if known and all(t is bool for t in known):
        return "boolean"
    if known and all(t is int for t in known):
        return "bigint"
    return "double" if known and all(t in (int, float) for t in known) else "string"


def read_attributes(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(stream_id, a0, a1, ...)`` of a file's records, and the column and name of each attribute; none if there is no table."""
    table = path if is_geojson(path) else re.sub(r"(?i)\.shp$", "", path) + ".dbf"
    try:
        files = spark.read.format("binaryFile").load(table).select("content")
    except AnalysisException:
        return spark.createDataFrame([], "stream_id long"), []

    def of_geojson(data: bytes) -> tuple[list[tuple[str, str]], Iterator[list]]:
        own = [f.get("properties") or {} for f in geojson_features(data)]
        names = list(dict.fromkeys(k for x in own for k in x))
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        return [(n, json_kind([x.get(n) for x in own])) for n in names], ([text(x.get(n)) for n in names] for x in own)

    def content(data: bytes) -> tuple[list[tuple[str, str]], Iterator[list]]:
        return of_geojson(data) if is_geojson(table) else ([f[:2] for f in table_fields(data)], table_rows(data))

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(content(data)[0], columns=["name", "kind"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                cells = list(content(data)[1])
                yield pd.DataFrame({"stream_id": range(len(cells)), "cells": cells})

    fields = [(f"a{i}", x.name, x.kind) for i, x in enumerate(files.mapInPandas(names, "name string, kind string").collect())]  # a row for each column
    found = files.mapInPandas(rows, "stream_id long, cells array<string>")
    return found.select("stream_id", *[F.get("cells", F.lit(i)).try_cast(kind).alias(column) for i, (column, _, kind) in enumerate(fields)]), [(column, name) for column, name, _ in fields]


def read_projection(spark: SparkSession, path: str) -> str | None:
    """The reference system that a shapefile states beside it; GeoJSON's is fixed."""
    if is_geojson(path):
        return "EPSG:4326"
    try:
        return spark.read.text(re.sub(r"(?i)\.shp$", "", path) + ".prj", wholetext=True).first().value
    except (AnalysisException, AttributeError):
        return None


def in_cells(segment: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """Segments in units of cells: x along columns, y along rows."""
    x0, dx, _, y0, _, dy = transform
    return segment.select("stream_id", *[((F.col(c) - o) / d).alias(c) for c, o, d in (("x0", x0, dx), ("y0", y0, dy), ("x1", x0, dx), ("y1", y0, dy))])


def short_names(names: list[str]) -> list[bytes]:
    """Names as a table can hold them: ten bytes, each once."""
    out: list[bytes] = []
    for name in names:
        short, n = name.encode("utf-8", "replace")[:10].decode("utf-8", "ignore").encode(), 0
        while short in out:
            n += 1
            short = f"{name[: 9 - len(str(n))]}_{n}".encode()[:10]
        out.append(short)
    return out


def table_cell(value, kind: str) -> bytes:
    """A value as a table's cell; text beyond the format's 254 bytes is cut at a character."""
    letter, width, _ = KINDS[kind]
    if value is None or value != value:
        text = b"?" if letter == b"L" else b""
    elif letter == b"L":
        text = b"T" if value else b"F"
    elif letter == b"D":
        text = value.strftime("%Y%m%d").encode()
    elif letter == b"C":
        text = str(value).encode()[:width].decode("utf-8", "ignore").encode()
    else:
        text = (f"{value:.15g}" if kind == "double" else str(int(value))).encode()
    return text.ljust(width) if letter == b"C" else text.rjust(width)


def write_polygons(rings: DataFrame, path: str, transform: tuple[float, ...], fields: list[tuple[str, str]] | None = None, projection: str | None = None, told: DataFrame | None = None) -> None:
    """Write ``(label, columns, rings)`` to ``<path>.shp``, ``.shx``, ``.dbf`` and, if known, ``.prj``, a record for each row.

    ``rings`` holds arrays of ``(r, c)`` corners; ``path`` lacks its suffix; ``fields`` are the columns and their names in the table.
    Where an area has many records, ``told`` holds them as ``(label, columns)``, and ``rings`` a row for each of their areas.
    """
    x0, dx, _, y0, _, dy = transform
    fields = fields or [("value", "Value"), ("stream_id", "index_right")]
    told, rings = (rings, rings.select("label", "rings").dropDuplicates(["label"])) if told is None else (told, rings)
    types = dict(told.dtypes)
    kinds = [types[c] if types[c] in KINDS else "string" for c, _ in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, lengths, r, c in zip(batch["label"], batch["lengths"], batch["r"], batch["c"]):
                points = np.column_stack([x0 + dx * c, y0 + dy * r]).astype("<f8")
                box = [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()]
                starts = np.cumsum([0, *lengths[:-1]]).astype("<i4")
                data = struct.pack("<i4d2i", POLYGONS[0], *box, len(lengths), len(points)) + starts.tobytes() + points.tobytes()
                yield pd.DataFrame([(label, len(data), data, *box)], columns=["label", "size", "data", "x_min", "y_min", "x_max", "y_max"])

    def run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "row": [b" " + b"".join(table_cell(cells[f"f{i}"], kind) for i, kind in enumerate(kinds)) for cells in batch["cells"]]})

    # plain lists: rings of unequal lengths make no array of arrays
    corners = F.flatten("rings")
    flat = F.transform("rings", lambda x: F.size(x)).alias("lengths"), corners["r"].alias("r"), corners["c"].alias("c")
    asked = told.select("label", F.struct(*[F.col(c).cast(kind).alias(f"f{i}") for i, ((c, _), kind) in enumerate(zip(fields, kinds))]).alias("cells"))
    rows = written(asked.mapInPandas(run_rows, "label long, row binary"), "rows")
    shapes = written(rings.select("label", *flat).mapInPandas(run, "label long, size long, data binary, x_min double, y_min double, x_max double, y_max double"), "polygons")
    shapes = shapes.join(shuffled(rows.groupBy("label").agg(F.count("*").alias("n"))), "label")
    n, total, *box = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), *[F.coalesce(f(c), F.lit(0.0)) for f, c in ((F.min, "x_min"), (F.min, "y_min"), (F.max, "x_max"), (F.max, "y_max"))]).first()
    if 100 + 8 * n + total >= 2**31:
        raise ValueError("a shapefile holds 2 GB at most; keep such areas as tables")

    def head(size: int) -> bytes:
        return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, POLYGONS[0], *box, 0, 0, 0, 0)

    columns = b"".join(name.ljust(11, b"\0") + KINDS[kind][0] + b"\0" * 4 + bytes(KINDS[kind][1:]) + b"\0" * 14 for name, kind in zip(short_names([x for _, x in fields]), kinds))
    at = 100
    with open_output(path + ".shp") as shp, open_output(path + ".shx") as shx, open_output(path + ".dbf") as dbf:
        shp.write(head(100 + 8 * n + total))
        shx.write(head(100 + 8 * n))
        dbf.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + len(columns), 1 + sum(KINDS[k][1] for k in kinds)) + columns + b"\r")
        i, table = 0, rows.orderBy("label", "row").toLocalIterator()
        for x in shapes.orderBy("label").toLocalIterator():
            data = bytes(x.data)
            for row in islice(table, x.n):
                if row.label != x.label:
                    raise ValueError("a record's area has no rings")
                i += 1
                shp.write(struct.pack(">2i", i, x.size // 2))
                shp.write(data)
                shx.write(struct.pack(">2i", at // 2, x.size // 2))
                dbf.write(bytes(row.row))
                at += 8 + x.size
        dbf.write(b"\x1a")
    if projection:
        with open_output(path + ".prj") as prj:
            prj.write(projection.encode())
