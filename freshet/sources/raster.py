"""GeoTIFF rasters: band 1, in strips or tiles; plain, deflated, LZW, PackBits, LZMA or Zstandard; integer and float differences.

Files are read through ``binaryFile``.  One task cuts a file into its packed strips or tiles, which are then
dealt out and decoded to cells in parallel.  A raster is
written as one file: executors encode strips of rows, which the driver only strings together.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.staging import written


#: Tag numbers and field types of the format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, FORMAT, SCALE, TIEPOINT, TRANSFORM, CITATION = 256, 257, 258, 259, 273, 278, 279, 339, 33550, 33922, 34264, 34737
SAMPLES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, NODATA = 277, 284, 317, 322, 323, 324, 325, 42113
PROJECTION = (34735, 34736, 34737)
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def read_tags(data: bytes) -> tuple[str, dict[int, tuple[int, tuple]]]:
    """Byte order, and of each tag its field type and values."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in SIZES:
            continue
        form = order + (f"{count}s" if kind == 2 else SIZES[kind] * count)
        place = at + 10 + 12 * i
        if struct.calcsize(form) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = kind, struct.unpack_from(form, data, place)
    return order, tags


def transform_of(tags: dict[int, tuple[int, tuple]]) -> tuple[float, ...]:
    """The geotransform (x0, dx, 0, y0, 0, dy)."""
    if TRANSFORM in tags:
        m = tags[TRANSFORM][1]
        if m[1] or m[4]:
            raise ValueError("rotated rasters are not read")
        return (m[3], m[0], 0.0, m[7], 0.0, m[5])
    dx, dy = tags.get(SCALE, (12, (1.0, 1.0)))[1][:2]
    i, j, _, x, y, _ = tags.get(TIEPOINT, (12, (0.0,) * 6))[1]
    return (x - i * dx, dx, 0.0, y + j * dy, 0.0, -dy)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, which widen one code early."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = singles.copy(), 9, b""
            continue
        if not table:
            table = singles.copy()
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        last = word
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs of literal and of repeated bytes."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def unpacked(data: bytes, packed: int) -> bytes:
    if packed == 1:
        return data
    if packed in (8, 32946):
        return zlib.decompress(data)
    if packed == 5:
        return unpack_lzw(data)
    if packed == 32773:
        return unpack_bits(data)
    if packed == 34925:
        import lzma

        return lzma.decompress(data)
    if packed == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {packed} of a raster is not read")


def undone(block: np.ndarray, predictor: int) -> np.ndarray:
    """Values of a block ``(rows, columns, samples)`` whose rows were stored as differences."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "iu":
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    if predictor == 3 and block.dtype.kind == "f":  # bytes of a row by their weight, the heaviest first, as differences
        rows, cols, depth = block.shape
        size = block.dtype.itemsize
        data = np.cumsum(block.view("u1").reshape(rows, size * cols, depth), axis=1, dtype="u1")
        planes = data.reshape(rows, size, cols * depth)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols, depth)
    raise ValueError(f"predictor {predictor} of a raster is not read")


class Layout:
    """Where the blocks of band 1 lie in a file and in the grid."""

    def __init__(self, data: bytes):
        self.order, self.tags = read_tags(data)
        self.cols, self.rows, self.packed, self.predictor = self.one(WIDTH, 0), self.one(HEIGHT, 0), self.one(COMPRESSION, 1), self.one(PREDICTOR, 1)
        self.tiled = TILE_OFFSETS in self.tags
        if not (self.tiled or OFFSETS in self.tags):
            raise ValueError("the raster has neither strips nor tiles")
        self.kind = np.dtype(KINDS[self.one(FORMAT, 1), self.one(BITS, 1)]).newbyteorder(self.order)
        self.offsets, self.counts = (self.tags[t][1] for t in ((TILE_OFFSETS, TILE_COUNTS) if self.tiled else (OFFSETS, COUNTS)))
        self.high, self.wide = (self.one(TILE_HEIGHT, 0), self.one(TILE_WIDTH, 0)) if self.tiled else (min(self.one(ROWS, self.rows), self.rows), self.cols)
        self.depth = self.one(SAMPLES, 1) if self.one(PLANAR, 1) == 1 else 1
        self.across = -(-self.cols // self.wide)
        self.blocks = self.across * -(-self.rows // self.high)
        nodata = self.tags.get(NODATA, (2, (b"",)))[1][0].split(b"\0")[0].strip()
        self.nodata = float(nodata) if nodata else None

    def one(self, tag: int, default: int) -> int:
        return self.tags.get(tag, (0, (default,)))[1][0]

    def place(self, i: int) -> tuple[int, int]:
        return i // self.across * self.high, i % self.across * self.wide

    def block(self, data: bytes, i: int) -> bytes:
        return data[self.offsets[i] : self.offsets[i] + self.counts[i]]

    def how(self) -> tuple[int, int, str, int, int, int]:
        """All that decoding a block needs, as plain values."""
        return self.packed, self.predictor, self.kind.str, self.high if self.tiled else 0, self.wide, self.depth


def decode_block(data: bytes, r: int, c: int, rows: int, cols: int, packed: int, predictor: int, kind: str, high: int, wide: int, depth: int) -> np.ndarray:
    """Band 1 of a block that begins at (r, c) of a grid of ``rows`` by ``cols``; ``high`` is zero for strips."""
    whole = unpacked(data, packed)
    own = np.dtype(kind)
    n = high or min(rows - r, len(whole) // (own.itemsize * wide * depth))
    return undone(np.frombuffer(whole, own, n * wide * depth).reshape(n, wide, depth), predictor)[: rows - r, : cols - c, 0]


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """Band 1 and the geotransform."""
    own = Layout(data)
    grid = np.empty((own.rows, own.cols), own.kind)
    for i in range(own.blocks):
        r, c = own.place(i)
        part = decode_block(own.block(data, i), r, c, own.rows, own.cols, *own.how())
        grid[r : r + part.shape[0], c : c + part.shape[1]] = part
    return grid, transform_of(own.tags)


def file_head(shape: tuple[int, int], kind: np.dtype, transform: tuple[float, ...], strip_rows: int, sizes: list[int], deflate: bool, projection: dict[int, tuple[int, tuple]]) -> bytes:
    """All that stands before the strips, whose packed sizes are given."""
    form = {"i": 2, "u": 1, "f": 3}[kind.kind]
    fields = {
        WIDTH: (4, (shape[1],)), HEIGHT: (4, (shape[0],)), BITS: (3, (kind.itemsize * 8,)), COMPRESSION: (3, (8 if deflate else 1,)), 262: (3, (1,)),
        OFFSETS: (4, (0,) * len(sizes)), SAMPLES: (3, (1,)), ROWS: (4, (strip_rows,)), COUNTS: (4, tuple(sizes)), FORMAT: (3, (form,)),
        SCALE: (12, (transform[1], -transform[5], 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, transform[0], transform[3], 0.0)), **projection,
    }

    def values(tag: int) -> bytes:
        code, own = fields[tag]
        data = own[0] if code == 2 else struct.pack("<" + SIZES[code] * len(own), *own)
        return data + b"\0" * (len(data) % 2)

    extra = 8 + 2 + 12 * len(fields) + 4
    first = extra + sum(len(v) for v in map(values, fields) if len(v) > 4)
    ends = np.cumsum([first, *sizes])
    if ends[-1] >= 2**32:
        raise ValueError("a GeoTIFF file holds 4 GB at most; keep such grids as tables of cells")
    fields[OFFSETS] = (4, tuple(ends[:-1].tolist()))
    entries, more = b"", b""
    for tag in sorted(fields):
        code, own = fields[tag]
        data = values(tag)
        entries += struct.pack("<HHI", tag, code, len(own[0]) if code == 2 else len(own))
        entries += struct.pack("<I", extra + len(more)) if len(data) > 4 else data.ljust(4, b"\0")
        more += data if len(data) > 4 else b""
    return struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + entries + struct.pack("<I", 0) + more


def encode(grid: np.ndarray, transform: tuple[float, ...], deflate: bool = True) -> bytes:
    """A GeoTIFF of a grid in one strip."""
    grid = np.ascontiguousarray(grid, grid.dtype.newbyteorder("<"))
    strip = zlib.compress(grid.tobytes()) if deflate else grid.tobytes()
    return file_head(grid.shape, grid.dtype, transform, grid.shape[0], [len(strip)], deflate, {}) + strip


def open_output(path: str):
    """A stream to a local path or a URI; folders are made."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner, compression=None)


def details(spark: SparkSession, path: str) -> tuple[tuple[int, int], tuple[float, ...], dict[int, tuple[int, tuple]]]:
    """Rows and columns, geotransform, and projection tags of one raster; its cells aren't sent to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                _, tags = read_tags(data)
                yield pd.DataFrame({"tags": [repr({t: tags[t] for t in (WIDTH, HEIGHT, SCALE, TIEPOINT, TRANSFORM, *PROJECTION) if t in tags})]})

    import ast

    tags = ast.literal_eval(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "tags string").first().tags)
    return (tags[HEIGHT][1][0], tags[WIDTH][1][0]), transform_of(tags), {t: tags[t] for t in PROJECTION if t in tags}


def list_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the ``.tif`` and ``.img`` files of a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,img}").load(folder).select("path", "length")


def write_raster(cells: DataFrame, path: str, shape: tuple[int, int], kind: str, transform: tuple[float, ...], projection: dict | None = None, fill: float = 0.0, strip_rows: int = 256, nodata: float | None = None) -> None:
    """Write ``(r, c, v)`` as one GeoTIFF; cells that are absent or null hold ``fill``, or ``nodata``, which the file then names."""
    rows, cols = shape
    more = dict(projection or {})
    if nodata is not None:
        fill, more[NODATA] = nodata, (2, (f"{nodata:.17g}".encode() + b"\0",))
    kept = np.dtype(kind).newbyteorder("<")

    def packed(strip: int, own: pd.DataFrame | None = None) -> bytes:
        grid = np.full((min(strip_rows, rows - strip * strip_rows), cols), fill, kept)
        if own is not None:
            grid[own["r"].to_numpy() - strip * strip_rows, own["c"].to_numpy()] = own["v"].to_numpy()
        return zlib.compress(grid.tobytes())

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        data = packed(int(key[0]), own)
        return pd.DataFrame({"strip": [int(key[0])], "size": [len(data)], "data": [data]})

    own = cells.where(f"v IS NOT NULL AND r BETWEEN 0 AND {rows - 1} AND c BETWEEN 0 AND {cols - 1}").select(F.floor(F.col("r") / strip_rows).alias("strip"), "r", "c", F.col("v").cast("double").alias("v"))
    strips = written(own.groupBy("strip").applyInPandas(run, "strip long, size long, data binary"), "strips")
    sizes = {x.strip: x.size for x in strips.select("strip", "size").collect()}  # a row for each strip of rows
    every = range(-(-rows // strip_rows))
    blank = {len_: packed(s) for s in {0, every[-1]} for len_ in [min(strip_rows, rows - s * strip_rows)]}
    blank_of = lambda s: blank[min(strip_rows, rows - s * strip_rows)]
    with open_output(path) as out:
        out.write(file_head(shape, kept, transform, strip_rows, [sizes.get(s) or len(blank_of(s)) for s in every], True, more))
        at = 0
        for x in strips.orderBy("strip").toLocalIterator():
            for s in range(at, x.strip):
                out.write(blank_of(s))
            out.write(bytes(x.data))
            at = x.strip + 1
        for s in range(at, len(every)):
            out.write(blank_of(s))


def read_cells(spark: SparkSession, path: str, nodata: bool = False) -> DataFrame:
    """``(path, r, c, v)`` of all rasters under a path; with ``nodata`` the cells that a file marks as empty are left out."""
    packed = "path string, i long, r int, c int, rows int, cols int, packed int, predictor int, kind string, high int, wide int, depth int, empty double, block binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                own = Layout(data)
                for i in range(own.blocks):
                    yield pd.DataFrame([(name, i, *own.place(i), own.rows, own.cols, *own.how(), own.nodata if nodata else None, own.block(data, i))], columns=[x.split()[0] for x in packed.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                grid = decode_block(x.block, *(int(v) for v in (x.r, x.c, x.rows, x.cols, x.packed, x.predictor)), x.kind, *(int(v) for v in (x.high, x.wide, x.depth)))
                step = max(1, (1 << 18) // max(1, grid.shape[1]))
                for top in range(0, len(grid), step):
                    part = grid[top : top + step].astype(float)
                    rows, cols = np.indices(part.shape)
                    out = pd.DataFrame({"path": x.path, "r": (rows + top + x.r).ravel(), "c": (cols + x.c).ravel(), "v": part.ravel()})
                    yield out if pd.isna(x.empty) else out[out["v"] != x.empty]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    blocks = files.mapInPandas(cut, packed).repartition(F.col("path"), F.col("i"))
    return blocks.mapInPandas(run, "path string, r int, c int, v double")
