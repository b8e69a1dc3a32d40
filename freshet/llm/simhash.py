"""Operator 6: near duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints within 4 of 64 bits agree within 1 bit on at least one of four
16-bit segments.  For each segment a vantage-point tree splits the 65,536
possible values by their distance to a vantage value.  A fingerprint lives in one leaf
of each tree and visits the later leaves that the triangle bound can't rule out
(``|d(v, x) - d(v, y)| <= d(x, y)``), so every pair meets in some leaf,
where whole fingerprints are compared.  The trees depend on nothing but their
depth, which grows with the number of fingerprints so that leaves stay small; beyond
33 million there are three segments of 21 or 22 bits and a leaf for every value.
Leaves above ``leaf_rows`` are split into blocks that are compared block by block.
A task returns a spanning forest of its links, never all pairs.

Contract
--------
Null and empty texts, and those without a word, have fingerprint zero and link like any
other.  Repeated rows share a component; null keys are kept and are the least
only where a component has no other key (then ``component_id`` is null).  An
empty table gives an empty result, extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, lean, only, sliced, staged

SEGMENTS, BITS, RADIUS = 4, 4, 1
SEED = 42


def fingerprint(text: str | None, words_in_shingle: int = 4) -> int:
    """Majority of the bits of the shingles' hashes, as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_in_shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(words) - words_in_shingle + 1].tolist()
    ends = ends[words_in_shingle - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(key, fp)``: fingerprints as signed 64-bit integers with the same bits."""
    narrow = only(docs, key=id_column, text=text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "fp"])

    return narrow.mapInArrow(lean(run), f"key {narrow.schema['key'].dataType.simpleString()}, fp long")


class VantageTree:
    """A vantage-point tree over all values of a segment; leaves are numbered from left to right."""

    _made: dict[tuple[int, int], "VantageTree"] = {}

    def __init__(self, depth: int, width: int = 16, radius: int = RADIUS):
        self.width, self.radius = width, radius
        self.rng = np.random.default_rng(7)
        n = 1 << width
        self.home = np.zeros(n, dtype=np.int32)
        self.leaves = 0
        from_, to = [], []
        self.visits: tuple[list, list] = (from_, to)
        every = np.arange(n, dtype=np.uint32)
        self._grow(every, np.empty(0, dtype=np.uint32), depth)
        value, leaf = np.concatenate(from_ or [np.empty(0, np.uint32)]), np.concatenate(to or [np.empty(0, np.int32)])
        order = np.argsort(value, kind="stable")
        self.leaf = leaf[order].astype(np.int32)
        self.first = np.searchsorted(value[order], np.arange(n + 1))

    def _grow(self, own: np.ndarray, visiting: np.ndarray, depth: int) -> None:
        """``own`` live below this node; ``visiting`` live further left and may have partners here."""
        if depth and len(own) > 1:
            vantage = self.rng.choice(own)
            d = np.bitwise_count(own ^ vantage)
            cut = int(np.median(d))
            if (d <= cut).all():
                cut -= 1
            if (d <= cut).any():
                v = np.bitwise_count(visiting ^ vantage).astype(int)
                left = d <= cut
                boundary = own[left & (d + self.radius > cut)]
                self._grow(own[left], visiting[v - self.radius <= cut], depth - 1)
                self._grow(own[~left], np.concatenate([visiting[v + self.radius > cut], boundary]), depth - 1)
                return
        leaf = self.leaves
        self.leaves += 1
        self.home[own] = leaf
        here = np.zeros(1 << self.width, dtype=bool)
        here[own] = True
        near = np.zeros(len(visiting), dtype=bool)  # a leaf that holds no value in reach is not entered
        for flip in [1 << b for b in range(self.width)]:
            near |= here[visiting ^ np.uint32(flip)]
        self.visits[0].append(visiting[near])
        self.visits[1].append(np.full(int(near.sum()), leaf, dtype=np.int32))

    def routes(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaf where each value lives; and, as positions in ``value`` and leaves, those it visits."""
        n = self.first[value + 1] - self.first[value]
        row = np.repeat(np.arange(len(value)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return self.home[value], row, self.leaf[self.first[value][row] + within]

    @classmethod
    def of(cls, depth: int, width: int = 16) -> "VantageTree":
        if (depth, width) not in cls._made:
            cls._made[depth, width] = WholeTree(width) if depth >= width else cls(depth, width)
        return cls._made[depth, width]


class WholeTree(VantageTree):
    """The tree grown until every leaf is one value, in the order of values; it needs no table.

    A value visits the leaves of the greater values within one bit.
    """

    def __init__(self, width: int):
        self.width, self.leaves = width, 1 << width

    def routes(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = np.int64(1) << np.arange(self.width)
        row, bit = np.nonzero((value[:, None] & bits) == 0)
        return value, row, value[row] | bits[bit]


def layout(n: int, aim: int = 512) -> tuple[tuple[int, ...], int]:
    """Widths of the segments and the trees' depth for ``n`` fingerprints.

    Of four segments one is within a bit.  So is one of three (four bits on three), whose trees go deeper at about as many visits;
    they serve where leaves of one 16-bit value would hold more than ``aim``.
    """
    if n > aim << 16:
        return (22, 21, 21), 22
    return (16,) * SEGMENTS, min(16, max(0, round(np.log2(max(1, n) / aim))))


def routed(distinct: DataFrame, widths: tuple[int, ...], depth: int) -> DataFrame:
    """``(segment, leaf, fp, home)``: every fingerprint in the leaves where it lives or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 20_000):
                fp = whole[at : at + 20_000]
                shift = 0
                for segment, width in enumerate(widths):
                    value = ((fp.view("<u8") >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    shift += width
                    home, row, visited = VantageTree.of(depth, width).routes(value)
                    leaf = np.concatenate([home, visited]).astype("i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(leaf), segment, "i8")), pa.array(leaf), pa.array(np.concatenate([fp, fp[row]])), pa.array(np.arange(len(leaf)) < len(fp))],
                        ["segment", "leaf", "fp", "home"],
                    )

    return distinct.select("fp").mapInArrow(lean(run), "segment long, leaf long, fp long, home boolean")


class Forest:
    """Union-find over positions; the least position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(fps: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int = BITS, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links between rows ``left`` and ``right``."""
    forest = Forest(len(fps))
    a, b = fps[left].view("<u8"), fps[right].view("<u8")
    step = max(1, block // max(1, len(b)))
    for at in range(0, len(a), step):
        close = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= bits
        i, j = np.nonzero(close)
        for x, y in zip(left[i + at].tolist(), right[j].tolist()):
            if x != y:
                forest.join(x, y)
    root = np.array([forest.root(x) for x in range(len(fps))], dtype=np.int64)
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def links(distinct: DataFrame, n: int, leaf_rows: int = 8192, aim: int = 512) -> DataFrame:
    """``(u, v)``: links that join just the fingerprints that are joined by some chain of near pairs."""
    rows = staged(routed(distinct, *layout(n, aim)), "routed")
    large = rows.where("home").groupBy("segment", "leaf").count().where(F.col("count") > leaf_rows).select("segment", "leaf", F.ceil(F.col("count") / leaf_rows).alias("blocks"))
    rows = rows.join(large, ["segment", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("facing"))
    rows = rows.select(
        "segment", "leaf", "fp",
        F.when(F.col("home"), F.least("block", "facing")).otherwise(F.col("facing")).alias("a"),
        F.when(F.col("home"), F.greatest("block", "facing")).otherwise(F.col("facing")).alias("b"),
        F.when(~F.col("home"), 2).when(F.col("block") <= F.col("facing"), 0).otherwise(1).cast("long").alias("side"),
    )

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fp", kind="stable")
        fps, side = part["fp"].to_numpy(), part["side"].to_numpy()
        first, other = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        if key[2] == key[3]:  # within a block, and against its visitors
            other = np.arange(len(fps))
        u, v = linked(fps, first, other) if len(first) and len(fps) > 1 else (fps[:0], fps[:0])
        return pd.DataFrame({"u": u, "v": v})

    return rows.groupBy("segment", "leaf", "a", "b").applyInPandas(meet, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node of each component, for all nodes but the roots.

    Large-star and small-star steps in turn until nothing changes; the edges are
    written to the shared folder after each turn.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        edges = staged(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(<id>, fingerprint, component_id)`` of every document."""
    marked = staged(fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = components(links(distinct, distinct.count()))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(joined.join(smallest, "root").select("fp", "component_id"), "named")
    out = marked.join(named, "fp")
    return out.select(F.col("key").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
