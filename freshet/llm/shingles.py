"""Near duplicates of a given Jaccard similarity of word shingles, by SimHash fingerprints and vantage-point trees.

A document is the set of its shingles' 64-bit hashes and has a fingerprint of 256 bits or more, each the majority of a
bit of the mixed hashes.  Sets at 0.8 differ in about 0.15 of the
bits, others in half of them.  As in operator 6, each segment of a fingerprint has a vantage-point tree over its values,
and a fingerprint meets those within one bit on a segment in some leaf, where 256 bits are compared.  There are as many
segments as it takes for a pair at 0.8 to meet in none once in a million.  Fingerprints that a chain of near ones
joins in a leaf are a bucket.

Every candidate is verified on the whole sets.  A bucket's documents are first held against
its least one; only where that leaves a bucket in more than one component are all its
pairs held against each other, with buckets that hold the same documents taken once.

Contract
--------
Texts of at most ``words_in_shingle`` words are one shingle; null texts and those without a word are the
empty set and alike.  Repeated rows share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, sliced, staged
from .simhash import SEED, Forest, VantageTree, components

WORDS, LEAST = 5, 0.8
#: Share of the bits in which sets at 0.8 differ: 0.15 for large sets, 0.165 at most for others (simulated), but 0.19 for five shingles against four of them.
DIFFER, MISSED = 0.165, 1e-6
#: A set of fewer shingles is at 0.8 with none but itself.
LEAST_SHINGLES = 4
#: Words of a fingerprint that are compared in a leaf, and the bits in which near ones differ at most: of the first two words, of all, and of the
#: wide fingerprints that are compared before two sets are.  All are above the mean at ``DIFFER`` by 5.6 standard deviations or more.
COMPARED, FIRST_BITS, BITS = 4, 48, 76
WIDE, WIDE_BITS = 16, 264
_SALT = np.random.default_rng(11).integers(0, 2**64, size=64, dtype=np.uint64)


def shingle_set(text: str | None, words_in_shingle: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - words_in_shingle + 1) if words else 0
    return np.unique(np.array([digest(b" ".join(words[i : i + words_in_shingle]), SEED) for i in range(n)], dtype="<u8"))


def signature(shingles: np.ndarray, words: int) -> np.ndarray:
    """The SimHash fingerprint of a set, in words of 64 bits; ties are 0, so that bits are independent of each other."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(shingles), 255):
        z = shingles[at : at + 255, None] + _SALT[:words]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")


def layout(n: int, aim: int) -> tuple[int, int, int]:
    """Number and width of the segments and the trees' depth for ``n`` sets; one leaf holds all of a few."""
    depth = max(0, round(math.log2(max(1, n) / aim)))
    if not depth:
        return 1, 8, 0
    width = min(22, max(8, depth + 1))
    near = (1 - DIFFER) ** width + width * DIFFER * (1 - DIFFER) ** (width - 1)
    return math.ceil(math.log(MISSED) / math.log(1 - near)), width, depth if width <= 16 else width


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sets is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def shingle_sets(docs: DataFrame, id_column: str, text_column: str, words_in_shingle: int, words: int) -> DataFrame:
    """``(key, mark, fp, sig)``; ``mark`` is a hash of the text, ``fp`` of the set, ``sig`` its fingerprint (null: fewer than ``LEAST_SHINGLES``)."""
    import xxhash

    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_column}`").alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            sets = [shingle_set(t, words_in_shingle) for t in part.column(2).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(fp, pa.int64()), pa.array([signature(s, words).tobytes() if len(s) >= LEAST_SHINGLES else None for s in sets], pa.binary())],
                ["key", "mark", "fp", "sig"],
            )

    return narrow.mapInArrow(lean(run), f"key {narrow.schema['key'].dataType.simpleString()}, mark long, fp long, sig binary")


def values(batch: pa.RecordBatch, segments: int, width: int) -> Iterator[np.ndarray]:
    """The values of each segment of the fingerprints of ``(fp, sig)``."""
    whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    bits = np.unpackbits(whole, axis=1, count=segments * width, bitorder="little")
    for at in range(0, segments * width, width):
        yield bits[:, at : at + width].astype(np.int64) @ (np.int64(1) << np.arange(width))


def large_leaves(distinct: DataFrame, segments: int, width: int, depth: int, leaf_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By segment, the leaves where more than ``leaf_rows`` live, and the number of blocks of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, value in enumerate(values(batch, segments, width) if batch.num_rows else ()):
                leaf, n = np.unique(VantageTree.of(depth, width).routes(value)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), segment, "i8")), pa.array(leaf.astype("i8")), pa.array(n.astype("i8"))], ["segment", "leaf", "n"])

    counts = distinct.select("fp", "sig").mapInArrow(lean(run), "segment long, leaf long, n long").groupBy("segment", "leaf").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > leaf_rows).orderBy("segment", "leaf").toPandas()
    return {k: (part["leaf"].to_numpy(), -(-part["n"].to_numpy() // leaf_rows)) for k, part in found.groupby("segment")}


def routed(distinct: DataFrame, segments: int, width: int, depth: int, large: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(segment, leaf, a, b, side, packed)``: fingerprints in the leaves where they live or visit, many to a row.

    Blocks ``a`` and ``b`` of a large leaf meet; ``side`` is 0 for those of the lesser block, 1 for the other's and 2 for visitors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 20_000):
            if not batch.num_rows:
                continue
            whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            fp = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
            packed = np.column_stack([fp, whole[:, :COMPARED]])
            for segment, value in enumerate(values(batch, segments, width)):
                home, row, visited = VantageTree.of(depth, width).routes(value)
                leaf = np.concatenate([home, visited]).astype(np.int64)
                who = np.concatenate([np.arange(len(fp)), row])
                blocks = np.ones(len(leaf), dtype=np.int64)
                if segment in large:
                    at = np.minimum(np.searchsorted(large[segment][0], leaf), len(large[segment][0]) - 1)
                    blocks = np.where(large[segment][0][at] == leaf, large[segment][1][at], 1)
                entry = np.repeat(np.arange(len(leaf)), blocks)
                facing = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                block = (fp[who[entry]] >> np.uint64(33)).astype(np.int64) % blocks[entry]
                lives = entry < len(fp)
                a, b = np.where(lives, np.minimum(block, facing), facing), np.where(lives, np.maximum(block, facing), facing)
                side = np.where(lives, block > facing, 2).astype(np.int64)
                most = int(blocks.max())
                code = ((leaf[entry] * most + a) * most + b) * 3 + side
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                own = packed[who[entry[order]]]
                first = order[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(first), segment, "i8")),
                        *(pa.array(x[first].astype("i8")) for x in (leaf[entry], a, b, side)),
                        pa.array([x.tobytes() for x in np.split(own, starts[1:])], pa.binary()),
                    ],
                    ["segment", "leaf", "a", "b", "side", "packed"],
                )

    return distinct.select("fp", "sig").mapInArrow(lean(run), "segment long, leaf long, a long, b long, side long, packed binary")


def joined_near(words: np.ndarray, first: np.ndarray, other: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """For each row the least one that a chain of near pairs joins it to; pairs are of a row of ``first`` and one of ``other``."""
    up = np.arange(len(words))
    x, y = words[other, 0], words[other, 1]
    rows = max(1, step // max(1, len(other)))
    for at in range(0, len(first), rows):
        some = first[at : at + rows]
        near = np.bitwise_count(words[some, 0][:, None] ^ x) + np.bitwise_count(words[some, 1][:, None] ^ y) <= FIRST_BITS
        i, j = np.nonzero(near & (up[some][:, None] != up[other]))
        i, j = some[i], other[j]
        close = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= BITS
        i, j = i[close], j[close]
        while len(i):  # the greater root of each pair hangs below the least it meets
            low, high = np.minimum(up[i], up[j]), np.maximum(up[i], up[j])
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]
            apart = up[i] != up[j]
            i, j = i[apart], j[apart]
    return up


def near_sets(distinct: DataFrame, segments: int, width: int, depth: int, leaf_rows: int) -> DataFrame:
    """``(band, fp, least)``: the buckets of two sets and more, each with its least set."""
    rows = routed(distinct, segments, width, depth, large_leaves(distinct, segments, width, depth, leaf_rows))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u8").reshape(-1, 1 + COMPARED) for x in part["packed"]]
        whole, side = np.concatenate(parts), np.repeat(part["side"].to_numpy(), [len(x) for x in parts])
        order = np.argsort(whole[:, 0].astype("<i8"), kind="stable")
        whole, side = whole[order], side[order]
        first = np.flatnonzero(side == 0)
        other = np.arange(len(whole)) if key[2] == key[3] else np.flatnonzero(side == 1)
        up = joined_near(np.ascontiguousarray(whole[:, 1:]), first, other)
        fps = whole[:, 0].astype("<i8")
        several = np.bincount(up, minlength=len(up))[up] > 1
        return pd.DataFrame({"segment": key[0], "leaf": key[1], "a": key[2], "b": key[3], "least": fps[up][several], "fp": fps[several]})

    found = rows.groupBy("segment", "leaf", "a", "b").applyInPandas(meet, "segment long, leaf long, a long, b long, least long, fp long")
    return found.select(F.xxhash64("segment", "leaf", "a", "b", "least").alias("band"), "fp", "least")


def texts_of(marked: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(fp, text)`` of the wanted ``fp``; texts take less room than their sets."""
    marks = marked.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("mark").alias("mark"))
    return texts.join(marks, "mark").groupBy("fp").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, marked: DataFrame, texts: DataFrame, least: float, words_in_shingle: int) -> DataFrame:
    """The pairs ``(u, v)`` that are alike."""
    wanted = pairs.select(F.col("u").alias("fp")).union(pairs.select(F.col("v").alias("fp"))).distinct()
    found = staged(texts_of(marked, texts, wanted), "texts")
    joined = pairs.join(found.toDF("u", "a"), "u").join(found.toDF("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda text: shingle_set(text, words_in_shingle))
        for batch in batches:
            yes = [alike(known(a.as_py()), known(b.as_py()), least) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["u", "v"]).filter(pa.array(yes, pa.bool_()))

    return joined.mapInArrow(lean(run), "u long, v long")


def joined_within(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a bucket that join components; pairs that are joined already are passed over."""
    place = {r: i for i, r in enumerate(dict.fromkeys(roots.tolist()))}
    at = [place[r] for r in roots.tolist()]
    forest, found = Forest(len(place)), []
    wide = np.array([signature(x, WIDE) for x in sets])
    for i in left.tolist():
        near = right[np.bitwise_count(wide[right] ^ wide[i]).sum(axis=1) <= WIDE_BITS]
        for j in near.tolist():
            if at[i] != at[j] and forest.root(at[i]) != forest.root(at[j]) and alike(sets[i], sets[j], least):
                forest.join(at[i], at[j])
                found.append((int(fps[i]), int(fps[j])))
    return found


def remaining(buckets: DataFrame, roots: DataFrame, marked: DataFrame, texts: DataFrame, least: float, words_in_shingle: int, block_rows: int) -> DataFrame:
    """``(u, v)``: links between components that share a bucket of more than two documents."""
    rows = buckets.join(roots, buckets["fp"] == roots["node"], "left").select("band", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.expr("bit_xor(xxhash64(fp))").alias("sign"))
    open_ = open_.where("n > 2 AND low <> high").groupBy("n", "sign").agg(F.min("band").alias("band"))
    rows = staged(rows.join(open_.select("band", F.ceil(F.col("n") / block_rows).alias("blocks")), "band"), "open")
    rows = rows.join(staged(texts_of(marked, texts, rows.select("fp").distinct()), "texts"), "fp")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "fp", "root", "text", "block", F.least("block", "facing").alias("a"), F.greatest("block", "facing").alias("b"))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fp", kind="stable")
        sets = [shingle_set(x, words_in_shingle) for x in part["text"]]
        left, right = (np.flatnonzero(part["block"].to_numpy() == k) for k in key[1:3])
        found = joined_within(part["fp"].to_numpy(), part["root"].to_numpy(), sets, left, right, least)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.groupBy("band", "a", "b").applyInPandas(meet, "u long, v long")


def one_of_each(docs: DataFrame, words_in_shingle: int = WORDS, least: float = LEAST, id_column: str = "doc_id", text_column: str = "text", block_rows: int = 1024, leaf_rows: int = 8192, aim: int = 512) -> DataFrame:
    """One row of each component of near duplicates: the least by id (nulls last), then by a hash of the text."""
    if least < LEAST:
        raise ValueError(f"fingerprints are laid out for similarities of {LEAST} and more")
    segments, width, depth = layout(docs.count(), aim)
    marked = staged(shingle_sets(docs, id_column, text_column, words_in_shingle, max(COMPARED, -(-segments * width // 64))), "shingles")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("mark"), text.alias("text"))
    distinct = staged(marked.where("sig IS NOT NULL").groupBy("fp").agg(F.first("sig").alias("sig")), "distinct")
    buckets = staged(near_sets(distinct, segments, width, depth, leaf_rows), "buckets")
    pairs = staged(buckets.where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct(), "pairs")
    edges = staged(verified(pairs, marked, texts, least, words_in_shingle), "alike")
    roots = components(edges)
    more = staged(remaining(buckets.select("band", "fp"), roots, marked, texts, least, words_in_shingle, block_rows), "more")
    if more.take(1):
        roots = components(edges.unionByName(more))
    named = marked.join(roots, marked["fp"] == roots["node"], "left").select("key", "mark", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "mark")).alias("row"))
    first = first.select(F.col("row.key").alias("__key"), F.col("row.mark").alias("__mark"))
    known = docs.withColumn("__at", F.xxhash64(text))
    kept = known.join(first, known[id_column].eqNullSafe(first["__key"]) & (known["__at"] == first["__mark"]), "left_semi")
    if marked.groupBy("key", "mark").count().where("count > 1").take(1):
        kept = kept.dropDuplicates([id_column, "__at"])
    return kept.drop("__at")
