"""Operator 9: token ids in files of fixed-width packed integers.

File layout, all integers little-endian: the magic ``FRBP0001``; the blocks, each of
whole bytes; the footer with the block offsets, the key (signed 64-bit), a null flag
and the first id of each document; last a header of unsigned 64-bit integers (bits of
an id, ids in a block, documents, ids, position of the footer), which is known only then.  An id takes the least bits that hold the vocabulary.  Every block but
the last holds the same number of ids, so ids ``a`` to ``b`` need only the
blocks they touch.

Contract
--------
Null text counts as empty (the end id only).  Files follow the order of the
keys, null keys first; equal keys stand beside each other in the order of a hash of their
texts, and may go on in the next file, however many they are.  An empty table gives no file and no row.  Extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, filesystem, groups_by_size, lean, new_folder, only, publish, sliced
from .tokenise import encoder_of

MAGIC = b"FRBP0001"
HEADER = struct.Struct("<5Q")


def bits_for(vocabulary: int) -> int:
    """The least bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits, the low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class BitWriter:
    """Writes documents to an open stream, a block at a time."""

    def __init__(self, out, bits: int, block: int = 16384):
        self.out, self.bits, self.block = out, bits, block
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.place = len(MAGIC)
        self.offsets: list[int] = []
        self.keys: list[int | None] = []
        self.starts: list[int] = []
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * self.block:
            self.flush(self.waiting - self.waiting % self.block)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, dtype="<u4")
        for at in range(0, n, self.block):
            data = pack_bits(ids[at : min(at + self.block, n)], self.bits)
            self.offsets.append(self.place)
            self.out.write(data)
            self.place += len(data)
        self.pending, self.waiting = [ids[n:]], self.waiting - n

    def close(self) -> None:
        self.flush(self.waiting)
        n = len(self.keys)
        self.out.write(np.array([*self.offsets, self.place], dtype="<u8").tobytes())
        self.out.write(np.array([k or 0 for k in self.keys], dtype="<i8").tobytes())
        self.out.write(np.array([k is None for k in self.keys], dtype="u1").tobytes())
        self.out.write(np.array([*self.starts, self.n_ids], dtype="<u8").tobytes())
        self.out.write(HEADER.pack(self.bits, self.block, n, self.n_ids, self.place))


class BitFile:
    """Random access to a file: ``ids(a, b)`` reads only the blocks it needs."""

    def __init__(self, path: str):
        store, inner = filesystem(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(HEADER.size, size - HEADER.size)
        self.bits, self.block, self.n_docs, self.n_ids, footer = HEADER.unpack(tail)
        data = self.file.read_at(size - HEADER.size - footer, footer)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1)
        at = 8 * (n_blocks + 1)
        self.keys = np.frombuffer(data, "<i8", self.n_docs, at)
        self.null = np.frombuffer(data, "u1", self.n_docs, at + 8 * self.n_docs)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at + 9 * self.n_docs)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.empty(0, dtype="<u4")
        first, last = a // self.block, (b - 1) // self.block
        begin = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last + 1]) - begin, begin)
        whole = [unpack_bits(data[int(self.offsets[k]) - begin : int(self.offsets[k + 1]) - begin], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(whole)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[str, int, int]]:
    """Encode and write; returns (path, documents, ids) of each file in the order of keys.

    One range shuffle by key, then by a hash of the text and the row's number, so no key is too
    many rows for one file; a file is a partition, written under a name of its
    own and moved into place, so a lost task writes it again.
    """
    narrow = only(docs, key=id_column, text=text_column)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    numbered = narrow.withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.tokens"
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        batches = sliced(batches)
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        made = {}

        def write(out):
            nonlocal batch
            writer = BitWriter(out, bits)
            while batch is not None:
                keys = batch.column(0).to_pylist()
                at = 0
                for texts in groups_by_size([t or "" for t in batch.column(1).to_pylist()]):
                    for key, packed in zip(keys[at:], encoder.batch(texts)):
                        writer.add(key, np.frombuffer(packed + end, dtype="<u4"))
                    at += len(texts)
                batch = next(batches, None)
            writer.close()
            made.update(docs=len(writer.keys), ids=writer.n_ids)

        publish(path, write)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [made["docs"]], "ids": [made["ids"]]})

    files = ordered.mapInArrow(lean(run), "part long, path string, docs long, ids long").collect()  # a row for each file
    return [(f.path, f.docs, f.ids) for f in sorted(files)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]], id_column: str = "doc_id", documents_at_once: int = 512) -> DataFrame:
    """``(<id>, start, ids binary)`` of each document; ``start`` counts the ids of all files before."""
    rows, before = [], 0
    for path, docs, ids in files:
        rows.append((path, before))
        before += ids
    listed = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = BitFile(path)
                for a in range(0, file.n_docs, documents_at_once):
                    b = min(a + documents_at_once, file.n_docs)
                    starts = file.starts[a : b + 1].astype("i8")
                    ids = file.ids(int(starts[0]), int(starts[-1]))
                    data = [ids[s:e].tobytes() for s, e in zip(starts[:-1] - starts[0], starts[1:] - starts[0])]
                    keys = pa.array(file.keys[a:b], pa.int64(), mask=file.null[a:b].astype(bool))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(starts[:-1] + base, pa.int64()), pa.array(data, pa.binary())], ["key", "start", "ids"])

    return listed.mapInArrow(lean(run), "key long, start long, ids binary").withColumnRenamed("key", id_column)


def op9_bitpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(documents(spark, sf_dir), new_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, vocabulary=49408)
    read = read_token_files(spark, files)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
