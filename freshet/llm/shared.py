"""Shared folder, staging and file helpers of the operators in this package."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.staging import new_folder, shared_dir, written as staged  # noqa: F401


def filesystem(path: str):
    """pyarrow file system and inner path of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path)
    elif path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def publish(path: str, write) -> None:
    """Write a file under a name of its own, then move it to ``path``.

    A task that is run again replaces the file of the lost attempt.
    """
    store, inner = filesystem(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    temporary = f"{inner}.{uuid.uuid4().hex[:12]}.tmp"
    with store.open_output_stream(temporary) as out:
        write(out)
    store.move(temporary, inner)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; any others are left out."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def groups_by_size(texts: list[str], most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """Slices of a list that hold about ``most_chars`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most_chars:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that fewer texts are held as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that waits for other tasks afterwards: memory it no longer uses goes back to the system."""

    def lean_run(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return lean_run
