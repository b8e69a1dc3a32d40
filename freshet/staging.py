"""Relations written to the folder that driver and executors share, which cuts their lineage.

An application has one folder there, which goes when the application ends.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none and all runs on one machine a temporary one is made.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        current = spark.sparkContext.getCheckpointDir()
        place = os.path.dirname(current) if current else None
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The application's folder; the file system deletes it on exit."""
    name = f"{shared_dir(spark)}/freshet-{spark.sparkContext.applicationId}"
    if name not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _FOLDERS[name] = name
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the application's."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles, whatever Spark reckons its size to be.

    Spark goes by files, and the cells of a grid may pack a thousandfold: millions of them would be gathered in the driver to be broadcast.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
