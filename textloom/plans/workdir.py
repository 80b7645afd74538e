"""Where intermediate tables go, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only on a local master."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not hasattr(sc, "_textloom_work_dir"):
        sc._textloom_work_dir = tempfile.mkdtemp(prefix="textloom-")
    return sc._textloom_work_dir


_made: ContextVar[list[str] | None] = ContextVar("textloom_work_tables", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def work_tables() -> Iterator[list[str]]:
    """The paths of the work tables made inside, for ``delete_tables``.

    They may go once nothing that was derived from them is to be read again.
    """
    outer, made = _made.get(), []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if outer is not None:
            outer += made


def delete_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove work tables, wherever their file system is; what is gone already is passed over."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def reads_from(df: DataFrame, paths: Iterable[str]) -> bool:
    """If a frame reads one of these work tables."""
    names = {path.rsplit("/", 1)[-1] for path in paths}
    return any(part in names for file in df.inputFiles() for part in file.split("/"))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where the package is installed on the cluster.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if getattr(sc, "_textloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "textloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._textloom_shipped = True
