"""Commits of a stored index: numbered JSON files, each of which is created once.

Whoever creates the next number has committed. A writer that comes second is told so,
reads what the first one did, and tries the number after. The file appears whole: it
is written under another name, then linked (local folders) or renamed without
overwriting (other file systems, where that is atomic, as on HDFS).
"""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _local(location: str) -> str | None:
    """The plain path of a local folder; None for other file systems."""
    if location.startswith("file:"):
        return "/" + location.removeprefix("file:").lstrip("/")
    return location if "://" not in location else None


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _name(number: int) -> str:
    return f"{number:010d}.json"


def newest_number(spark: SparkSession, location: str) -> int | None:
    """The last commit. Only names are looked at."""
    fs, folder = _file_system(spark, f"{location}/commits")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n[:-5]) for n in names if re.fullmatch(r"\d{10}\.json", n)), default=None)


def read_commit(spark: SparkSession, location: str, number: int | None = None) -> tuple[int, dict] | None:
    """(number, content) of a commit, the newest if no number is given; None without any."""
    if number is None and (number := newest_number(spark, location)) is None:
        return None
    fs, path = _file_system(spark, f"{location}/commits/{_name(number)}")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return number, json.loads(text)


def try_commit(spark: SparkSession, location: str, number: int, content: dict) -> bool:
    """Create a commit; False if its number is taken."""
    data = json.dumps(content, sort_keys=True).encode()
    folder, part = f"{location}/commits", f".part-{uuid.uuid4().hex}"
    if local := _local(folder):
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{part}", "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{local}/{part}", f"{local}/{_name(number)}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{local}/{part}")
        return True
    fs, source = _file_system(spark, f"{folder}/{part}")
    stream = fs.create(source)
    stream.write(bytearray(data))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    modes = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    modes[0] = hadoop.Options.Rename.NONE
    try:
        context = hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(source, hadoop.Path(f"{folder}/{_name(number)}"), modes)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        fs.delete(source, False)
        return False
    return True


def drop_commits(spark: SparkSession, location: str, before: int) -> None:
    """Remove commits older than a number."""
    fs, folder = _file_system(spark, f"{location}/commits")
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if re.fullmatch(r"\d{10}\.json", name) and int(name[:-5]) < before:
            fs.delete(status.getPath(), False)
