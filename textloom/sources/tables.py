"""Reading tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A table of more bytes than this for each core has splits enough of its own.
SPREAD_BYTES_PER_CORE = 128 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one of a few files is spread over the cores.

    A file with a single row group is one task, whatever its number of rows. A
    table of many files, or of many bytes, is left as it is: a shuffle of all
    its text would cost more than it brings.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if len(table.inputFiles()) < cores and size <= cores * SPREAD_BYTES_PER_CORE:
        return table.repartition(cores)
    return table
