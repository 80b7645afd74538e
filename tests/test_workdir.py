import os

import pytest
from conftest import SMALL

from textloom.plans import workdir
from textloom.sources import tables


class Context:
    def __init__(self, master):
        self.master = master


class Session:
    """A session without a shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    def __init__(self, master):
        self.sparkContext = Context(master)


def test_folder_of_the_session_is_used(spark):
    assert workdir.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = workdir.materialize(spark.range(5))
    assert stored.count() == 5
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in stored.inputFiles())


def test_own_folder_only_on_a_local_master():
    session = Session("local[2]")
    assert workdir.work_dir(session) == workdir.work_dir(session)
    with pytest.raises(ValueError):
        workdir.work_dir(Session("spark://host:7077"))


def test_large_tables_are_not_shuffled(spark, monkeypatch):
    path = f"{SMALL}/documents.parquet"
    assert "Repartition" in tables.read_table(spark, path)._jdf.queryExecution().toString()
    monkeypatch.setattr(tables, "SPREAD_BYTES_PER_CORE", 10)
    assert "Repartition" not in tables.read_table(spark, path)._jdf.queryExecution().toString()


def test_work_tables_are_removed(spark):
    with workdir.work_tables() as outer:
        with workdir.work_tables() as made:
            df = workdir.materialize(spark.range(5), "numbers")
        other = workdir.materialize(spark.range(7))
    assert len(made) == 1 and len(outer) == 2 and os.path.isdir(made[0])
    assert workdir.reads_from(df.where("id > 1"), made) and not workdir.reads_from(other, made)
    workdir.delete_tables(spark, made)
    workdir.delete_tables(spark, made)
    assert not os.path.exists(made[0]) and other.count() == 7
