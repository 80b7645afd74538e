import os
import sqlite3
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("textloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from textloom.plans.workdir import ship_package
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """The small documents table as a dict, for brute-force comparison."""
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


class FullText:
    """An in-memory full-text table with the same tokenizer, to compare with."""

    def __init__(self, texts, tokenizer="porter"):
        self.con = sqlite3.connect(":memory:")
        self.con.execute(f"create virtual table f using fts5(content, tokenize='{tokenizer}')")
        self.con.executemany("insert into f(rowid, content) values (?, ?)", list(texts.items()))

    def search(self, match):
        """{id: (score, snippet)} of a match expression; a malformed one matches nothing."""
        try:
            rows = self.con.execute(
                "select rowid, abs(bm25(f)), snippet(f, 0, '<mark>', '</mark>', '...', 32)"
                " from f where f match ?", (match,)).fetchall() if match else []
        except sqlite3.OperationalError:
            return {}
        return {r[0]: (r[1], r[2]) for r in rows}

    def tokens(self, text):
        con = sqlite3.connect(":memory:")
        con.execute("create virtual table t using fts5(content, tokenize='unicode61')")
        con.execute("create virtual table v using fts5vocab(t, 'instance')")
        con.execute("insert into t values (?)", (text,))
        return [r[0] for r in con.execute('select term from v order by "offset"')]


@pytest.fixture(scope="session")
def fulltext(texts):
    return FullText(texts)
