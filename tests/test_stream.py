import time

from textloom.operators import search as se
from textloom.plans.index import open_index
from textloom.streaming.feed import FEED_SCHEMA, stream_index, stream_rescan


def test_feed_in_batches(spark, tmp_path):
    feed, ix, offsets = (str(tmp_path / n) for n in ("feed", "ix", "offsets"))

    def push(rows):
        spark.createDataFrame(rows, FEED_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(FEED_SCHEMA).parquet(feed)
        stream_index(stream, ix, offsets, doc_buckets=2, term_buckets=2).awaitTermination()
        return open_index(spark, ix)

    index = push([("/a", "upsert", "first version", 1.0), ("/a", "upsert", "second version", 2.0),
                  ("/b", "upsert", "other words", 1.0), ("/c", "upsert", "to be removed", 1.0),
                  ("/d", "upsert", "never seen", 1.0), ("/d", "delete", None, 1.0)])
    assert {r["path"]: r["content"] for r in index.documents().collect()} == {
        "/a": "second version", "/b": "other words", "/c": "to be removed"}
    index = push([("/c", "delete", None, 5.0), ("/a", "upsert", "third version", 5.0),
                  ("/e", "upsert", None, 5.0)])
    assert {r["path"]: r["content"] for r in index.documents().collect()} == {
        "/a": "third version", "/b": "other words", "/e": ""}
    assert (index.n_docs, index.total_len) == (3, 4)
    assert se.search(index.corpus(), "version", k=-1).count() == 1
    assert index.streams == {offsets: 1}
    index = push([("/a", "upsert", "late and old", 4.0), ("/c", "upsert", "before its deletion", 4.0),
                  ("/b", "delete", None, 0.5), ("/e", "upsert", "newer", 6.0)])
    assert {r["path"]: r["content"] for r in index.documents().collect()} == {
        "/a": "third version", "/b": "other words", "/e": "newer"}
    index = push([("/c", "upsert", "back again", 6.0), ("/d", "upsert", "same time as its deletion", 1.0)])
    assert {r["path"]: r["content"] for r in index.documents().collect()} == {
        "/a": "third version", "/b": "other words", "/c": "back again", "/e": "newer"}


def test_two_feeds_keep_their_batches(spark, tmp_path):
    ix = str(tmp_path / "ix")
    for name, text in (("one", "from one"), ("two", "from two"), ("one", "one again")):
        feed = str(tmp_path / name)
        spark.createDataFrame([(f"/{name}", "upsert", text, 1.0)], FEED_SCHEMA).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(FEED_SCHEMA).parquet(feed)
        stream_index(stream, ix, feed + "-offsets", doc_buckets=1, term_buckets=1).awaitTermination()
    index = open_index(spark, ix)
    assert index.streams == {str(tmp_path / "one-offsets"): 1, str(tmp_path / "two-offsets"): 0}
    assert {r["path"]: r["content"] for r in index.documents().collect()} == {
        "/one": "one again", "/two": "from two"}


def test_rescan(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("rescanned words")
    reports = []
    query = stream_rescan(spark, str(src), str(tmp_path / "ix"), str(tmp_path / "offsets"), 60,
                          reports.append, doc_buckets=1, term_buckets=1)
    try:
        for _ in range(120):
            if reports:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert reports and reports[0].index.n_docs == 1
