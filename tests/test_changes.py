from textloom.operators import changes as ch
from textloom.operators import stats as st

SNAPSHOT = "path string, size long, mtime double"


def test_actions(spark):
    now = spark.createDataFrame([("new", 1, 1.0), ("same", 1, 1.0), ("grown", 2, 1.0),
                                 ("older", 1, 0.5)], SNAPSHOT)
    before = spark.createDataFrame([("same", 1, 1.0), ("grown", 1, 1.0), ("older", 1, 1.0),
                                    ("gone", 1, 1.0)], SNAPSHOT)
    assert dict(ch.classify_changes(now, before).collect()) == {
        "new": "added", "same": "unchanged", "grown": "updated", "older": "updated", "gone": "removed"}
    assert dict(ch.classify_changes(now, before, force=True).collect()) == {
        "new": "added", "same": "updated", "grown": "updated", "older": "updated", "gone": "removed"}
    assert {r["path"] for r in ch.changed_files(now, before).collect()} == {"new", "grown", "older"}
    assert {r["path"] for r in ch.deleted_files(now, before).collect()} == {"gone"}


def test_digests_and_moves(spark):
    kind = SNAPSHOT + ", digest string"
    now = spark.createDataFrame([("same", 1, 1.0, "a"), ("rewritten", 1, 1.0, "b"), ("to", 1, 2.0, "m"),
                                 ("copy1", 1, 1.0, "c"), ("copy2", 1, 1.0, "c"), ("none", 1, 1.0, None)], kind)
    before = spark.createDataFrame([("same", 1, 1.0, "a"), ("rewritten", 1, 1.0, "x"), ("from", 1, 1.0, "m"),
                                    ("copy0", 1, 1.0, "c"), ("gone", 1, 1.0, None)], kind)
    actions = dict(ch.classify_changes(now, before).collect())
    assert actions["rewritten"] == "updated" and actions["same"] == "unchanged"
    added, removed = (a.join(b.select("path"), "path", "left_anti") for a, b in ((now, before), (before, now)))
    assert [tuple(r) for r in ch.moved_files(added, removed).collect()] == [("to", "from")]
    assert ch.moved_files(added.limit(0), removed).count() == 0


def test_views(spark):
    meta = spark.createDataFrame(
        [("a", 1, 1.0, 2.0, "utf-8", None), ("b", 1, 3.0, 2.0, None, "Failed to read file")],
        "path string, size long, mtime double, last_indexed double, encoding string, error string")
    docs = spark.createDataFrame([("a", "x", "then")], "path string, content string, last_modified string")
    rows = {r["path"]: r["last_modified"] for r in st.indexed_files(meta, docs).collect()}
    assert rows == {"a": "then", "b": None}
    assert [tuple(r) for r in st.indexed_ok(meta).collect()] == [("a", 1, "utf-8")]
    assert [tuple(r) for r in st.with_errors(meta).collect()] == [("b", "Failed to read file")]
    assert [r[0] for r in st.needs_reindex(meta).collect()] == ["b"]
    row = st.index_stats(docs, meta, 1 << 20).first()
    assert tuple(row) == (1, "1970-01-01T00:00:02", 1.0, 1, 1)
