import os

import pytest

from textloom.operators import search as se
from textloom.operators.stats import index_stats
from textloom.plans.index import open_index
from textloom.plans.refresh import refresh, refresh_file

OPTIONS = dict(doc_buckets=3, term_buckets=2)


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def counters(report):
    r = report.summary.first()
    return (r["success"], r["files_processed"], r["files_added"], r["files_updated"],
            r["files_removed"], r["errors"])


def found(index, query):
    hits = se.search(index.corpus(), query, k=-1).join(index.documents(), "doc_id")
    return {os.path.basename(r["path"]) for r in hits.collect()}


@pytest.fixture
def source(tmp_path):
    src = tmp_path / "src"
    put(src, "test1.txt", "Python programming tutorial")
    put(src, "test2.md", "Java development guide")
    put(src, "subdir/test3.txt", "Web development with JavaScript")
    return src


def test_add_modify_delete(spark, source, tmp_path):
    ix = str(tmp_path / "ix")
    report = refresh(spark, str(source), ix, run_time=100.0, **OPTIONS)
    assert counters(report) == (True, 3, 3, 0, 0, 0)
    assert found(report.index, "development") == {"test2.md", "test3.txt"}
    assert found(report.index, "program") == {"test1.txt"}

    again = refresh(spark, str(source), ix)
    assert counters(again) == (True, 0, 0, 0, 0, 0)
    assert again.index.generation == 0

    put(source, "test1.txt", "Rust programming, second edition of the tutorial")
    put(source, "new.txt", "Go development")
    os.unlink(source / "test2.md")
    third = refresh(spark, str(source), ix)
    assert counters(third) == (True, 2, 1, 1, 1, 0)
    assert found(third.index, "python") == set()
    assert found(third.index, "rust") == {"test1.txt"}
    assert found(third.index, "development") == {"new.txt", "test3.txt"}
    assert (third.index.n_docs, third.index.total_len) == (3, 13)

    forced = refresh(spark, str(source), ix, force=True)
    assert counters(forced) == (True, 3, 0, 3, 0, 0)
    assert (forced.index.n_docs, forced.index.total_len) == (3, 13)
    ids = [r["doc_id"] for r in forced.index.documents().collect()]
    assert len(set(ids)) == 3
    # Readers of an older generation are not disturbed.
    assert found(report.index, "python") == {"test1.txt"}


def test_scores_after_refresh_equal_a_new_index(spark, source, tmp_path):
    refresh(spark, str(source), str(tmp_path / "a"), **OPTIONS)
    put(source, "test1.txt", "development development of tools")
    os.unlink(source / "subdir/test3.txt")
    a = refresh(spark, str(source), str(tmp_path / "a")).index
    b = refresh(spark, str(source), str(tmp_path / "b"), **OPTIONS).index

    def scores(index):
        hits = se.search(index.corpus(), "development", k=-1).join(index.documents(), "doc_id")
        return {r["path"]: r["score"] for r in hits.collect()}
    assert scores(a) == scores(b) and len(scores(a)) == 2


def test_files_above_a_cap_are_skipped_and_stay(spark, source, tmp_path):
    ix = str(tmp_path / "ix")
    assert counters(refresh(spark, str(source), ix, **OPTIONS))[0]
    grown = put(source, "test1.txt", b"python " * 200_000)
    again = refresh(spark, str(source), ix, max_mb=1)
    assert counters(again) == (False, 0, 0, 0, 0, 1)
    row = again.outcomes.where("status = 'skipped'").first()
    assert row["path"] == grown and "size cap" in row["reason"]
    assert found(again.index, "python") == {"test1.txt"}
    assert counters(refresh(spark, str(source), ix)) == (True, 1, 0, 1, 0, 0)


def test_errors_and_stale_content(spark, source, tmp_path):
    ix = str(tmp_path / "ix")
    binary = put(source, "binary.txt", b"\0\1\2")
    broken = put(source, "broken.txt", b"\xef\xbb\xbf" + b"a" * 9000 + b"\xff")
    first = refresh(spark, str(source), ix, **OPTIONS)
    assert counters(first) == (False, 3, 3, 0, 0, 2)
    assert {r["message"] for r in first.errors.collect()} == {
        f"Failed to index {binary}", f"Failed to index {broken}"}
    stored = {r["path"]: r for r in first.index.metadata().collect()}
    assert binary not in stored and stored[broken]["error"].startswith("Failed to read file")
    # A binary file is tried every time, a broken one when it changes.
    assert counters(refresh(spark, str(source), ix)) == (False, 0, 0, 0, 0, 1)

    # Content indexed before stays searchable when a file turns bad.
    put(source, "test1.txt", b"\xef\xbb\xbf" + b"b" * 9000 + b"\xff")
    put(source, "test2.md", b"PK\3\4")
    second = refresh(spark, str(source), ix)
    assert counters(second) == (False, 0, 0, 0, 0, 3)
    assert found(second.index, "python") == {"test1.txt"} and found(second.index, "java") == {"test2.md"}
    row = index_stats(second.index.documents(), second.index.metadata(), second.index.size_bytes()).first()
    assert (row["indexed_files"], row["total_documents"], row["errors_encountered"]) == (3, 3, 2)
    os.unlink(broken)
    os.unlink(source / "test1.txt")
    third = refresh(spark, str(source), ix)
    assert third.summary.first()["files_removed"] == 2
    assert found(third.index, "python") == set()


def test_single_file(spark, source, tmp_path):
    ix = str(tmp_path / "ix")
    put(source, "code.py", "def tutorial(): pass")
    assert counters(refresh_file(spark, str(source), ix, "code.py", **OPTIONS)) == (True, 1, 1, 0, 0, 0)
    assert counters(refresh_file(spark, str(source), ix, "code.py")) == (True, 1, 0, 1, 0, 0)
    assert found(open_index(spark, ix), "tutorial") == {"code.py"}
    with pytest.raises(ValueError, match="Path outside source directory"):
        refresh_file(spark, str(source), ix, "../outside.txt")
    with pytest.raises(FileNotFoundError):
        refresh_file(spark, str(source), ix, "missing.txt")
    assert open_index(spark, ix).n_docs == 1
    # A full run drops what its own filters do not admit.
    report = refresh(spark, str(source), ix)
    assert counters(report) == (True, 3, 3, 0, 1, 0)


def test_empty_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    ix = str(tmp_path / "ix")
    assert open_index(spark, ix) is None
    report = refresh(spark, str(tmp_path / "src"), ix, **OPTIONS)
    assert counters(report) == (True, 0, 0, 0, 0, 0)
    assert report.index.n_docs == 0
    assert se.search(report.index.corpus(), "python").count() == 0
    row = index_stats(report.index.documents(), report.index.metadata()).first()
    assert (row["indexed_files"], row["last_scan"], row["errors_encountered"]) == (0, "Never", 0)


def test_binary_file_reader(spark, source, tmp_path):
    ix = str(tmp_path / "ix")
    report = refresh(spark, str(source), ix, reader="binaryFile", **OPTIONS)
    assert counters(report) == (True, 3, 3, 0, 0, 0)
    assert found(report.index, "development") == {"test2.md", "test3.txt"}


def test_moved_file_keeps_its_postings(spark, source, tmp_path):
    ix = str(tmp_path / "ix")
    put(source, "copy1.txt", "Equal notes")
    put(source, "copy2.txt", "Equal notes")
    first = refresh(spark, str(source), ix, **OPTIONS)
    ids = {os.path.basename(r["path"]): r["doc_id"] for r in first.index.documents().collect()}
    os.rename(source / "test1.txt", source / "subdir" / "renamed.txt")
    os.unlink(source / "copy1.txt")
    os.rename(source / "copy2.txt", source / "copy3.txt")
    put(source, "test2.md", "Java development guide, changed")
    second = refresh(spark, str(source), ix)
    assert counters(second) == (True, 3, 2, 1, 3, 0)  # a move counts as one added and one removed
    index = second.index
    after = {os.path.basename(r["path"]): (r["doc_id"], r["born"]) for r in index.files().collect()}
    assert set(after) == {"renamed.txt", "test2.md", "test3.txt", "copy3.txt"}
    assert after["renamed.txt"] == (ids["test1.txt"], 0)
    assert after["copy3.txt"][1] == 1  # of two copies that went, neither is known to be the one that moved
    assert found(index, "python") == {"renamed.txt"} and found(index, "equal") == {"copy3.txt"}
    assert "renamed.txt" not in {os.path.basename(r["path"]) for r in index.postings().where("born = 1").join(
        index.documents(), "doc_id").collect()}
    assert (index.n_docs, index.total_len) == (4, 13)
    assert {r["term"]: r["df"] for r in index.terms().where("term = 'python'").collect()} == {"python": 1}

    os.rename(source / "subdir" / "renamed.txt", source / "again.txt")
    third = refresh(spark, str(source), ix)
    assert found(third.index, "python") == {"again.txt"}
    os.unlink(source / "again.txt")
    last = refresh(spark, str(source), ix)  # merges the segments as well
    assert found(last.index, "python") == set() and (last.index.n_docs, last.index.total_len) == (3, 10)
    assert last.index.terms().where("term = 'python' and df <> 0").count() == 0
