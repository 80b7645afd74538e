import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import filetypes as ft
from textloom.functions.paths import path_like, preview
from textloom.functions.times import iso_time
from textloom.operators.pathsearch import search_by_path
from textloom.sources import files as files_module
from textloom.sources.files import (
    check_scan_options, read_bytes, read_text, resolve_path, scan_corpus,
)


def write(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


def names(files, root):
    return {os.path.relpath(r["path"], root) for r in files.collect()}


@pytest.fixture
def tree(tmp_path):
    write(tmp_path, "simple.txt", "Simple text")
    write(tmp_path, "document.md", "# Title")
    write(tmp_path, "code.py", "x = 1")
    write(tmp_path, "UPPER.TXT", "upper")
    write(tmp_path, "sub dir/nested.txt", "nested")
    write(tmp_path, "sub dir/.hidden/deep.txt", "deep")
    write(tmp_path, "_draft.txt", "draft")
    write(tmp_path, "empty.txt", "")
    write(tmp_path, "large.txt", "x" * (1 << 20) + "y")
    write(tmp_path, "index/old.txt", "inside the index")
    return tmp_path


def test_scan_filters(spark, tree):
    src, ix = str(tree), str(tree / "index")
    txt = {"simple.txt", "UPPER.TXT", "sub dir/nested.txt", "sub dir/.hidden/deep.txt",
           "_draft.txt", "empty.txt", "large.txt"}
    assert names(scan_corpus(spark, src, ix, include=[".txt"]), src) == txt
    assert names(scan_corpus(spark, src, ix), src) == txt | {"document.md"}
    assert names(scan_corpus(spark, src, ix, include=[]), src) == txt | {"document.md", "code.py"}
    assert names(scan_corpus(spark, src, ix, include=[], exclude=[".txt"]), src) == {
        "document.md", "code.py"}
    assert names(scan_corpus(spark, src, ix, include=[".TXT"]), src) == set()
    assert names(scan_corpus(spark, src, ix, include=[".txt"], max_mb=1), src) == txt - {"large.txt"}
    assert "index/old.txt" in names(scan_corpus(spark, src), src)


def test_scan_stats_and_links(spark, tree):
    os.symlink(tree / "sub dir", tree / "linked")
    os.symlink(tree / "simple.txt", tree / "linked.txt")
    rows = {r["path"]: r for r in scan_corpus(spark, str(tree)).collect()}
    assert not any("/linked/" in p for p in rows)
    assert str(tree / "linked.txt") in rows
    for path, row in rows.items():
        assert (row["size"], row["mtime"]) == (os.stat(path).st_size, os.stat(path).st_mtime)


def test_binary_file_reader(spark, tree):
    found = names(scan_corpus(spark, str(tree), str(tree / "index"), reader="binaryFile"), tree)
    assert found == {"simple.txt", "UPPER.TXT", "sub dir/nested.txt", "large.txt", "document.md"}


def test_extension(spark):
    cases = {"/a/b.txt": ".txt", "/a/b.TAR.GZ": ".gz", "/a/.bashrc": "", "/a/b.": "", "/a.d/b": "",
             "/a/..x": ".x", "b.é": ".é", "/a/b.c.": ""}
    rows = spark.createDataFrame([(p,) for p in cases], "path string")
    assert dict(rows.select("path", ft.extension("path")).collect()) == cases


def expected_read(path, probe_bytes):
    """What plain file reading says: (status, encoding, text)."""
    data = path.read_bytes()
    if os.path.splitext(path.name)[1].lower() not in ft.TEXT_EXTENSIONS:
        return "skipped", None, None
    looked_at = data[:probe_bytes]
    if any(data.startswith(s) for s in ft.BINARY_SIGNATURES) or b"\0" in looked_at:
        return "skipped", None, None
    encoding = "latin-1"
    if data[:3] == b"\xef\xbb\xbf":
        encoding = "utf-8-sig"
    else:
        try:
            with open(path, encoding="utf-8") as handle:
                handle.read(1024 if probe_bytes else -1)
            encoding = "utf-8"
        except UnicodeDecodeError:
            pass
    try:
        with open(path, encoding=encoding) as handle:
            return "ok", encoding, handle.read()
    except UnicodeDecodeError:
        return "error", None, None


@pytest.mark.parametrize("probe_bytes", [None, 8192])
def test_reading_equals_plain_file_reading(spark, tmp_path, probe_bytes):
    rng = random.Random(11)
    blobs = [
        b"", b"plain\r\nlines\rhere\n", "Hello 世界".encode(), b"\xef\xbb\xbfHello", b"\xef\xbb\xbf",
        b"\xef\xbb\xbfbad \xff", "Café résumé".encode("latin-1"), bytes([0xFF, 0xFE, 0xFD, 0xFC]),
        bytes([0xFD, 0xFC]), b"\0\1\2\3", b"PK\3\4rest", b"%PDF-1.4", b"ID3 text", b"RIFFraff",
        b"BZh", b"\x1f\x8b", b"a" * 8192 + b"\0", b"a" * 8191 + b"\0", b"a" * 9000 + b"\xff",
        b"a" * 8191 + "é".encode(), b"a" * 8190 + "世".encode(), b"a" * 8189 + "😀".encode(),
        b"a" * 8190 + "😀".encode() + b"x" * 99, b"a" * 8191 + b"\xe0", b"a" * 8191 + b"\xf0\x80",
        b"a" * 8190 + b"\xed\xa0", b"a" * 8190 + b"\xe0\x80zz", b"a" * 8191 + b"\xc1x",
        b"a" * 2000 + b"\xc3", b"a" * 1023 + b"\xc3", b"a" * 1024 + b"\xc3", b"a" * 500 + b"\xe4\xb8",
        b"\r\n" * 1023 + b"\xc3", b"\r\n" * 1030 + b"\xc3", "é".encode() * 6000, "世".encode() * 4000,
        b"\xc3", "é".encode() * 1100 + b"\xe4\xb8", "\u2028x".encode(), b"a" * 8190 + b"\xed\xa0zz",
    ]
    for _ in range(60):
        size = rng.choice([10, 1023, 1024, 1500, 8190, 8192, 8193, 9000])
        text = "".join(rng.choice("abé世😀\r\n") for _ in range(size)).encode()
        blobs.append(text[:rng.choice([size, 8191, 8192, 8193, len(text)])])
    blobs += [b"text in " + bytes([b]) for b in range(0x7E, 0x100, 9)]
    paths = [write(tmp_path, f"f{i:03d}.txt", b) for i, b in enumerate(blobs)]
    paths += [write(tmp_path, "tool.exe", "text"), write(tmp_path, "README", "text")]
    files = spark.createDataFrame(
        [(str(p), p.stat().st_size, p.stat().st_mtime) for p in paths],
        "path string, size long, mtime double")
    rows = {r["path"]: r for r in read_text(read_bytes(files), probe_bytes=probe_bytes).collect()}
    for p in paths:
        row = rows[str(p)]
        want = expected_read(p, probe_bytes)
        assert (row["status"], row["encoding"], row["content"]) == want, (p.name, p.read_bytes()[:20])
        assert (row["error"] is not None) == (want[0] == "error")


def test_late_accent_and_late_nul(spark, tmp_path):
    accent = write(tmp_path, "accent.txt", b"a" * 9000 + "é".encode("latin-1"))
    nul = write(tmp_path, "nul.txt", b"a" * 8192 + b"\0")
    files = spark.createDataFrame([(str(p), 1, 1.0) for p in (accent, nul)], "path string, size long, mtime double")
    rows = {r["path"]: r for r in read_text(read_bytes(files)).collect()}
    assert rows[str(accent)]["content"] == "a" * 9000 + "é" and rows[str(nul)]["status"] == "skipped"


def test_a_directory_that_cannot_be_listed_fails_the_scan(monkeypatch):
    def refuse(folder):
        raise PermissionError(folder)

    monkeypatch.setattr(os, "scandir", refuse)
    with pytest.raises(PermissionError):
        list(files_module._list_directory("/somewhere"))
    monkeypatch.setattr(os, "scandir", lambda folder: (_ for _ in ()).throw(FileNotFoundError(folder)))
    assert list(files_module._list_directory("/somewhere")) == []


def test_missing_file_is_skipped(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "gone.txt"), 1, 1.0)],
                                  "path string, size long, mtime double")
    assert read_text(read_bytes(files)).first()["status"] == "skipped"


def test_by_name_only(spark, tmp_path):
    files = spark.createDataFrame([("/x/a.txt", 3, 1.0, bytearray(b"PK\3\4"))],
                                  "path string, size long, mtime double, content binary")
    assert read_text(files, check_content=False).first()["status"] == "ok"


def test_resolve_path(tmp_path):
    src = tmp_path / "src"
    write(src, "a.txt", "x")
    write(tmp_path, "src_other/b.txt", "x")
    assert resolve_path(str(src), "a.txt") == str(src / "a.txt")
    assert resolve_path(str(src), str(src / "a.txt")) == str(src / "a.txt")
    for outside in ("../src_other/b.txt", "/etc/passwd", str(tmp_path / "src_other/b.txt")):
        with pytest.raises(ValueError, match="Path outside source directory"):
            resolve_path(str(src), outside)


def test_scan_options(tmp_path):
    good = str(tmp_path)
    check_scan_options(good, str(tmp_path / "ix"), [".txt"], [], 5000, 60)
    bad = [
        dict(source=good + "/none"), dict(source=str(write(tmp_path, "f.txt", "x"))),
        dict(source=good, index_dir=good), dict(source=good, interval_seconds=59),
        dict(source=good, max_mb=0), dict(source=good, max_mb=-1),
        dict(source=good, include=["txt"]), dict(source=good, exclude=["md"]),
    ]
    for options in bad:
        with pytest.raises(ValueError):
            check_scan_options(**options)


def test_path_search(spark, fulltext):
    rows = [("/docs/python.txt", "x" * 199), ("/docs/java.md", "x" * 200), ("/docs/web.txt", "x" * 300),
            ("/notes/Meeting.txt", "short"), ("/a_b%c\\d.txt", "y"), ("/É.txt", "z")]
    docs = spark.createDataFrame([(p, t, "now") for p, t in rows],
                                 "path string, content string, last_modified string")
    con = fulltext.con
    con.execute("create table if not exists p (path text)")
    con.execute("delete from p")
    con.executemany("insert into p values (?)", [(p,) for p, _ in rows])
    for pattern in ["/docs/%", "%.md", "%.none", "/NOTES/%", "/docs/____.md", "%\\%", "%_b%", "%é%", "", "%"]:
        want = [r[0] for r in con.execute("select path from p where path like ? order by path", (pattern,))]
        got = [r["path"] for r in search_by_path(docs, pattern, k=-1).collect()]
        assert got == want, pattern
    found = {r["path"]: r["snippet"] for r in search_by_path(docs, "/docs/%").collect()}
    assert [len(found[p]) for p in ("/docs/python.txt", "/docs/java.md", "/docs/web.txt")] == [199, 203, 203]
    assert search_by_path(docs, "%", k=0).count() == 0
    assert docs.where(path_like("path", "%.MD")).count() == 1
    assert docs.select(preview("content")).count() == 6


def test_iso_time(spark):
    rows = spark.createDataFrame([(0.0,), (1704067200.5,), (1234567890.0,), (1.000001,)], "s double")
    assert [r[0] for r in rows.select(iso_time("s")).collect()] == [
        "1970-01-01T00:00:00", "2024-01-01T00:00:00.500000", "2009-02-13T23:31:30",
        "1970-01-01T00:00:01.000001"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert rows.select(iso_time(F.lit(0.0))).first()[0] == "1970-01-01T00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
