import os
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import grouping
from textloom.operators import search as se
from textloom.operators.corpus import PostingsCorpus
from textloom.plans import commits, index as ix

CHANGES = "path string, status string, size long, mtime double, encoding string, content string, error string, last_modified string"
OPTIONS = dict(doc_buckets=3, term_buckets=2)


def changes(spark, rows):
    """Rows (path, status, content)."""
    return spark.createDataFrame([(p, s, 1, 1.0, "utf-8", c, "bad" if s == "error" else None, "then") for p, s, c in rows],
                                 CHANGES)


def apply(spark, location, rows, **more):
    return ix.apply_changes(spark, location, changes(spark, rows), 100.0, **OPTIONS, **more)


def text(seed, n=40):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rnd.choice(["", "x", "y"])
                    for _ in range(n))


def state(index):
    """All that a search can see, without the numbers of documents."""
    paths = {r["doc_id"]: r["path"] for r in index.documents().collect()}
    postings = sorted((r["term"], paths[r["doc_id"]], r["tf"], r["doc_len"], tuple(r["positions"]))
                      for r in index.postings().collect())
    terms = sorted((r["term"], r["df"], r["cf"]) for r in index.terms().collect())
    return sorted(paths.values()), postings, terms, index.n_docs, index.total_len


def rows_written(location, segment):
    import pyarrow.parquet as pq
    count = 0
    for folder, _, names in os.walk(location):
        if f"segment={segment}" in folder:
            count += sum(pq.read_metadata(f"{folder}/{n}").num_rows for n in names if n.endswith(".parquet"))
    return count


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    docs = {f"/{i}": text(i) for i in range(120)}
    first = apply(spark, a, [(p, "ok", c) for p, c in docs.items()])
    assert sorted(r["doc_id"] for r in first.documents().collect()) == list(range(120))
    step = [("/3", "ok", text(1003)), ("/5", "deleted", None), ("/7", "error", None), ("/8", "ok", "omega alone"),
            ("/new", "ok", text(2000)), ("/absent", "deleted", None), ("/9", "skipped", None), ("/bad", "error", None)]
    second = apply(spark, a, step)
    own = second.segments[-1]
    assert len(second.segments) == 2 and second.segments[0] == first.segments[0]
    # 5 files, 3 documents of at most 30 terms and what they replace.
    assert own.rows["files"] == 5 and own.rows["gone"] == 4 and rows_written(a, own.name) < 300
    docs |= {"/3": text(1003), "/8": "omega alone", "/new": text(2000)}
    del docs["/5"]
    new = apply(spark, b, [(p, "ok", c) for p, c in docs.items()])
    assert state(second) == state(new)
    meta = {r["path"]: r["error"] for r in second.metadata().collect()}
    assert len(meta) == 121 and meta["/7"] == meta["/bad"] == "bad" and meta["/3"] is None
    # A document whose file failed once is replaced like others, twice in a row too.
    for words in ("once more", "and again"):
        third = apply(spark, a, [("/7", "ok", words)])
    docs["/7"] = "and again"
    assert state(third) == state(apply(spark, b, [("/7", "ok", "and again")]))
    for query in ("alpha", "beta gamma", '"alpha" OR "omega"'):
        got = [(round(r["score"], 9)) for r in se.search(third.corpus(), query, 20).collect()]
        assert got == [round(r["score"], 9) for r in se.search(ix.open_index(spark, b).corpus(), query, 20).collect()]


def test_merging(spark, tmp_path):
    a = str(tmp_path / "a")
    index = apply(spark, a, [(f"/{i}", "ok", text(i)) for i in range(80)])
    for k in range(5):
        index = apply(spark, a, [(f"/{k}", "ok", text(500 + k)), (f"/{k + 20}", "deleted", None), (f"/n{k}", "ok", text(k))])
    before, reader = state(index), ix.open_index(spark, a)
    merged = ix.merge_segments(spark, a)
    assert len(merged.segments) < len(index.segments) == 6
    assert merged.segments[0] == index.segments[0]     # of another size: left as it is
    assert state(merged) == before == state(reader)
    small = merged.segments[1]
    assert small.rows["files"] == 10 and small.rows["gone"] == 10 and small.numbers == [[1, 5]]
    deleted = {r["path"] for r in merged.deletions().collect()}
    assert deleted == {f"/{k + 20}" for k in range(5)}
    everything = ix.merge_segments(spark, a, fan=1 << 30)
    assert state(everything) == before
    index = apply(spark, a, [("/0", "deleted", None)])
    names = {s.name for s in index.segments}
    assert len(ix.remove_old(spark, a)) == 5
    assert state(ix.open_index(spark, a))[3] == before[3] - 1
    assert {s.name for s in ix.open_index(spark, a).segments} == names
    # Everything into one segment: nothing that was replaced is left.
    one = ix._merged(index, index.segments)
    assert one.rows["gone"] == 0 and one.rows["files"] == index.files().count()


def test_two_writers_both_land(spark, tmp_path, monkeypatch):
    a = str(tmp_path / "a")
    apply(spark, a, [(f"/{i}", "ok", f"start {i}") for i in range(6)])
    meet, write = threading.Barrier(2, timeout=120), ix._write_segment

    def together(*args):
        out = write(*args)
        if threading.current_thread().name in waiting:
            waiting.discard(threading.current_thread().name)
            meet.wait()      # both have read the same state and written, neither has committed
        return out

    monkeypatch.setattr(ix, "_write_segment", together)
    for rows in ({"x": [("/0", "ok", "from x"), ("/x", "ok", "x alone")], "y": [("/1", "ok", "from y"), ("/y", "ok", "y alone")]},
                 {"x": [("/2", "ok", "both x"), ("/3", "deleted", None)], "y": [("/2", "ok", "both y"), ("/4", "deleted", None)]}):
        waiting, failed = set(rows), []

        def run(name):
            try:
                apply(spark, a, rows[name])
            except Exception as error:  # noqa: BLE001
                failed.append(error)

        threads = [threading.Thread(target=run, args=(n,), name=n) for n in rows]
        [t.start() for t in threads]
        [t.join(300) for t in threads]
        assert not failed
    index = ix.open_index(spark, a)
    found = {r["path"]: r["content"] for r in index.documents().collect()}
    assert found.pop("/2") in ("both x", "both y")
    assert found == {"/0": "from x", "/1": "from y", "/x": "x alone", "/y": "y alone", "/5": "start 5"}
    ids = [r["doc_id"] for r in index.documents().collect()]
    assert len(set(ids)) == len(ids) == index.n_docs == 6
    assert sorted((r["term"], r["df"]) for r in index.terms().collect()) == sorted(
        (r["term"], r["df"]) for r in index.postings().groupBy("term").agg(F.count("*").alias("df")).collect())


def test_commits_are_created_once(spark, tmp_path):
    a = f"file:{tmp_path}/a"
    assert commits.read_commit(spark, a) is None
    assert commits.try_commit(spark, a, 0, {"x": 1}) and not commits.try_commit(spark, a, 0, {"x": 2})
    assert commits.try_commit(spark, a, 1, {"x": "ü"})
    assert commits.read_commit(spark, a) == (1, {"x": "ü"}) and commits.read_commit(spark, a, 0) == (0, {"x": 1})
    commits.drop_commits(spark, a, 1)
    assert os.listdir(tmp_path / "a/commits") == ["0000000001.json"]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Frequent words in all documents, rarer ones in some."""
    rnd, rows = random.Random(4), []
    for i in range(3000):
        words = ["the"] * rnd.randint(1, 4) + ["of"] * rnd.randint(0, 3) + ["data"] * (rnd.random() < 0.2)
        words += ["rare"] * rnd.randint(1, 3) * (i % 100 == 0) + ["scarce"] * (i % 211 == 0) + ["filler"] * rnd.randint(5, 60)
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    location = str(tmp_path_factory.mktemp("skewed") / "i")
    ix.build_index(docs.where("doc_id < 2500"), location, **OPTIONS)
    more = docs.where("doc_id >= 2400").select(
        "doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("ok").alias("status"), F.lit(1).alias("size"),
        F.lit(1.0).alias("mtime"), F.lit("utf-8").alias("encoding"), F.concat("text", F.lit(" rare")).alias("content"),
        F.lit(None).cast("string").alias("error"), F.lit("x").alias("last_modified"))
    return ix.apply_changes(spark, location, more, 1.0)


@pytest.mark.parametrize("words, k", [(["rare", "the", "of"], 10), (["scarce", "rare", "data", "the"], 5), (["the", "of"], 10),
                                      (["rare", "rare", "the"], 20), (["rare", "nowhere", "of"], 3), (["nowhere"], 3),
                                      (["scarce", "data"], 2000)])
def test_best_of_any_equals_all_rows(skewed, monkeypatch, words, k):
    monkeypatch.setattr("textloom.operators.corpus.FEW_ROWS", 0)
    bounded = [tuple(r) for r in se.search_terms(skewed.corpus(), words, "any", k=k).collect()]
    with monkeypatch.context() as m:
        m.setattr(PostingsCorpus, "best_of_any", lambda *a: None)
        full = [tuple(r) for r in se.search_terms(skewed.corpus(), words, "any", k=k).collect()]
    assert bounded == full and (full or words == ["nowhere"])


def test_best_of_any_reads_fewer_rows(skewed, monkeypatch):
    monkeypatch.setattr("textloom.operators.corpus.FEW_ROWS", 0)
    corpus, units = skewed.corpus(), se._units(skewed.corpus(), ["rare", "the", "of"])
    all_rows = corpus.hits(units).frame.agg(F.sum(F.expr("int(tf_0 > 0) + int(tf_1 > 0) + int(tf_2 > 0)"))).first()[0]
    found = corpus.best_of_any(units, 10)
    rows = found.frame.agg(F.sum(F.expr("int(tf_0 > 0) + int(tf_1 > 0) + int(tf_2 > 0)"))).first()[0]
    assert rows < 0.5 * all_rows


def test_prefix_goes_by_the_dictionary(skewed, monkeypatch):
    corpus = skewed.corpus()
    assert corpus._terms_from("ra") == ["rare"] and corpus._terms_from("zz") == []
    first = [tuple(r) for r in se.search_prefix(corpus, "ra", k=20).collect()]
    assert se.search_prefix(corpus, "zz", k=20).isEmpty()
    monkeypatch.setattr("textloom.operators.corpus.MOST_TERMS", 0)
    assert first == [tuple(r) for r in se.search_prefix(skewed.corpus(), "ra", k=20).collect()]
    plain = PostingsCorpus(skewed.postings(), skewed.n_docs, skewed.total_len)
    assert first == [tuple(r) for r in se.search_prefix(plain, "ra", k=20).collect()]


def test_a_batch_is_grouped_in_parts_of_few_tokens():
    tokens = [["a", "b", "a"], [], ["b"] * 9, ["c"], ["a", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(range(5))], ["tokens", "doc_id"])
    parts = list(grouping.slices(batch, 4))
    assert [p.column("doc_id").to_pylist() for p in parts] == [[0, 1], [2], [3, 4]]
    rows = [r for p in parts for r in grouping.group_tokens(p, False, True).to_pylist()]
    whole = grouping.group_tokens(batch, False, True).to_pylist()
    key = lambda r: (r["term"], r["doc_id"])
    assert sorted(rows, key=key) == sorted(whole, key=key)
    assert [r["term"] for r in whole] == ["a", "a", "b", "b", "c", "c"]


def test_a_batch_is_freed_before_the_next_one_is_read():
    """And no group has more than 65,536 tokens, but for a longer document."""
    alive, sizes = [], []

    def batches():
        for _ in range(3):
            alive.append(pa.total_allocated_bytes())
            tokens = pa.array([[f"w{i}" for i in range(40_000)]] * 4, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([tokens, pa.array(range(4))], ["tokens", "doc_id"])
            del tokens

    for part in grouping.grouper(False, True)(batches()):
        sizes.append(sum(part.column("tf").to_pylist()))
        del part
    assert sizes == [40_000] * 12
    assert max(alive) - alive[0] < 100_000


def test_blocks_of_terms_with_few_documents_each_are_left_out(spark, tmp_path, monkeypatch):
    """The bounds join moves no postings, whatever the size of the dictionary."""
    monkeypatch.setattr(ix, "BLOCKED_DF", 2)
    rows = [(i * 128 + j, f"all {'some' if i < 2 else 'other'}") for i in range(4) for j in range(6)]
    index = ix.build_index(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "i"), stem=False)
    blocked = {r["term"] for r in index.table("terms").where("blocked").collect()}
    assert blocked == {"all"} and index.table("blocks").count() == 4
    assert index.postings().where("tf <> size(positions) or born <> 0").isEmpty()
