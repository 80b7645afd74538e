import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries as Q
from textloom.llm import runs as R

SMALL = "/root/testdata/sf0.001"


def runs_of(words):
    """Every run by comparing all distances: (start, length, period)."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(24, 3 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out)


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(seed):
    rnd = random.Random(seed)
    k, words = rnd.choice([1, 2, 3, 5, 40]), []
    for _ in range(rnd.randint(1, 5)):
        unit = [f"w{rnd.randrange(k)}" for _ in range(rnd.randint(1, rnd.choice([3, 10, 40, 90])))]
        words += (unit * rnd.randint(1, 12))[:rnd.randint(1, 300)]
    return words


@pytest.mark.parametrize("long", [R.LONG, 100])
def test_runs_equal_all_distances(spark, long):
    docs = [made(seed) for seed in range(60)]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in R.find_runs(rows, long=long, core=64).collect()}
    assert len(found) == len(docs) and sum(bool(r["runs"]) for r in found.values()) > 30
    for i, words in enumerate(docs):
        expected = runs_of(words)
        assert [tuple(r) for r in found[i]["runs"]] == expected, words
        assert found[i]["n_words"] == len(words) and found[i]["kept_text"] == collapsed(words, expected)


def test_one_word_takes_linear_time():
    import time
    ids = R.np.zeros(1 << 18, R.np.int64)
    started = time.time()
    found = [f for low, high, reach in R.octaves(len(ids))
             for f in R.fragments(ids, low, high, reach, R.np.arange(0, len(ids), 2 * reach))]
    assert {int(f[0]) for f in found} == {1} and time.time() - started < 60


def test_query_on_whole_table(spark, texts):
    got = {r["doc_id"]: r for r in Q.op13_periodic_runs(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 10
    for doc, text in texts.items():
        words = split(text)
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_of(words)
        r = got[doc]
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_odd_rows(spark, odd, empty):
    found = R.find_runs(odd)
    assert found.count() == odd.count()
    assert found.where("runs is null or kept_text is null").isEmpty()
    assert {r["n_words"] for r in found.where("doc_id in (3, 4, 5)").collect()} == {0}
    assert found.where("doc_id is null").count() == 1
    assert R.find_runs(empty).isEmpty()
    same = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (1, "b " * 5), (None, "a " * 30)],
                                 "doc_id long, text string")
    assert sorted(len(r["runs"]) for r in R.find_runs(same).collect()) == [0, 1, 1, 1]
    planted = Q.with_planted_runs(odd.select("doc_id", "text"))
    assert planted.count() == odd.count() and planted.where(F.col("doc_id").isNull()).count() == 1
