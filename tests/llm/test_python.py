"""Operators that use Python, against brute force, the tokenizers library and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import regex
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import bitpack, bpe, columns, components, hamming, licenses, neardup, toxicity, vocab
from textloom.llm.queries import VOCABULARY

# ---------------------------------------------------------------- encoding


def library_ids(text):
    return vocab.library(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def random_texts(n):
    rng = random.Random(4)
    alphabet = "abcXYZ éßÀÖØþÿ×÷µªºÅÉÑñ'Σς́ \x1c\x85İ日本١٢3!?.-\n\t<|>" + "’“😀ﬁ"
    words = ["don't", "<|endoftext|>", "<|startoftext|>", "I'LL", "''s", "naïve", "ⅷ", "²"]
    return ["".join(rng.choice(words) if rng.random() < 0.1 else rng.choice(alphabet) for _ in range(rng.randrange(60)))
            for _ in range(n)]


def test_forced_boundaries_equal_the_library():
    made = bpe.encoder(VOCABULARY)
    for text in random_texts(4000):
        assert np.frombuffer(made.of(text), "<i4").tolist() == library_ids(text), repr(text)
        assert np.frombuffer(bitpack.encoder(VOCABULARY).of(text), "<i4").tolist() == library_ids(text), repr(text)


def test_fragments_are_cut():
    made = bpe.ForcedBoundaryEncoder(VOCABULARY)
    assert made.cut("q" + "x" * 2 + "q") and "".join(made.cut("zqxqjvé")) == "zqxqjvé"
    assert any(len(made.cut(a + b)) == 2 for a in "qzxj" for b in "qzxj")


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_encode_decode(request, which):
    docs = request.getfixturevalue(which)
    made = vocab.library(VOCABULARY)
    out = bpe.digests(bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)).collect()
    again = bpe.digests(bpe.round_trip(docs, VOCABULARY)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library_ids(r["text"])
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(made.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_encode_empty(empty):
    assert bpe.decode(bpe.encode(empty, VOCABULARY), VOCABULARY).count() == 0


# ------------------------------------------------------------- packed files

@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype("<i4")
    assert len(bitpack.pack(ids, bits)) == -(-1003 * bits // 8)
    assert (bitpack.unpack(bitpack.pack(ids, bits), 1003, bits) == ids).all()


def test_random_access(tmp_path):
    ids = np.random.default_rng(1).integers(0, 49408, 5000).astype("<i4")
    path = tmp_path / "x.bits"
    path.write_bytes(b"".join(bitpack.file_bytes(ids, 16, 700)))
    shard = bitpack.Shard(f"file://{path}")
    assert shard.n_ids == 5000
    for a, b in ((0, 5000), (699, 701), (700, 1400), (4999, 5000), (12, 12), (2100, 2101)):
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_shards(spark, request, which):
    docs = request.getfixturevalue(which)
    manifest = bitpack.write_documents(spark, docs, VOCABULARY, shard_ids=5000)
    rows = sorted(bitpack.with_crc(bitpack.read_shards(manifest)).collect(), key=lambda r: r["start"])
    start, want = 0, []
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in docs.collect():
        own = [*library_ids(r["text"]), 1]
        want.append((r["doc_id"], len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in rows)


def test_shards_empty(spark, empty):
    assert bitpack.read_shards(bitpack.write_documents(spark, empty, VOCABULARY)).count() == 0


# --------------------------------------------------------------- licenses

def test_license_base(documents, odd):
    for docs in (documents, odd):
        got = licenses.scan_licenses(docs).collect()
        texts = {}
        for r in docs.collect():
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
            places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
                      if words[i:i + len(phrase.split())] == phrase.split()]
            starts = [p[0] for p in places]
            texts.setdefault(r["doc_id"], []).append(
                (len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({p[1] for p in places})))
        for r in got:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in texts[r["doc_id"]]
            assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
        assert len(got) == docs.count()


@pytest.mark.parametrize("label, notice, edits", licenses.NOTICES)
def test_license_notices_next_to_each_other(label, notice, edits):
    """As many places as a scan by edit distance finds."""
    made = licenses.Scanner([(label, notice, edits)], ())
    wrong = notice.replace("e", "x", 1)
    for text in (f"{notice} {notice}", f"{notice} {notice} {notice}", f"{wrong} {notice}", f"{notice} {wrong} {wrong}"):
        found = made.scan(text)["spans"]
        places, at = 0, 0
        while at < len(text):   # the shortest end of a match from each place on, left to right
            row = list(range(len(notice) + 1))
            end = None
            for k in range(at, min(len(text), at + len(notice) + edits)):
                new = [row[0] + 1]
                for j, c in enumerate(notice):
                    new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != text[k])))
                row = new
                if row[-1] <= edits and (end is None or row[-1] < end[0]):
                    end = (row[-1], k + 1)
            if end:
                places, at = places + 1, end[1]
            else:
                at += 1
        assert len(found) == places >= 2, text


def test_many_license_places_take_linear_time():
    import time
    started = time.time()
    found = licenses.Scanner().scan("all rights reserved released under the mit license " * 20_000)
    assert found["n_base"] == 20_000 and len(found["spans"]) == 40_000 and time.time() - started < 20


def test_license_notices_within_edits():
    made, rng = licenses.Scanner(), random.Random(3)
    for label, notice, edits in licenses.NOTICES:
        for _ in range(30):
            chars = list(notice)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(1, len(chars) - 1)
                rng.choice((lambda: chars.pop(k), lambda: chars.insert(k, "q"), lambda: chars.__setitem__(k, "q")))()
            line = f" some words {''.join(chars)} follow here "
            whole = regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}", line)
            spans = made.notices_in(line)
            assert whole and spans, (notice, line)
            assert any(s[1] <= sum(whole.fuzzy_counts) for s in spans)
    assert made.notices_in(" nothing of the kind is said in these words ") == []
    found = made.scan("licenced under the apache licence, version 2.0")
    assert found["labels"] == ["apache-2.0"] and found["spans"][0]["word"] == 0 and found["n_base"] == 0


# --------------------------------------------------------------- toxicity

def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").withColumn("out", toxicity.held_out()).collect()
    out = [r for r in rows if r["out"]]
    right = [(r["score"] >= 0.3) == (r["toxic"] == 1) for r in out]
    assert len(out) > 50 and sum(right) >= 0.9 * len(right)
    bad = [r for r in out if r["toxic"] == 1 and r["score"] >= 0.3]
    assert bad and all(0 <= r["score"] <= 1 for r in rows) and sum(bool(r["offending"]) for r in bad) >= 0.8 * len(bad)


def test_noisy_or_equals_its_definition():
    model = toxicity.Model(-4.0, {"bad": 5.0, "worse": 3.0})
    text = "All is well. This is bad!\nBad and worse. Nothing. 12."
    p = lambda z: 1 / (1 + np.exp(-z))
    want = 1 - np.prod([1 - p(z) for z in (-4, 1, 4, -4)])
    score, spans = model.score(text)
    assert score == pytest.approx(want) and [text[a:b].strip() for a, b, _ in spans] == ["This is bad", "Bad and worse"]
    assert model.score("") == (0.0, [])


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


# ---------------------------------------------------------- near duplicates

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """(id, set size, smallest reachable id) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and label[a] is not None and label[b] is not None
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            if (label[a], label[b]) != (least, least):
                label[a] = label[b] = least
                changed = True
    return sorted((str(i), len(s), str(c)) for (i, _), s, c in zip(rows, sets, label))


def varied(seed, n):
    """Near copies around the limit, exact copies and a shared passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzuvw") + str(rng.randrange(40))
    passage, rows = [word() for _ in range(60)], []
    bases = [[word() for _ in range(rng.randrange(3, 120))] for _ in range(n // 6)]
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + max(1, len(own) // 25))):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own + passage * (i % 5 == 0))))
    return rows


@pytest.mark.parametrize("region", [1000, 6])
def test_near_duplicates(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "NEAREST", 2)
    rows = varied(5, 500)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                  region=region).collect()
    mine = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got)
    want = brute_components(rows)
    if region == 1000:
        assert mine == want
    else:  # very small regions go deep, and so may miss a pair at the limit
        assert sum(a == b for a, b in zip(mine, want)) >= 0.98 * len(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("region", [1000, 100, 30])
def test_links_in_front_of_a_common_passage(spark, region):
    """Texts 0.735 alike by a common passage; each second one is 0.752 alike to the one before."""
    passage, rows = " ".join(f"p{i}" for i in range(604)), []
    for i in range(400):
        own = [f"u{i}x{k}" for k in range(108)]
        own[-12:] = [f"s{i // 2}x{k}" for k in range(12)]
        rows.append((i, f"{passage} {' '.join(own)}"))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=region).collect()
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert sum(component[i] == component[i + 1] for i in range(0, 400, 2)) >= 0.95 * 200
    assert all(c in (i, i - 1) for i, c in component.items())


@pytest.mark.parametrize("few", [50, 1])
def test_full_regions_lose_no_link_at_the_limit(spark, monkeypatch, few):
    """Texts of a common passage, 0.752 alike in pairs, in regions that are full at four values, not at six."""
    monkeypatch.setattr(neardup, "FEW", few)
    passage, rows = " ".join(f"p7x{i}" for i in range(302)), []
    for i in range(200):
        own = [f"u{i}x{k}" for k in range(54)]
        own[-8:] = [f"s{i // 2}x{k}" for k in range(8)]
        rows.append((i, f"{passage} {' '.join(own)}"))
    sets = [set(neardup.shingler().hashes(t).tolist()) for _, t in rows[:3]]
    assert 0.75 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.76 > 0.75 > len(sets[1] & sets[2]) / len(sets[1] | sets[2])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=80).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_rare_shingles_make_a_row_for_each_class_not_for_each_pair(spark):
    """Forty classes with the same twenty rare shingles, and two of them with one more."""
    rows = [(c, s) for c in range(40) for s in range(20)] + [(3, 20), (4, 20), (5, 21)]
    prefix = spark.createDataFrame(rows, "class long, shingle long").withColumns(
        {"size": F.lit(30).cast("long"), "n": F.lit(40).cast("long")})
    classes = spark.range(40).select(F.col("id").alias("class"), F.lit(30).cast("long").alias("size"),
                                     F.lit(bytearray(96)).alias("low"))
    got = neardup.rare_regions(prefix, classes).collect()
    assert sorted(r["class"] for r in got) == sorted([*range(40), 3, 4])
    assert len({r["region"] for r in got}) == 2
    assert neardup.rare_regions(prefix, classes, few=39).isEmpty()


def test_rows_of_wanted_keys_are_marked_in_place(spark, monkeypatch):
    """All wanted keys, few others, and the same plan without a shuffle of rows at any broadcast limit."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), "id")
    spark.conf.set(limit, "-1")
    try:
        found = columns.marked(rows, rows.where("id % 10 = 0").select("key"))
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["marked"] for r in found.collect()}
        monkeypatch.setattr(columns, "KEY_BITS", 16)
        few = columns.marked(rows, rows.where("id % 10 = 0").select("key")).where("marked").count()
        none = columns.marked(rows, rows.where("false").select("key")).where("marked").count()
    finally:
        spark.conf.set(limit, before)
    assert len(got) == 20_000 and all(got[i] for i in range(0, 20_000, 10))
    assert sum(got.values()) < 2_010 and 2_000 < few < 3_500 and none == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated ids with other texts, and repeated rows."""
    words = [f"w{i}" for i in range(60)]
    a, b, g = " ".join(words[:30]), " ".join(words[20:60]), " ".join(reversed(words))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (9, g), (9, g), (10, ""), (10, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = [(r["doc_id"], r["text"], r["n"]) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a, 0), (5, b, 2), (9, g, 4), (10, "", 6), (10, "", 7),
                                                      (None, a, 8), (None, a, 9)]))


@pytest.mark.parametrize("block_bytes", [1, 20_000, 1 << 30])
def test_prefixes(spark, monkeypatch, block_bytes):
    """What the texts of a group share moves once a block; the prefixes are those of all rows."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = [(i, " ".join(base[:rng.randrange(30, 60)] + [f"x{rng.randrange(90)}" for _ in range(rng.randrange(8))]))
             for i in range(200)] + [(-5, "of its own only, it shares no shingle"), (1 << 40, "a short one")]
    sets = {c: neardup.shingler().hashes(t).view(np.int64).tolist() for c, t in texts}
    n = collections.Counter(x for s in sets.values() for x in s)
    want = {}
    for c, held in sets.items():
        order = sorted((n[x], x) for x in held)[:len(held) - -(-len(held) * 75 // 100) + 1]
        want |= {(c, len(held), x, k): 1 for k, x in order if k > 1}
    tables, write = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: tables.setdefault(name, write(df, name)))
    got = neardup.prefixes(spark.createDataFrame(texts, "class long, text string")).collect()
    assert collections.Counter(map(tuple, got)) == want
    moved = tables["near-held"].count()
    assert moved <= len(n) if block_bytes == 1 << 30 else moved <= len(n) * (sum(len(t) for _, t in texts) // block_bytes + 1)
    assert moved <= sum(map(len, sets.values())) // (1 if block_bytes == 1 else 3)


@pytest.mark.parametrize("size", [40, neardup.SKETCH, 3 * neardup.SKETCH])
def test_sketches_lose_no_link(size):
    draw = np.random.default_rng(size)
    refused = 0
    for _ in range(200):
        other = draw.integers(0, size // 3)
        h = np.unique(draw.integers(0, 1 << 63, size + other, dtype=np.uint64) << np.uint64(1))
        gone = draw.permutation(len(h))
        p, q = np.sort(h[gone[:size]]), np.sort(h[gone[other:]])
        both = len(np.intersect1d(p, q))
        link = 100 * both >= 75 * (len(p) + len(q) - both)
        cut = [(x[:neardup.SKETCH] >> np.uint64(32)).astype("<u4") for x in (p, q)]
        maybe = neardup.may_link(cut, np.array([len(p), len(q)]))[1, 0]
        assert maybe or not link
        refused += not maybe
    assert refused > 10


def test_near_duplicates_odd(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = neardup.near_duplicates(odd).collect()
    want = brute_components(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert neardup.near_duplicates(empty).count() == 0
    kept = corpus_pipeline.near_dedup(spark, odd, SMALL)
    assert kept.columns == odd.columns and {2} not in [{r["doc_id"]} for r in kept.collect()]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + k) for k in range(1, 300)] + \
            [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    label = {x: x for u, v in links if u != v for x in (u, v)}
    for _ in range(100):
        for u, v in links:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["label"] for r in got} == label and len(got) == len(label)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --------------------------------------------------------------- top-k codes

def test_hamming(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    codes = [int(base[rng.integers(40)]) ^ (int(rng.integers(1 << 62)) & int(rng.integers(1 << 62)) & int(rng.integers(1 << 62)))
             for _ in range(700)] + [int(base[0])] * 60
    rows = [(i, c) for i, c in enumerate(codes)] + [(None, 5), (9999, None), (3, codes[3])]
    frame = spark.createDataFrame(rows, "id long, code long")
    got = hamming.nearest_codes(frame, frame.where(F.col("id") % 50 == 0), 10, shard=200, block=4).collect()
    for q in range(0, 760, 50):
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:10]
        assert sorted((r["rank"], r["distance"], r["id"]) for r in got if r["query_id"] == q) == \
            [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    none = frame.limit(0)
    assert hamming.nearest_codes(none, none).count() == 0
    assert hamming.nearest_codes(frame.limit(3), frame.limit(1), 10).count() == 3


def test_search_stops_early():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    codes[:20] = codes[0] ^ (np.uint64(1) << np.arange(20, dtype=np.uint64))
    index = hamming.SegmentIndex(np.arange(5000), codes)
    _, distances, verified = index.search(codes[0], 10)
    assert distances.max() <= 2 and verified < 500


# ----------------------------------------------------------------- pipeline

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    previous = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, previous, SMALL)
        assert out.columns == docs.columns, name
        previous = spark.createDataFrame(out.collect(), docs.schema)
    rows = {(r["doc_id"], r["text"]) for r in previous.collect()}
    texts = dict(rows)
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in previous.collect())
    for r in out:
        assert r["ids"] == library_ids(texts[r["doc_id"]])
