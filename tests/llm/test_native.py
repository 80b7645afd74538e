"""Mixing, quality rules, line templates and preferences on odd rows and against plain Python."""

import collections
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import linetemplates, mixing, preferences, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORD.findall(text or ""))


# ------------------------------------------------------------------ mixing

def filled(sizes, weights, share=1.5, cap=2.0):
    """Water-filling by rounds: clamp what is above, share out the rest again."""
    target, open_ = {s: 0.0 for s in sizes}, {s for s in sizes if sizes[s]}
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_mixing(request, which):
    docs = request.getfixturevalue(which)
    plan = mixing.plan_mix(docs)
    rows = mixing.mixed(docs, plan).select("row.doc_id", "row.source", "row.text", "size", "target",
                                           "source_size", "repetitions").collect()
    assert len(rows) == docs.count()
    sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == n_words(r["text"]) and 0 <= r["repetitions"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["repetitions"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s]
    again = mixing.mixed(docs, mixing.plan_mix(docs)).select("row.doc_id", "repetitions").collect()
    assert sorted((str(a[0]), a[1]) for a in again) == sorted((str(r["doc_id"]), r["repetitions"]) for r in rows)
    assert mixing.repeated(mixing.mixed(docs, plan)).count() == sum(r["repetitions"] for r in rows)


def test_mixing_one_source_at_its_cap(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i else "y") for i in range(10)],
                                 "doc_id long, text string, source string")
    plan = {r["source"]: r["target"] for r in mixing.plan_mix(docs).collect()}
    assert plan["y"] == 6.0 and plan["x"] == pytest.approx(39.0)


def test_mixing_sums_are_few_files(spark, monkeypatch):
    """The sums of a source are one file, however many tasks sum."""
    files, write = {}, mixing.materialize

    def counted(df, name):
        table = write(df, name)
        files[name] = sum(f.endswith(".parquet") for f in table.inputFiles())
        return table

    monkeypatch.setattr(mixing, "materialize", counted)
    docs = spark.createDataFrame([(i, f"word {i}", "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("30", "false")):
            spark.conf.set(k, v)
        mixing.plan_mix(docs)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert files["mix-parts"] <= 3


def test_mixing_empty(empty):
    assert mixing.mixed(empty, mixing.plan_mix(empty)).count() == 0


# ----------------------------------------------------------------- quality

def figures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_quality_figures(request, which):
    docs = request.getfixturevalue(which)
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a a a a\nx b c x b c x b c\n\nx b c x b c x b c")))
    rows = quality.base_figures(docs, keep=["doc_id", "text"]).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"],
                r["n_repeat_words"]) == figures(r["text"])


def test_quality_thresholds_merge_and_keep(odd, empty, spark):
    f = quality.with_verdict_inputs(quality.base_figures(odd, keep=["doc_id", "lang", "source"]))
    out = quality.judged(f, quality.thresholds(f)).collect()
    assert len(out) == odd.count() and all(r["kept"] in (True, False) for r in out)
    assert not any(r["kept"] for r in out if r["n_words"] < 50)
    f = quality.with_verdict_inputs(quality.base_figures(empty, keep=["doc_id", "lang", "source"]))
    assert quality.judged(f, quality.thresholds(f)).count() == 0
    # A group of few takes its language's bounds.
    rows = [(i, "en", "big" if i < 60 else "tiny", 100, 500 + i % 7, 0, 5, 0, 0) for i in range(62)]
    f = quality.with_verdict_inputs(spark.createDataFrame(
        rows + [(99, "en", "tiny", 100, 500, 90, 5, 0, 0)],
        "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long,"
        " n_dup_lines long, n_repeat_words long"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(f, quality.thresholds(f)).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_quality_keeps_labelled_good(spark, documents):
    kept = corpus_pipeline.quality_rules(spark, documents, SMALL)
    assert kept.columns == documents.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").join(documents, "doc_id")
    good = [r for r in labels.collect() if r["quality"] == 1 and n_words(r["text"]) >= 50]
    assert sum(r["doc_id"] in ids for r in good) >= 0.97 * len(good)


# ------------------------------------------------------------------- lines

def brute_lines(docs, min_docs, fixed_share, support, depth):
    """{row number: kept text}: the same rules in plain Python."""
    last = (1 << 63) - 1
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    places = [(k, d if d is not None else last, n, masked(line)) for k, (d, t) in enumerate(docs)
              for n, line in enumerate((t or "").split("\n")) if WORD.search(line)]
    docs_of, leaf_docs, seqs = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for _, d, _, t in places:
        docs_of[t].add(d)
    leaf = lambda t: (len(t), t[:depth])
    for t, ds in docs_of.items():
        leaf_docs[leaf(t)] += len(ds)
        seqs[leaf(t)].add(t)
    template = {}
    for key, ts in seqs.items():
        if leaf_docs[key] < min_docs:
            continue
        held = collections.Counter((p, w) for t in ts for p, w in enumerate(t))
        for t in ts:
            fixed = tuple((p, w) for p, w in enumerate(t) if w != "<*>" and held[p, w] >= support)
            wide = len(ts) > 1 and fixed and len(fixed) >= fixed_share * len(t)
            template[t] = (key, fixed) if wide else (key, t)
    users = collections.defaultdict(set)
    for t, name in template.items():
        users[name] |= docs_of[t]
    gone = collections.defaultdict(set)
    for k, d, n, t in places:
        if t in template and len(users[template[t]]) >= min_docs and d != min(users[template[t]]):
            gone[k].add(n)
    return ["\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[k])
            for k, (_, t) in enumerate(docs)]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_templates(spark, odd, documents, min_docs):
    logs = [(i, f"user u{i} logged in from host alpha{'beta' if i % 2 else 'gamma'} at {i}:00 today\n"
                f"opened door of room {'abc'[i % 3]} with key k{i} at noon sharp again", "en", "s", 1) for i in range(100, 112)]
    docs = documents.unionByName(spark.createDataFrame(logs, documents.schema)).unionByName(odd.select(documents.columns))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(map(str, zip(rows, brute_lines(rows, min_docs, 0.7, 2, 3))))
    got = linetemplates.dedup_lines(docs, min_docs=min_docs, support=2).select("row.doc_id", "row.text", "kept_text")
    assert sorted(str(((r[0], r[1]), r[2])) for r in got.collect()) == want
    assert any(a[1] and a[1] != b for a, b in zip(rows, brute_lines(rows, min_docs, 0.7, 2, 3)))


def test_line_dedup_stage(spark, odd, empty):
    out = corpus_pipeline.line_dedup(spark, odd, SMALL)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert corpus_pipeline.line_dedup(spark, empty, SMALL).count() == 0


# ------------------------------------------------------------- preferences

def test_preferences(spark):
    kind = "pair_id long, turn long, role string, text string"
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
         (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, None, None, None), (3, 0, "user", "x"),
         (4, 0, "assistant", "only chosen"), (None, 0, "user", "lost"), (1, 3, "assistant", "yes")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "less"), (1, 3, "assistant", "yes"),
         (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, None, None, None), (3, 0, "user", "y")]
    out = preferences.format_preferences(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind))
    assert out.where("part >= 0").count() == 4  # a null turn number is in a part of its own
    got = {}
    for r in out.orderBy("pair_id", "part").collect():
        known = got.setdefault(r["pair_id"], r.asDict())
        if known["part"] != r["part"]:
            got[r["pair_id"]] = r.asDict() | {p: known[p] + r[p] for p in ("prompt", "chosen", "rejected")}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["prompt"] == turn("user", "hi") + turn("assistant", "hello")
    assert got[1]["chosen"] == turn("user", "more") + turn("assistant", "yes")
    assert got[1]["rejected"] == turn("user", "less") + turn("assistant", "yes")
    span = got[1]["chosen_spans"][0]
    assert got[1]["chosen"][span["start"]:span["end"]] == "yes<|im_end|>" and len(got[1]["chosen_spans"]) == 1
    assert got[2]["prompt"] == turn("user", "same") + turn("assistant", "same") and got[2]["chosen"] == ""
    assert got[3]["prompt"] == turn("", "") and got[3]["rejected"] == turn("user", "y") and not got[3]["rejected_spans"]
    assert got[4]["prompt"] == "" and got[4]["rejected"] == "" and got[4]["chosen"] == turn("assistant", "only chosen")
    none = spark.createDataFrame([], kind)
    assert preferences.format_preferences(none, none).count() == 0


def test_preferences_in_parts(spark):
    """A long conversation in parts says the same as in one row; differing turns of one number are no prefix."""
    kind = "pair_id long, turn long, role string, text string"
    role = lambda i: "assistant" if i % 2 else "user"
    a = [(1, i, role(i), f"turn {i}") for i in range(40)] + [(2, 0, "user", "x"), (2, 1, "user", "a"), (2, 1, "user", "b")]
    b = [(1, i, role(i), f"turn {i}" if i < 21 else f"other {i}") for i in range(30)] + [(2, 0, "user", "x"), (2, 1, "user", "a")]
    a, b = (spark.createDataFrame(x, kind) for x in (a, b))
    whole = {r["pair_id"]: r for r in preferences.format_preferences(a, b).collect()}
    assert whole[1]["prompt"].count("<|im_start|>") == 21 and whole[1]["rejected"].count("<|im_start|>") == 9
    assert whole[2]["prompt"].count("<|im_start|>") == 1 and whole[2]["chosen"].count("<|im_start|>") == 2
    parts = preferences.format_preferences(a, b, part_bits=3).orderBy("pair_id", "part").collect()
    assert [r["part"] for r in parts] == [0, 1, 2, 3, 4, 0]
    for p in ("prompt", "chosen", "rejected"):
        assert "".join(r[p] for r in parts if r["pair_id"] == 1) == whole[1][p]
    for rows in (parts, whole.values()):
        trained = [r[p][s["start"]:s["end"]] for r in rows if r["pair_id"] == 1
                   for p in ("chosen", "rejected") for s in r[f"{p}_spans"]]
        assert sorted(trained) == sorted([f"turn {i}<|im_end|>" for i in range(21, 40, 2)]
                                         + [f"other {i}<|im_end|>" for i in range(21, 30, 2)])
