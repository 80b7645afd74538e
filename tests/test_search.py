import random

import pytest

from textloom.operators import search as se
from textloom.operators.batch import rejected_queries, search_batch
from textloom.operators.classify import classify_queries, classify_query
from textloom.operators.corpus import DocumentCorpus
from textloom.operators.snippets import snippets_for_query, with_batch_snippets
from textloom.plans.index import build_index

# What a user types, and the match expression that it stands for; None: nothing is asked.
MATCH = {
    "tion": "tion", "the": "the", "with an": "with an", "of the": "of the", '"of the"': '"of the"',
    "the-of": '"the-of"', "prog*": '"prog*"', "it's": '"it\'s"', "a.b@c.d": '"a.b@c.d"', "The OF": "The OF",
    '"tion" OR "leaux"': '"tion" OR "leaux"', '"tion" AND "the"': '"tion" AND "the"',
    '"tion" NOT "the"': '"tion" NOT "the"', '"the" "of"': '"the" "of"', "^the": "^the", "^the of": "^the of",
    "the + of": "the + of", "of_the": "of_the", "and": "and", "or with": "or with", "C++": "C++",
    "foo,bar": "foo,bar", "what?": "what?", "a;b": "a;b", '"': '"', '""': '""', '"---"': '"---"', "   ": None,
    "": None, "the the": "the the", "zzzzqq": "zzzzqq", "élan": "élan", "leaux élle": "leaux élle",
    "an AND with": '"an AND with"', '"the" + "of"': '"the" + "of"', "→ tion": "→ tion", "tions": "tions",
    '"the" ; "of"': '"the" ; "of"', '"the" OR OR "of"': '"the" OR OR "of"', '"the" , "of"': '"the" , "of"',
    '"the" || "of"': '"the" || "of"', '"content" : "tion"': '"content" : "tion"',
    '"Content":"tion" "the"': '"Content":"tion" "the"', '"other" : "tion"': '"other" : "tion"',
}
QUERIES = list(MATCH)


@pytest.fixture(scope="module")
def corpora(spark, documents, tmp_path_factory):
    index = build_index(documents, str(tmp_path_factory.mktemp("ix") / "i"), doc_buckets=4,
                        term_buckets=4)
    return {"documents": DocumentCorpus(documents), "index": index.corpus()}


def as_dict(results):
    return {r["doc_id"]: r["score"] for r in results.collect()}


@pytest.mark.parametrize("kind", ["documents", "index"])
@pytest.mark.parametrize("query", QUERIES)
def test_typed_query_equals_full_text_engine(corpora, fulltext, kind, query):
    got = as_dict(se.search(corpora[kind], query, k=-1))
    want = {i: s for i, (s, _) in fulltext.search(MATCH[query]).items()}
    assert got.keys() == want.keys()
    for doc_id, score in want.items():
        assert got[doc_id] == pytest.approx(score, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("kind", ["documents", "index"])
def test_operators_equal_full_text_engine(corpora, fulltext, kind):
    corpus = corpora[kind]
    cases = [
        (se.search_prefix(corpus, "thr", k=-1), "thr*"),
        (se.search_near(corpus, ["with", "tion"], 3, k=-1), "NEAR(with tion, 3)"),
        (se.search_near(corpus, ["the", "of", "and"], 2, k=-1), "NEAR(the of and, 2)"),
        (se.search_first(corpus, "the", k=-1), "^the"),
        (se.search_phrase(corpus, "of the", k=-1), '"of the"'),
        (se.search_terms(corpus, ["of", "leaux", "of the"], "any", k=-1), '"of" OR "leaux" OR "of the"'),
        (se.search_terms(corpus, ["tion"], exclude=["of the", "with"], k=-1),
         '"tion" NOT "of the" NOT "with"'),
    ]
    for results, match in cases:
        got, want = as_dict(results), fulltext.search(match)
        assert got.keys() == want.keys(), match
        for doc_id, (score, _) in want.items():
            assert got[doc_id] == pytest.approx(score, rel=1e-9, abs=1e-12), match


@pytest.mark.parametrize("query", ["tion", "with an", '"of the"', "the of", '"tion" OR "leaux"',
                                   "^the", "the the", "tion leaux"])
def test_snippets(corpora, documents, fulltext, query):
    corpus = corpora["index"]
    best = se.search(corpus, query, k=-1)
    rows = snippets_for_query(corpus, best, documents, query).collect()
    want = fulltext.search(query)
    assert len(rows) == len(want)
    for r in rows:
        assert r["snippet"] == want[r["doc_id"]][1]


def test_order_limits_and_ties(corpora):
    corpus = corpora["index"]
    ranked = [tuple(r) for r in se.search_terms(corpus, ["tion"], k=-1).collect()]
    assert ranked == sorted(ranked, key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in se.search_terms(corpus, ["tion"], k=7).collect()] == ranked[:7]
    assert se.search_terms(corpus, ["tion"], k=0).count() == 0
    assert len(se.search_terms(corpus, ["tion"]).collect()) == 10


def test_complex_queries_are_refused(corpora):
    with pytest.raises(ValueError):
        se.search(corpora["index"], '"a" OR "b" AND "c"')


def test_batch_equals_single_queries(spark, corpora):
    typed = [*QUERIES, '"the" OR "of"', '"with" NOT "tion"', "with"]
    hard = spark.createDataFrame([(1, '"a" OR "b" AND "c"'), (2, '"a" ; "b"'), (3, "tion")], "query_id int, query string")
    assert {r["query_id"] for r in search_batch(corpora["index"], hard, k=4).collect()} == {3}
    assert {r["query_id"]: r["mode"] for r in rejected_queries(hard).collect()} == {1: "complex", 2: "invalid"}
    table = spark.createDataFrame(list(enumerate(typed)) + [(999, None)], "query_id int, query string")
    for kind, checked in (("documents", typed[:3]), ("index", typed)):
        corpus, got = corpora[kind], {}
        for r in search_batch(corpus, table, k=4).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["score"])
        for number, query in enumerate(checked):
            one = [(r["doc_id"], r["score"]) for r in se.search(corpus, query, k=4).collect()]
            assert [got.get(number, {})[i] for i in sorted(got.get(number, {}))] == one, query


def test_query_table_equals_single_classification(spark):
    typed = [*QUERIES, None, "\x1a", "a\x1ab", "\x1c\x1d", "\u3000", "a\u3000b", "a\x0bb", "java + ^go", "a^b",
             "^ a", "a +", "+ a", "^", '"a""b"', '"a" AND ""', '"" NOT "b"', '"a" NOT ""', '"a"OR"b"',
             '"a" OR "b" AND "c"', "{a}", "ÀÉ_x", "a\nb\t c\r", '"a\n" \t "b"', "ΣΑΣ", "a\n", "+", "a+b+ c"]
    table = spark.createDataFrame(list(enumerate(typed)), "id int, query string")
    rows = {r["id"]: r for r in classify_queries(table).collect()}
    for number, query in enumerate(typed):
        one, row = classify_query(query, stem=False), rows[number]
        assert row["mode"] == one.mode, query
        for required, units in ((True, one.units), (False, one.excluded)):
            assert [(tuple(i["terms"]), i["first"]) for i in row["items"] if i["required"] == required] == [
                (u.terms, u.first) for u in units], query


def test_batch_snippets(spark, corpora, documents, fulltext):
    typed = ["tion", "with an", '"of the"', '"tion" NOT "the"', "^the of"]
    table = spark.createDataFrame(list(enumerate(typed)), "query_id int, query string")
    corpus = corpora["index"]
    rows = with_batch_snippets(corpus, search_batch(corpus, table, k=5), table, documents).collect()
    assert len(rows) > 10
    for r in rows:
        assert r["snippet"] == fulltext.search(typed[r["query_id"]])[r["doc_id"]][1]


def test_near_against_brute_force(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 18))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, words in [(0, "ab"), (2, "abc"), (5, "ba")]:
        want = set()
        for i, text in texts.items():
            t = text.split()
            spans = [[p for p, w in enumerate(t) if w == word] for word in words]
            starts = [s for s in range(len(t))
                      if all(any(s <= p <= s + n + 1 for p in places) for places in spans)]
            if starts:
                want.add(i)
        assert set(as_dict(se.search_near(DocumentCorpus(docs), list(words), n, k=-1))) == want


def test_skewed_terms_are_complete(spark, tmp_path):
    """One word in every document, one document with most tokens of the corpus."""
    rows = [(i, "hot " * (1 + i % 3) + f"rare{i}") for i in range(300)] + [(300, "hot cold " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = build_index(docs, str(tmp_path / "i"), doc_buckets=3, term_buckets=2)
    assert index.total_len == sum(len(t.split()) for _, t in rows)
    for corpus in (index.corpus(), DocumentCorpus(docs)):
        assert se.search_terms(corpus, ["hot"], k=-1).count() == 301
        assert as_dict(se.search(corpus, "hot rare7", k=-1)).keys() == {7}
        assert se.search_phrase(corpus, "hot cold hot", k=-1).count() == 1


def test_classification(spark):
    cases = {
        None: ("empty", []), "  ": ("empty", []), "python programming": ("all", ["python", "programming"]),
        '"programming language"': ("all", ["programming language"]),
        "python AND java": ("all", ["python and java"]), "PORTABLE": ("all", ["portable"]),
        "prog*": ("all", ["prog"]), "Python's": ("all", ["python s"]), "((x": ("all", ["x"]),
        '"a" OR "b"': ("any", ["a", "b"]), '"a" AND "b"': ("all", ["a", "b"]),
        '"a" "b"': ("all", ["a", "b"]), "python near java": ("all", ["python", "near", "java"]),
        "C++": ("invalid", []), "foo,bar": ("invalid", []), "what?": ("invalid", []),
        '"': ("invalid", []), '""': ("empty", []), '"---"': ("empty", []),
        "foo_bar": ("all", ["foo bar"]), '"a" AND ""': ("empty", []), '"a" OR ""': ("any", ["a"]),
        '"a" OR "b" AND "c"': ("complex", []), "a\x0bb": ("invalid", []), "java + ^go": ("invalid", []),
    }
    for query, (mode, units) in cases.items():
        found = classify_query(query, stem=False)
        assert (found.mode, [" ".join(u.terms) for u in found.units]) == (mode, units), query
    assert classify_query("^python java").units[0].first
    negated = classify_query('"a" NOT "b" NOT "c"', stem=False)
    assert [u.terms for u in negated.excluded] == [("b",), ("c",)]
