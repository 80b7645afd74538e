import pytest

from textloom.plans.index import build_index
from textloom.plans.results import search_results, search_results_batch

QUERIES = ["tion", "with an", '"of the"', "zzzzqq", '"the" OR OR "of"']


@pytest.fixture(scope="module")
def index(spark, documents, tmp_path_factory):
    return build_index(documents, str(tmp_path_factory.mktemp("results") / "i"), doc_buckets=4, term_buckets=4)


def best(fulltext, query, k):
    found = sorted(fulltext.search(query).items(), key=lambda x: (-round(x[1][0], 9), x[0]))
    return [(str(doc), snippet) for doc, (_, snippet) in found[:k]]


def test_result_rows(index, fulltext):
    for query, k in ((QUERIES[0], 5), (QUERIES[2], -1), (QUERIES[3], 5), (QUERIES[4], 5), (None, 5), (QUERIES[0], 0)):
        rows = search_results(index, query, k)
        assert rows.columns == ["path", "snippet", "score", "last_modified"]
        want = best(fulltext, query, None if k < 0 else k) if query else []
        assert [(r["path"], r["snippet"]) for r in rows.collect()] == want, query


def test_batch_rows(spark, index, fulltext):
    table = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    rows = search_results_batch(index, table, k=3).orderBy("query_id", "rank").collect()
    for number, query in enumerate(QUERIES):
        found = [(r["path"], r["snippet"]) for r in rows if r["query_id"] == number]
        assert found == best(fulltext, query, 3), query
