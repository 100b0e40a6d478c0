"""Every operator on odd rows: nulls in any column, empty and very long texts, repeated rows, clashing names, empty tables."""

import math

import pytest

from parallaxis.llm import ann, licenses, mixing, near_vectors, ngram_join, packing, pii, substrings, toxicity, urls
from parallaxis.llm.queries import word_bpe

LONG = "amber copper violet " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None, "x", 1.0, None), (None, "", "s", None, None, "k"), (1, "", "s", "x", 1.0, "k"), (1, "cc by apache license", "s", "x", 1.0, "k"), (1, "cc by apache license", "s", "x", 1.0, "k"), (2, LONG, None, "x", None, "k"), (3, "é ß 漢字 a@b.co 1.2.3.4", "t", "y", 2.0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, labels string, score double, key string")


OPERATORS = {
    "packing": lambda d: packing.pack_documents(d, word_bpe()),
    "substrings": substrings.dedup_substrings,
    "licenses": licenses.scan_licenses,
    "mixing": mixing.mix_sources,
    "pii": pii.find_pii,
    "ngrams": lambda d: ngram_join.jaccard_components(d, 3, (9, 10)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_texts(odd, name):
    out = OPERATORS[name](odd).collect()
    if name == "packing":
        assert len({(r.sequence_id, r.offset) for r in out}) == len(out) and sum(r.length for r in out if r.doc_id == 2) == next(r.doc_tokens for r in out if r.doc_id == 2)
    else:
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd.collect())
    if name == "substrings":
        assert [r.n_removed for r in out if r.doc_id == 2][0] > 500_000
    if name == "ngrams":
        assert {r.component_id for r in out if r.doc_id == 1} == {1} and [r.n_shingles for r in out if r.doc_id == 2] == [3]
    assert OPERATORS[name](odd.where("false")).count() == 0


def test_toxicity_keeps_columns_and_rows(spark, odd):
    rows = [(i, ("river stone " * 20) + ("vilething grotslur " * 3 if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(odd, model)
    assert sorted(out.columns) == sorted([*odd.columns, "predicted"]) and out.count() == odd.count()
    scores = [r.score for r in out.collect()]
    assert all(0 <= s <= 1 for s in scores) and len({s for s, r in zip(scores, out.collect()) if r.text == "cc by apache license"}) == 1
    kept = toxicity.drop_toxic(odd, labels.where("false"))
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))


VECTORS = [
    (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.95, math.sqrt(1 - 0.9025), 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0, math.inf, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0]), (None, [1.0, 0.0, 0.0]), (9, [0.0, 0.0, 1.0]),
]


def test_vectors(spark):
    v = spark.createDataFrame([(i, x, 0.5, "c") for i, x in VECTORS], "vec_id long, embedding array<double>, score double, cid string")
    got = [(r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_duplicates(v).collect()]
    assert len(got) == len(VECTORS)
    assert [g[2] for g in got if g[0] == 2] == [1] and all(g[1] == 0 and g[2] == g[0] for g in got if g[0] in (4, 5, 6, 7, 8, 9))
    assert [g[1:] for g in got if g[0] == 3] == [(3, 1)]
    assert near_vectors.near_duplicates(v.where("false")).count() == 0
    found = ann.nearest_neighbours(v, v.where("vec_id in (2, 5)"), 3).orderBy("rank").collect()
    assert {r.query_id for r in found} == {2} and [r.vec_id for r in found][:2] == [1, 1] and [r.rank for r in found] == [1, 2, 3]
    assert ann.nearest_neighbours(v.where("false"), v, 3).count() == 0


def test_urls(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "http://A.example.com/" + "a" * 200_000), (None, "https://x.net/es/?q"), (4, "ftp://.com/"), (5, "no scheme")]
    pages = spark.createDataFrame([(p, u, "h", "r") for p, u in rows], "page_id long, url string, host string, rule string")
    out = urls.judge_urls(pages).collect()
    assert len(out) == len(rows) and {r.verdict for r in out if r.page_id in (1, 2, 5)} == {"block"} and [r.rule for r in out if r.page_id is None] == ["net/es/"]
    assert urls.judge_urls(pages.where("false")).count() == 0
