import numpy as np
import pytest

from hopweave.operators import knn, textsets
from hopweave.plans import catalog


def plain(rows, asked, k, places):
    by = {}
    for i, t, w in rows:
        by.setdefault(i, []).append((t, w))
    out = []
    for q in {i for i, _, _ in asked}:
        own = [(t, w) for i, t, w in asked if i == q]
        found = []
        for b, terms in by.items():
            products = [w * x for t, w in own for s, x in terms if t == s]
            if products:
                found.append((-round(sum(products), places) + 0.0, b))
        out += [(q, r, b, round(d, 6)) for r, (d, b) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("low", [0.1, -1.0])
def test_sparse_search_in_blocks_and_columns_is_that_of_all_pairs(spark, monkeypatch, low):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        of = i - i % 3 if 60 <= i < 120 else i  # some are copies
        own = np.random.default_rng(of)
        terms = np.unique(np.minimum(own.geometric(0.12, 8), 40))
        rows += [(i, f"t{t}", round(float(w), 2)) for t, w in zip(terms, own.uniform(low, 1, len(terms)), strict=True)]
    rows += [(500, "t1", 0.0), (501, "t9", 1e6), (502, "alone", 1.0), (503, "t2", 1e-20)]
    asked = [r for r in rows if r[0] % 4 == 0] + [(900, "nowhere", 1.0), (904, "t1", 0.5), (904, "t1", 0.25)]
    base, queries = (spark.createDataFrame(x, "id long, term string, weight double").repartition(3) for x in (rows, asked))
    want = plain(rows, asked, 5, 6)
    found = lambda: sorted((r.q_id, r.rank, r.b_id, round(r.dist + 0.0, 6)) for r in knn.sparse_ip(base, queries, 5, places=6).collect())
    assert found() == want and len(want) > 150
    monkeypatch.setattr(knn, "POSTING_BYTES", 1500)
    monkeypatch.setattr(knn, "COLUMNS", 3)
    assert found() == want
    monkeypatch.setattr(knn, "COMMON", 1)
    assert found() == want
    assert knn.sparse_ip(base, queries.limit(0), 5).count() == 0 and knn.sparse_ip(base.limit(0), queries, 5).count() == 0


def test_a_row_that_floats_cannot_tell_from_another_ranks_by_doubles(spark):
    rows = [(i, t, 1.0 + (i == 7 and t == "b") * 1e-7) for i in range(20) for t in "ab"]
    base = spark.createDataFrame(rows, "id long, term string, weight double")
    found = knn.sparse_ip(base, spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], "id long, term string, weight double"), 3, places=8)
    assert [r.b_id for r in found.orderBy("rank").collect()] == [7, 0, 1]


def test_tfidf_of_texts_is_that_of_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 150, " ".join(rng.choice([f"Term{j}" for j in range(80)], rng.integers(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "term1 term2"), (3, None), (900, ""), (901, " \n term1\tTERM1 é"), (902, " \t")], "doc_id long, text string").repartition(3)
    asked = lambda w: sorted((r.id, r.term, round(r.weight, 9)) for r in w.collect())
    flat = lambda w: w.selectExpr("id", "inline(arrays_zip(terms, weights)) as (term, weight)")
    want = asked(textsets.tfidf(textsets.terms(docs)))
    assert asked(flat(textsets.tfidf_texts(docs))) == want and len(want) > 500
    monkeypatch.setattr(textsets, "PART_CHARS", 50)  # many parts, some of one document
    assert asked(flat(textsets.tfidf_texts(docs))) == want
    assert textsets.tfidf_texts(docs.limit(0)).count() == 0


def test_sparse_ip_topk_shuffles_texts_not_their_terms(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"word{j}" for j in range(3000)], 200))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def moved():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = moved()
    assert catalog.QUERIES["sparse_ip_topk"](spark, str(tmp_path)).toArrow().num_rows == 400
    assert sum(b for k, b in moved().items() if k not in before) < 1.5 * sum(len(t) for _, t in rows)
