import numpy as np

from hopweave.operators import textsets
from hopweave.plans import catalog


def test_bm25_of_texts_is_that_of_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 150, " ".join(rng.choice([f"Term{j}" for j in range(80)], rng.integers(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "term1 term2"), (3, None), (900, ""), (901, " \n term1\tTERM1 é")], "doc_id long, text string").repartition(3)
    asked = lambda w: sorted((r.id, r.term, round(r.weight, 9)) for r in w.collect())
    want = asked(textsets.bm25(textsets.terms(docs)))
    assert asked(textsets.bm25_texts(docs)) == want and len(want) > 500
    monkeypatch.setattr(textsets, "PART_CHARS", 50)  # many parts, some of one document
    assert asked(textsets.bm25_texts(docs)) == want
    assert textsets.bm25_texts(docs.limit(0)).count() == 0


def test_bm25_weights_shuffles_texts_not_their_terms(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"word{j}" for j in range(3000)], 200))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def moved():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = moved()
    assert catalog.QUERIES["bm25_weights"](spark, str(tmp_path)).toArrow().num_rows == 2000
    assert sum(b for k, b in moved().items() if k not in before) < 1.5 * sum(len(t) for _, t in rows)
