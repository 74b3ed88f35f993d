"""Near-dedup where ids repeat with other texts: each group keeps one row."""

from hopweave.llm import simhash_bk as S


def kept(spark, rows):
    return sorted(tuple(r) for r in S.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_a_group_stays_though_its_id_is_in_another(spark):
    assert kept(spark, [(5, "one two three"), (7, "ONE two three"), (5, "quite another text"), (3, "quite another TEXT")]) == [(3, "quite another TEXT"), (5, "one two three")]


def test_unlike_texts_of_one_id_stay(spark):
    assert kept(spark, [(5, "one two three"), (5, "quite another text"), (5, "one two three"), (8, "one TWO three")]) == [(5, "one two three"), (5, "quite another text")]
