import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from hopweave.llm import token_output as T
from hopweave.llm.common import new_path


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 700_003])
def test_blocks_round_trip_and_decode_from_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    seen, count = np.unique(ids if n else np.array([3]), return_counts=True)
    coder = T.Coder(seen, T.quantised(count.astype(float)))
    b = coder.encode(ids)
    assert np.array_equal(coder.decode(b), ids)
    k = len(b["mark_step"])
    assert np.array_equal(np.concatenate([coder.decode(b, i, i + 1) for i in range(k)]), ids)
    if n > 1000:
        assert k > 1 and len(b["stream"]) < 2 * n


def test_one_symbol_takes_no_room():
    coder = T.Coder(np.array([7]), T.quantised(np.array([5.0])))
    b = coder.encode(np.full(5000, 7, np.uint32))
    assert b["stream"] == b"" and np.array_equal(coder.decode(b), np.full(5000, 7))


def test_file_matches_library(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 50)
    path = P.path("byte_bpe_50k.json")
    texts = ["Hello world", None, "", " \n\n x  y", "a<|endoftext|>b <|endoftext|> c", "it's 12345 é漢字  😀", "word " * 500, "Hello world"]
    rows = [(i * 3 % 8, t, "z") for i, t in enumerate(texts)] + [(None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = T.token_digests(df, new_path(spark, "t"), path, 0).orderBy("start").collect()
    tk, start = Tokenizer.from_file(path), 0
    for r, (doc, text, _) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert T.token_digests(df.limit(0), new_path(spark, "t"), path, 0).count() == 0


def test_damaged_block_is_refused(spark):
    path = new_path(spark, "t")
    T.write_token_file(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"), 0)
    from pyspark.sql import functions as F

    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc32", F.lit(1).cast("long"))
    bad = new_path(spark, "t")
    blocks.write.partitionBy("part").parquet(f"{bad}/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
    with pytest.raises(Exception, match="checksum"):
        T.read_token_file(spark, bad).collect()


def test_an_id_with_most_rows_is_spread(spark):
    rows = [(i if i % 3 else 7, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = new_path(spark, "t")
    T.write_token_file(df, path, P.path("byte_bpe_50k.json"), 0)
    got = T.read_token_file(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    from pyspark.sql import functions as F

    held = spark.read.parquet(f"{path}/blocks").select("part", F.explode("doc_ids").alias("d")).where("d = 7")
    assert held.select("part").distinct().count() > 2
