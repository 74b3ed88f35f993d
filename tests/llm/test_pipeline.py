"""The corpus pipeline against plain Python, stage by stage, and each stage on awkward tables."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hopweave.llm import quality_crf as Q

from .test_secret_scan import brute as secret_spans
from .test_simhash import brute as near_copies
from .test_suffix_dedup import cut_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    shared = say(90)
    rows = []
    for i in range(40):
        lines = [say(int(rng.integers(12, 40))) for _ in range(int(rng.integers(2, 6)))]
        if i % 5 == 0:
            lines.insert(1, shared)
        if i % 7 == 0:
            lines.append(f"my password = hunter{i}hunter and AKIA{'ABCD1234' * 2}Z")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(6)]  # exact copies
    rows += [(200, rows[8][1].replace("word", "Word", 1)), (300, "too short"), (301, "!!! ".join(words[:40])), (302, " ".join(f"{w}$$$" for w in words[:60]))]
    return rows


def masked(text):
    keep, at = "", -1
    for a, _, _, b in secret_spans(text):
        keep += text[max(at, 0) : a] + "[secret]" if a > at else ""
        at = max(at, b)
    return text if not secret_spans(text) else keep + text[at:]


def test_run_matches_plain_python(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(301, 0), (302, 0)], "doc_id long, quality int")
    labels.withColumn("toxic", labels["quality"] * 0).write.parquet(str(tmp_path / "labels.parquet"))
    weights = Q.fitted(df, labels)
    kept = [(k, t) for k, t in rows if Q.verdict(t, weights)[6]]
    assert {300, 302}.isdisjoint(k for k, _ in kept) and len(kept) >= 45
    component = {k: c for k, _, c in near_copies(kept)}
    kept = [(k, t) for k, t in kept if component[k] == k]
    assert len(kept) <= 41
    kept = [(k, masked(t)) for (k, _), (t, _) in zip(kept, cut_passages(kept, 200))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tk, pieces, used = Tokenizer.from_file(P.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        used[r.sequence_id] += r.length
    assert {k: sum((i for _, i in sorted(p)), []) for k, p in pieces.items()} == {k: [*tk.encode(t, add_special_tokens=False).ids, 1] for k, t in kept}
    assert max(used.values()) <= 2048


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_bear_awkward_tables(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    spark.createDataFrame([(None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = "some words that make a long line of text. " * 3000
    rows = [(None, None, None, None, None), (None, "x", None, None, 1), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 5), (3, long, "en", "s", 5), (4, "é " * 30, None, None, None)]
    extra = ["k1", "_key", "_row", "fp", "component_id", "_spans", "ids", "_k1"]
    df = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], SCHEMA + "".join(f", {c} int" for c in extra))
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = sorted(len(tk.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    # what is left of the texts: the rules reject all; of near-duplicates (those without words,
    # and equal rows) one stays, and rows without an id stay; the long text repeats itself; nothing is secret
    left = [[], [(2, None, ""), (1, "x"), (1, long), (1, "é " * 30)], [(3, None, ""), (1, "x"), (2, ""), (1, "é " * 30)], [(3, None, ""), (1, "x"), (2, long), (1, "é " * 30)]]
    for docs in (df, df.limit(0), df.select("doc_id", "text", "lang", "source", "n_chars")):
        out = stage(spark, docs, str(tmp_path))
        got, empty = out.collect(), docs.isEmpty()
        if k == len(corpus_pipeline.STAGES) - 1:
            assert sum(r.length for r in got) == (0 if empty else sum(tokens)) and max([r.length for r in got], default=0) <= 2048
            continue
        assert out.columns == docs.columns
        want = Counter() if empty else sum((Counter({t[-1]: n}) for n, *t in left[k]), Counter())
        assert Counter(r.text or "" for r in got) == want
        if "k1" in docs.columns:
            assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in got)
