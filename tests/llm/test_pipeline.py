"""The pipeline's stages one by one against plain Python on their own input."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import corpus_pipeline as pipeline

from tickweave.llm.common import table, written
from tickweave.llm.mixing import mix
from tickweave.llm.pieces import Vocabulary, decode
from tickweave.llm.q_rows import model_path
from tickweave.llm.toxicity import toxicity

from .test_exact_dedup import normal
from .test_jaccard import brute


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "SentencePiece encoding"]
    clean = written(stage["toxicity"](spark, docs, sf), "test")
    assert clean.columns == docs.columns
    scored = toxicity(docs, table(spark, sf, "labels"))
    assert ids(clean) == ids(scored.where("score < 0.7")) and clean.count() > 0.85 * docs.count()

    once = written(stage["exact dedup"](spark, clean, sf), "test")
    best = {}
    for r in clean.collect():
        rank = (-len(r["text"]), r["doc_id"])
        best[normal(r["text"])] = min(best.get(normal(r["text"]), rank), rank)
    assert ids(once) == sorted(i for _, i in best.values())

    far = written(stage["n-gram Jaccard join"](spark, once, sf), "test")
    assert ids(far) == sorted({c for _, _, c in brute([(r["doc_id"], r["text"]) for r in once.collect()])})

    mix = written(stage["mixing"](spark, far, sf), "test")
    counts = Counter(ids(mix))
    assert set(counts) <= set(ids(far)) and max(counts.values()) <= 2 and mix.columns == docs.columns
    words = {r["doc_id"]: len(r["text"].split()) for r in far.collect()}
    assert abs(sum(words[i] * n for i, n in counts.items()) / sum(words.values()) - 1.5) < 0.1

    end = written(stage["SentencePiece encoding"](spark, mix, sf), "test")
    texts = {r["doc_id"]: r["text"] for r in far.collect()}
    back = decode(end, Vocabulary.load(model_path())).collect()
    assert Counter(r["doc_id"] for r in back if r["sample"] == 0) == counts and all(r["text"] == texts[r["doc_id"]] for r in back)


def test_rows_with_null_and_repeated_ids(spark, prose, sf):
    """Near copies without an id are one row; an id on two texts loses only the near copy; rows are mixed one by one."""
    a, b, c, e = (prose(i, 80) for i in range(4))
    rows = [(None, a, "en", "s"), (None, a + " tail", "en", "s"), (7, b, "en", "s"), (7, b, "en", "s"), (8, c, "en", "s"), (9, c + " tail", "en", "s"),
            (9, e, "en", "s"), (None, "", "en", "s"), (None, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    far = Counter((r["doc_id"], r["text"]) for r in pipeline.without_near_copies(spark, docs, sf).collect())
    lone = sum(far.pop((None, t), 0) for t in (a, a + " tail"))
    assert lone == 1 and far == {(7, b): 1, (8, c): 1, (9, e): 1, (None, ""): 2}

    kinds = [(None, a, "en", "s"), (7, b, "en", "s"), (7, b, "en", "s"), (7, b, "en", "s"), (9, c, "en", "s"), (9, e, "en", "t"), (10, c, "en", None)]
    docs = spark.createDataFrame(kinds, "doc_id long, text string, lang string, source string").repartition(2)
    hashes = {r["h"]: r["text"] for r in docs.selectExpr("xxhash64(text) h", "text").collect()}
    want = Counter()
    for r in mix(docs).collect():
        want[r["doc_id"], hashes[r["text_hash"]]] += r["takes"]
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.mixed(spark, docs, sf).collect())
    assert got == +want and got[None, a] > 0


def test_messy(spark, messy, empty, sf):
    """All columns of the rows, those whose names the stages use themselves too, come through with their values."""
    values = {c: {r[c] for r in messy.select(c).distinct().collect()} for c in messy.columns[4:]}
    for docs in (messy, empty.drop("n_chars")):
        n, columns = docs.count(), docs.columns
        for name, f in pipeline.STAGES:
            docs = written(f(spark, docs, sf), "test")
            assert docs.count() <= n * (2 if name == "mixing" else 4), name
            if name != "SentencePiece encoding":
                assert docs.columns == columns
                assert all({r[c] for r in docs.select(c).distinct().collect()} <= v for c, v in values.items() if c in columns)


def test_intermediate_tables_go_with_the_next_stage(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    stages = dict(pipeline.STAGES)
    once = stages["exact dedup"](spark, docs, sf)
    left = list(pipeline._LEFT[spark.sparkContext.applicationId])
    assert left and all(Path(p.removeprefix("file://")).exists() for p in left)
    n = written(once, "test").count()
    far = stages["n-gram Jaccard join"](spark, spark.read.parquet(written(once, "test").inputFiles()[0].rsplit("/", 1)[0]), sf)
    assert not any(Path(p.removeprefix("file://")).exists() for p in left) and 0 < far.count() <= n
