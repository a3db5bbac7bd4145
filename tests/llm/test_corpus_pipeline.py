"""The pipeline's stages against brute force on the smallest tables."""

import re

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from cadenza.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns_and_loss(stages):
    for frame in stages[1:-1]:
        assert frame.schema == stages[0].schema
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] and ids[3] == ids[4] == ids[5]


def test_quality_keeps_clean(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect()]
    good = [i in kept for i, q in known if q == 1]
    bad = [i in kept for i, q in known if q == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) <= 0.2 * max(1, len(bad))


def test_one_of_exact_copies_stays(stages):
    texts = [r.text for r in stages[2].collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {r.text for r in stages[1].collect()}


def test_no_benchmark_passage_left(spark, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    clean = lambda t: not any(tuple(w[i : i + k]) in windows for w in [words(t)] for k in {len(x) for x in windows} for i in range(len(w) - k + 1))
    want = {r.doc_id for r in stages[2].collect() if clean(r.text)}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_secrets_are_gone(stages):
    from cadenza.llm.secret_scan import findings

    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r.n_chars == len(r.text) and not findings(r.text)[0]
        assert (r.text == before[r.doc_id]) == (not findings(before[r.doc_id])[1])
