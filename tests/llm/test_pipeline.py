from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pickflow.llm import mixing, parity_join, quality  # noqa: E402
from pickflow.llm.common import scratch  # noqa: E402

from .test_parity_join import expected as linked  # noqa: E402
from .test_tokens import expected as encoded  # noqa: E402


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "test")
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        kept.append((docs, out))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.dtypes == docs.dtypes, name
        docs = out
    (raw, good), (_, single), (_, clean), (_, mixed), (_, index) = kept

    model = quality.train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r.doc_id for r in quality.score(raw, model).where("predicted = 1").collect()) == sorted(r.doc_id for r in good.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum(y == 1 and d not in ids for d, y in labels.items()) <= 0.01 * len(labels) and sum(y == 0 and d in ids for d, y in labels.items()) <= 0.01 * len(labels)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == [i for i, _, c in linked(rows) if i == c]

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id for r in clean.collect()}
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaked and not leaked & after
    part = {i for i, t in before.items() if i not in after and i not in leaked}
    assert len(part) <= 2 + len(leaked) // 4

    want = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    got = sorted((tuple(r) for r in index.collect()), key=lambda r: r[1])
    ordered = sorted((r.doc_id, r.text) for r in mixed.collect())
    from pickflow.llm.queries import tokenizer_path

    assert got == encoded(ordered, tokenizer_path())


def test_empty_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_one_of_each_keeps_all_that_stand_alone(spark, make_docs):
    docs = make_docs("a b c d e f", "completely other words stand here now", None, "")
    assert parity_join.one_of_each(docs).count() == 4
