import zlib

import numpy as np
import pyarrow as pa
import pytest

from pickflow.llm import quality
from pickflow.llm.queries import op5_quality
from pickflow.llm.wordhash import as_bytes, shingle_sets, words


def test_held_out_accuracy_and_columns(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op5_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in op5_quality(spark, sf).collect())


def test_labels_of_held_out_rows_change_nothing(spark, make_docs):
    texts = [("good plain words here and there. " * 9 + str(i)) if i % 3 else ("BAD!! BAD!! BAD!! " * 20 + str(i)) for i in range(60)]
    docs = make_docs(*texts, None, "", " \n", "x" * 30_000, "y " * 30_000)
    rows = [(i, int(i % 3 != 0)) for i in range(60)]
    out = lambda rows: sorted(tuple(r) for r in quality.score(docs, quality.train(docs, spark.createDataFrame(rows, "doc_id bigint, quality int"))).collect())
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in rows]
    assert out(rows) == out(flipped) == out(rows * 2)
    assert len(out(rows)) == 65


def test_keep_good_keeps_columns(spark, make_docs):
    docs = make_docs(*["fine words. " * 30] * 5, "BAD!! " * 40, None).withColumnRenamed("lang", "score")
    model = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 7
    assert quality.keep_good(docs.limit(0), model).collect() == []
    assert {r.score for r in quality.score(docs, quality.Model(constant=0.0)).collect()} == {0.0}


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_words_and_shingles(block, monkeypatch):
    from pickflow.llm import wordhash

    monkeypatch.setattr(wordhash, "BLOCK", block)
    texts = ["", None, " ", "one", " One two\tthree ", "ab" * 40 + " c", "a b c d e f a b c d e f", "ünï cödé\x0bx\x0cy", "x", "a b c d e", "A B C D E", "a b c d", "ab c", "a bc"]
    data, begins = as_bytes(pa.array(texts))
    hashes, start, end, at = words(data, begins)
    want = [[w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    got = [[bytes(data[a:b]) for a, b in zip(start[i:j], end[i:j])] for i, j in zip(at, at[1:])]
    assert got == want
    by_word = {}
    for h, w in zip(hashes.tolist(), [w for ws in want for w in ws]):
        assert by_word.setdefault(h, w.decode().lower() if w.isascii() else w.decode()) == (w.decode().lower() if w.isascii() else w.decode())
    assert len(by_word) == len({w.decode().lower() if w.isascii() else w for ws in want for w in ws})
    sets = list(shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 1, 6, 1, 1, 1, 1, 1, 1, 1]
    assert sets[9].tolist() == sets[10].tolist() != sets[11].tolist() and sets[12].tolist() != sets[13].tolist()


def test_texts_reach_workers_few_at_a_time(spark, make_docs):
    """Batches that go to a worker and come back end at some bytes, also if their rows are few."""
    from pickflow.llm.common import TEXT_BATCH, text_batches

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = make_docs(*["word " * 200_000] * 12).coalesce(1)
    try:
        kept = quality.keep_good(docs, quality.Model(constant=1.0))
        assert kept.count() == 12
        assert max(r["n"] for r in docs.select("doc_id", "text").mapInArrow(sizes, "n bigint").collect()) <= TEXT_BATCH + 1_100_000
    finally:
        text_batches(spark, None)
