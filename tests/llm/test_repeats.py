import hashlib
import random

import numpy as np
import pytest

from pickflow.llm import repeats
from pickflow.llm.queries import op10_repeats


def expected(rows):
    """Every string of 100 bytes in a set, document by document."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for q in range(len(b) - 99):
            s = b[q : q + 100]
            if s in seen:
                gone[q : q + 100] = True
            seen.add(s)
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(docs):
    return sorted((tuple(r) for r in repeats.without_repeats(docs).collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted((tuple(r) for r in op10_repeats(spark, sf).collect()), key=str) == sorted(expected(docs), key=str)


@pytest.mark.parametrize("segment", [500, 2 << 20])
def test_random_repeats(spark, make_docs, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(("ab", "the", "ün", "x", f"r{rng.randrange(99999)}")) for _ in range(n))
    shared = [words(n) for n in (20, 21, 24, 30, 60, 200)]
    texts = []
    for i in range(80):
        t = words(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t += rng.choice(("", " ", "\n", "é")) + s[a : a + rng.randrange(len(s))] + words(rng.randrange(10))
        texts.append(t)
    texts += [texts[5], texts[7], "z" * 99, "z" * 100, "z" * 101, "q" * 1000, "ab" * 700, "abc" * 300, "", None, shared[5], shared[5] * 3]
    rows = list(enumerate(texts))
    docs = make_docs(*rng.sample(rows, len(rows))).withColumnRenamed("lang", "row").withColumnRenamed("source", "spans")
    assert result(docs) == sorted(expected(rows), key=str)


def test_repeated_and_null_ids_and_empty_table(spark, make_docs):
    t, u = "".join(f"{i} " for i in range(60)), "".join(f"{i}-" for i in range(60))
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in repeats.without_repeats(make_docs((2, t), (2, t), (3, u), (None, u), (4, "x"))).collect())
    assert got == [("2", False), ("2", True), ("3", True), ("4", False), ("None", False)]
    assert result(make_docs((1, t)).limit(0)) == []


def test_merged():
    row, begin, end = repeats.merged(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 3, 9, 5]), np.array([6, 4, 5, 10, 9]))
    assert (row.tolist(), begin.tolist(), end.tolist()) == ([1, 1, 2], [0, 9, 5], [5, 10, 9])


def test_a_text_of_many_megabytes(spark, make_docs):
    rng = random.Random(9)
    long = "".join(f"{rng.randrange(1 << 40)} " for _ in range(800_000))
    assert len(long) > 9 << 20
    rows = [(1, "before"), (2, long + long[5_000_000:5_000_400]), (3, long[100:900])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.without_repeats(make_docs(*rows)).collect()}
    assert got == {1: (6, 0, 0), 2: (len(long) + 400, 400, 1), 3: (800, 800, 1)}
