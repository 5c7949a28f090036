import random
import re
from collections import Counter

import numpy as np
import pytest

from pickflow.llm import parity_join
from pickflow.llm.graph import components
from pickflow.llm.queries import op7_parity_join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def result(docs):
    return sorted(tuple(r) for r in parity_join.linked_documents(docs).collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op7_parity_join(spark, sf).collect()) == expected(docs)


def variants(rng, n_words, count, edits):
    base = [f"w{rng.randrange(40)}" if rng.random() < 0.2 else f"v{rng.randrange(10**6)}" for _ in range(n_words)]
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(3) or ["z"]
        yield " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_random_near_copies(spark, make_docs, seed):
    rng = random.Random(seed)
    texts = [t for size in (1, 2, 3, 5, 6, 7, 9, 12, 20, 33, 60, 120, 300, 1300, 1700, 2500) for t in variants(rng, size, 12, max(1, size // 18))]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((5, 10, 40)))) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[30].upper(), "", None, " \n", "x " * 20_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert result(make_docs(*rows)) == expected(rows)


def test_chain_through_a_key_and_blocks(spark, make_docs, monkeypatch):
    """Each text is linked with its neighbours only, all with much in common; many share keys without being linked."""
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)] + [(100 + i, " ".join(words[12 * i : 12 * i + 60])) for i in range(25)]
    assert result(make_docs(*rows)) == expected(rows)


def test_parts_are_pigeonholes():
    """Any two sets within the largest difference share a key, also where few parts are in use."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6, 7, 30, 200, 1152, 1153, 1500, 1600, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            keep = rng.permutation(a)[: len(a) - rng.integers(0, len(a) // 7 + 1)]
            more = rng.integers(0, 1 << 63, max(0, int((8 * len(keep) - 6 * len(a)) / 6)), dtype=np.uint64)
            b = np.unique(np.concatenate([keep, more]))
            i = len(np.intersect1d(a, b))
            if 100 * i >= 75 * (len(a) + len(b) - i):
                assert len(np.intersect1d(parity_join.part_keys(a), parity_join.part_keys(b)))
                x, y = (np.frombuffer(parity_join.sketch(s), np.uint8) for s in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * i
                if min(len(a), len(b)) > parity_join.FIRST:
                    assert parity_join.apart(parity_join.wide_sketch(a), parity_join.wide_sketch(b)) <= len(a) + len(b) - 2 * i


def test_wide_sketches_fold():
    a, b = (np.unique(np.random.default_rng(s).integers(0, 1 << 63, n, dtype=np.uint64)) for s, n in ((1, 1500), (2, 7000)))
    assert parity_join.wide_sketch(a) is None and len(parity_join.wide_sketch(b)) == 16 * parity_join.BITS // 8
    assert parity_join.apart(parity_join.sketch(a), parity_join.sketch(b)) == parity_join.apart(parity_join.sketch(a), parity_join.wide_sketch(b))


def test_few_parts_go_on_to_another_dealing(monkeypatch):
    monkeypatch.setattr(parity_join, "PARTS", 3)
    a = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 20, dtype=np.uint64) << np.uint64(2))
    assert len(parity_join.part_keys(a)) > parity_join.largest_difference(20, 26)


def test_repeated_and_null_ids_and_empty_table(spark, make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = make_docs((5, a), (5, b), (3, a), (4, b), (9, "alone here"), (None, a), (None, None)).withColumnRenamed("lang", "n").withColumnRenamed("source", "rep")
    got = Counter((r.doc_id, r.component_id) for r in parity_join.linked_documents(docs).collect())
    assert got == Counter({(5, 3): 2, (3, 3): 1, (4, 3): 1, (9, 9): 1, (None, None): 2})
    kept = parity_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None", "None"]
    assert result(docs.limit(0)) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)] + [(300, 300 + i) for i in range(1, 50)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[95] == got[100] == got[90] == 90 and got[201] == 200 and got[349] == 300
    assert len(got) == 41 + 3 + 2 + 50


def test_rounds_leave_few_files(spark, monkeypatch, tmp_path):
    """However many partitions a shuffle has, a table of some rows is one file; all are found in files of few rows, too."""
    monkeypatch.setattr("pickflow.llm.common.use_checkpoint_dir", lambda _: str(tmp_path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(500, 500 + i) for i in range(1, 60)], "u bigint, v bigint")
    try:
        for k, v in zip(kept, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        for most, files in ((50_000, 1), (30, 12)):
            monkeypatch.setattr("pickflow.llm.common.FILE_ROWS", most)
            got = dict(tuple(r) for r in components(edges, 179).collect())
            assert got == {**dict.fromkeys(range(121), 0), **dict.fromkeys(range(500, 560), 500)}
            tables = [len(list(p.glob("*.parquet"))) for p in tmp_path.iterdir()]
            assert 1 <= max(tables) <= files
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_join_ends_batches_of_texts_at_some_bytes(spark, make_docs):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    parity_join.ParityJoin(make_docs("a b c d e f"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20
