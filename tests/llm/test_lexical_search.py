import math
import random
import re
from collections import Counter

import numpy as np

from pickflow.llm.lexical_search import Best, Shard, best_documents, impacts
from pickflow.llm.queries import op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id bigint, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, size=10):
    """Every document scored for every item by the rules of the contract."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in total), sum(total)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for (doc, bag), n in zip(bags, total, strict=True):
            score = 0
            for x, times in Counter(terms(text)).items():
                if bag[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += times * w * (1_000_000_000 * bag[x] // (1000 * bag[x] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored)[:size], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, name, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*(["doc_id", "text"] if name == "documents" else ["item_id", "text"])).collect()]


def test_whole_table(spark, sf):
    got = op11_lexical_search(spark, sf)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert found(got) == expected(table(spark, "documents", sf), table(spark, "benchmark", sf))


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, make_docs):
    rng = random.Random(3)
    words = ["alpha", "BETA", "gamma9", "d", "élan", "日本", "x", "y", "z"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "...", " ".join(rng.choices(words, k=rng.randint(1, 30))), "the same text"])) for _ in range(300)]
    rows += [(900, "alpha " * 60_000 + "tail"), (None, "alpha beta"), (7, "alpha beta"), (7, "alpha beta")]
    items = [(1, "alpha, Alpha; beta!"), (1, "gamma9 élan"), (2, "the same text"), (2, "the same text"), (3, None), (4, ""), (5, "?!"), (6, "never-seen"), (None, "x y z 日本"), (8, "d " * 50)]
    docs = make_docs(*rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "item_id").withColumnRenamed("n_chars", "n")
    asked = spark.createDataFrame(items, ITEM).selectExpr("*", "1L AS doc_id", "'a' AS terms")
    want = expected(rows, [i for i in items if i[1] is not None])
    assert found(best_documents(docs, asked)) == want
    assert found(best_documents(docs, asked, size=3)) == expected(rows, [i for i in items if i[1] is not None], 3)


def test_empty_tables(spark, make_docs):
    asked = spark.createDataFrame([(1, "a")], ITEM)
    assert best_documents(make_docs("a b").limit(0), asked).collect() == []
    assert best_documents(make_docs("a b"), asked.limit(0)).collect() == []
    assert best_documents(make_docs("", None), asked).collect() == []


def test_queries_in_several_passes(spark, make_docs, monkeypatch):
    monkeypatch.setattr("pickflow.llm.lexical_search.QUERY_BYTES", 40)
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} common") for i in range(80)]
    items = [(i, f"w{i % 7} w{(i + 2) % 5} common words here") for i in range(20)]
    assert found(best_documents(make_docs(*rows), spark.createDataFrame(items, ITEM))) == expected(rows, items)


def test_search_of_a_shard_looks_at_few_documents():
    """Exact for any shard, and a rare term keeps most documents unscored."""
    rng = np.random.default_rng(5)
    docs, size = 4000, 300
    counts = rng.integers(1, 30, docs)
    term = np.concatenate([np.sort(rng.choice(size, c, replace=False, p=(p := 1 / np.arange(1, size + 1)) / p.sum())) for c in counts])
    weight = np.linspace(100, 9000, size).astype(np.int64)
    value = impacts(weight[term], rng.integers(1, 4, len(term)), np.repeat(counts * 2, counts), docs, int(counts.sum() * 2))
    ids = rng.permutation(docs)
    shard = Shard(ids, np.ones(docs, bool), counts, term, value)
    owner = np.repeat(ids, counts)
    for terms, times in (([0, 3, 250], [1, 2, 1]), ([1], [1]), ([5, 6, 7, 8, 280, 299], [1] * 6), ([2, 2 + size], [1, 1])):
        best = Best()
        scored = shard.search(np.array(terms), np.array(times), best)
        total = np.zeros(docs, np.int64)
        for t, c in zip(terms, times, strict=True):
            np.add.at(total, owner[term == t], value[term == t] * c)
        order = np.lexsort((np.arange(docs), -total))[:10]
        assert [(-s, i) for s, _, i in best.rows] == [(total[i], i) for i in order if total[i]]
        if 299 in terms:
            assert scored < docs / 4


def test_range_maximum_is_that_of_every_range():
    rng = np.random.default_rng(1)
    term = np.sort(rng.integers(0, 5, 400))
    shard = Shard(np.arange(400), np.ones(400, bool), np.ones(400, np.int64), term, rng.integers(1, 50, 400))
    begin = np.searchsorted(shard.key, np.arange(6) * shard.width)
    for _ in range(300):
        t = rng.integers(0, 5)
        a, b = sorted(rng.integers(begin[t], begin[t + 1] + 1, 2))
        if a < b:
            assert shard.impact[shard.largest(np.array([a]), np.array([b]))[0]] == shard.impact[a:b].max()
