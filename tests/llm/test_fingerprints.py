import hashlib

from pickflow.llm.fingerprints import edited_text, fingerprint, fingerprints_with_edits, likeness
from pickflow.llm.queries import op4_fingerprints


def expected(rows):
    rows = sorted(rows)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        e = (text[: n - n // 2] + nxt[: n // 2]).encode()
        a, b, c = fingerprint(text.encode()), fingerprint(e), fingerprint(nxt.encode())
        out.append((doc_id, n, hashlib.sha256(e).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op4_fingerprints(spark, sf).collect())
    assert got == expected(docs)
    edited, following = [r[5] for r in got if r[1] > 300], [r[6] for r in got if r[1] > 300]
    assert sum(edited) / len(edited) > sum(following) / len(following) + 0.1


def test_edge_texts_and_other_columns(spark, make_docs):
    rows = list(enumerate(["", None, "a", "ab", "é日", "x" * 70_000, "same text here", "same text here", "z"], 5))
    docs = make_docs(*rows).withColumnRenamed("lang", "_tail").withColumnRenamed("source", "_range")
    got = sorted(tuple(r) for r in fingerprints_with_edits(docs).collect())
    assert got == expected(rows)
    assert got[6][3] == got[7][3] and got[6][6] == 1.0


def test_one_document_empty_table_repeated_and_null_ids(spark, make_docs):
    (row,) = fingerprints_with_edits(make_docs((3, "abcdef"))).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprints_with_edits(make_docs((3, "abcdef")).limit(0)).collect() == []
    got = fingerprints_with_edits(make_docs((1, "p"), (1, "p"), (2, "q"), (2, "r"), (None, "n"))).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "2", "None"]


def test_digest():
    text = ("one two three four five six seven eight nine ten " * 20).encode()
    assert likeness(fingerprint(text), fingerprint(text)) == 1.0
    assert likeness(fingerprint(text), fingerprint(text + b"eleven")) > 0.9
    assert 0.0 <= likeness(fingerprint(b""), fingerprint(bytes(range(256)) * 40)) <= 1.0
    assert edited_text("abcde", "X") == "abcX"
