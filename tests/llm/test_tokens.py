import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from pickflow.llm import token_files
from pickflow.llm.queries import op1_token_files, tokenizer_path


def expected(rows, path):
    t, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op1_token_files(spark, sf).collect())
    assert got == expected([tuple(r) for r in docs], tokenizer_path())


TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\nx y\n z", "tab\tx y", "don't we'll I'M", "a\u00a0b c", "a \u00a0 b", "\x1c a \x1d b", "x\u3000 y",
    "1 22 333,4", "ciónñ 日本 語 àâÿ Ñandú žluťoučký ɐbc ǅ ªº", "end\n", "p\nq r.\ns t\n\nu v\n w x\n.y a\tb\nc d\n<|endoftext|> e <|endoftext|>\nf it\n's x.\n, y", "<|endoftext|> x <|endoftext|>", "a" * 5000 + " b" * 3000, "\u2028 a", "é e\u0301 x", "a\x00b c", "🙂 🙂x",
]


@pytest.mark.parametrize("end", [0, 7])
def test_edge_texts(spark, make_docs, end):
    rows = list(enumerate(TEXTS))
    got = sorted(tuple(r) for r in token_files.tokenized(make_docs(*rows), tokenizer_path(), end).collect())
    want = expected(rows, tokenizer_path())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert end or got == want


def test_repeated_ids_empty_table_and_other_columns(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs((2, "x y"), (2, "z"), (None, "n"), (1, "a b c")).withColumn("tokens", F.lit("clash")).withColumn("_file", F.lit(1))
    got = token_files.tokenized(docs, tokenizer_path()).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 1), (True, 2), (True, 2)]
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, 1, 2, 2]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))
    assert token_files.tokenized(docs.limit(0), tokenizer_path()).collect() == []


def test_layout(spark, sf, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, tokenizer_path())
    columns = {}
    for f in (tmp_path / "tokens").glob("part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_offset_index and col.has_column_index
                columns[col.path_in_schema] = col.encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"] and "DELTA_BINARY_PACKED" in columns["offset"]
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"])
    plan = token_files.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema:")[-1]


def test_words_with_runs_of_marks_are_learned_by_their_word():
    encoder = token_files.ChunkEncoder(tokenizer_path(), 0, remember=4)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["x " + " ".join(f"{w}{m}" for w in ("oued", "Añgo", "dog'", "a1", "x.y") for m in ("***", "$$$", ".%%%", "...", "#####", ",|>", ".'", "!?)")), "x oued** oued"]
    for _ in range(2):  # the second time after some were forgotten
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    encoder = token_files.ChunkEncoder(tokenizer_path(), 0)
    encoder.encode(["x oued***"])
    assert "oued" in encoder.known
