import hashlib
import re

from pickflow.llm.fill_middle import UNIT, digests, fill_in_middle, restored
from pickflow.llm.queries import op12_fill_middle


def expected(doc_id, text):
    """The rules of the contract by hand, with a list of units."""
    text = text or ""
    units = re.findall(UNIT, text)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def key(row):
    return tuple(str(x) for x in row)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op12_fill_middle(spark, sf).collect()), key=key)
    assert got == sorted((expected(*d) for d in docs), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_edges_marks_blanks_nulls_and_clashing_columns(spark, make_docs):
    odd = ["", None, " ", "\t\n \x0b\x0c\r", "a", " a ", "a  b\n\nc ", "é 日本 𝄞x  ", "x<P>y", "<M>", "a <S> b", "<P <S M> >", "$1 \\2 $", "a\\", "\xa0 b c", "< P>", "a<", ">S> b <"]
    rows = [(i, t) for i, t in enumerate(odd * 12)] + [(None, "no id here at all"), (None, None), (3, "same id"), (3, "same id")]
    docs = make_docs(*rows).withColumnRenamed("lang", "n").withColumnRenamed("source", "form").withColumnRenamed("n_chars", "output")
    got = sorted((tuple(r) for r in digests(docs).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert digests(docs.limit(0)).collect() == []


def test_a_very_long_text_is_cut_in_one_match(spark, make_docs):
    for doc_id in range(8):  # some of these are rearranged
        text = "wörd, " * 400_000 + " " * 200_000
        (row,) = digests(make_docs((doc_id, text))).collect()
        assert tuple(row) == expected(doc_id, text)


def test_rates_and_restored_text(spark, make_docs):
    docs = make_docs(*[f"one two three {i}" for i in range(300)])
    made = fill_in_middle(docs, rate=100, spm=0)
    assert {r.form for r in made.collect()} == {"psm"}
    back = made.select("doc_id", restored(made.output, made.form).alias("t"))
    assert sorted(tuple(r) for r in back.collect()) == [(i, f"one two three {i}") for i in range(300)]
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_no_python_and_no_shuffle(spark, make_docs):
    plan = digests(make_docs("a b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
