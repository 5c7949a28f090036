import duckdb
import pytest

from pickflow.llm import warc_audit as W
from pickflow.llm.common import scratch
from pickflow.llm.queries import op6_warc_audit


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(W.AUDIT_SQL)
    df = op6_warc_audit(spark, sf)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://h/{i}\n" if i % 5 else None, None if i % 7 == 0 else f"<p>été {i}\n\r\n</p>" * (i % 4), "x", 1) for i in range(70)]
    rows += [(3, "http://h/3", "again", "x", 1), (None, "u", "null id", "x", 1), (50, None, "WARC/1.1\r\n" * 9000, "x", 1)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, file string, place int")


@pytest.mark.parametrize("most", [1, 5, 16, 17, 1000])
def test_located_and_only_there(spark, pages, most):
    records = W.to_records(pages, most)
    a, b = scratch(spark, "a"), scratch(spark, "b")
    W.write_archive(records, a)
    W.write_archive(records.selectExpr("page_id", "file", "place", "length", "case when page_id in (4, 33, 69) then translate(record, 'W', 'V') else record end as record"), b)
    listed = W.manifest(records)
    assert records.groupBy("file").count().agg({"count": "max"}).first()[0] <= most
    got = W.audit(listed, a, b, most).collect()
    assert sorted(r.page_id for r in got if not r.intact) == [4, 33, 69] and len(got) == 73
    raw = {f: b"".join(bytes(c) for (c,) in rows) for f, rows in _files(spark, a).items()}
    want = {(r.file, r.place): (r.record + "\n").encode() for r in records.collect()}
    where = {(r.file, r.place): (r.offset, r.length) for r in listed.collect()}
    for at, record in want.items():
        offset, length = where[at]
        assert raw[at[0]][offset : offset + length] == record and record.endswith(b"\r\n\r\n")
    assert all(r.intact for r in W.audit(listed, a, a, most).collect())


def _files(spark, path):
    out = {}
    import gzip

    for r in spark.read.format("binaryFile").load(path).collect():
        out.setdefault(r.file, []).append((gzip.decompress(r.content),))
    return out


def test_missing_file_and_empty_table(spark, pages):
    records = W.to_records(pages.where("page_id < 20"), 5)
    a, b = scratch(spark, "a"), scratch(spark, "b")
    W.write_archive(records, a)
    W.write_archive(records.where("file <> 'w2-0'"), b)
    bad = {r.page_id for r in W.audit(W.manifest(records), a, b, 5).collect() if not r.intact}
    assert bad == {10, 11, 12, 13, 14}
    assert W.audit_of_pages(pages.limit(0)).collect() == []
    assert sorted(str(r.page_id) for r in W.audit_of_pages(pages).collect() if not r.intact) == ["5"]


def test_root_covers_places(spark, pages):
    """The same records in another order, or at other places, have another root."""
    records = W.to_records(pages.where("page_id between 20 and 24"), 5)
    a = scratch(spark, "a")
    W.write_archive(records, a)
    one = W.manifest(records).selectExpr("file", "place", "offset", "length")
    roots = set()
    for change in ("offset", "offset + 1"):
        ranges = one.selectExpr("file", f"struct(place, {change} as offset, length) as r").groupBy("file").agg({"r": "collect_list"}).toDF("file", "ranges")
        roots |= {r.l1[0] for r in W.trees(spark, a, ranges, 5).collect()}
    assert len(roots) == 2
