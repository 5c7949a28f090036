"""Fixity of web archives: Merkle trees over WARC records, compared between replicas.

An archive is a folder of gzipped WARC files, each written by Spark with the records of one group of pages; what is said
of bytes is said of the unzipped file. A manifest says where
each record begins and how long it is. Records are hashed, and the hashes with their byte ranges, in order and ``FAN`` at a
time, are hashed into a tree per file. Replicas are compared at the roots; only below a mismatch are the children compared,
down to the records. A tree is a few arrays in the row of its file, so nothing but one row per file is joined. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pickflow.llm.common import BROADCAST_ROWS, scratch, stored

#: Children of a node, and most records of a file.
FAN, RECORDS = 16, 1000
_EOL = "\r\n"


def record(page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2026-01-01T00:00:00Z") -> Column:
    """A page as a WARC resource record, as text, without the line feed that ends it. Nulls: empty."""
    body = F.coalesce(F.col(payload), F.lit(""))
    # the target is one line of the header; characters that would end it are escaped
    target = F.replace(F.replace(F.coalesce(F.col(url), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = (
        ("WARC-Type", F.lit("resource")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", target),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(body).cast("string")),
    )
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)) for name, value in header]
    return F.concat(F.lit(f"WARC/1.1{_EOL}"), *lines, F.lit(_EOL), body, F.lit(f"{_EOL}\r"))


def to_records(pages: DataFrame, most: int = RECORDS) -> DataFrame:
    """page_id, file, place, length, record: pages dealt to files by ranges of ids, at most ``most`` records each.

    Pages are ordered by id and a hash of the record; ranges with more pages than ids (repeated ids, null ids, which form a
    range of their own) go on in further files. Records of a file lie in one partition.
    """
    rows = pages.select("page_id", record().alias("record")).select(
        "*",
        F.coalesce(F.floor(F.col("page_id") / most), F.lit(-1)).cast("long").alias("_range"),
        F.md5(F.concat("record", F.lit("\n"))).alias("_tie"),
        (F.octet_length("record") + 1).cast("long").alias("length"),
    )
    number = F.row_number().over(Window.partitionBy("_range").orderBy("page_id", "_tie")) - 1
    return rows.withColumn("_n", number).select(
        "page_id",
        F.concat(F.lit("w"), F.col("_range").cast("string"), F.lit("-"), F.floor(F.col("_n") / most).cast("string")).alias("file"),
        (F.col("_n") % most).cast("int").alias("place"),
        "length",
        "record",
    )


def manifest(records: DataFrame) -> DataFrame:
    """page_id, file, place, offset, length of every record."""
    upto = F.sum("length").over(Window.partitionBy("file").orderBy("place"))
    return records.select("page_id", "file", "place", (upto - F.col("length")).alias("offset"), "length")


def write_archive(records: DataFrame, path: str) -> None:
    """Write gzipped WARC files under ``path``, a folder for each ``file``; every record ends with the blank line the format asks for.

    With a column ``archive`` several archives are written in one go, each under its own folder. The records of a file must
    lie in one partition, as those of ``to_records`` do.
    """
    folders = [c for c in ("archive", "file") if c in records.columns]
    rows = records.sortWithinPartitions(*folders, "place").select(*folders, "record")
    rows.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy(*folders).text(path)


def _depth(most: int) -> int:
    depth = 0
    while FAN**depth < most:
        depth += 1
    return depth


def _level(below: str, name: str) -> tuple[Column, Column]:
    """The nodes over ``below``, as column ``name``, and the bytes each covers."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(below) / FAN).cast("int") - 1, F.lit(0)))
    some = lambda column, i: F.slice(F.col(column), i * FAN + 1, FAN)
    line = lambda h, r: F.concat_ws(" ", r["b"].cast("string"), r["e"].cast("string"), h)
    return (
        F.transform(parts, lambda i: F.sha2(F.array_join(F.zip_with(some(below, i), some("_r", i), line), "\n"), 256)).alias(name),
        F.transform(parts, lambda i: F.struct(F.get(some("_r", i), F.lit(0))["b"].alias("b"), F.element_at(some("_r", i), -1)["e"].alias("e"))).alias("_r"),
    )


def trees(spark: SparkSession, path: str, ranges: DataFrame, most: int = RECORDS) -> DataFrame:
    """One row per file of ``ranges`` (file, ranges: array of offset and length): l0 (record hashes) up to the root level.

    A node is the hash of its children's hashes, each with the bytes it covers; beyond the end of a file bytes are empty.
    A file that the archive lacks has a tree over nothing.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("file").cast("string").alias("file"), F.col("value").cast("binary").alias("content"))
    missing = ranges.join(files.select("file"), "file", "left_anti").withColumn("content", F.lit(b""))
    cut = lambda c: F.transform("ranges", lambda r: F.sha2(F.substring(c, (r["offset"] + 1).cast("int"), r["length"].cast("int")), 256))
    rows = ranges.join(files, "file").unionByName(missing).select(
        "file",
        "ranges",
        # as an element of an array the content is one object; as a column it would be copied for every record
        F.get(F.transform(F.array("content"), cut), F.lit(0)).alias("l0"),
        F.transform("ranges", lambda r: F.struct(r["offset"].alias("b"), (r["offset"] + r["length"]).alias("e"))).alias("_r"),
    )
    for level in range(_depth(most)):
        rows = rows.select(*[c for c in rows.columns if c != "_r"], *_level(f"l{level}", f"l{level + 1}"))
    return rows.drop("_r")


def _children(last: Column):
    return lambda i: F.sequence(i * FAN, F.least(i * FAN + FAN - 1, last))


def damaged(one: str, other: str, most: int = RECORDS) -> Column:
    """Places of the records in which two trees (structs) differ, found from the root down."""
    depth = _depth(most)

    def differ(level: int):
        return lambda i: ~F.get(F.col(f"{one}.l{level}"), i).eqNullSafe(F.get(F.col(f"{other}.l{level}"), i))

    found = F.filter(F.array(F.lit(0)), differ(depth))
    for level in range(depth - 1, -1, -1):
        last = F.size(F.col(f"{one}.l{level}")) - 1
        children = _children(last)
        found = F.filter(F.flatten(F.transform(found, children)), differ(level))
    return found


def audit(listed: DataFrame, primary: str, replica: str, most: int = RECORDS) -> DataFrame:
    """Per row of the manifest ``listed``: page_id, file, offset, length, record_sha256 (of the primary), intact.

    ``intact`` is false where the replica's record differs. A file that the replica lacks, or that ends early, has no intact
    records there. An empty manifest gives an empty result.
    """
    spark = listed.sparkSession
    ranges = listed.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "offset", "length"))).alias("ranges"))
    ranges = F.broadcast(ranges) if listed.count() <= BROADCAST_ROWS else ranges
    one, other = (stored(trees(spark, path, ranges, most).drop("ranges"), "trees") for path in (primary, replica))
    pack = lambda df, name: df.select("file", F.struct(*[c for c in df.columns if c != "file"]).alias(name))
    both = pack(one, "p").join(pack(other, "r"), "file").withColumn("bad", damaged("p", "r", most))
    found = both.select("file", "bad", F.posexplode("p.l0").alias("place", "record_sha256")).select("file", "place", "record_sha256", (~F.array_contains("bad", F.col("place"))).alias("intact"))
    return listed.join(found, ["file", "place"]).select("page_id", "file", "offset", "length", "record_sha256", "intact")


#: Pages that the audit query damages in the replica.
DAMAGE = "page_id % 97 = 5"


def audit_of_pages(pages: DataFrame, damage: str = DAMAGE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive and as a replica with damaged records, and audit the replica.

    Damage keeps the length: every ``e`` of the record becomes an ``f``. Null url or html: empty. Other columns are ignored.
    """
    spark = pages.sparkSession
    records = to_records(pages)
    if pages.limit(1).count() == 0:
        return records.select("page_id", "file", F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.col("record").alias("record_sha256"), F.lit(True).alias("intact"))
    path = scratch(spark, "warc")
    broken = F.when(F.coalesce(F.expr(damage), F.lit(False)), F.translate("record", "e", "f")).otherwise(F.col("record"))
    both = F.array(F.struct(F.lit("primary").alias("archive"), "record"), F.struct(F.lit("replica").alias("archive"), broken.alias("record")))
    write_archive(records.select("file", "place", F.inline(both)), path)
    return audit(stored(manifest(records), "manifest"), f"{path}/archive=primary", f"{path}/archive=replica")


AUDIT_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(html, '') AS body, coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1) AS rng,
         replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target
  FROM pages),
t AS (
  SELECT page_id, rng, concat('WARC/1.1', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:page:', page_id, '>', e, 'WARC-Date: 2026-01-01T00:00:00Z', e,
         'WARC-Target-URI: ', target, e, 'Content-Type: text/html; charset=utf-8', e, 'Content-Length: ', strlen(body), e, e, body, e, e) AS rec
  FROM r, (SELECT chr(13) || chr(10) AS e)),
n AS (SELECT *, row_number() OVER (PARTITION BY rng ORDER BY page_id, md5(rec)) - 1 AS k FROM t),
f AS (SELECT *, concat('w', rng, '-', k // 1000) AS file FROM n)
SELECT page_id, file, CAST(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY k) - strlen(rec) AS BIGINT) AS "offset", CAST(strlen(rec) AS BIGINT) AS length,
       sha256(rec) AS record_sha256, NOT coalesce(page_id % 97 = 5, false) AS intact
FROM f
"""
