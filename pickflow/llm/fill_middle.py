"""Fill-in-the-middle: a text is cut at two units into prefix, middle and suffix, and put together in another order.

The cut is one match of one pattern, made for the row: ``unit{a}`` and ``unit{b - a}``, both possessive, then the rest, so
the engine counts units without keeping places to return to, and a text of millions of units needs no deeper stack. The
replacement of that match is the new text. All of it are Spark functions, row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space at the end. Fixed by the contract.
UNIT = r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: Marks of prefix, suffix and middle. Fixed by the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _numbers(seed: int, key: Column) -> list[Column]:
    """The four random numbers of a document, from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n units, form, prefix_chars, middle_chars (code points), output.

    ``rate`` of 100 texts are rearranged, of these ``spm`` of 100 with the suffix first. Form is plain, psm or spm; a plain
    text is its own output and has null lengths. Empty texts, and texts that hold a mark, stay plain. A null text counts as
    empty and a null id as the empty string. What is drawn depends on seed and doc_id only, so rows with one id are cut at the
    same draw of their own units. Other columns are ignored.
    """
    h1, h2, h3, h4 = _numbers(seed, F.col("doc_id"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    units = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    drawn = units.withColumns(
        {
            "form": F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm"),
            "one": h1 % (F.col("n") + 1),
            "two": h2 % (F.col("n") + 1),
        }
    )
    first, between = F.least("one", "two"), F.abs(F.col("one") - F.col("two"))
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), first, F.lit(rf"}}+)({UNIT}{{"), between, F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    put = drawn.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    prefix, middle, _ = pieces(F.col("output"), F.col("form"))
    return put.select("doc_id", "n", "form", F.length(prefix).cast("bigint").alias("prefix_chars"), F.length(middle).cast("bigint").alias("middle_chars"), "output")


def pieces(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output, null if it is plain. A mark stands where it was put and nowhere else."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    psm, spm = form == "psm", form == "spm"
    prefix = F.when(psm, between(PREFIX, SUFFIX)).when(spm, between(PREFIX, MIDDLE))
    suffix = F.when(psm, between(SUFFIX, MIDDLE)).when(spm, between(SUFFIX, PREFIX))
    return prefix, F.when(psm | spm, F.split_part(output, F.lit(MIDDLE), F.lit(2))), suffix


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    prefix, middle, suffix = pieces(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with the digests of the output and of the text rebuilt from it, in place of the output."""
    made = fill_in_middle(docs)
    return made.select(
        *made.columns[:-1],
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


DIGESTS_SQL = rf"""
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
           sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d
    FROM documents
), drawn AS (
    SELECT *, len(units) AS n, ('0x' || substr(d, 1, 8))::BIGINT % (len(units) + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (len(units) + 1) AS y,
           ('0x' || substr(d, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS h4
    FROM h
), cut AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 >= 50 THEN 'plain'
                WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[:least(x, y)], '') AS p,
           array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
           array_to_string(units[greatest(x, y) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
