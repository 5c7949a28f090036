"""Mix sources to target weights: capped water-filling over sources, seeded whole and fractional repetitions of documents.

DataFrame functions only. What is shuffled is one row per (source, block) and the id, source and size of each document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickflow.llm.common import WORD, stored

#: Each source is dealt into so many blocks by a hash of the document id; repetitions are decided by block.
BLOCKS = 1024


def word_count(text: str = "text"):
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``, ``weight``).

    The budget, a multiple of all sizes, is shared by weight. A source that would get more than ``max_epochs`` times its
    size is clamped there, and the excess goes to the others by weight, until none is above. Sorted by cap over weight,
    the clamped sources come first, so running sums over the source rows give the fixed point. With a budget above all
    caps every source gets its cap. The window sees one row per source.
    """
    caps = sources.withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = caps.select(
        "*",
        F.row_number().over(order).alias("_n"),
        (
            (F.lit(float(budget)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("_level"),
    )
    open_ = F.col("_level") < F.col("_cap") / F.col("weight")
    first = F.min(F.when(open_, F.struct("_n", "_level"))).over(whole)
    target = F.least(F.col("_cap"), F.coalesce(first["_level"] * F.col("weight"), F.col("_cap")))
    return levels.withColumn("target", target).drop("_cap", "_n", "_level")


def source_weights(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Weights repeat over the sources in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, ``source``): doc_id, size, source, source_size, target, taken, copies.

    ``taken`` are the words the mix takes. Of each source all documents are repeated floor(target / size) times; the rest
    of the target goes to whole blocks in hash order, and in the one block where it runs out each document gives the same
    fraction, rounded by its seed. So a source misses its target by rounding only, and no document exceeds ``max_epochs``
    rounded up. ``copies`` says the same in whole documents: in the block where the target runs out a document is taken
    with the probability of the fraction.

    Null text: size 0, nothing taken. Null source: a source of its own. Repeated ids or rows: each row counts and is
    decided alike. Empty table: empty result. Other columns of ``docs`` are ignored.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            word_count().alias("size"),
            (number(1) % blocks).alias("_block"),
            (number(9) / F.lit(2.0**32)).alias("_u"),
        ),
        "mix-sizes",
    )
    by_block = stored(sized.groupBy("source", "_block").agg(F.sum("size").alias("_words")), "mix-blocks")
    sources = by_block.groupBy("source").agg(F.sum("_words").alias("source_size"))
    filled = water_fill(source_weights(sources, weights), budget, max_epochs).drop("weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = (
        by_block.alias("b")
        .join(filled.alias("f"), F.col("b.source").eqNullSafe(F.col("f.source")))
        .select("b.source", "_block", "_words", "source_size", "target", F.floor(rate).alias("_whole"))
        .withColumn(
            "_left",
            F.col("target")
            - F.col("_whole") * F.col("source_size")
            - (F.sum("_words").over(Window.partitionBy("source").orderBy("_block")) - F.col("_words")),
        )
        .withColumn("_share", F.when(F.col("_words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_left") / F.col("_words")))).otherwise(0.0))
    )
    return (
        sized.alias("d")
        .join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._block") == F.col("s._block")))
        .select(
            "doc_id",
            "size",
            F.col("d.source").alias("source"),
            "source_size",
            "target",
            (F.col("_whole") * F.col("size") + F.floor(F.col("size") * F.col("_share") + F.when(F.col("_share") < 1, F.col("_u")).otherwise(0.0))).cast("long").alias("taken"),
            (F.col("_whole") + (F.col("_u") < F.col("_share")).cast("long")).cast("int").alias("copies"),
        )
    )


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (``copies``); rows taken zero times are left out.

    Rows that share an id are decided alike, so the join is on distinct ids. All columns are kept.
    """
    decided = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    return (
        docs.alias("d")
        .join(decided.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
        .where(F.col("_copies") > 0)
        .select("d.*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .drop("_copy")
    )


#: DuckDB SQL for the rows of ``mix`` with its defaults, over the view ``{docs}``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM {docs}),
docs_ AS (
  SELECT doc_id, source, size, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 1024 AS block,
         CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized),
blocks AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM docs_ GROUP BY ALL),
sources AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM blocks GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER o AS n,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source)),
found AS (SELECT (SELECT arg_min(level, n) FROM levels WHERE level < cap / weight) AS level),
filled AS (SELECT source, source_size, least(cap, coalesce(f.level * weight, cap)) AS target FROM levels, found f),
shares AS (
  SELECT b.source, b.block, b.words, source_size, target,
         floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
         sum(words) OVER (PARTITION BY b.source ORDER BY block) - words AS before
  FROM blocks b JOIN filled f ON b.source IS NOT DISTINCT FROM f.source),
shared AS (
  SELECT *, CASE WHEN words > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (target - whole * source_size - before) / words)) ELSE 0 END AS share
  FROM shares)
"""
MIX_SQL = (
    SQL
    + """
SELECT doc_id, size, s.source_size, s.target,
       CAST(whole * size + floor(size * share + CASE WHEN share < 1 THEN u ELSE 0 END) AS BIGINT) AS taken
FROM docs_ d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source AND d.block = s.block
"""
)
