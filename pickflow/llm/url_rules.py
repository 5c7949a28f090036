"""URL filtering: stated host rules, and association rules mined from labelled URLs by FP-growth.

A URL becomes a set of tokens (host suffixes, path words, parameter names, scheme). FP-growth finds token sets that go with
a label; rules under the stated confidence and support, and rules that a shorter one already implies, are pruned. Rules are
matched by an inverted index from token to rule over the distinct token sets, so a host that holds a third of all pages is
matched once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.llm.common import ascii_lower, small_side, stored

#: Stated rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8


def url_parts(url: str = "url") -> dict[str, Column]:
    """Host, path and rest of a URL. Null or without ``://``: all empty."""
    at = F.locate("://", F.col(url))
    after = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    return {
        "scheme": ascii_lower(F.when(at > 0, F.expr(f"substring({url}, 1, locate('://', {url}) - 1)")).otherwise("")),
        "host": ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
        "rest": F.regexp_extract(after, r"(?s)^[^?#]*(.*)$", 1),
    }


def stated_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits (struct of length, rule, verdict), or null. Ties: the longer host, then the verdict block.

    A rule fits its host and every subdomain when the path starts with the rule's path. Rules are a list in the program.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(len(h)).alias("host_length"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else reduce(lambda a, _: a, fits)


def url_tokens(scheme: Column, host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens: scheme, host suffixes, path words without digits (with their place for the first), parameter names."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.filter(F.regexp_extract_all(path, F.lit(r"([^/._\-]+)"), 1), lambda w: ~w.rlike("[0-9]"))
    first = F.regexp_extract(path, r"^/([^/]+)/", 1)
    names = F.regexp_extract_all(rest, F.lit(r"[?&#]([^=&#?]+)"), 1)
    return F.array_distinct(
        F.concat(
            F.when(scheme != "", F.array(F.concat(F.lit("s:"), scheme))).otherwise(F.array().cast("array<string>")),
            F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")),
            F.when(first != "", F.array(F.concat(F.lit("1:"), first))).otherwise(F.array().cast("array<string>")),
            F.transform(words, lambda w: F.concat(F.lit("p:"), w)),
            F.transform(F.filter(names, lambda w: ~w.rlike("[0-9]")), lambda w: F.concat(F.lit("q:"), w)),
        )
    )


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules from rows of ``tokens`` and ``label``: tokens, label, confidence, support.

    A token is kept for mining if its share of the rows reaches ``min_support``, so there are at most (tokens of a URL) /
    ``min_support`` of them whatever the number of rows. A rule is dropped when a rule with fewer of its tokens and the
    same label has at least its confidence. No rows: no rules.
    """
    spark = labelled.sparkSession
    schema = "tokens array<string>, label string, confidence double, support double"
    items = labelled.where("label is not null").select(F.array_append("tokens", F.concat(F.lit("="), "label")).alias("items"))
    if items.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = stored(
        model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith("="))
        .where(~F.exists("antecedent", lambda t: t.startswith("=")))
        .select(F.sort_array("antecedent").alias("tokens"), F.expr("substring(consequent[0], 2)").alias("label"), "confidence", "support"),
        "url-rules",
    )
    shorter = found.select(F.col("tokens").alias("_t"), F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    # A rule is compared with the rules of one token less, found by leaving out each token in turn: equality, not all pairs.
    parts = found.where(F.size("tokens") > 1).select(
        "tokens", "label", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("_part")
    )
    implied = (
        parts.join(shorter, (F.col("_part") == F.col("_t")) & (F.col("label") == F.col("_l")) & (F.col("_c") >= F.col("confidence")))
        .select("tokens", "label")
        .distinct()
    )
    return found.join(implied, ["tokens", "label"], "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame, key: str = "_tokens") -> DataFrame:
    """For each token set the label of its best rule: by confidence, then support, then label. Sets without a rule are left out."""
    numbered = rules.withColumn("_rule", F.xxhash64("tokens", "label")).withColumn("_need", F.size("tokens"))
    index = numbered.select(F.explode("tokens").alias("_token"), "_rule", "_need", "label", "confidence", "support")
    hits = (
        token_sets.select(key, F.explode(key).alias("_token"))
        .join(small_side(index), "_token")
        .groupBy(key, "_rule", "_need", "label", "confidence", "support")
        .agg(F.count("*").alias("_have"))
        .where("_have = _need")
    )
    return hits.groupBy(key).agg(F.max(F.struct("confidence", "support", "label")).alias("_best"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    labels: DataFrame | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    default: str = "allow",
) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``): page_id, host, path, rule, verdict, mined_label, confidence.

    The longest stated rule decides; elsewhere the best mined rule; elsewhere ``default``. ``labels`` (``page_id``,
    ``label`` allow or block) are what is mined; without them the verdicts of the stated rules are, which extends them to
    hosts they do not name. Null or broken URL: empty host and path, no tokens, ``default``. Repeated rows stay repeated.
    Other columns of ``pages`` are ignored.
    """
    parts = url_parts()
    split = pages.select("page_id", *(c.alias(n) for n, c in parts.items())).withColumn("_stated", stated_rule(rules, F.col("host"), F.col("path")))
    split = stored(
        split.select(
            "page_id", "host", "path", "_stated", url_tokens(F.col("scheme"), F.col("host"), F.col("path"), F.col("rest")).alias("_tokens")
        ),
        "url-tokens",
    )
    if labels is None:
        labelled = split.select(F.col("_tokens").alias("tokens"), F.col("_stated.verdict").alias("label"))
    else:
        labelled = split.join(labels.select("page_id", "label"), "page_id").select(F.col("_tokens").alias("tokens"), "label")
    mined = mine_rules(labelled, min_support, min_confidence)
    open_sets = split.where("_stated is null").groupBy("_tokens").count().select("_tokens")
    best = small_side(stored(match_rules(open_sets, mined), "url-verdicts"))
    ruled = split.where("_stated is not null").select("page_id", "host", "path", "_stated", F.lit(None).cast("string").alias("mined_label"), F.lit(None).cast("double").alias("confidence"))
    rest = (
        split.where("_stated is null")
        .join(best, "_tokens", "left")
        .select("page_id", "host", "path", "_stated", F.col("_best.label").alias("mined_label"), F.col("_best.confidence").alias("confidence"))
    )
    return ruled.unionByName(rest).select(
        "page_id",
        "host",
        "path",
        F.col("_stated.rule").alias("rule"),
        F.coalesce("_stated.verdict", "mined_label", F.lit(default)).alias("verdict"),
        "mined_label",
        "confidence",
    )
