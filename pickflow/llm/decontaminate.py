"""Benchmark decontamination by canonical templates, also for questions whose numbers, names or units were replaced.

Every word of a text becomes a template word: numbers, units after numbers and names become typed placeholders, all others
are lower-cased. Windows of template words are hashed and joined with the benchmark's; where enough of an item's windows
occur in a document, the words behind the placeholders are compared, at every place by itself and along chains of places
shifted by words put in or left out: a value of the item must stand for one value of the document wherever it occurs in
them, and the other way round. Windows that are there word for word always count. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickflow.llm.common import WORD, small_side, stored

#: Words of a window (three doublings of single words), and those of them that must not be placeholders.
WINDOW, LITERAL = 8, 5
#: Share of an item's windows that a document must have.
COVER = 0.5
#: Items with at most so many windows are also looked for as a whole; with other names and numbers if so many words are plain.
FEW, PLAIN = 3, 3
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years",
    "meters", "metres", "kilometers", "miles", "feet", "inches", "pounds", "ounces", "grams", "kilograms", "liters", "litres", "dollars", "euros", "cents",
    "usd", "eur", "percent", "%", "degrees", "kmh", "mph", "volts", "watts",
)
_BLANK = r"\x20\x09-\x0D"


def template(text: Column, units: Sequence[str] = UNITS) -> Column:
    """``text`` with placeholders, as many words as before. A capital after the end of a sentence makes no name."""
    out = F.regexp_replace(text, rf"[0-9][^{_BLANK}]*", NUMBER)
    out = F.regexp_replace(out, rf"\p{{Lu}}(?<=[^.!?:;>|{_BLANK}][{_BLANK}]\p{{Lu}})[^{_BLANK}]*", NAME)
    names = "|".join(u.replace("%", "[%]") for u in sorted(units, key=len, reverse=True))
    return F.lower(F.regexp_replace(out, rf"(?<={NUMBER}[{_BLANK}])(?i:{names})(?=[.,;:!?]?(?:[{_BLANK}]|$))[^{_BLANK}]*", UNIT))


def all_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def _pairs(hashes: str, step: int) -> Column:
    """Hash of each element with the one ``step`` further; the last ``step`` are of no use."""
    return F.zip_with(F.col(hashes), F.expr(f"slice({hashes}, {step + 1}, greatest(size({hashes}), 1))"), lambda a, b: F.xxhash64(a, b))


def windows(rows: DataFrame, words: Column, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``_windows``: the hashes of all runs of ``WINDOW`` words, by their first word."""
    out = rows.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    for step in (1, 2, 4):
        out = out.select(*keep, F.size("_h").alias("_n"), _pairs("_h", step).alias("_h"))
    return out.select(*keep, F.expr(f"slice(_h, 1, greatest(_n - {WINDOW - 1}, 0))").alias("_windows"))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, _at, _window, _of (windows of the item): those with enough words that are no placeholders."""
    coded = items.select("item_id", all_words(template(F.col("text"))).alias("_t"))
    literal = lambda i: F.size(F.filter(F.slice(F.col("_t"), i + 1, WINDOW), lambda w: ~w.isin(NUMBER, NAME, UNIT))) >= LITERAL
    return (
        windows(coded, F.col("_t"), ["item_id", "_t"])
        .select("item_id", F.posexplode_outer(F.transform("_windows", lambda w, i: F.when(literal(i), w))).alias("_at", "_window"))
        .where("_window is not null")
        .selectExpr("item_id", "_at", "_window", "count(*) over (partition by item_id) as _of")
    )


def contaminated(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """One row per document id and benchmark item found in it: doc_id, item_id, coverage, at (word), reparameterised.

    ``docs``: doc_id, text; ``items``: item_id, text. Items with few windows or none are found as a whole (``whole_items``).
    Null or empty texts are never found. Repeated items are found each under its own id, and an
    id with several texts if any of them is found; documents with the same id are judged together. Null ids are left out. Other columns are ignored.
    """
    wordings = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("_key"), "text").distinct()
    # every text by itself, under the hash of it
    texts = wordings.select(F.col("_key").alias("item_id"), "text").distinct()
    index = stored(item_windows(texts), "items")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_row"), "text")
    own = windows(rows.select("doc_id", "_row", all_words(template(F.col("text"))).alias("_t")), F.col("_t"), ["doc_id", "_row"])
    # an inner explode would get a filter on its size, pushed below the doublings and so evaluated many times over
    hits = own.select("doc_id", "_row", F.posexplode_outer("_windows").alias("_pos", "_window")).join(small_side(index), "_window")
    # windows of one item at one place of one text; a shift by a word more or less opens another place
    places = hits.groupBy("doc_id", "item_id", "_of", "_row", (F.col("_pos") - F.col("_at")).alias("_shift")).agg(F.collect_set("_at").alias("_ats"))
    found = stored(
        places.groupBy("doc_id", "item_id", "_of")
        .agg(F.collect_list(F.struct("_row", "_shift", "_ats")).alias("_places"))
        .where(F.size(F.array_distinct(F.flatten("_places._ats"))) >= cover * F.col("_of")),
        "leaks",
    )
    item_words = texts.select("item_id", all_words(F.col("text")).alias("_iw"), all_words(template(F.col("text"))).alias("_it"))
    doc_words = rows.join(small_side(found.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id", "_row"]).select("doc_id", "_row", all_words(F.col("text")).alias("_dw"))
    at_places = found.select("doc_id", "item_id", "_of", F.explode("_places").alias("_p")).select("doc_id", "item_id", "_of", "_p.*").join(item_words, "item_id").join(doc_words, ["doc_id", "_row"])
    by_text = chains(compared(at_places), cover).unionByName(whole_items(rows, texts, index))
    best = F.max(F.struct((~F.col("reparameterised")).alias("same"), "coverage", (-F.col("at")).alias("s"))).alias("_o")
    named = by_text.withColumnRenamed("item_id", "_key").join(wordings.select("item_id", "_key"), "_key").groupBy("doc_id", "item_id").agg(best)
    return named.selectExpr("doc_id", "item_id", "_o.coverage as coverage", "-_o.s as at", "not _o.same as reparameterised")


def bare(text: Column) -> Column:
    """``text`` with the marks before and after each word left out; as many words as before."""
    out = F.regexp_replace(text, rf"(?<![^{_BLANK}])[^\p{{L}}\p{{N}}{_BLANK}]+(?=[\p{{L}}\p{{N}}])", "")
    return F.regexp_replace(out, rf"(?<=[\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}{_BLANK}]+(?![^{_BLANK}])", "")


def _both(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``_r`` (words without marks in lower case) and ``_t`` (their template, as many words)."""
    return rows.select(*keep, all_words(F.lower(bare(F.col("text")))).alias("_r"), all_words(template(bare(F.col("text")))).alias("_t"))


def whole_items(docs: DataFrame, texts: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage (1), at, reparameterised of the items with few windows or none that stand in a text as a whole.

    Found by the hash of their first words (up to ``WINDOW``), and by that of the template words after the first, which may
    be a name only for what stands before it in the document; then compared word for word at their own length. Texts
    with several words but no plain one after the first, and single words of fewer than eight characters, are left out.
    """
    plain = lambda w: ~w.isin(NUMBER, NAME, UNIT)
    many = index.groupBy("item_id").agg(F.max("_of").alias("_of")).where(F.col("_of") > FEW)
    few = _both(texts.join(many, "item_id", "left_anti"), "item_id").where("size(_r) > 0").withColumn("_n", F.size("_r"))
    later = F.size(F.filter(F.slice("_t", 2, 1 << 30), plain))
    few = few.where(F.when(F.col("_n") == 1, F.length(F.get("_r", F.lit(0))) >= 8).otherwise(later > 0))
    first = lambda words, begin, n: F.xxhash64(F.slice(words, begin, n), n)
    size = F.least("_n", F.lit(WINDOW))
    raw = few.select("*", F.lit(False).alias("_new"), size.alias("_k"), first(F.col("_r"), F.lit(1), size).alias("_hash"))
    rest = F.least(F.col("_n") - 1, F.lit(WINDOW))
    new = few.where((F.col("_n") > 1) & (later >= PLAIN)).select("*", F.lit(True).alias("_new"), rest.alias("_k"), first(F.col("_t"), F.lit(2), rest).alias("_hash"))
    keys = stored(raw.unionByName(new), "whole-items").withColumnsRenamed({"_r": "_ir", "_t": "_it"})
    # at most two kinds of eight lengths
    kinds = sorted((r["_new"], r["_k"]) for r in keys.select("_new", "_k").distinct().collect())
    if not kinds:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint, coverage double, at int, reparameterised boolean")
    both = _both(docs, "doc_id", "_row")
    runs = lambda words, k: F.transform(words, lambda _, i: F.when(i + k <= F.size(words), first(words, i + 1, F.lit(k))))
    hits = None
    for is_new, k in kinds:
        there = both.select("doc_id", "_row", F.posexplode_outer(runs(F.col("_t" if is_new else "_r"), k)).alias("_pos", "_hash"))
        there = there.join(small_side(keys.where((F.col("_new") == is_new) & (F.col("_k") == k)).select("_hash").distinct()), "_hash").select("doc_id", "_row", "_pos", "_hash", F.lit(is_new).alias("_new"), F.lit(k).alias("_k"))
        hits = there if hits is None else hits.unionByName(there)
    hits = stored(hits, "whole-hits")
    words = _both(docs.join(small_side(hits.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id", "_row"]), "doc_id", "_row")
    at = (F.col("_pos") - F.col("_new").cast("int")).alias("_at")
    placed = hits.join(small_side(keys), ["_new", "_k", "_hash"]).select("*", at).where("_at >= 0").join(words, ["doc_id", "_row"])
    own = lambda c: F.slice(c, F.col("_at") + 1, F.col("_n"))
    placed = placed.select("doc_id", "item_id", "_at", "_new", "_n", "_ir", "_it", own("_r").alias("_r"), own("_t").alias("_t"))
    opening = F.when(plain(F.get("_it", F.lit(0))), F.get("_r", F.lit(0)) == F.get("_ir", F.lit(0))).otherwise(F.get("_t", F.lit(0)) == F.get("_it", F.lit(0)))
    pairs = F.array_distinct(F.filter(F.arrays_zip(F.col("_ir").alias("i"), F.col("_r").alias("d"), F.col("_it").alias("t")), lambda p: ~plain(p["t"])))
    pairs = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))
    same = F.col("_r") == F.col("_ir")
    template_fits = opening & (F.slice("_t", 2, 1 << 30) == F.slice("_it", 2, 1 << 30)) & _fits(pairs)
    found = placed.where(same | (F.col("_new") & template_fits))
    return found.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.col("_at").cast("int").alias("at"), (~same).alias("reparameterised"))


def compared(places: DataFrame) -> DataFrame:
    """Per place: the pairs of words (item, document) at the placeholders in its windows, and which windows have equal or no pairs."""
    slots = lambda a: F.filter(F.sequence(a, a + (WINDOW - 1)), lambda i: F.get("_it", i).isin(NUMBER, NAME, UNIT))
    pair = lambda i: F.struct(F.get("_iw", i).alias("i"), F.get("_dw", i + F.col("_shift")).alias("d"))
    differs = lambda i: F.lower(F.get("_iw", i)) != F.lower(F.get("_dw", i + F.col("_shift")))
    return places.select(
        "doc_id",
        "item_id",
        "_of",
        "_row",
        "_shift",
        "_ats",
        (F.col("_shift") / F.size("_iw")).alias("_lengths"),
        F.array_distinct(F.transform(F.array_distinct(F.flatten(F.transform("_ats", slots))), pair)).alias("_pairs"),
        F.filter("_ats", lambda a: ~F.exists(slots(a), differs)).alias("_equal"),
        F.filter("_ats", lambda a: F.size(slots(a)) == 0).alias("_plain"),
    )


def _fits(pairs: Column) -> Column:
    """Whether each word of the item stands for one word of the document, and the other way round."""
    return (F.size(F.array_distinct(pairs["i"])) == F.size(pairs)) & (F.size(F.array_distinct(pairs["d"])) == F.size(pairs))


def chains(places: DataFrame, cover: float) -> DataFrame:
    """doc_id, item_id, coverage, at, reparameterised of the items whose windows fit in a chain of places, or are equal anywhere.

    From every place with fitting pairs a chain is begun, and places shifted by up to the item's length are added, largest
    first, as long as all pairs fit. Windows without placeholders fit into every chain.
    """
    near = Window.partitionBy("doc_id", "item_id", "_row").orderBy("_lengths").rangeBetween(0, 1)
    fitting = F.when(_fits(F.col("_pairs")), F.struct((-F.size("_ats")).alias("n"), F.col("_shift").alias("s"), F.col("_ats").alias("ats"), F.col("_pairs").alias("pairs")))

    def added(chain: Column, place: Column) -> Column:
        pairs = F.array_union(chain["pairs"], place["pairs"])
        return F.when(_fits(pairs), F.struct(F.array_union(chain["ats"], place["ats"]).alias("ats"), pairs.alias("pairs"))).otherwise(chain)

    begun = F.struct(F.col("_place.ats").alias("ats"), F.col("_place.pairs").alias("pairs"))
    chained = (
        places.withColumn("_place", fitting)
        .withColumn("_near", F.when(F.col("_place").isNotNull(), F.collect_list("_place").over(near)))
        .withColumn("_chain", F.when(F.col("_place").isNotNull(), F.aggregate(F.array_sort("_near"), begun, added)))
    )
    # the place that names a chain is its largest, the first of them if several are
    chain = F.struct(F.col("_chain.ats").alias("ats"), F.exists("_chain.pairs", lambda s: s["i"] != s["d"]).alias("new"), F.col("_shift").alias("at"), F.size("_ats").alias("n"))
    judged = chained.groupBy("doc_id", "item_id", "_of").agg(
        F.collect_set(F.when(F.col("_chain").isNotNull(), chain)).alias("_chains"),
        F.array_distinct(F.flatten(F.collect_list("_plain"))).alias("_plain"),
        F.array_distinct(F.flatten(F.collect_list("_equal"))).alias("_equal"),
        F.max(F.struct(F.size("_equal").alias("n"), (-F.col("_shift")).alias("s"))).alias("_most"),
    )
    # unchanged before changed, then the most covered, the largest place, the first
    ranked = lambda ats, new, n, at: F.struct((~new).alias("same"), (F.size(ats) / F.col("_of")).alias("coverage"), n.alias("n"), (-at).alias("s"))
    options = F.concat(
        F.array(ranked(F.col("_equal"), F.lit(False), F.col("_most.n"), -F.col("_most.s"))),
        F.transform("_chains", lambda c: ranked(F.array_union(c["ats"], F.col("_plain")), c["new"], c["n"], c["at"])),
    )
    return (
        judged.select("doc_id", "item_id", F.array_max(F.filter(options, lambda o: o["coverage"] >= cover)).alias("_o"))
        .where("_o is not null")
        .selectExpr("doc_id", "item_id", "_o.coverage as coverage", "cast(-_o.s as int) as at", "not _o.same as reparameterised")
    )


def judged(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, items (sorted ids found in it, or an empty list)."""
    found = contaminated(docs, items, cover).groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"))


def clean(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of ``docs``, all columns, in whose document no item was found. Rows without an id are kept."""
    bad = contaminated(docs, items, cover).select("doc_id").distinct()
    return docs.join(small_side(bad), "doc_id", "left_anti").select(*docs.columns)
