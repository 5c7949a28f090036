import pytest

from pickflow.llm import decontaminate
from pickflow.llm.queries import op8_decontamination

ITEM = "a train leaves the station of Bergen at 12 km per hour while Alice waits for 30 minutes near the old harbour until Alice boards the train and rides for 45 km before she leaves again at noon"


def test_verbatim_items_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {r.doc_id: set(r["items"]) for r in op8_decontamination(spark, sf).collect()}
    assert len(got) == len(docs)
    flagged = 0
    for d in docs:
        there = {i.item_id for i in items if i.text in d.text}
        assert there <= got[d.doc_id]
        # nothing else but items of which a large part is there
        for i in items:
            if i.item_id in got[d.doc_id] - there:
                w = i.text.lower().split()
                runs = {" ".join(w[k : k + 8]) for k in range(len(w) - 7)}
                text = " ".join(d.text.lower().split())
                assert sum(r in text for r in runs) >= 0.5 * len(runs)
        flagged += bool(there)
    assert flagged > 5


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "Aa Bb Cc Dd Ee Ff Gg Hh Ii Jj Kk"), (6, ITEM + " x"), (6, ITEM + " x")], "item_id bigint, text string")


def found(spark, make_docs, items, *texts):
    docs = make_docs(*texts).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "_window")
    return {r.doc_id: (r.contaminated, list(r["items"])) for r in decontaminate.judged(docs, items).collect()}


def test_reparameterised_and_inconsistent(spark, make_docs, items):
    other = ITEM.replace("Bergen", "Turin").replace("Alice", "Maria").replace("12 km", "99 miles").replace("30 minutes", "7 hours").replace("45 km", "3 miles")
    broken = other.replace("until Maria", "until Peter")
    got = found(spark, make_docs, items, f"Before. {ITEM} after", f"Before that {other}", broken, ITEM[:60], None, "", "plain words only " * 3000, "Aa Bb Cc Dd Ee Ff Gg Hh Ii Jj Kk", f"x {ITEM} y {ITEM}")
    assert got[0] == got[1] == got[8] == (True, [1, 6])
    assert all(got[i] == (False, []) for i in (2, 3, 4, 5, 6, 7))
    rows = decontaminate.contaminated(make_docs(ITEM, other), items.where("item_id = 1")).collect()
    assert {(r.doc_id, r.item_id, r.at, r.reparameterised) for r in rows} == {(0, 1, 0, False), (1, 1, 0, True)}


def test_template_keeps_words(spark):
    texts = ["", "It costs 5 kg. Then Bob met Zoë, who Paid $12.50 for 3 % of it", "A. B c D", "x 5\nm y", "1,000 hours; End"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontaminate.template(__import__("pyspark").sql.functions.col("text")).alias("t"))
    got = {r.text: r.t for r in df.collect()}
    assert got[texts[1]] == "it costs <num> <unit> then <name> met <name> who <name> $<num> for <num> <unit> of it"
    assert got[texts[3]] == "x <num>\n<unit> y"
    assert all(len(a.split()) == len(b.split()) for a, b in got.items())


def test_clean_and_empty_tables(spark, make_docs, items):
    docs = make_docs((0, ITEM), (1, "clean"), (1, "clean"), (None, ITEM), (2, None))
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "None"]
    assert decontaminate.clean(docs.limit(0), items).collect() == [] and decontaminate.clean(docs, items.limit(0)).count() == 5
    assert "Python" not in kept._jdf.queryExecution().toString()


def test_every_place_counts(spark, make_docs, items):
    other = ITEM.replace("Bergen", "Turin").replace("Alice", "Maria").replace("12 km", "99 miles").replace("30 minutes", "7 hours").replace("45 km", "3 miles")
    broken = other.replace("until Maria", "until Peter")
    longer = other.replace("near the old", "near the very old")
    shorter = other.replace("waits for", "waits")
    two_words = ITEM.replace("Alice", "Mary Ann")
    got = found(spark, make_docs, items.where("item_id = 1"), f"{broken}. {ITEM}", f"{broken}. {other}", ITEM.replace("near the old", "near the very old"), longer, shorter, f"{longer}. {broken}", longer.replace("until Maria", "until Peter"), f"{broken}. {broken}", two_words, f"{broken} and {broken.replace('Turin', 'Paris')}")
    assert {i for i, (is_leak, _) in got.items() if is_leak} == {0, 1, 2, 3, 4, 5, 8}
    rows = decontaminate.contaminated(make_docs(f"{broken}. {ITEM}", longer), items.where("item_id = 1")).collect()
    assert {(r.doc_id, r.at, r.reparameterised) for r in rows} == {(0, len(broken.split()), False), (1, 0, True)}


def test_every_text_of_an_id_counts(spark, make_docs):
    second = "which of the two small boats crosses the wide river first when the wind blows from the cold north"
    items = spark.createDataFrame([(1, ITEM), (1, second), (2, second)], "item_id bigint, text string")
    got = found(spark, make_docs, items, ITEM, f"so {second}", f"{second} {ITEM}", "neither")
    assert got == {0: (True, [1]), 1: (True, [1, 2]), 2: (True, [1, 2]), 3: (False, [])}


def test_items_without_windows(spark, make_docs):
    few = ["Tom has 3 apples, Ann 5 pears, Bob 7 plums", "how deep is the sea?", "何が一番高い山ですか", "Which of all the rivers here is the longest", "Who Wrote The Long Book of Kells In Ireland Then"]
    items = spark.createDataFrame(list(enumerate(few)), "item_id bigint, text string")
    docs = ["well " + few[0] + " yes", "he asked \"" + few[1] + "\" twice", few[2], "and " + few[3] + '" too', f"x {few[4].upper()}", "Tom has 4 apples, Eve 6 pears, Jim 9 plums", "Tom has 4 apples, Eve 6 pears", "how deep is a sea", "", None]
    got = found(spark, make_docs, items, *docs)
    assert {i: v for i, (is_leak, v) in got.items() if is_leak} == {0: [0], 1: [1], 2: [2], 3: [3], 4: [4], 5: [0]}
