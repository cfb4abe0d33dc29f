import random

from kinfold.llm import decontaminate
from kinfold.llm.queries import QUERIES


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b).collect()}


ITEM = "Anna bought 12 apples at 3 $ each and gave 12 apples to her friend Boris before walking 5 km back home that evening."


def test_reparameterised_and_inconsistent_questions(spark):
    free = "so then people often talk about many other things in the long evening hours without any plan"
    docs = [
        (1, f"{free} {ITEM} {free}"),
        (2, f"{free} Clara bought 40 apples at 7 € each and gave 40 apples to her friend Dario before walking 9 km back home that evening. {free}"),
        (3, f"{free} Clara bought 40 apples at 7 € each and gave 99 apples to her friend Dario before walking 9 km back home that evening. {free}"),
        (4, f"{free} {free}"),
        (5, None), (6, ""), (7, "12 13 14 15 16 17 18 19"), (8, ITEM.upper()), (9, "word " * 60_000 + ITEM), (9, ITEM),
    ]
    got = found(spark, docs, [(1, ITEM), (2, None), (3, ""), (4, "1 2 3 4 5 6 7 8 9"), (5, "What is the capital of France?")])
    assert {k[0] for k in got} == {1, 2, 9} and all(k[1] == 1 for k in got)
    assert got[1, 1]["exact"] and got[1, 1]["coverage"] > 0.9 and not got[2, 1]["exact"]


def test_items_of_few_plain_words_and_items_with_a_word_put_in_or_left_out(spark):
    sums = "Add 12 and 13 and 14 kg then 15 16 17 and 18 km minus 19 20 21 %"
    names = "Members: Anna Berg Boris Cole Clara Dahl Dario Eng Emil Falk Fred Gray"
    upper = "FIND THE SUM OF ALL PRIME NUMBERS BELOW TWENTY AND EXPLAIN EACH STEP"
    long = "the old miller carried every sack of flour across the narrow bridge before sunrise and then he slept under the tall oak until the evening bell rang twice"
    words = long.split()
    free = "so then people often talk about many other things in the long evening hours without any plan"
    docs = [(1, f"{free} {sums} {free}"), (2, f"{free} {names} {free}"), (3, f"{free}. {upper} {free}"), (4, " ".join([*words[:14], "quietly", *words[14:]])), (5, " ".join(words[:14] + words[15:])), (6, sums.replace("1", "3")), (7, " ".join(words[14:] + free.split() + words[:10]))]
    got = found(spark, docs, [(1, sums), (2, names), (3, upper), (4, long)])
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}
    assert all(r["exact"] for r in got.values())


def test_short_item_and_empty_tables(spark):
    got = found(spark, [(1, "they ask what is the capital of Spain? and so on"), (2, "the capital of it all")], [(5, "What is the capital of France?")])
    assert set(got) == {(1, 5)}
    assert not found(spark, [], [(1, ITEM)]) and not found(spark, [(1, ITEM)], [])


def test_against_brute_force_on_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    whole = {(d[0], i["item_id"]) for d in docs for i in items if " ".join(i["text"].split()) in " ".join(d[1].split())}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_template_decontamination"](spark, sf_dir).collect()}
    assert whole and whole <= got
    rng = random.Random(1)
    words = {d[0]: d[1].lower().split() for d in docs}
    for doc, item in got - whole:  # what else is found shares most of the item's words in order
        text = next(i["text"] for i in items if i["item_id"] == item).lower().split()
        k = rng.randrange(len(text))
        grams = {tuple(text[j : j + 4]) for j in range(len(text) - 3)}
        assert k >= 0 and len(grams & {tuple(words[doc][j : j + 4]) for j in range(len(words[doc]) - 3)}) >= 0.4 * len(grams)
