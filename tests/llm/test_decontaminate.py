from __future__ import annotations

from emberlog.llm import decontaminate
from emberlog.llm.decontaminate import drop_leaks, leaks

ITEM = "Ann has 3 apples and buys 4 more apples from the market every day for 2 days, how many apples does Ann have?"
PLAIN = "the quick brown fox jumps over the lazy dog while seven wise owls look on from the old oak tree"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, Text string, row int")


def found(docs, items, **given):
    return sorted(((r.doc_id, r.item_id, r.slots_changed > 0) for r in leaks(docs, items, **given).collect()), key=repr)


def test_slots(spark, table_of):
    items = bench(spark, [(1, ITEM, "x", 1), (2, PLAIN, "x", 1), (3, None, "x", 1), (4, "too short", "x", 1), (5, "five words are one window", "x", 1)])
    docs = table_of(
        [
            (1, "Before it. " + ITEM + " And after it."),
            (2, "Some text. Tom has 7 apples and buys 12 more apples from the market every day for 5 weeks, how many apples does Tom have? More."),
            (3, "Tom has 7 apples and buys 12 more apples from the market every day for 5 weeks, how many apples does Bob have?"),
            (4, "Tom has 7 apples and buys 7 more apples from the market every day for 5 weeks, how many apples does Tom have?"),
            (5, "and so THE QUICK, BROWN FOX JUMPS OVER THE LAZY DOG WHILE SEVEN WISE OWLS LOOK ON FROM the OLD oak tree!"),
            (6, "the quick brown fox is not enough of it to be seen as the item that it was taken from"),
            (7, "they said: five words are one window, and went on"),
            (8, "five words are many windows"),
            (9, None),
            (10, "too short"),
            (11, "owls look on from the old oak tree where the quick brown fox jumps over the lazy dog while seven wise"),
        ]
    )
    assert found(docs, items) == sorted([(1, 1, False), (2, 1, True), (5, 2, False), (7, 5, False), (11, 2, False)], key=repr)
    assert sorted(r.doc_id for r in drop_leaks(docs, items).collect()) == [3, 4, 6, 8, 9, 10]


def test_all_windows_joined_when_the_benchmark_is_large(spark, table_of):
    items = bench(spark, [(1, ITEM, "x", 1), (2, PLAIN, "x", 1)])
    docs = table_of([(1, ITEM), (2, "nothing to see in here at all but words"), (3, "so " + PLAIN)])
    want = found(docs, items)
    assert found(docs, items, filtered_by=0) == want == [(1, 1, False), (3, 2, False)]


def test_short_items_and_few_literals_are_parameters(spark, table_of):
    items = bench(spark, [(1, "too short", "x", 1), (2, "Between 3 miles and 4 miles Ann ran 5 miles", "x", 1)])
    docs = table_of([(1, "it is too short to say"), (2, "between 7 km and 8 km Bob ran 9 km"), (3, "nothing of it")])
    assert found(docs, items) == [(2, 2, True)]
    assert found(docs, items, shortest=1, least=1) == [(1, 1, False), (2, 2, True)]


def test_odd_tables(spark, odd, empty):
    items = bench(spark, [(1, "One sentence of plain words that says what it says", "x", 1), (None, "word1 word2 word3 word4 word5 word6 word7 word8", "x", 1), (1, "", "x", 1)])
    none = bench(spark, [])
    assert sorted(map(str, found(odd, items))) == sorted(["(5, 1, False)", "(7, None, False)", "(8, None, False)", "(None, 1, False)"])
    assert sorted(str(r.doc_id) for r in drop_leaks(odd, items).collect()) == sorted(["1", "2", "3", "6", "None", "9", "10"])
    assert leaks(empty, items).collect() == [] == leaks(odd, none).collect() == drop_leaks(empty, items).collect()
    assert drop_leaks(odd, none).count() == odd.count()


def test_every_planted_item_is_found(spark):
    """Items of the data, planted whole and lower-cased."""
    path = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{path}/benchmark.parquet")
    docs = items.selectExpr("item_id AS doc_id", "concat('some words ahead, ', text, ' and some behind') AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    lower = docs.selectExpr("doc_id + 1000 AS doc_id", "lower(text) AS text", "lang", "source", "n_chars")
    got = {(r.doc_id % 1000, r.item_id) for r in leaks(docs.unionByName(lower), items).select("doc_id", "item_id").collect()}
    assert {i for i, j in got if i == j} == {r.item_id for r in items.collect()}
    assert leaks(docs.unionByName(lower), items).where("doc_id % 1000 = item_id").count() == 2 * items.count()


def test_items_dense_in_slots(spark, table_of):
    items = bench(spark, [(1, "A train travels 60 miles in 2 hours and 90 miles in 3 hours", "x", 1)])
    docs = table_of(
        [
            (1, "so it goes: A train travels 80 km in 4 days and 70 km in 6 days, and so on"),
            (2, "A train travels 80 km in 4 days and 70 kg in 6 days"),
            (3, "a list of 80 km in 4 days and of 70 km in 6 days"),
            (4, "it was 80 km in 4 days and 70 km"),
        ]
    )
    assert found(docs, items) == [(1, 1, True)]


def test_words_beside_the_item_in_its_first_and_last_slot(spark, table_of):
    items = bench(spark, [(1, "Natalia sold clips to 48 of her friends in April and then Natalia sold half as many clips in May", "x", 1), (2, "Ann saw the old grey mare go up the hill and then down to Ann", "x", 1)])
    copy = "Bob sold clips to 52 of her friends in April and then Bob sold half as many clips in May"
    docs = table_of(
        [
            (1, f"Question: {copy}. Answer: 3"),
            (2, f"Problem\n{copy}"),
            (3, f"Question: {copy.replace('Bob', 'Mary Jane')}"),
            (4, "Question: Tom sold clips to 52 of her friends in April and then Bob sold half as many clips in May"),
            (5, "Question: Tom saw the old grey mare go up the hill and then down to Tom. Answer: here"),
            (6, "Question: Tom saw the old grey mare go up the hill and then down to Bob. Answer: here"),
        ]
    )
    # the plain words of 5 and 6 are an alignment of their own
    assert found(docs, items) == [(1, 1, True), (2, 1, True), (3, 1, True), (5, 2, False), (6, 2, False)]


def test_consistent_edges():
    slots = {0: ("2ann", "2question tom"), 14: ("2ann", "2tom answer")}
    assert decontaminate._changed(slots, 15) == 1 and decontaminate._changed(slots | {7: ("2ann", "2tom")}, 15) == 1
    assert decontaminate._changed(slots | {14: ("2ann", "2bob answer")}, 15) is None and decontaminate._changed(slots | {7: ("2ann", "2bob")}, 15) is None
    assert decontaminate._changed({0: ("13", "12 3"), 5: ("14", "14")}, 9) == 0 and decontaminate._changed({0: ("13", "12 4"), 5: ("19", "14")}, 9) == 2
    assert decontaminate._changed({0: ("2ann", "2tom"), 5: ("2bob", "2tom")}, 9) is None


def test_copies_with_words_put_in_and_left_out(spark, table_of):
    words = [f"w{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(36)]
    items = bench(spark, [(1, " ".join(words), "x", 1)])
    put_in = words[:12] + ["more"] + words[12:24] + ["more"] + words[24:]
    left_out = words[:11] + words[12:23] + words[24:]
    apart = words[:12] + ["other"] * 40 + words[12:24] + ["other"] * 40 + words[24:]
    docs = table_of([(i, " ".join(x)) for i, x in enumerate((put_in, left_out, apart, words[:12] + ["more"] * 3))])
    assert sorted((r.doc_id, r.covered, r.item_tokens) for r in leaks(docs, items).collect()) == [(0, 36, 36), (1, 34, 36)]
