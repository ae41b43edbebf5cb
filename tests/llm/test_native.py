"""Template windows and quotations against plain Python."""

import re

import pytest

from palimpsest.llm import decontaminate as dc
from palimpsest.llm import quotes

ITEMS = [(1, "A train leaves Paris at 7 km per hour and after 3 hours it meets Anna, who has 3 apples and gives Anna's brother 2."),
         (2, "the quick brown fox jumps over the lazy dog while seven wise owls watch it quietly from above"),
         (3, "short one"), (4, None), (5, ""), (6, "five words are enough here"),
         (2, "the quick brown fox jumps over the lazy dog while seven wise owls watch it quietly from above")]


def test_passages_and_other_case(spark, documents, monkeypatch):
    """The half of a long item, copies in other case, and what stays."""
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)]
    long = " ".join(words).capitalize() + " costs Anna 5 dollars at Straße 7."
    bench = spark.createDataFrame([(1, long), (2, ITEMS[0][1])], "item_id long, text string")
    texts = ["so: " + " ".join(words[20:33]) + " and on", "so: " + " ".join(words[20:32]) + " and on", ITEMS[0][1].lower(), ITEMS[0][1].upper(),
             " ".join(long.split()[:30]), ITEMS[0][1].upper().replace("7", "9"), "nothing of it", None, "", long.upper(),
             " ".join(words[20:26]) + " gap " + " ".join(words[26:33])]
    table = documents(texts, item_id=4)
    for limit in (200_000, 0):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
        got = {(r["doc_id"], r["item_id"]) for r in dc.passages(table, bench).collect()}
        assert got == {(0, 1), (2, 2), (3, 2), (4, 1), (5, 2), (9, 1)}
    left = dc.without_contaminated(table, bench)
    assert left.columns == table.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 6, 7, 8, 10]


def test_templates(spark):
    frame = spark.createDataFrame([("Mary has 3.5kg, B2B iPhone 5 % $7 and 12 miles!",), ("",)], "text string")
    got = frame.select(dc.template("text").alias("t"), dc.originals("text").alias("o")).collect()
    assert got[0]["t"] == ["P", "has", "N", "U", "P", "N", "P", "iP", "N", "U", "U", "N", "and", "N", "U"]
    assert got[0]["o"] == ["Mary", "has", "3.5", "kg", "B", "2", "B", "iPhone", "5", "%", "$", "7", "and", "12", "miles"]
    assert got[1]["t"] == [] and got[1]["o"] == []


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contaminated(spark, documents, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    own = ITEMS[0][1]
    other = own.replace("Paris", "Rome").replace("7", "12").replace("3", "9").replace("Anna", "Bea")
    mixed = own.replace("Anna,", "Carl,").replace("3 hours", "8 hours").replace("7", "3").replace("Paris", "Anna")
    half = " ".join(ITEMS[1][1].split()[:13])
    texts = ["noise before. " + own + " noise after", "In some text " + other, mixed, "x " + ITEMS[1][1].replace("seven", "nine"), half,
             "the quick brown fox jumps over the lazy cat", "nothing of the kind is here at all, not even once", None, "", "short one",
             "so five words are enough here then", own + "\n" + ITEMS[1][1], ("filler words go on " * 20_000) + ITEMS[1][1], own, own]
    ids = [*range(len(texts) - 2), None, 0]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumnRenamed("text", "question")
    got = dc.contaminated(documents(texts, ids, item_id=9, words="x", at=1), bench, item_text="question").collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    # document 2 has mixed-up slots; one changed word leaves document 3 with 3 of 11 windows
    assert set(found) == {(0, 1), (1, 1), (4, 2), (10, 6), (11, 1), (11, 2), (12, 2), (None, 1)}
    assert found[0, 1]["verbatim"] and not found[1, 1]["verbatim"] and found[1, 1]["agreement"] == 1.0
    assert found[0, 1]["share"] == found[1, 1]["share"] == 1.0 and found[4, 2]["share"] < 1
    table = documents(texts, ids, item_id=9, words="x")
    left = dc.without_contaminated(table, bench.withColumnRenamed("question", "text"))
    assert left.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3", "5", "6", "7", "8", "9"]
    assert dc.contaminated(documents([]), bench, item_text="question").count() == 0
    assert dc.contaminated(documents(texts, ids), bench.where("false"), item_text="question").count() == 0


def plain_level(line):
    m = re.match(r"[ \t]*((?:>[ \t]*)+)", line)
    return m[1].count(">") if m else 0


TALK = [
    (1, 0, "user", "What is the plan?\nWe meet at noon."),
    (1, 1, "assistant", "> what is  the plan?\n\nWe go north."),
    (1, 2, "user", "Another thing."),
    (1, 3, "user", "> > What is the plan?\n> We go north.\nWhy north?"),
    (1, 4, "assistant", ">Why north?\nBecause.\n> never said this\n"),
    (1, 5, "user", "> We meet at noon.\n> What is the plan?\nNoon is fine."),
    (2, 0, "user", "> What is the plan?\nnot said in here"),
    (2, 1, "user", None), (2, 2, "user", ""), (2, 3, None, "\n \n"), (None, 0, "user", "hello"), (None, 1, "user", "> hello\nhi"),
    (3, None, "user", "> hello\nlost"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 2, "user", ">same\n" * 3000 + "end"),
]


def test_quotes(spark):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in TALK], "conv_id long, turn long, role string, text string, lines string, key int")
    got = [r.asDict() for r in quotes.link_quotes(frame).collect()]
    assert len(got) == len(TALK)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1] | {"role": 0} == {"conv_id": 1, "turn": 1, "role": 0, "text": "We go north.", "quote_level": 1, "n_quotes": 1, "n_linked": 1,
                                      "reply_to": 0, "reply_path": [0, 1]}
    assert (by[1, 3]["reply_to"], by[1, 3]["reply_path"], by[1, 3]["quote_level"], by[1, 3]["n_linked"]) == (1, [0, 1, 3], 2, 2)
    assert (by[1, 4]["reply_to"], by[1, 4]["n_quotes"], by[1, 4]["n_linked"], by[1, 4]["text"]) == (3, 2, 1, "Because.")
    assert by[1, 4]["reply_path"] == [0, 1, 3, 4] and by[1, 5]["reply_path"] == [0, 5]
    assert by[2, 0]["n_linked"] == 0 and by[2, 0]["reply_to"] is None and by[2, 0]["reply_path"] == [0]
    assert by[None, 1]["reply_to"] == 0 and by[3, None]["reply_path"] == [None] and by[3, 2]["reply_path"] == [1, 2]
    assert by[3, 2]["text"] == "end" and by[2, 1]["text"] == by[2, 2]["text"] == by[2, 3]["text"] == ""
    order = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["reply_path"])
    assert [r["turn"] for r in order] == [0, 1, 3, 4, 5, 2]
    assert quotes.link_quotes(frame.where("false")).count() == 0


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 30)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: r["reply_path"] for r in got} == {i: list(range(i + 1)) for i in range(30)}
