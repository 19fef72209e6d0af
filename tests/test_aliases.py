"""Names in text against patterns one by one."""

import random
import re

import pytest

from claimloom.operators import aliases as L

NAMES = [("red plate", []), ("plate", ["dish", "Plate!"]), ("new york", ["NYC", "big-apple"]), ("new york times", []), ("york", []), ("x.y_z", []), ("Größe", []), ("...", ["dots"]), ("...only", [])]


def pattern(alias):
    parts = re.findall("[a-z0-9]+", alias.lower())
    return re.compile(r"(?<![a-z0-9])" + r"[\W_]+".join(parts) + r"(?![a-z0-9])") if parts else None


@pytest.fixture(scope="module")
def names(spark):
    entities = spark.createDataFrame([(e,) for e, _ in NAMES] + [("york",), (None,)], "entity string")
    more = spark.createDataFrame([(e, a, k) for e, x in NAMES for k, a in enumerate(x)] + [("stranger", "y", 0)], "entity string, alias string, ord long")
    return L.expanded(entities, more).cache()


def texts(seed=1, n=200):
    r = random.Random(seed)
    words = ["red", "Plate", "new", "New", "york", "times", "é", "big", "apple", "NYC", "dish", "x", "y", "z", "gr", "Größe", "only", "platex", "7"]
    odd = [None, "", "...", "new york times", "red_plate.new--york", "new é york", "platé plate"]
    return list(enumerate(odd + ["".join(r.choice(words) + r.choice([" ", "  ", ", ", "_", "\n", "-", ""]) for _ in range(r.randrange(30))) for _ in range(n)]))


def test_expanded_names(names):
    got = {(r["entity"], r["key"]): r["alias"] for r in names.collect()}
    assert got[("plate", "plate")] == "plate" and got[("plate", "dish")] == "dish" and ("plate", "Plate!") not in got
    assert got[("...", "dots")] == "dots" and got[("Größe", "gr e")] == "Größe" and len(got) == 12
    assert not [k for k in got if k[0] in ("stranger", None)]


@pytest.mark.parametrize("stretch", [L.STRETCH, 3])
def test_mentions_are_those_of_the_patterns(spark, names, monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    rows = texts()
    found = L.mentioned(spark.createDataFrame(rows, "id int, text string"), names)
    got = {(r["id"], r["entity"]): r["aliases"] for r in found.collect()}
    want = {}
    keys = [(r["entity"], r["alias"]) for r in names.collect()]
    for i, text in rows:
        for entity, alias in keys:
            p = pattern(alias)
            if text and p and p.search(text.lower()):
                want.setdefault((i, entity), []).append(alias)
    assert got == {k: sorted(v) for k, v in want.items()} and len(want) > 200


def test_longest_names_from_the_left(spark, names):
    rows = [(1, "The New York Times, red plate; york new york dish"), (2, "red plate plate")]
    found = L.longest(L.occurrences(spark.createDataFrame(rows, "id int, text string"), names))
    got = sorted((r["id"], r["at"], r["n"], r["entity"], r["alias"]) for r in found.collect())
    assert got == [(1, 1, 3, "new york times", "new york times"), (1, 4, 2, "red plate", "red plate"), (1, 6, 1, "york", "york"), (1, 7, 2, "new york", "new york"), (1, 9, 1, "plate", "dish"), (2, 0, 2, "red plate", "red plate"), (2, 2, 1, "plate", "plate")]


def test_nothing_to_find(spark, names):
    some = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert L.mentioned(some.where("id > 1"), names).isEmpty() and L.mentioned(some, names.where("n > 99")).isEmpty() and L.longest(L.occurrences(some, names)).isEmpty()


def test_words_that_lean_on_text_before(spark):
    rows = [(1, "What did THOSE machines run?"), (2, "Thatcher and nothing else"), (3, None)]
    got = [r["m"] for r in spark.createDataFrame(rows, "id int, text string").orderBy("id").select(L.discourse("text").alias("m")).collect()]
    assert got == [["those", "those machines"], [], []]


def test_only_likely_stretches_are_shuffled(spark):
    from claimloom.operators import aliases

    texts = spark.createDataFrame([(i, f"the red ball and the blue ball {i} of the green one") for i in range(50)], "id int, text string")
    names = aliases.expanded(spark.createDataFrame([("the red ball",), ("the blue",), ("the missing name",)], "entity string"))
    found = aliases.mentioned(texts, names)
    assert {(r["entity"], r["n_places"], r["first_at"]) for r in found.collect()} == {("the red ball", 1, 0), ("the blue", 1, 4)} and found.count() == 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert aliases.mentioned(texts, names)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2  # first tokens and the filter, before anything is shuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
