"""The stored trigram index finds what the scan finds."""

import random

import pytest
from pyspark.sql import functions as F

from codeterra.operators import search, trigrams
from tests.conftest import frame

WORDS = "parse parser parsing graph graphs edge edges node import imports resolve resolver resolved token tokens line lines read reader file files".split()


@pytest.fixture(scope="module")
def names(spark):
    pick = random.Random(3)
    made = [(f"p{k % 40}", k % 7, " ".join(pick.choices(WORDS, k=pick.randint(1, 4))), k % 3) for k in range(400)]
    made += [("tie", 1, "edge reader", 1)] * 60 + [("none", 1, None, 1), ("blank", 2, " -- ", 1), ("empty", None, "", 2), (None, 3, "resolver token", None), ("long", 1, "edge " * 20_000 + "reader zebra", 0)]
    return frame(spark, made, "path string, line int, text string, user long").withColumn("score", F.lit("a clashing name")).withColumn("name", F.col("text"))


@pytest.fixture(scope="module")
def index(names, tmp_path_factory):
    return trigrams.build(names, "name", f"file://{tmp_path_factory.mktemp('index')}/i", owner="user")


@pytest.mark.parametrize("question", ["parser", "edge reader", "graph nodes files lines of a reader", "zebra", "  ", "e", "where is the parser that reads import lines and resolves tokens of files?"])
def test_index_and_scan(names, index, question):
    rows = names.drop("score")
    for n, owner in ((1, None), (15, 1), (100, None)):
        kept = rows if owner is None else rows.where(F.col("user") == owner)
        assert search.indexed(index, question, n, "x", owner).collect() == search.scored(kept, "name", question, n, "x").collect(), (n, owner)


def test_many_ties_are_joined(names, index, monkeypatch):
    monkeypatch.setattr(trigrams, "LOOKED_UP", 3)
    want = search.scored(names.drop("score"), "name", "edge reader", 70, "x").collect()
    assert len(want) == 70 and search.indexed(index, "edge reader", 70, "x").collect() == want


def test_only_the_questions_lists_are_read(index):
    pushed = index.lists.where(trigrams._any("gram", [f"g{k}" for k in range(25)]))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [g0,g1," in pushed and "In(gram, [g10,g11," in pushed  # as values, ten at a time


def test_an_empty_table(spark, names, tmp_path):
    made = trigrams.build(names.limit(0), "name", f"file://{tmp_path}/i")
    assert search.indexed(made, "parser", 5, "x").count() == 0
