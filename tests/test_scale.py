"""What keeps large inputs within bounds: texts looked at once, small slices in Python, few bytes moved."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import extract
from threadlens.sources import readers


def test_fold_in_slices():
    said = ["AbC", None, "Écolê", "", "ß", "ﬁ 한", "x"] * 50
    seen = []

    def one(text, fold=T._fold_one):
        seen.append(text)
        return fold(text)

    T._fold_one, kept = one, T._fold_one
    try:
        got = T._decomposed.func(pa.array(said))
    finally:
        T._fold_one = kept
    assert got.to_pylist() == [kept(x) for x in said]
    assert len(seen) == 150 and all(not x.isascii() for x in seen)  # plain texts never become Python's strings


def test_mentions_look_at_a_text_once(spark, monkeypatch):
    from threadlens.operators import catalogue

    cat = catalogue.index(spark.createDataFrame([(0, "Weak Hero", "series", [], None)], "prio int, canonical string, kind string, aliases array<string>, year int"))
    said = [("v", i, f"c{i}", f"u{i}", ("movie name: Weak Hero", "first!!", None)[i % 3], 0) for i in range(60)]
    seen, find = [], extract._mentions
    monkeypatch.setattr(extract, "_mentions", lambda texts, *rest: (seen.append(texts.count()), find(texts, *rest))[1])
    found = extract.mentions(spark.createDataFrame(said, readers.COMMENTS), cat, spark.createDataFrame([], "word string, zipf double"))
    assert seen == [2]
    assert {(r.seq, r.author, r.canonical) for r in found.collect()} == {(i, f"u{i}", "Weak Hero") for i in range(0, 60, 3)}
    assert found.where(F.col("text") != "movie name: Weak Hero").isEmpty()


def test_ngram_sweep_moves_two_numbers_a_gram(spark):
    from threadlens.plans import queries

    plan = queries.QUERIES["ngram_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if re.search(r"\ba#", x)]
    assert dealt and all(re.fullmatch(r"a#\d+L?, b#\d+L?, \d+", x) for x in dealt), plan[:3000]
