"""Visitors' names and counters on small tables."""

from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.streaming import community, state

NAMES = "video_id string, folded string, name string, count long, db string, first long, last long"


def test_spellings(spark):
    df = spark.createDataFrame([("Yang llwoo",), ("Dune or Arrival",), ("x / Solo Leveling, ",), ("plain",)], "n string")
    got = {r.n: r.s for r in df.select("n", community.spellings(F.col("n")).alias("s")).collect()}
    assert got["Yang llwoo"] == ["Yang llwoo", "Yang Ilwoo"] and got["plain"] == ["plain"]
    assert got["Dune or Arrival"] == ["Dune or Arrival", "Dune", "Arrival"]
    assert got["x / Solo Leveling, "] == ["x / Solo Leveling, ", "Solo Leveling"]


def test_names_beside_answers(spark):
    names = spark.createDataFrame(
        [("a", "dune", "dune", 1, None, 5, 5), ("a", "arrival", "Arrival", 3, None, 1, 9), ("a", "once", "Once", 1, None, 1, 1), ("a", "known", "Known", 1, "db", 2, 2),
         ("b", "lights", "Lights", 2, "db", 1, 1), ("b", "other", "Other", 2, None, 2, 2), ("c", "hidden", "Hidden", 1, None, 1, 1), ("z", "x", "X", 9, None, 1, 1)], NAMES)
    answers = spark.createDataFrame([("a", "DUNE", "low", ["Dune: Part"], None), ("b", None, None, None, None), ("c", None, None, None, None), ("d", "Solo", "high", [], "Solo")], "video_id string, title string, confidence string, also_called array<string>, db_name string")
    got = {r.video_id: (r.title, r.confidence, r.community, r.from_community, [(o.title, o["count"]) for o in r.others]) for r in community.with_names(answers, names).collect()}
    assert got == {
        "a": ("DUNE", "low", 1, False, [("Arrival", 3), ("Known", 1)]), "b": ("Lights", "high", 2, True, [("Other", 2)]),
        "c": (None, None, None, False, []), "d": ("Solo", "high", None, False, []),
    }
    page = community.names_page(names, 3).collect()
    assert [(r["at"], r.name, r.shown) for r in page] == [(9, "Arrival", True), (5, "dune", False), (2, "Known", True)]


def test_names_looked_up_again_and_restarted(spark):
    names = spark.createDataFrame([("a", "yang llwoo", "Yang llwoo", 1, None, 1, 4), ("a", "yang ilwoo", "Yang Ilwoo", 2, None, 2, 3), ("a", "dune", "Dune", 1, "db", 1, 1)], NAMES)
    found = spark.createDataFrame([("a", "yang llwoo", "Yang Ilwoo", "new"), ("a", "dune", "Not This", "new")], "video_id string, folded string, better string, db string")
    got = {r.folded: (r.name, r["count"], r.db, r["first"], r["last"]) for r in community.rechecked(names, found).collect()}
    assert got == {"yang ilwoo": ("Yang Ilwoo", 3, "new", 1, 4), "dune": ("Dune", 1, "db", 1, 1)}
    saved = spark.createDataFrame([("a", "dune", "DUNE", 4, None, 0, 0), ("a", "yang ilwoo", "old", 2, None, 0, 0), ("b", "x", "X", 1, None, 0, 0)], NAMES)
    got = {(r.video_id, r.folded): r.name for r in community.names_restarted(names, saved).collect()}
    assert got == {("a", "dune"): "DUNE", ("a", "yang ilwoo"): "Yang Ilwoo", ("a", "yang llwoo"): "Yang llwoo", ("b", "x"): "X"}


def test_stats_page(spark):
    rows = [(f"2024-01-{d:02}", "visits", d) for d in range(1, 11)] + [("2024-01-10", "lookups", 5)]
    got = [tuple(r) for r in community.stats_page(spark.createDataFrame(rows, "day string, field string, n long"), ["visits", "lookups", "shares"], days=2).collect()]
    assert got == [("All time", 55, 5, 0), ("Last 7 days", 49, 5, 0), ("2024-01-10", 10, 5, 0), ("2024-01-09", 9, 0, 0)]


def test_write_behind_counts_each_post_once(spark, tmp_path):
    posts = "video_id string, name string, ts long, db string"
    folder, source = str(tmp_path / "names"), str(tmp_path / "posts")
    merge = lambda table, batch: state.upsert_names(table, batch.withColumn("folded", T.fold(F.col("name"))))
    for rows in ([("a", "Dune", 1, None), ("a", "dune", 2, None)], [("a", "DUNE", 3, "db")], [("b", "Solo", 4, None)]):
        spark.createDataFrame(rows, posts).coalesce(1).write.mode("append").parquet(source)
        community.write_behind(spark.readStream.schema(posts).parquet(source), folder, NAMES, merge, None).awaitTermination()
    got = {(r.video_id, r.folded): (r.name, r["count"], r.db) for r in community.current(spark, folder, NAMES).collect()}
    assert got == {("a", "dune"): ("Dune", 3, "db"), ("b", "solo"): ("Solo", 1, None)}
    assert len(community._versions(spark, folder)) == 2
    assert community.current(spark, str(tmp_path / "none"), NAMES).count() == 0
