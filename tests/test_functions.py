"""Text and similarity functions against plain versions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from threadlens.functions import lexicon as L
from threadlens.functions import patterns as P
from threadlens.functions import similarity as S
from threadlens.functions import text as T
from threadlens.operators import cluster, metadata


def column(spark, values, *columns, fold=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    if fold:
        df = df.withColumn("f", T.fold(F.col("v")))
    return [r[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def plain_fold(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t)).strip()


def test_fold(spark):
    r = random.Random(2)
    parts = list("aÉßﬁ Ω!_-9'") + ["हिन्दी", "называется", "지금", "Ａ", "²", " ", "\n"]
    values = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)]
    assert column(spark, values, T.fold(F.col("v"))) == [plain_fold(v) for v in values]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio(spark):
    r = random.Random(3)
    pairs = [("".join(r.choice("abc ") for _ in range(r.randint(0, 12))), "".join(r.choice("abc ") for _ in range(r.randint(0, 12)))) for _ in range(200)]
    for a, b in pairs:
        assert S.lcs(a, b) == plain_lcs(a, b)
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select(S.ratio("a", "b").alias("u"), S.ratio_native(F.col("a"), F.col("b")).alias("n"), S.can_reach(F.col("a"), F.col("b"), 88.0).alias("can")).collect():
        assert abs(x.u - x.n) < 1e-9 and (x.can or x.u < 88)
    assert round(S.indel("sollo levelling", "solo leveling"), 2) == 92.86 and S.indel("killer", "kingkiller") == 75.0
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0


def test_span_keys(spark):
    df = spark.createDataFrame([(0, "the Solo Leveling manhwa season 2"), (1, "s a parasite"), (2, "read"), (3, "An Arrival")], "i int, span string")
    assert [r.key for r in T.with_span_key(df).orderBy("i").collect()] == ["solo leveling", "parasite", "", "arrival"]


def test_slots_and_junk(spark):
    values = ["#f4 Thailand on Netflix", "Teach You A Lesson (2021) so good", '"Get Schooled"!!', "one two three four five six seven eight nine"]
    assert column(spark, values, T.clean_slot(F.col("v"))) == ["f4 Thailand", "Teach You A Lesson", "Get Schooled", ""]
    junk = ["la novela", "kya hai", "Teach You", "me too", "it", "name title", "the"]
    assert column(spark, junk, T.is_junk(F.col("f")), fold=True) == [True, True, False, True, True, True, True]
    cased = ["May I Help You", "What is the", "SHOUT IT", "All of us are dead", ""]
    assert column(spark, cased, T.is_title_case(F.col("v"))) == [True, False, True, False, False]


def test_questions(spark):
    yes = ["What is the name of this?", "как называется", "НАЗЫВАНИЕ называется? как называется", "cómo se llama", "Movie ka naam kya hai", "제목 뭐"]
    assert all(column(spark, yes, T.is_question(F.col("v")))) and not any(column(spark, ["It's called Monster", "name it"], T.is_question(F.col("v"))))


def test_metadata_scores(spark):
    values = ["May I Help You ?", "turkish series", "kim soo hyun", "x"]
    got = column(spark, values, T.title_score(F.col("v"), F.col("f")), fold=True)
    assert [round(x, 2) for x in got] == [0.9, 0.0, 0.15, 0.0]


def test_title_clean_and_key(spark):
    values = ["Resident playbook)}", "The Omniscient Reader’s Viewpoint!!", "A Business Proposal drama movie", "movie"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r.k for r in T.with_group_key(df, "v", "k").orderBy("i").collect()] == ["resident playbook", "omniscient readers viewpoint", "business proposal drama", "movie"]


def test_forms_and_ids(spark):
    assert column(spark, ["the lord of the rings"], T.title_forms(F.col("v"))) == [["The lord of the rings", "The Lord of the Rings"]]
    urls = ["dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=1", "https://x.com/watch?v=dQw4w9WgXcQ", "nothing"]
    assert column(spark, urls, T.video_id(F.col("v"))) == ["dQw4w9WgXcQ"] * 3 + [None]


def test_inflected_and_patterns():
    assert {"makes", "making", "tries", "tried"} <= set(L.inflected(("make", "try")))
    assert len(P.FRAMES) == 32


def test_leaders_and_merges():
    assert cluster.leaders(["solo leveling", "sollo leveling", "dune", "solo levelling"], 88.0) == ["solo leveling", "solo leveling", "dune", "solo leveling"]
    import pandas as pd

    rows = pd.DataFrame({"key": ["a", "b", "c"], "videos": [3, 2, 1]})
    assert cluster.merge_order(rows, {("a", "b"), ("b", "c"), ("c", "b"), ("b", "a")}) == {"b": "a"} | {}


def plain_split(glued, zipf):
    import math

    best = {0: (0.0, [])}
    for i in range(1, len(glued) + 1):
        for j in range(max(0, i - 16), i):
            w = glued[j:i]
            s = best[j][0] + (math.log10(zipf[w] / 10) if w in zipf else -6 - 0.6 * len(w))
            if i not in best or s > best[i][0]:
                best[i] = (s, best[j][1] + [w])
    return best[len(glued)][1]


@pytest.mark.parametrize("glued", ["teachyoualesson", "", "zzz", "youyoua"])
def test_best_split(glued):
    zipf = {"teach": 4.8, "you": 7.5, "a": 7.3, "lesson": 4.5, "les": 2.0, "son": 5.0}
    assert metadata.best_split(glued, zipf) == plain_split(glued, zipf)
