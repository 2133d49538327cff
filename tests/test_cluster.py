"""Split clustering against plain versions: similar pairs, leaders, components."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.functions.similarity import indel
from threadlens.operators import cluster
from threadlens.operators.components import components


def _names(n: int, seed: int) -> list[str]:
    """Short and long names, with edited and doubled ones among them."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        if out and rng.random() < 0.7:
            s = list(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", " ", "é", "aa"])
            out.append("".join(s))
        else:
            out.append("".join(rng.choice("abcde ") for _ in range(rng.choice([0, 1, 3, 5, 6, 9, 12, 20, 40, 90]))))
    return out


@pytest.mark.parametrize("least", [85.0, 88.0, 90.0, 96.0])
def test_similar_pairs_are_all_found(spark, least):
    names = _names(500, 7) + ["abcd", "abxcd", "aaaaaaaaa", "aaaaaaaa", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "x" * 300, "x" * 299]
    got = {(r.a, r.b) for r in cluster.similar(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), [], "name", least).collect()}
    own = sorted(set(names))
    assert got == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if indel(a, b) >= least} and len(got) > 20


@pytest.mark.parametrize("small", [0, 150, 10_000])
def test_leaders_of_split_groups(spark, small):
    rows = [(v, i, n) for v in range(3) for i, n in enumerate(_names((40, 200, 400)[v], v))]
    got = cluster.with_leader(spark.createDataFrame([*rows, (0, 999, None)], "video int, at int, name string").repartition(5), "video", "name", ["at"], small=small).collect()
    wanted = {}
    for v in range(3):
        own = [n for u, _, n in rows if u == v]
        wanted |= {(v, i, n): k for i, (n, k) in enumerate(zip(own, cluster.leaders(own, 88.0)))}
    assert {(r.video, r["at"], r.name): r.leader for r in got if r.name is not None} == wanted and len(got) == len(rows) + 1
    assert [r.leader for r in got if r.name is None] == [None]


def test_leaders_along_a_chain(spark):
    """Each name is similar to its neighbours only, so that every second one leads and no round settles many."""
    links = [(f"n{i:02}", i, f"n{i + 1:02}") for i in range(9)]
    got = {r.b: r.leader for r in cluster.led(spark.createDataFrame(links, "a string, at int, b string"), []).collect()}
    assert got == {f"n{i:02}": f"n{i - 1:02}" for i in range(1, 10, 2)}
    assert cluster.led(spark.createDataFrame([], "a string, at int, b string"), []).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "video int, at int, name string")
    assert cluster.with_leader(none, "video", "name", ["at"]).count() == 0
    assert cluster.similar(none, ["video"], "name", 88.0).count() == 0
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_of_names(spark):
    rng = random.Random(3)
    links = [(f"k{rng.randrange(90)}", f"k{rng.randrange(90)}") for _ in range(60)] + [("hub", f"k{i}") for i in range(20)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string").where(F.col("a") <= F.col("b")).union(spark.createDataFrame([(b, a) for a, b in links if a > b], "a string, b string"))).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1]}
