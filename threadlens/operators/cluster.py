"""Order-dependent merging: greedy leader clustering of names, and greedy merging of ranked rows.

Names are led by the first name before them, in a stated order, that leads and is similar enough; one without leads itself.
A group's *distinct* names suffice, since an equal name meets the same leaders as its first occurrence did. Small groups go
through a grouped map. Larger ones are split: an equi join on rare character grams finds every pair of similar names, and
rounds of joins over these pairs settle who leads, so that neither a video with very many names nor a large cluster falls to
one task. Both ways give the same leaders.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.lineage import settled
from ..functions.similarity import indel

#: Distinct names up to which a group is gone through in one task, in seconds.
SMALL = 1_000
#: Length of two names together from which they are paired by runs of three characters, and below it by runs of two.
LONG = 24


def leaders(names: list[str], least: float) -> list[str]:
    """For each name in order, the first leader at a ratio of ``least`` or more; a name without one leads."""
    found, out = [], []
    for name in names:
        lead = next((k for k in found if 2.0 * min(len(k), len(name)) * 100.0 >= least * (len(k) + len(name)) and indel(name, k) >= least), None)
        if lead is None:
            found.append(lead := name)
        out.append(lead)
    return out


def _grams(name: Column, q: int) -> Column:
    """The runs of ``q`` characters, each with how often it came before, so that equal runs count as often as they occur."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(name) - q + 1, F.lit(1)))
    runs = F.transform(at, lambda i: F.substr(name, i, F.lit(q)))
    return F.transform(runs, lambda g, i: F.xxhash64(F.lit(q), g, F.size(F.filter(F.slice(runs, F.lit(1), i), lambda x: x == g))))


def similar(names: DataFrame, by: list[str], name: str, least: float) -> DataFrame:
    """(by..., a, b, ratio), a < b: every pair of different names of a group with a ratio of ``least`` (85 or more).

    A ratio of ``least`` allows d = e * (n + m) inserted and deleted characters, e = 1 - least / 100, for names of n and m. A
    deletion ends at most q of the shorter name's runs of q characters, an insertion q - 1, which leaves at least
    T = (n + m) * (1/2 - (q - 1/2) * e) - q + 1 runs in common. With runs in one order, two names then share one among
    the first (runs - T + 1) of both, so only these are joined; the rarest come first. Hashes that collide add candidates,
    which the ratio rejects, and lose none."""
    if least < 85:
        raise ValueError("runs of characters find every pair from a ratio of 85 on")
    e, n = 1 - least / 100, F.char_length(name)
    low, high = F.ceil(n * ((1 - e) / (1 + e)) - 1e-9), F.floor(n * ((1 + e) / (1 - e)) + 1e-9)

    def runs(q: int, fits: Column, total: Column) -> Column:
        common = F.ceil(total * (0.5 - (q - 0.5) * e) - q + 1 - 1e-9)
        return F.when(fits, F.struct(F.lit(q).alias("q"), F.greatest(n - q + 2 - common, F.lit(0)).cast("int").alias("first"), _grams(F.col(name), q).alias("grams")))

    short = runs(2, (n >= 2) & (n + low < LONG), F.greatest(n + low, F.lit(math.ceil(1 / e - 1e-9))))
    long = runs(3, (n >= 3) & (n + high >= LONG), F.greatest(n + low, F.lit(LONG)))
    each = names.where(F.col(name).isNotNull()).select(*by, name).distinct().withColumn("s", F.explode(F.filter(F.array(short, long), lambda s: s.isNotNull())))
    each = settled(each.select(*by, F.col(name).alias("name"), "s.*").select(*by, "name", "q", "first", F.explode("grams").alias("gram")))
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = each.join(often, "gram").groupBy(*by, "name", "q", "first").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    rare = settled(ranked.where("first > 0").select(*by, "name", "q", F.explode(F.slice("grams", F.lit(1), F.col("first"))["gram"]).alias("gram")))
    a, b = rare.withColumnRenamed("name", "a"), rare.withColumnRenamed("name", "b")
    total = F.char_length("a") + F.char_length("b")
    fits = F.when(F.col("q") == 2, total < LONG).otherwise(total >= LONG)
    pairs = a.join(b, [*by, "q", "gram"]).where((F.col("a") < F.col("b")) & fits & S.can_reach(F.col("a"), F.col("b"), least))
    return pairs.select(*by, "a", "b").distinct().withColumn("ratio", S.ratio("a", "b")).where(F.col("ratio") >= least)


def led(links: DataFrame, by: list[str]) -> DataFrame:
    """(by..., b, leader) of the names that another leads. ``links`` (by..., a, at, b): similar names, a before b, with a's
    place in the order. In each round the names without an undecided one before them lead, and those linked to them follow;
    every round decides the whole front."""
    links = settled(links)
    left, fell = links, []
    while not left.isEmpty():
        first = left.select(*by, "a").join(left.select(*by, F.col("b").alias("a")), [*by, "a"], "left_anti").distinct()
        now = settled(left.join(first, [*by, "a"], "left_semi").select(*by, "b").distinct())
        fell.append(now)
        left = settled(left.join(now, [*by, "b"], "left_anti").join(now.withColumnRenamed("b", "a"), [*by, "a"], "left_anti"))
    if not fell:
        return links.select(*by, "b", F.col("a").alias("leader"))
    follow = reduce(DataFrame.union, fell).withColumnRenamed("b", "a")
    return links.join(follow, [*by, "a"], "left_anti").groupBy(*by, "b").agg(F.min_by("a", F.struct("at", "a")).alias("leader"))


def with_leader(df: DataFrame, by: str, name: str, order: list[str], least: float = 88.0, small: int = SMALL) -> DataFrame:
    """``df`` with ``leader``: of each group of ``by``, the name that leads the row's name. Names of one place in the order
    go by their text; a null name has no leader. Groups of more than ``small`` distinct names are split."""
    at = F.format_string("|".join(["%020d"] * len(order)), *(F.col("_first")[c].cast("long") for c in order))
    first = df.where(F.col(name).isNotNull() & F.col(by).isNotNull()).groupBy(by, name).agg(F.min(F.struct(*order)).alias("_first"))
    first = settled(first.select(by, F.col(name).alias("_name"), at.alias("_at")))
    large = settled(first.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > small).select(by))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_name"])
        pdf["leader"] = leaders(pdf["_name"].tolist(), least)
        return pdf[pdf["leader"] != pdf["_name"]][[by, "_name", "leader"]]

    kind = df.schema[by].dataType.simpleString()
    follow = first.join(large, by, "left_anti").groupBy(by).applyInPandas(work, f"`{by}` {kind}, `_name` string, leader string")
    if not large.isEmpty():
        many = settled(first.join(large, by, "left_semi"))
        place = lambda c: many.select(by, F.col("_name").alias(c), F.col("_at").alias(f"{c}_at"))
        pairs = similar(many, [by], "_name", least).join(place("a"), [by, "a"]).join(place("b"), [by, "b"])
        one, two = F.struct(F.col("a_at").alias("at"), F.col("a").alias("name")), F.struct(F.col("b_at").alias("at"), F.col("b").alias("name"))
        links = pairs.select(by, F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).select(by, F.col("x.name").alias("a"), F.col("x.at").alias("at"), F.col("y.name").alias("b"))
        follow = follow.union(led(links, [by]).select(by, F.col("b").alias("_name"), "leader"))
    out = df.join(follow.withColumnRenamed("_name", name), [by, name], "left")
    return out.withColumn("leader", F.coalesce("leader", name))


def merge_order(rows: pd.DataFrame, pairs: set[tuple[str, str]]) -> dict[str, str]:
    """For ``rows`` (key, videos) from the strongest on: each takes the rows paired with it that have no more videos and
    are not merged yet. Chains end at the last target."""
    merged: dict[str, str] = {}
    keys, videos = rows["key"].tolist(), dict(zip(rows["key"], rows["videos"]))
    by: dict[str, list[str]] = {}
    rank = {k: i for i, k in enumerate(keys)}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    for key in keys:
        if key in merged:
            continue
        for other in sorted(by.get(key, ()), key=rank.__getitem__):
            if other not in merged and videos[other] <= videos[key]:
                merged[other] = key
    for key in list(merged):
        to = merged[key]
        while to in merged:
            to = merged[to]
        merged[key] = to
    return merged
