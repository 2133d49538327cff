"""One list of answers a video, from what comments state, what its metadata says and what the catalogue knows.

The last step depends on order (a catalogue title is compared with the answers so far, an alias with the first answer),
so it is a grouped map over each video's short candidate lists, which the joins before it have made.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.lineage import settled
from ..functions.similarity import indel
from . import aliases, discover, extract, metadata
from .catalogue import Catalogue

SAME = 88.0
ANSWERS = "video_id string, rank int, title string, confidence string, sources array<string>, commenters long, likes long, alternates array<struct<name: string, kind: string>>"


def same(a: str, b: str) -> bool:
    """Whether two folded names name one work."""
    return bool(a and b) and (a == b or (2.0 * min(len(a), len(b)) * 100.0 >= SAME * (len(a) + len(b)) and indel(a, b) >= SAME))


def _first(rows: list[dict], folded: str) -> dict | None:
    return next((r for r in rows if same(r["folded"], folded)), None)


def fuse(stated: list[dict], metas: list[dict], known: list[dict], alternates: list[dict], listed: dict[str, list[dict]]) -> list[dict]:
    """Answers of one video. ``stated``: discoveries by rank; ``metas``: metadata candidates by confidence; ``known``:
    catalogue titles by commenters; ``alternates``: stated aliases in order; ``listed``: the catalogue's by folded title."""
    answers, used = [], set()

    def add(title, folded, confidence, sources, commenters=0, likes=0):
        answers.append({"title": title, "folded": folded, "confidence": confidence, "sources": sources, "commenters": commenters, "likes": likes, "alternates": []})

    for d in stated:
        meta, title = _first(metas, d["folded"]), _first(known, d["folded"])
        sources = [f"comments:{d['commenters']}"] + ([f"metadata:{meta['source']}"] if meta else []) + (["catalogue"] if title else [])
        if meta:
            used.add(meta["folded"])
        sure = "high" if meta or title or d["commenters"] >= 5 else "medium" if d["commenters"] >= 3 else "low"
        add(d["title"], d["folded"], sure, sources, d["commenters"], d["likes"])
    for k in known:
        if _first(answers, k["folded"]):
            continue
        meta = _first(metas, k["folded"])
        if meta:
            used.add(meta["folded"])
        add(k["title"], k["folded"], "high" if meta else "medium" if k["commenters"] >= 3 else "low", ["catalogue"] + ([f"metadata:{meta['source']}"] if meta else []), k["commenters"])
    own = [m for m in metas if m["source"] in ("title", "hashtag") and m["folded"] not in used]
    if own and not any(a["confidence"] == "high" for a in answers) and not _first(answers, own[0]["folded"]):
        add(own[0]["title"], own[0]["folded"], "medium" if own[0]["confidence"] >= 0.7 else "low", [f"metadata:{own[0]['source']}"])
    if not answers and metas:
        add(metas[0]["title"], metas[0]["folded"], "low", [f"metadata:{metas[0]['source']}"])
    answers.sort(key=lambda a: (L.TIER_ORDER[a["confidence"]], -a["commenters"], -a["likes"]))
    if not answers:
        return answers

    first, names = answers[0], []
    if sum(a["confidence"] != "low" for a in answers) <= 3:
        names += [(a["title"], a["folded"], a["kind"]) for a in alternates if not same(a["folded"], first["folded"])]
    for a in listed.get(first["folded"], []):
        if not any(same(a["folded"], f) for _, f, _ in names):
            names.append((a["title"], a["folded"], "catalogue"))
    first["alternates"] = [(n, k) for n, _, k in names]
    kept = [a for a in answers[1:] if not any(same(a["folded"], f) for _, f, _ in names)]
    merged = len(answers) - 1 - len(kept)
    if merged:
        for a in answers[1:]:
            if not any(a is b for b in kept):
                first["commenters"] += a["commenters"]
                first["likes"] += a["likes"]
        first["sources"].append(f"merged:{merged}")
    return [first, *kept]


def _parts(comments: DataFrame, cat: Catalogue, freq: DataFrame, meta: DataFrame | None, mentions: DataFrame | None) -> DataFrame:
    """Every candidate of every video as rows of one schema: part, ord, title, source/kind, confidence, commenters, likes."""

    def part(df, name, ord_, title, source=None, confidence=None, commenters=None, likes=None, of=None):
        pick = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
        return df.select("video_id", F.lit(name).alias("part"), F.col(ord_).cast("long").alias("ord"), F.col(title).alias("title"), pick(source, "string").alias("source"), pick(confidence, "double").alias("confidence"), pick(commenters, "long").alias("commenters"), pick(likes, "long").alias("likes"), pick(of, "string").alias("of"))

    stated = settled(discover.discover(comments, freq))
    found = mentions if mentions is not None else extract.mentions(comments, cat, freq)
    known = found.groupBy("video_id", "canonical").agg(F.count_distinct(F.coalesce("author", F.lit(""))).alias("commenters"), F.min("seq").alias("seq")).transform(settled)
    other = aliases.stated(comments).withColumn("at", F.col("ord.seq") * 1_000_000 + F.col("ord.frame_no") * 1000 + F.col("ord.match_no"))
    rows = part(stated, "stated", "rank", "title", commenters="commenters", likes="likes")
    rows = rows.union(part(known, "known", "seq", "canonical", commenters="commenters")).union(part(other, "alias", "at", "name", source="kind"))
    titles = stated.select("video_id", "title").union(known.select("video_id", "canonical"))
    if meta is not None:
        metas = settled(metadata.candidates(meta, cat, freq))
        rows = rows.union(part(metas.withColumnRenamed("text", "title"), "meta", "ord", "title", source="source", confidence="confidence"))
        titles = titles.union(metas.select("video_id", "text"))
    listed = titles.distinct().join(aliases.of_catalogue(titles, cat), "title").withColumnRenamed("title", "of")
    return rows.union(part(listed, "listed", "at", "name", of="of"))


def analyze(comments: DataFrame, cat: Catalogue, freq: DataFrame, meta: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(video_id, rank, title, confidence, sources, commenters, likes, alternates): each video's answers, best first."""
    rows = settled(_parts(comments, cat, freq, meta, mentions)).withColumn("folded", T.fold(F.col("title"))).withColumn("of", T.fold(F.col("of")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "ord"])
        parts = {name: own.to_dict("records") for name, own in pdf.groupby("part")}
        known = sorted(parts.get("known", []), key=lambda r: (-r["commenters"], r["ord"]))
        listed: dict[str, list[dict]] = {}
        for r in parts.get("listed", []):
            listed.setdefault(r["of"], []).append(r)
        whole = [r | {"commenters": int(r["commenters"]), "likes": int(r["likes"])} for r in parts.get("stated", [])]
        known = [r | {"commenters": int(r["commenters"])} for r in known]
        other = [r | {"kind": r["source"]} for r in parts.get("alias", [])]
        found = fuse(whole, parts.get("meta", []), known, other, listed)
        out = [(pdf["video_id"].iloc[0], i, a["title"], a["confidence"], a["sources"], a["commenters"], a["likes"], [{"name": n, "kind": k} for n, k in a["alternates"]]) for i, a in enumerate(found, 1)]
        return pd.DataFrame(out, columns=["video_id", "rank", "title", "confidence", "sources", "commenters", "likes", "alternates"])

    return rows.groupBy("video_id").applyInPandas(work, ANSWERS)
