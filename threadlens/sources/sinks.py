"""Small outputs for people: text tables, a report page, JSON lines. Each collects a stated top-N only."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(ranked: DataFrame, limit: int = 25) -> str:
    """Ranked titles (``rank.rank``) in fixed-width columns."""
    rows = ranked.orderBy(F.desc("commenters"), F.desc("mentions"), "canonical").limit(limit).collect()
    if not rows:
        return "No titles found."
    out = [f"{'#':>2}  {'title':<34} {'kind':<8} {'ppl':>4} {'conf':>5}  example", "-" * 110]
    for i, r in enumerate(rows, 1):
        example = r["example_comment"].replace("\n", " ")
        example = example[:47] + "..." if len(example) > 50 else example
        out.append(f"{i:>2}  {r['canonical'][:34]:<34} {r['kind']:<8} {r['commenters']:>4} {r['confidence']:>5.1f}  {example}")
    return "\n".join(out)


def report_text(totals: DataFrame, ranked: DataFrame, top: int = 25) -> str:
    t = totals.first()
    out = [f"{t['videos']} videos | {t['comments']:,} comments | {t['people_asking']:,} people asking", f"{t['videos_with_demand']} videos with demand, {t['videos_answered_high']} answered for sure, {t['demand_gap']} not"]
    for i, r in enumerate(ranked.orderBy("rank").limit(top).collect(), 1):
        out.append(f"{i:>3}  {r['title'][:40]:<40} {r['videos']:>4} videos {r['commenters']:>5} people  {r['kind'] or ''}")
    return "\n".join(out)


def bars(counts: DataFrame, name: str, n: str, top: int = 12) -> str:
    """Rows of a bar chart, scaled to the largest."""
    rows = counts.orderBy(F.desc(n), name).limit(top).collect()
    most = max((r[n] for r in rows), default=0) or 1
    return "\n".join(f'<div class="bar"><span>{html.escape(str(r[name]))}</span><i style="width:{round(100 * r[n] / most)}%"></i><b>{r[n]}</b></div>' for r in rows)


def report_page(totals: DataFrame, ranked: DataFrame, genres: DataFrame, languages: DataFrame, top: int = 50) -> str:
    t, e = totals.first(), lambda x: html.escape(str(x if x is not None else ""))
    rows = "\n".join(
        f"<tr><td>{i}</td><td>{e(r['title'])}</td><td>{e(r['kind'])}</td><td>{r['videos']}</td><td>{r['commenters']}</td><td>{r['demand']}</td><td>{e(', '.join(r['alternates']))}</td></tr>"
        for i, r in enumerate(ranked.orderBy("rank").limit(top).collect(), 1)
    )
    head = f"<p>{t['videos']} videos, {t['comments']:,} comments, {t['people_asking']:,} people asking; {t['demand_gap']} videos without a sure answer.</p>"
    style = "<style>body{font:15px sans-serif;max-width:60em;margin:auto}.bar i{display:inline-block;height:.7em;background:#58c}.bar span{display:inline-block;width:12em}</style>"
    columns = "<tr><th>#</th><th>title</th><th>kind</th><th>videos</th><th>people</th><th>asked</th><th>also</th></tr>"
    return f'<!doctype html><meta charset="utf-8"><title>Title demand</title>{style}<h1>Title demand</h1>{head}<table>{columns}{rows}</table><h2>By segment</h2>{bars(genres, "genre", "videos")}<h2>By language</h2>{bars(languages, "lang", "comments")}'


def json_lines(df: DataFrame, top: int) -> list[str]:
    return [json.dumps(json.loads(r[0]), ensure_ascii=False) for r in df.limit(top).select(F.to_json(F.struct("*"))).collect()]
