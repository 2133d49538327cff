"""The engine from a command line or as a batch job (``spark-submit`` settings apply).

    python -m threadlens titles COMMENTS [--top 25] [--json] [--out FOLDER]
    python -m threadlens report SWEEP --out FOLDER [--cache FOLDER]
    python -m threadlens learn SWEEP --out FOLDER

COMMENTS is a file or folder of comment files, one a video; SWEEP a file or folder of sweep results. What is written to
``--out`` is whole; what is printed, and the report page, show the stated number of rows.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import settled
from .operators import analyze, catalogue, discover, extract, learn, rank, report
from .sources import cache, readers, sinks

#: Comments that a source gives at a time; a limit takes whole pages.
PAGE = 100


def _frequencies(spark: SparkSession, path: str | None) -> DataFrame:
    schema = "word string, zipf double"
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def _meta(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    raw = spark.read.text(path, wholetext=True)
    return readers.video_meta(raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("video_id"), F.col("value").alias("payload")))


def titles(spark: SparkSession, args: argparse.Namespace) -> str:
    """Ranked catalogue titles, titles stated outright and the best answers of every video."""
    comments = readers.comments(spark, args.comments)
    if args.limit:
        comments = readers.limited(comments.withColumn("page", F.floor(F.col("seq") / PAGE)), args.limit, PAGE).drop("page")
    comments = settled(comments)
    cat, freq = catalogue.index(readers.catalogue(spark, args.catalogue)), _frequencies(spark, args.frequencies)
    mentions = settled(extract.mentions(comments, cat, freq))
    answers = settled(analyze.analyze(comments, cat, freq, _meta(spark, args.meta), mentions))
    stated = comments.limit(0) if args.no_discover else settled(discover.discover(comments, freq))
    asked = discover.demand(comments)
    if args.out:
        rank.rank(mentions, ("video_id",)).write.mode("overwrite").json(f"{args.out}/titles")
        answers.write.mode("overwrite").json(f"{args.out}/answers")
        asked.write.mode("overwrite").json(f"{args.out}/demand")
        if not args.no_discover:
            stated.write.mode("overwrite").json(f"{args.out}/discovered")
    ranked = settled(rank.rank(mentions))
    first = [F.desc("commenters"), F.desc("likes"), "title", "video_id"]
    best = answers.orderBy("video_id", "rank")
    n_asked = asked.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    if args.json:
        rows = lambda df: [json.loads(x) for x in sinks.json_lines(df, args.top)]
        found = [] if args.no_discover else rows(stated.orderBy(*first).select("video_id", "title", "commenters", "likes", "frames", "example"))
        return json.dumps({"source": args.comments, "comments_read": comments.count(), "titles": rows(rank.ordered(ranked)), "asked_by": n_asked, "answers": rows(best), "discovered": found}, indent=2, ensure_ascii=False)
    out = [f"{args.comments}: {comments.count()} comments, {mentions.count()} mentions of {ranked.count()} titles", "", sinks.table(ranked, args.top)]
    if not args.no_discover:
        out += ["", "Named in so many words:"] + [f"{r.title[:44]:<44}{r.commenters:>5}{r.likes:>8}" for r in stated.orderBy(*first).limit(args.top).collect()]
    out += ["", f"Answers ({n_asked} comments ask):"]
    for r in best.where("rank <= 3").limit(args.top).collect():
        out.append(f"  {r.video_id}: {r.title} [{r.confidence}] {'+'.join(r.sources)}" + "".join(f"; also {a['name']} ({a['kind']})" for a in r.alternates[:6]))
    return "\n".join(out)


def make_report(spark: SparkSession, args: argparse.Namespace) -> str:
    """The demand report of a sweep, as JSON folders, a page and a summary."""
    sweep = settled(readers.sweep(spark, args.sweep))
    ranked, rejected = report.build(sweep, _frequencies(spark, args.frequencies), cache.read(spark, args.cache) if args.cache else None)
    ranked, rejected = settled(ranked), settled(rejected)
    totals, genres, languages = settled(report.totals(sweep, ranked)), report.by_genre(sweep), settled(report.languages(sweep))
    parts = {"titles": ranked, "rejected": rejected, "totals": totals, "genres": genres, "languages": languages, "kinds": report.by_kind(ranked), "gap": report.gap(sweep)}
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{args.out}/{name}")
    top = ranked.where("confirmed") if ranked.where("confirmed").limit(1).count() else ranked
    page = sinks.report_page(totals, top, genres, languages)
    spark.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(f"{args.out}/page")
    counts = ranked.agg(F.count_if(~F.col("confirmed"))).first()[0], rejected.count()
    return f"{sinks.report_text(totals, top, args.top)}\n\n{counts[0]} unconfirmed, {counts[1]} rejected -> {args.out}"


def learned(spark: SparkSession, args: argparse.Namespace) -> str:
    """Catalogue entries that a sweep's answers add to the catalogue at hand."""
    cat = catalogue.index(readers.catalogue(spark, args.catalogue))
    new = settled(learn.learned(readers.sweep(spark, args.sweep), cat, _frequencies(spark, args.frequencies)))
    new.write.mode("overwrite").json(args.out)
    return f"{new.count()} titles -> {args.out}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="threadlens", description="Titles that comment threads name and ask for.")
    sub = p.add_subparsers(dest="job", required=True)
    one = sub.add_parser("titles", help=titles.__doc__)
    one.add_argument("comments")
    one.add_argument("--limit", type=int, help="comments read of a video, in whole pages (default: all)")
    one.add_argument("--meta", help="folder of API answers about the videos, one a file")
    one.add_argument("--json", action="store_true", help="print one JSON object")
    one.add_argument("--no-discover", action="store_true", help="leave out titles that are in no catalogue")
    one.add_argument("--out", help="folder for all rows")
    two = sub.add_parser("report", help=make_report.__doc__)
    two.add_argument("--cache", help="folder of the title-database cache")
    three = sub.add_parser("learn", help=learned.__doc__)
    for q in (two, three):
        q.add_argument("sweep")
        q.add_argument("--out", required=True)
    for q in (one, three):
        q.add_argument("--catalogue", help="JSON catalogue (default: the built-in one)")
    for q in (one, two, three):
        q.add_argument("--frequencies", help="Parquet table of (word, zipf); without it no word counts as ordinary")
        q.add_argument("--top", type=int, default=25)
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("threadlens").getOrCreate()
    print({"titles": titles, "report": make_report, "learn": learned}[args.job](spark, args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
