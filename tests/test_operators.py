"""Operators end to end on small threads; the three golden suites where their files are at hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import analyze, catalogue, discover, extract, finder, learn, metadata, rank, report, titledb
from threadlens.sources import cache, readers, sinks
from threadlens.streaming import state

#: A folder with fixture.json, adversarial.json and multilingual.json (arrays of comments with what they should give).
SUITES = os.environ.get("TITLE_SUITES", "")
#: Hand-set frequencies of words in the suites: a regression check of the rules, not evidence of accuracy.
ZIPF = {
    "monster": 4.6, "energy": 5.0, "dune": 3.3, "parasite": 3.3, "arrival": 4.3, "bastard": 4.2, "bleach": 3.4, "sweet": 5.0, "home": 5.8, "true": 5.5, "beauty": 4.9, "whiplash": 2.9, "boxer": 3.7,
    "vigilante": 3.2, "prestige": 4.0, "interstellar": 3.4, "berserk": 2.9, "vagabond": 2.7, "death": 5.5, "note": 5.1, "mode": 4.6, "lifestyle": 4.6, "taking": 5.3, "alabama": 4.3, "buggy": 3.0,
}


@pytest.fixture(scope="module")
def cat(spark):
    return catalogue.index(readers.catalogue(spark))


@pytest.fixture(scope="module")
def freq(spark):
    return spark.createDataFrame(list(ZIPF.items()), "word string, zipf double")


@pytest.mark.skipif(not os.path.isdir(SUITES), reason="the suites are not at hand")
def test_extraction_suites(spark, cat, freq):
    rows, wanted = [], []
    for name in ("fixture", "adversarial"):
        with open(f"{SUITES}/{name}.json") as f:
            for i, c in enumerate(json.load(f)):
                rows.append((name, i, c["id"], c["author"], c["text"], 0))
                wanted += [(name, i, t) for t in c["expect"]]
    found = extract.mentions(spark.createDataFrame(rows, readers.COMMENTS), cat, freq)
    score = learn.scores(found.withColumnRenamed("canonical", "title"), spark.createDataFrame(wanted, "video_id string, seq long, title string"), ["video_id", "seq"]).first()
    assert score.r >= 0.95 and score.p >= 0.9
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(SUITES), reason="the suites are not at hand")
def test_multilingual_suite(spark, freq):
    with open(f"{SUITES}/multilingual.json") as f:
        cases = json.load(f)
    comments = spark.createDataFrame([(f"v{i}", 0, "c", "u", c["text"], 0) for i, c in enumerate(cases)], readers.COMMENTS)
    got = {r.video_id: r.f for r in discover.discover(comments, freq).where("rank = 1").select("video_id", T.fold(F.col("title")).alias("f")).collect()}
    wanted = spark.createDataFrame([(f"v{i}", c["expect"]) for i, c in enumerate(cases)], "v string, e string").select("v", T.fold(F.col("e")).alias("e")).collect()
    assert [got.get(r.v) for r in wanted] == [r.e for r in wanted]
    spark.catalog.clearCache()


def test_mentions(spark, cat, freq):
    said = ["Solo Leveling is peak", "sollo levelling was my first manhwa", "read ORV instead", "monster energy is all I drink", "watch Monster, the anime", "first!!"]
    found = extract.mentions(spark.createDataFrame([("v", i, f"c{i}", f"u{i}", t, 0) for i, t in enumerate(said)], readers.COMMENTS), cat, freq)
    got = {(r.seq, r.canonical, r.method) for r in found.collect()}
    assert {(s, c) for s, c, _ in got} == {(0, "Solo Leveling"), (1, "Solo Leveling"), (2, "Omniscient Reader's Viewpoint"), (4, "Monster")}
    spark.catalog.clearCache()


THREAD = [
    ("v", 0, "a", "u1", "In Korean, the title is \"Get Schooled\"", 3), ("v", 1, "b", "u2", "Drama name : Teach You A Lesson", 40), ("v", 2, "c", "u3", "what is the name of this drama?", 5),
    ("v", 3, "c.1", "u4", "@bob12 Teach you a lesson", 9), ("v", 4, "c.2", "u5", "thanks!", 1), ("v", 5, "d", "u6", "it's called TEACH YOU A LESSON!", 2), ("w", 0, "x", "u1", "first!!", 0),
]


def test_discover_and_evidence(spark, freq):
    comments = spark.createDataFrame(THREAD, readers.COMMENTS)
    best = discover.discover(comments, freq).where("rank = 1").collect()
    assert len(best) == 1 and best[0].commenters == 3 and best[0].likes == 51 and best[0].title == "Teach You A Lesson"
    assert {(r.video_id, r.asked, r.asked_likes) for r in discover.demand(comments).collect()} == {("v", 1, 5), ("w", 0, 0)}
    shown = finder.evidence(spark.createDataFrame([("v", "Teach You A Lesson")], "video_id string, name string"), comments).orderBy("place").collect()
    assert [r.text for r in shown] == ["Teach you a lesson", "Drama name : Teach You A Lesson"] and shown[0].question.startswith("what is")


META = [("v", "Ep 3 | Teach You A Lesson | MBC #teachyoualesson", "ch", "Title : Teach You A Lesson\nmore", ["some tag"], 6)]


def test_analyze_and_find(spark, cat, freq):
    comments = spark.createDataFrame(THREAD, readers.COMMENTS)
    meta = spark.createDataFrame(META, "id string, title string, channel string, description string, tags array<string>, comment_count int")
    answers = analyze.analyze(comments, cat, freq, meta).cache()
    first = answers.where("rank = 1").collect()[0]
    assert first.title == "Teach You A Lesson" and first.confidence == "high" and ("Get Schooled", "translated") in [tuple(a) for a in first.alternates]
    assert [r.name for r in metadata.labelled(meta).collect()] == ["Teach You A Lesson"]
    found = finder.find(answers, comments, meta, cat, freq, spark.createDataFrame([], cache.SCHEMA)).collect()
    assert [(r.video_id, r.title, r.step) for r in found] == [("v", "Teach You A Lesson", 1)] and "matches what the uploader wrote" in found[0].note
    spark.catalog.clearCache()


ANILIST = '[{"id":"1","type":"MANGA","format":"MANGA","countryOfOrigin":"KR","title":{"english":"Get Schooled","romaji":"Chamgyoyuk"},"synonyms":["Teach You A Lesson"],"startDate":{"year":2020},"popularity":9,"siteUrl":"u"}]'
ARTICLE = '{"title":"Hidden Love (TV series)","description":"2023 Chinese television series","disambiguation":false,"redirects":[]}'


def test_title_database(spark):
    rows = [("anilist:teach you a lesson", ANILIST, "anilist"), ("wikititle:Hidden Love (TV series)", ARTICLE, "wikipedia"), ("anilist:hidden love", "[]", "anilist")]
    table = spark.createDataFrame(rows, cache.SCHEMA)
    titles = spark.createDataFrame([("Teach You A Lesson",), ("hidden love",), ("Hidden Lover",)], "title string")
    found = {(r.title, r.source, r.kind, r.country, r.primary) for r in titledb.lookup(titles, table).collect()}
    assert found == {("Teach You A Lesson", "anilist", "manhwa", "KR", False), ("hidden love", "wikipedia", "drama", "CN", True)}
    videos = spark.createDataFrame([("1", "hidden love", ["Chinese"], True), ("2", "hidden love", ["Turkish"], True), ("3", "Hidden Lover", ["Chinese"], True)], "vid string, title string, segments array<string>, live boolean")
    assert {r.vid: r.status for r in titledb.choose(videos, titledb.lookup(titles, table)).collect()} == {"1": "confirmed", "2": "contradicted", "3": "unconfirmed"}
    wanted = spark.createDataFrame([("anilist", "anilist:hidden love"), ("anilist", "anilist:new")], "source string, key string")
    assert [r.key for r in cache.missing(wanted, table).collect()] == ["anilist:new"]
    assert cache.merged(table, table.limit(1)).count() == 3


def test_report(spark, freq, tmp_path):
    answer = lambda t, n, conf="high": [(t, conf, ["comments:1"], n, 2, [])]
    rows = [(str(i), "kdrama edit", "", 1, 10, 5, {"es": 4}, answer(t, 1 + i)) for i, t in enumerate(["F4 Thailand", "F4 Thailand", "F4 Thiland", "School 2017", "School 2021", "korean drama", "And then"])]
    sweep = spark.createDataFrame(rows, readers.SWEEP)
    ranked, rejected = report.build(sweep, freq)
    got = {r.title: r.videos for r in ranked.collect()}
    assert got == {"F4 Thailand": 3, "School 2017": 1, "School 2021": 1} and rejected.count() == 0
    page = sinks.report_page(report.totals(sweep), ranked, report.by_genre(sweep), report.languages(sweep))
    assert "F4 Thailand" in page and "F4 Thailand" in sinks.report_text(report.totals(sweep), ranked)
    checked, _ = report.build(sweep, freq, spark.createDataFrame([], cache.SCHEMA))
    assert checked.count() == 3
    spark.catalog.clearCache()


def test_report_over_a_database(spark):
    import json

    freq = spark.createDataFrame([("filter", 4.5), ("reborn", 3.6), ("the", 7.0), ("blue", 5.0), ("lock", 4.6)], "word string, zipf double")
    work = lambda i, english, romaji=None, synonyms=(): {"id": i, "type": "ANIME", "format": "TV", "countryOfOrigin": "JP", "title": {"english": english, "romaji": romaji}, "synonyms": list(synonyms), "startDate": {"year": 2015}, "popularity": 9, "siteUrl": "u"}
    works = {
        "regressor instruction manual": work(1, "How to Use a Returner", synonyms=["Regressor Instruction Manual"]), "blue lock": work(2, "BLUE LOCK"),
        "one punch man": work(3, "One Punch Man", "Wanpanman", ["OPM"]),
    }
    cached = spark.createDataFrame([(k, json.dumps([w]), "anilist") for k, w in works.items()], cache.SCHEMA)
    said = [("Regressor Instruction Manual", []), ("Blue Lock", []), ("blue lock", []), ("One Punch Man", ["saitama"]), ("One Punch Man", ["saitama", "OPM"]), ("Filter", []), ("Reborn", []), ("Qwertle", []), ("Blue Day", [])]
    rows = [(str(i), "anime edit", "", 1, 10, 5, {"es": 4, "en/other": 2}, [(t, "high", ["comments:1"], 1 + i, 2, [(a, "x") for a in alts])]) for i, (t, alts) in enumerate(said)]
    sweep = spark.createDataFrame(rows, readers.SWEEP)
    ranked, _ = report.build(sweep, freq, cached)
    got = {r.title: r for r in ranked.collect()}
    assert {t for t, r in got.items() if r.confirmed} == {"Regressor Instruction Manual", "Blue Lock", "One Punch Man"}
    assert {t for t, r in got.items() if not r.confirmed} == {"Qwertle", "Blue Day"}
    assert got["Regressor Instruction Manual"].alternates == ["How to Use a Returner"] and got["One Punch Man"].alternates == ["OPM", "Wanpanman"]
    assert got["Blue Lock"].videos == 2 and got["Blue Lock"].variants == ["blue lock"]
    totals = report.totals(sweep, ranked).first()
    assert totals.distinct_titles == 3 and totals.non_english_comments == 36
    assert [(r.lang, r.comments, r.reach, r.comments_rank, r.reach_rank) for r in report.languages(sweep).collect()] == [("es", 36, 9, 1, 1), ("en/other", 18, 0, 2, None)]
    spark.catalog.clearCache()


def test_frames_are_tried_wherever_they_match(spark):
    from threadlens.functions import patterns as P

    assert len(P.FRAME_WORDS) == len(P.FRAMES)
    said = [
        "SE LLAMA Hidden Love", "El título es Alfa", "nombre: Beta", "se CHAMA Gama", "o nome é Delta", "НАЗЫВАЕТСЯ Эпсилон", "название: Дзета", "dizinin adı Eta", "filmin ADI Theta", "ismİ: Iota", "ısmi: Kappa",
        "naam: Lambda", "Mu naam hai", "naaam Nu hai", "اسم المسلسل: Xi", "judulnya Omicron", "ça s'appelle Pi", "le TITRE est Rho", "das heißt Sigma", "das HEISST Tau", "si chiama Upsilon", "tên phim là Phi", "truyện", "ชื่อเรื่อง Chi",
        "제목은 Psi", "タイトルは Omega", "片名是 Alef", "pamagat ay Bet", "tytuł: Gimel", "the drama name is Dalet", "TITLE: He", "it's called Vav", "thiſ is called Zayin", 'so "Het" then', "“Tet”", "Yod is on NETFLIX", "Kaf manhwa", "Lamed Drama",
        "look up Mem", "WATCH Nun", "boo\u212a", "nothing here", "", None,
    ]
    comments = spark.createDataFrame([(str(i % 3), i, str(i), "a", t, 1) for i, t in enumerate(said)], readers.COMMENT if hasattr(readers, "COMMENT") else "video_id string, seq long, id string, author string, text string, likes long")
    body = discover.bodies(comments)
    rows = lambda held: sorted(map(tuple, discover.frame_slots(body, P.FRAMES, held=held).collect()))
    every = rows(None)
    assert rows(P.FRAME_WORDS) == every and len({r[2] for r in every}) >= 20 and len(every) >= 35


def test_learned(spark, cat, freq):
    a = [("Lily Fever", "high", ["comments:4"], 4, 2, [("Lily Fevr", "aka")]), ("Monster", "high", ["comments:4"], 4, 2, []), ("Dune", "low", ["comments:9"], 9, 0, []), ("Rare Thing", "low", ["comments:1"], 1, 0, [])]
    sweep = spark.createDataFrame([("1", "q", "t", 0, 0, 0, {}, a)], readers.SWEEP)
    assert [(r.canonical, r.aliases) for r in learn.learned(sweep, cat, freq).collect()] == [("Lily Fever", ["Lily Fevr"])]


def test_sources(spark, tmp_path):
    (tmp_path / "vid1.json").write_text(json.dumps(["plain text", {"id": "x", "author": "me", "text": "hello", "likes": 3}, {"text": "only"}]))
    got = readers.comments(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.video_id, r.id, r.author, r.text, r.likes) for r in got] == [("vid1", "c0", "user0", "plain text", 0), ("vid1", "x", "me", "hello", 3), ("vid1", "c2", "user2", "only", 0)]
    pages = spark.createDataFrame([(i,) for i in range(250)], "n int").selectExpr("'v' as video_id", "n div 100 as page", "n")
    assert readers.limited(pages, 150).count() == 200
    ranked = rank.rank(spark.createDataFrame([("A", "k", "", "exact", 100.0, "a", "some text", 1)], "canonical string, kind string, author string, method string, score double, raw string, text string, seq long"))
    assert "A" in sinks.table(ranked) and json.loads(sinks.json_lines(ranked, 1)[0])["commenters"] == 1


def plain_gate(events, limit, seconds):
    held, out = {}, {}
    for i, key, t in events:
        times = [x for x in held.get(key, []) if t - x < seconds]
        out[i] = len(times) < limit
        held[key] = times + [t] if out[i] else times
    return out


def test_gates(spark, tmp_path):
    events = [(i, i % 3, float((i * 37) % 400)) for i in range(120)]
    events.sort(key=lambda e: (e[2], e[0]))
    df = spark.createDataFrame(events, "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    wanted = plain_gate(events, 2, 60.0)
    assert {r.event_id: r.accepted for r in state.gate(df, "user_id", 2, 60.0).collect()} == wanted
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    q = state.gated(stream, "user_id", 2, 60.0).writeStream.outputMode("update").format("memory").queryName("gated").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.table("gated").collect()} == wanted


def test_names_table(spark):
    table = spark.createDataFrame([("v", "a b", "A b", 2, None, 1, 5)], "video_id string, folded string, name string, count long, db string, first long, last long")
    posts = spark.createDataFrame([("v", "a b", "a B", None, 9), ("v", "c", "C", "db", 7)], "video_id string, folded string, name string, db string, ts long")
    got = {r.folded: (r.name, r["count"], r.db, r["first"], r["last"]) for r in state.upsert_names(table, posts).collect()}
    assert got == {"a b": ("A b", 3, None, 1, 9), "c": ("C", 1, "db", 7, 7)}
