"""Registered queries: each applies an operator of the library to whole tables; most have an equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import similarity as S
from ..functions import text as T
from ..functions.lineage import settled
from ..operators import aliases, catalogue, cluster, discover, extract, finder, learn, metadata, rank, report, titledb, words
from ..operators import analyze as fusion
from ..sources import cache as store
from ..sources import readers
from ..streaming import state
from . import view
from .view import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return view.titled(spark, sf).select(
        F.col("title").alias("canonical"), F.lit("part").alias("kind"), F.col("o_custkey").cast("string").alias("author"), F.col("o_orderpriority").alias("method"),
        (F.col("o_orderkey") % 100).cast("double").alias("score"), F.col("title").alias("raw"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("seq"),
    )


# ---- ranking and aggregates over mentions


@query(f"""WITH {view.SQL} SELECT title AS canonical, count(DISTINCT o_custkey) AS commenters, count(*) AS mentions, round(avg((o_orderkey % 100)::DOUBLE), 1) AS confidence
    FROM titled GROUP BY title ORDER BY commenters DESC, mentions DESC, canonical LIMIT 25""")
def rank_titles(spark, sf):
    return rank.ordered(rank.rank(_mentions(spark, sf)), 25).select("canonical", "commenters", "mentions", "confidence")


@query(f"WITH {view.SQL} SELECT title AS canonical, o_orderpriority AS method, count(*) AS n FROM titled GROUP BY ALL")
def method_histogram(spark, sf):
    return rank.rank(_mentions(spark, sf)).select("canonical", F.explode("methods").alias("method", "n"))


@query(f"WITH {view.SQL} SELECT o_custkey AS author, title, min(o_orderkey) AS first FROM titled GROUP BY ALL")
def first_mention_dedupe(spark, sf):
    one = W.partitionBy("o_custkey", "title").orderBy("o_orderkey")
    return view.titled(spark, sf).withColumn("n", F.row_number().over(one)).where("n = 1").select(F.col("o_custkey").alias("author"), "title", F.col("o_orderkey").alias("first"))


@query("""WITH m AS (SELECT l_orderkey % 5000 AS video_id, l_orderkey AS seq, l_linenumber AS pos, l_quantity AS ambiguity, l_linenumber AS evidence FROM lineitem),
    a AS (SELECT *, max(CASE WHEN ambiguity < 2.2 AND evidence >= -2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, seq) AS anchored FROM m)
    SELECT video_id, seq, pos, evidence + 2 * anchored AS evidence FROM a WHERE evidence + 2 * anchored >= CASE WHEN ambiguity >= 2.2 THEN 2 ELSE -2 END""")
def anchor_flag(spark, sf):
    m = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5000).alias("video_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("ambiguity"), F.col("l_linenumber").alias("evidence"), F.lit("exact").alias("method"), F.array().cast("array<string>").alias("reasons"))
    return extract.accepted(m).select("video_id", "seq", "pos", "evidence")


# ---- catalogue joins


@query(f"WITH {view.SQL} SELECT comment_id, title AS canonical FROM c WHERE comment_id % 6 < 4")
def exact_alias_join(spark, sf):
    cat = catalogue.index(view.catalogue_rows(spark, sf))
    body = extract.cleaned(view.threads(spark, sf))
    grams = extract.grams(body, cat.longest)
    return grams.join(cat.alias, grams["gram"] == cat.alias["key"]).select(F.col("seq").alias("comment_id"), "canonical").distinct()


@query("""WITH n AS (SELECT DISTINCT p_name AS canonical FROM part),
    a AS (SELECT canonical, array_to_string(list_transform(string_split(canonical, ' '), lambda x: x[1]), '') AS key FROM n)
    SELECT key, min(canonical) AS canonical FROM a WHERE len(key) >= 2 GROUP BY key HAVING count(*) = 1""")
def acronym_unique(spark, sf):
    return catalogue.index(view.catalogue_rows(spark, sf)).acronym


@query("""WITH n AS (SELECT DISTINCT p_name AS key, replace(p_name, ' ', '') AS t FROM part),
    g AS (SELECT DISTINCT key, substr(t, i, 3) AS tri FROM (SELECT key, t, unnest(range(1, len(t) - 1)) AS i FROM n))
    SELECT a.key, b.key AS alias FROM g a JOIN g b USING (tri) GROUP BY ALL HAVING count(*) >= 3""")
def trigram_block(spark, sf):
    cat = catalogue.index(view.catalogue_rows(spark, sf))
    return extract.blocked(cat.alias.select("key"), cat, 3)


_PERTURBED = "CASE p_partkey % 7 WHEN 0 THEN p_name || 's' WHEN 1 THEN p_name[1:3] || p_name[3:] WHEN 2 THEN p_name[2:] ELSE p_name END"
_LCS = """list_extract(list_reduce(range(1, len({a}) + 1), lambda before, i: list_reduce(range(1, len({b}) + 1), lambda done, j: list_append(done,
    CASE WHEN {a}[i:i] = {b}[j:j] THEN before[j] + 1 ELSE greatest(before[j + 1], done[-1]) END), [0::BIGINT]), list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT)), -1)"""


def _perturbed(spark, sf):
    p, k = F.col("p_name"), F.col("p_partkey") % 7
    text = F.when(k == 0, F.concat(p, F.lit("s"))).when(k == 1, F.concat(F.substring(p, 1, 3), F.substr(p, F.lit(3)))).when(k == 2, F.substr(p, F.lit(2))).otherwise(p)
    return table(spark, sf, "part").select("p_partkey", text.alias("name"), p.alias("p_name"))


@query(f"""WITH p AS (SELECT DISTINCT p_name AS a, {_PERTURBED} AS b FROM part), r AS (SELECT a, b, {_LCS.format(a="a", b="b")} AS lcs FROM p)
    SELECT a, b, round(200.0::DOUBLE * lcs / (len(a) + len(b)), 6) AS ratio FROM r""")
def indel_ratio(spark, sf):
    p = _perturbed(spark, sf).select(F.col("p_name").alias("a"), F.col("name").alias("b")).distinct()
    return p.select("a", "b", F.round(S.ratio_native(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"""WITH p AS (SELECT DISTINCT {_PERTURBED} AS key FROM part), n AS (SELECT DISTINCT p_name AS alias FROM part),
    r AS (SELECT key, alias, 200.0::DOUBLE * {_LCS.format(a="key", b="alias")} / (len(key) + len(alias)) AS score FROM p, n WHERE 200 * least(len(key), len(alias)) >= 88 * (len(key) + len(alias)))
    SELECT key, alias, round(score, 6) AS score FROM r WHERE score >= 88 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, alias) = 1""")
def fuzzy_resolve(spark, sf):
    cat = catalogue.index(view.catalogue_rows(spark, sf))
    pairs = extract.blocked(_perturbed(spark, sf).select(F.col("name").alias("key")).distinct(), cat, 2)
    scored = pairs.where(S.can_reach(F.col("key"), F.col("alias"), 88.0)).withColumn("score", S.ratio("key", "alias")).where("score >= 88")
    best = scored.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "alias"))).where("n = 1")
    return best.select("key", "alias", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT DISTINCT {_PERTURBED} AS key FROM part), n AS (SELECT DISTINCT p_name AS alias FROM part)
    SELECT key, CASE WHEN EXISTS (SELECT 1 FROM n WHERE alias = key) THEN 'exact' ELSE 'other' END AS method FROM p""")
def priority_resolve(spark, sf):
    cat = catalogue.index(view.catalogue_rows(spark, sf))
    keys = _perturbed(spark, sf).select(F.col("name").alias("key")).distinct()
    found = extract.resolve(keys, cat, spark.createDataFrame([], "word string, zipf double")).where("method = 'exact'")
    return keys.join(found.select("key", "method"), "key", "left").select("key", F.coalesce("method", F.lit("other")).alias("method"))


# ---- text functions

_FOLD = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({t})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_FOLD.format(t='text')}) AS folded FROM documents")
def fold_documents(spark, sf):
    return table(spark, sf, "documents").withColumn("f", T.fold(F.col("text"))).select("doc_id", F.md5(F.col("f").cast("binary")).alias("folded"))


@query(f"""WITH w AS (SELECT doc_id, string_split({_FOLD.format(t="text")}, ' ') AS w FROM documents), g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM w, range(1, 4) r(n))
    SELECT n, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM g GROUP BY n""")
def ngram_sweep(spark, sf):
    docs = table(spark, sf, "documents").withColumn("f", T.fold(F.col("text")))
    # told apart by 94 bits of hashes, with n in two more: as numbers they move in few bytes, and without counts beside them
    grams = docs.select(F.inline(T.ngrams(T.words_of(F.col("f")), 3))).select(F.col("n").cast("long").alias("n"), "gram")
    tail = F.shiftleft(F.xxhash64("gram", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)), 2).bitwiseOR(F.col("n"))
    each = grams.select(F.xxhash64("gram").alias("a"), tail.alias("b")).distinct()
    counted = docs.select(T.words_of(F.col("f")).alias("w")).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(n.cast("long").alias("n"), F.greatest(F.size("w") - n + 1, F.lit(0)).cast("long").alias("c")))).alias("x"))
    total = counted.groupBy("x.n").agg(F.sum("x.c").alias("grams")).where("grams > 0")
    return total.join(each.groupBy(F.col("b").bitwiseAND(F.lit(3)).alias("n")).agg(F.count("*").alias("distinct_grams")), "n")


@query(f"""WITH w AS (SELECT unnest(string_split({_FOLD.format(t="text")}, ' ')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word)
    SELECT word, round(log10(n * 1e9 / (SELECT sum(n) FROM c)), 6) AS zipf FROM c""")
def zipf_table(spark, sf):
    return words.frequencies(table(spark, sf, "documents")).select("word", F.round("zipf", 6).alias("zipf"))


@query("""WITH n AS (SELECT DISTINCT p_name AS span FROM part), w AS (SELECT span, unnest(string_split(span, ' ')) AS word FROM n),
    c AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part), z AS (SELECT word, log10(count(*) * 1e9 / (SELECT count(*) FROM c)) AS zipf FROM c GROUP BY word)
    SELECT span, round(min(zipf) - 1.2 * (count(*) - 1), 6) AS ambiguity FROM w JOIN z USING (word) GROUP BY span""")
def token_ambiguity(spark, sf):
    part = table(spark, sf, "part")
    return words.ambiguity(part.select("p_name"), words.frequencies(part, "p_name"), "p_name").select("span", F.round("ambiguity", 6).alias("ambiguity"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'the ' || p_name || ' movie' WHEN 1 THEN p_name || ' season 2' WHEN 2 THEN 'is a ' || p_name || ' by me' ELSE p_name END AS span, p_name FROM part) SELECT p_partkey, p_name AS key FROM t""")
def strip_noise(spark, sf):
    p, k = F.col("p_name"), F.col("p_partkey") % 4
    span = F.when(k == 0, F.concat(F.lit("the "), p, F.lit(" movie"))).when(k == 1, F.concat(p, F.lit(" season 2"))).when(k == 2, F.concat(F.lit("is a "), p, F.lit(" by me"))).otherwise(p)
    return T.with_span_key(table(spark, sf, "part").withColumn("span", span)).select("p_partkey", "key")


@query("""SELECT p_partkey, p_name AS key FROM part""")
def group_key(spark, sf):
    p, k = F.col("p_name"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("The "), F.initcap(p), F.lit("!!"))).when(k == 1, F.concat(F.upper(p), F.lit(" Webtoon"))).when(k == 2, F.concat(F.lit("a "), p, F.lit(")"))).otherwise(p)
    return T.with_group_key(table(spark, sf, "part").withColumn("name", name), "name", "key").select("p_partkey", "key")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name WHEN 2 THEN upper(p_name[1]) || p_name[2:] WHEN 3 THEN '' ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS t FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN -1 ELSE 3 END AS score, p_partkey % 5 IN (0, 4) AS title_case FROM t""")
def case_scores(spark, sf):
    p, k = F.col("p_name"), F.col("p_partkey") % 5
    name = F.when(k == 0, F.upper(p)).when(k == 1, p).when(k == 2, F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))).when(k == 3, "").otherwise(F.initcap(p))
    return table(spark, sf, "part").withColumn("name", name).select("p_partkey", T.case_score(F.col("name")).alias("score"), T.is_title_case(F.col("name")).alias("title_case"))


@query("""SELECT n_nationkey, r.r_name || ' drama' AS text, CASE WHEN n_nationkey % 3 = 0 THEN true ELSE false END AS descriptor FROM nation JOIN region r ON n_regionkey = r_regionkey""")
def descriptors(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    phrase = F.when(F.col("n_nationkey") % 3 == 0, "turkish series").when(F.col("n_nationkey") % 3 == 1, "love song").otherwise("chinese zodiac")
    return both.select("n_nationkey", F.concat("r_name", F.lit(" drama")).alias("text"), T.is_descriptor(phrase).alias("descriptor"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 11, 'a') WHEN 1 THEN lpad(o_orderkey::VARCHAR, 11, 'b') WHEN 2 THEN lpad(o_orderkey::VARCHAR, 11, 'c') END AS video FROM orders""")
def video_ids(spark, sf):
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 4
    url = F.when(m == 0, F.lpad(k, 11, "a")).when(m == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(k, 11, "b"), F.lit("&t=3"))).when(m == 2, F.concat(F.lit("https://youtu.be/"), F.lpad(k, 11, "c"))).otherwise("no video here")
    return table(spark, sf, "orders").withColumn("url", url).select("o_orderkey", T.video_id(F.col("url")).alias("video"))


@query("""WITH q AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'kdrama funny scene' WHEN 'de' THEN 'Anime edit' WHEN 'fr' THEN 'school romance' ELSE 'cooking' END AS q FROM documents)
    SELECT doc_id, CASE q WHEN 'kdrama funny scene' THEN 'Korean' WHEN 'Anime edit' THEN 'Anime' WHEN 'school romance' THEN 'School drama' ELSE 'Other' END AS genre,
           CASE q WHEN 'kdrama funny scene' THEN 'Korean,General drama' WHEN 'Anime edit' THEN 'Anime' WHEN 'school romance' THEN 'School drama,Romance' ELSE '' END AS segments FROM q""")
def genre_case(spark, sf):
    q = F.when(F.col("lang") == "en", "kdrama funny scene").when(F.col("lang") == "de", "Anime edit").when(F.col("lang") == "fr", "school romance").otherwise("cooking")
    return table(spark, sf, "documents").withColumn("q", q).select("doc_id", T.genre_of(F.col("q")).alias("genre"), F.array_join(T.segments_of(F.col("q")), ",").alias("segments"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(url, 'https?://\S+|www\.\S+', ' ', 'g'), '\b\d{1,2}:\d{2}(?::\d{2})?\b', ' ', 'g'), '<br>', ' '), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS cleaned,
    len(url) AS n FROM (SELECT page_id, 'at 1:02:33 see ' || url || ' a &amp; b<br>&quot;c&quot;' AS url FROM pages)""")
def clean_comments(spark, sf):
    text = F.concat(F.lit("at 1:02:33 see "), F.col("url"), F.lit(" a &amp; b<br>&quot;c&quot;"))
    return table(spark, sf, "pages").withColumn("t", text).select("page_id", F.md5(T.clean(F.col("t")).cast("binary")).alias("cleaned"), F.char_length("t").cast("long").alias("n"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), s AS (SELECT page_id, string_split_regex(title, '\. ') AS parts FROM t)
    SELECT page_id, unnest(range(0, len(parts)))::INTEGER AS pos, trim(unnest(parts)) AS part FROM s""")
def html_title_segments(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.posexplode(F.split(title, r"\. ")).alias("pos", "raw")).select("page_id", "pos", F.trim("raw").alias("part"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '["“”]([^"“”]{2,60})["“”]', 1)) AS quoted, len(regexp_extract_all(text, '[A-Z]{2,6}', 0)) AS caps FROM documents""")
def quoted_and_caps(spark, sf):
    quoted, caps = (F.size(F.regexp_extract_all("text", F.lit(p), F.lit(g))).cast("long") for p, g in ((r'["“”]([^"“”]{2,60})["“”]', 1), ("[A-Z]{2,6}", 0)))
    return table(spark, sf, "documents").select("doc_id", quoted.alias("quoted"), caps.alias("caps"))


@query(f"""WITH w AS (SELECT doc_id, string_split({_FOLD.format(t="text")}, ' ') AS w FROM documents), p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before, w[i + 1] AS after FROM w, unnest(range(1, len(w) + 1)) r(i))
    SELECT before, after, count(*) AS n FROM p WHERE word = 'the' GROUP BY ALL""")
def neighbour_words(spark, sf):
    docs = table(spark, sf, "documents").withColumn("f", T.fold(F.col("text")))
    each = docs.select(F.posexplode(T.words_of(F.col("f"))).alias("i", "word"), T.words_of(F.col("f")).alias("w")).where("word = 'the'")
    return each.groupBy(F.get("w", F.col("i") - 1).alias("before"), F.get("w", F.col("i") + 1).alias("after")).agg(F.count("*").alias("n"))


# ---- open discovery

_SHAPES = """SELECT video_id, comment_id, author, likes, title AS slot, CASE comment_id % 6 WHEN 0 THEN 'named' WHEN 1 THEN 'called' WHEN 2 THEN 'quoted' ELSE 'lang:es' END AS frame FROM c WHERE comment_id % 6 < 4"""


@query(f"WITH {view.SQL} SELECT comment_id, frame, slot FROM ({_SHAPES})")
def frame_extract(spark, sf):
    body = discover.bodies(view.threads(spark, sf))
    return discover.slots(discover.frame_slots(body, P.FRAMES, held=P.FRAME_WORDS)).select(F.col("seq").alias("comment_id"), "frame", "slot")


@query(f"WITH {view.SQL} SELECT video_id::VARCHAR AS video_id, frame, count(*) AS n FROM ({_SHAPES}) GROUP BY ALL")
def frame_histogram(spark, sf):
    body = discover.bodies(view.threads(spark, sf))
    hits = discover.slots(discover.frame_slots(body, P.FRAMES, held=P.FRAME_WORDS))
    return rank.histogram(hits, ["video_id"], "frame", "frames").select("video_id", F.explode("frames").alias("frame", "n"))


@query(f"WITH {view.SQL} SELECT video_id::VARCHAR AS video_id, count(*) FILTER (comment_id % 6 = 4) AS asked, coalesce(sum(likes) FILTER (comment_id % 6 = 4), 0)::BIGINT AS asked_likes FROM c GROUP BY video_id")
def demand_by_video(spark, sf):
    return discover.demand(view.threads(spark, sf))


@query(f"""WITH {view.SQL}, h AS ({_SHAPES}) SELECT video_id::VARCHAR AS video_id, slot AS title, count(DISTINCT author) AS commenters, sum(likes)::BIGINT AS likes, count(*) FILTER (frame <> 'quoted') AS strength FROM h GROUP BY ALL HAVING count(*) FILTER (frame <> 'quoted') >= 1""")
def discover_exact_fold(spark, sf):
    body = discover.bodies(view.threads(spark, sf)).cache()
    hits = settled(discover.hits(body, spark.createDataFrame([], "word string, zipf double"))).withColumn("leader", F.col("folded"))
    return discover.summarise(hits, body).select("video_id", "title", "commenters", "likes", "strength")


@query("""SELECT a.conv_id, a.turn, len(p.text) AS parent_chars FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 AND p.role = 'user'""")
def reply_parents(spark, sf):
    c = table(spark, sf, "conversations")
    body = c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seq"), F.concat(F.col("turn").cast("string")).alias("id"), "role", "text", F.lit(0).alias("likes"), F.col("text").alias("body"))
    asked = body.where("role = 'user'").withColumn("id", F.concat(F.lit("q"), (F.col("seq") + 1).cast("string")))
    given = body.withColumn("id", F.concat(F.lit("q"), F.col("seq").cast("string"), F.lit(".a")))
    both = discover.replies(asked.unionByName(given))
    return both.select(F.col("video_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"), F.char_length("parent_text").cast("long").alias("parent_chars"))


@query(f"WITH {view.SQL} SELECT video_id::VARCHAR AS video_id, title AS name, count(DISTINCT author) AS commenters FROM c GROUP BY ALL")
def alias_frames(spark, sf):
    c = view.comments(spark, sf)
    said = c.select(F.col("video_id").cast("string").alias("video_id"), F.col("comment_id").alias("seq"), F.col("comment_id").cast("string").alias("id"), F.col("author").cast("string").alias("author"), F.concat(F.lit("also known as "), F.col("title")).alias("text"), "likes")
    return aliases.stated(said).select("video_id", "name", "commenters")


@query("""WITH r AS (SELECT conv_id, turn, len(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY len(text) DESC, turn) AS place FROM conversations) SELECT conv_id, turn, n, place::INTEGER AS place FROM r WHERE place <= 2""")
def topk_evidence(spark, sf):
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "turn"))
    return table(spark, sf, "conversations").withColumn("n", F.char_length("text").cast("long")).withColumn("place", place).where("place <= 2").select("conv_id", "turn", "n", "place")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def report_map_merge(spark, sf):
    return rank.histogram(table(spark, sf, "documents"), ["source"], "lang", "langs").select("source", F.explode("langs").alias("lang", "n"))


# ---- report


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A sweep's results over the orders: fifty titles of parts as answers, their tier and counters by the keys."""
    t, k = view.titled(spark, sf), F.col("o_orderkey")
    conf = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    answer = F.struct(F.col("title"), conf.alias("conf"), F.array(F.lit("comments:3")).alias("sources"), (k % 7).alias("commenters"), (k % 100).alias("likes"), F.array().cast("array<struct<name: string, kind: string>>").alias("alternates"))
    langs = F.map_from_arrays(F.array(F.lit("en/other"), F.lit("es")), F.array((k % 5).cast("long"), (k % 4).cast("long")))
    return t.select(k.cast("string").alias("vid"), F.when(k % 2 == 0, "kdrama edit").otherwise("anime edit").alias("query"), F.lit("").alias("title"), (k % 11).alias("asked"), (k % 1000).alias("views"), (k % 13).alias("n_comments"), langs.alias("langs"), F.array(answer).alias("answers"))


@query(f"""WITH {view.SQL} SELECT title AS key, count(*) AS videos, sum(o_orderkey % 7)::BIGINT AS commenters, sum(o_orderkey % 100)::BIGINT AS likes, sum(o_orderkey % 11)::BIGINT AS demand,
    sum(o_orderkey % 1000)::BIGINT AS views, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.5 END), 2) AS confidence FROM titled WHERE o_orderkey % 3 < 2 GROUP BY title""")
def report_rollup(spark, sf):
    found = report.answers_of(_sweep(spark, sf)).withColumn("entity", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ': ', 1) for x in report.ENTITY_FIELDS)}>"))
    freq = words.frequencies(table(spark, sf, "part"), "p_name")
    return report.rows(found, freq).select("key", "videos", "commenters", "likes", "demand", "views", "confidence")


@query(f"""WITH {view.SQL} SELECT count(*) AS videos, sum(o_orderkey % 13)::BIGINT AS comments, sum(o_orderkey % 11)::BIGINT AS people_asking, count(*) FILTER (o_orderkey % 11 > 0) AS videos_with_demand,
    count(*) FILTER (o_orderkey % 3 = 0) AS videos_answered_high, count(*) FILTER (o_orderkey % 11 > 0 AND o_orderkey % 3 <> 0) AS demand_gap, sum(o_orderkey % 4)::BIGINT AS non_english_comments FROM titled""")
def report_totals(spark, sf):
    return report.totals(_sweep(spark, sf))


@query(f"""WITH {view.SQL} SELECT 'en/other' AS lang, sum(o_orderkey % 5)::BIGINT AS comments, 0::BIGINT AS reach FROM titled UNION ALL SELECT 'es', sum(o_orderkey % 4)::BIGINT, count(*) FILTER (o_orderkey % 4 >= 3) FROM titled""")
def language_reach(spark, sf):
    return report.languages(_sweep(spark, sf)).select("lang", "comments", "reach")


@query(f"WITH {view.SQL} SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Korean' ELSE 'Anime' END AS genre, count(*) AS videos FROM titled GROUP BY ALL")
def report_by_genre(spark, sf):
    return report.by_genre(_sweep(spark, sf))


@query(f"""WITH {view.SQL} SELECT o_orderkey::VARCHAR AS vid, o_orderkey % 11 AS asked FROM titled WHERE o_orderkey % 11 > 0 AND o_orderkey % 3 <> 0 ORDER BY asked DESC, vid LIMIT 10""")
def demand_gap(spark, sf):
    s = _sweep(spark, sf)
    return report.gap(s.withColumn("title", F.col("vid"))).select(F.col("title").alias("vid"), "asked")


@query("""WITH n AS (SELECT p_name AS key, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name FROM part)
    SELECT key, arg_max(name, CASE WHEN name = key THEN 1 WHEN name = upper(key) THEN 0 ELSE 3 END) AS title_raw FROM n GROUP BY key""")
def display_form_max_by(spark, sf):
    p, k = F.col("p_name"), F.col("p_partkey") % 3
    name = F.when(k == 0, p).when(k == 1, F.upper(p)).otherwise(F.initcap(p))
    n = table(spark, sf, "part").select(p.alias("key"), name.alias("name")).groupBy("key", "name").agg(F.count("*").alias("n"))
    order = F.struct(T.case_score(F.col("name")), "n")
    return n.groupBy("key").agg(F.max_by("name", order).alias("title_raw"))


@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), w AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
    n AS (SELECT count(*) FILTER (g.doc_id IS NOT NULL AND w.doc_id IS NOT NULL) AS tp, count(*) FILTER (w.doc_id IS NULL) AS fp, count(*) FILTER (g.doc_id IS NULL) AS fn FROM g FULL JOIN w USING (doc_id))
    SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS p, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS r FROM n""")
def prf_scoring(spark, sf):
    labels = table(spark, sf, "labels")
    one = lambda c: labels.where(c).select("doc_id", F.lit("x").alias("title"))
    return learn.scores(one("toxic = 1"), one("quality = 0"), ["doc_id"]).select("tp", "fp", "fn", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


# ---- title database


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as a database's works: their kind and country by the key."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "drama").when(k % 3 == 1, "film").otherwise("manhwa")
    country = F.when(k % 4 == 0, "KR").when(k % 4 == 1, "TR").when(k % 4 == 2, "US")
    return table(spark, sf, "part").select(
        F.col("p_name").alias("title_key"), F.lit("anilist").alias("source"), k.cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_name").alias("names"), kind.alias("kind"), country.alias("country"),
        (F.lit(1990) + F.col("p_size") % 30).cast("int").alias("year"), F.lit("").alias("url"), F.lit(False).alias("spanish"), F.lit(0).alias("rank"), F.lit(False).alias("searched"), k.alias("popularity"),
    )


_ENTITY = """e AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'drama' WHEN 1 THEN 'film' ELSE 'manhwa' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'KR' WHEN 1 THEN 'TR' WHEN 2 THEN 'US' END AS country, 1990 + p_size % 30 AS year FROM part)"""


@query(f"""WITH {_ENTITY}, v AS (SELECT DISTINCT p_name AS title FROM part), f AS (SELECT title, e.*, CASE WHEN country = 'KR' THEN 1 ELSE 0 END AS known,
        country = 'KR' OR (country IS NULL AND kind IN ('drama', 'film') AND year >= 1995) AS fit FROM v LEFT JOIN e ON e.name = v.title)
    SELECT title, CASE WHEN bool_or(coalesce(fit, false)) THEN 'confirmed' WHEN count(id) > 0 THEN 'contradicted' ELSE 'unconfirmed' END AS status,
           arg_max(id, known * 100000000000000 + (kind IN ('drama', 'film'))::INT * 10000000000000 + id) FILTER (fit)::VARCHAR AS entity FROM f GROUP BY title""")
def entity_choice(spark, sf):
    titles = table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    videos = titles.select(F.col("title").alias("vid"), "title", F.array(F.lit("Korean")).alias("segments"), F.lit(True).alias("live"))
    return titledb.choose(videos, titledb.matching(titles, _entities(spark, sf))).select("title", "status", F.col("entity.id").alias("entity"))


@query(f"""WITH {_ENTITY} SELECT id::VARCHAR AS id, CASE kind WHEN 'drama' THEN CASE country WHEN 'KR' THEN 'K-drama' WHEN 'TR' THEN 'Turkish series' ELSE 'TV series' END
    WHEN 'film' THEN CASE country WHEN 'KR' THEN 'Korean film' WHEN 'US' THEN 'American film' ELSE 'Film' END ELSE 'Manhwa' END AS label FROM e""")
def kind_labels(spark, sf):
    return _entities(spark, sf).select("id", titledb.kind_label(F.col("kind"), F.col("country"), F.col("spanish")).alias("label"))


@query("""WITH t AS (SELECT DISTINCT p_name AS title FROM part), f AS (SELECT title, unnest(list_distinct([upper(title[1]) || title[2:], array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || w[2:]), ' ')])) AS f FROM t)
    SELECT title, f || s AS variant FROM f, unnest(['', ' (TV series)', ' (South Korean TV series)', ' (Chinese TV series)', ' (Thai TV series)', ' (Japanese TV series)', ' (film)', ' (web series)', ' (manhwa)', ' (telenovela)']) u(s)""")
def wiki_variants(spark, sf):
    return titledb.wiki_variants(table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()).select("title", "variant")


@query("SELECT DISTINCT p_name AS key FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_name < 'm')")
def cache_missing(spark, sf):
    keys = table(spark, sf, "part").select(F.lit("anilist").alias("source"), F.col("p_name").alias("key"), "p_partkey")
    return store.missing(keys, keys.where("key < 'm'")).select("key")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 3) || CASE WHEN o_custkey % 3 = 1 THEN ' person' ELSE ' people' END || ' named it in the comments' || CASE WHEN o_custkey % 2 = 0 THEN ', and it matches what the uploader wrote.' ELSE '.' END ELSE 'The uploader wrote it, and it matches a known title.' END
    WHEN 1 THEN CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 3) || CASE WHEN o_custkey % 3 = 1 THEN ' person' ELSE ' people' END || ' named it in the comments. Likely, but worth a quick check.' ELSE 'The uploader wrote it. Likely, but nobody in the comments confirmed it.' END
    ELSE 'Only a guess from what the uploader wrote. Nobody in the comments confirmed it.' END AS note FROM orders""")
def confidence_note(spark, sf):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    tier = F.when(k == 0, "high").when(k == 1, "medium").otherwise("low")
    return table(spark, sf, "orders").select("o_orderkey", finder.note(tier, c % 3, c % 2 == 0).alias("note"))


# ---- sets


@query("""WITH a AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 3 = 0)
    SELECT 'both' AS side, w FROM a INTERSECT SELECT 'both', w FROM b UNION ALL (SELECT 'first' AS side, w FROM a EXCEPT SELECT 'first', w FROM b)""")
def set_operations(spark, sf):
    p = table(spark, sf, "part")
    a, b = (p.where(c).select(F.explode(F.split("p_name", " ")).alias("w")).distinct() for c in ("p_partkey % 2 = 0", "p_partkey % 3 = 0"))
    return a.intersect(b).select(F.lit("both").alias("side"), "w").union(a.exceptAll(b).select(F.lit("first"), "w"))


# ---- events: daily counters, rolling counts, streams

_DAY = "strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d')"


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, sf):
    return state.daily(table(spark, sf, "events"), "event_type")


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = "stream_daily_counts"
    spark.catalog.dropTempView(name)
    q = state.daily(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("""SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))::BIGINT AS n FROM events""")
def rolling_hour_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(W.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)).alias("n"))


@query(f"""WITH d AS (SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, event_type, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS last7 FROM d""")
def last7_rows(spark, sf):
    d = state.daily(table(spark, sf, "events"), "event_type")
    return d.select("day", "event_type", F.sum("n").over(W.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)).alias("last7"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def vote_shares(spark, sf):
    return state.shares(table(spark, sf, "events"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    return state.windowed(table(spark, sf, "events"), "event_type").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


# ---- order-dependent: SQL goes through each key's events one by one

_GATE = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    g AS (SELECT user_id, event_id, n, true AS accepted, t AS last, NULL::BIGINT AS earlier FROM e WHERE n = 1
        UNION ALL SELECT user_id, event_id, n, ok, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN last ELSE earlier END
        FROM (SELECT e.*, g.last, g.earlier, coalesce(e.t - g.{held} >= {us}, true) AS ok FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1))
    SELECT user_id, event_id, {out} FROM g"""


@query(_GATE.format(held="earlier", us=3_600_000_000, out="accepted"))
def rate_limit(spark, sf):
    return state.gate(table(spark, sf, "events"), "user_id", 2, 3600.0)


@query(_GATE.format(held="last", us=21_600_000_000, out="NOT accepted AS hit"))
def answer_cache(spark, sf):
    return state.cached(table(spark, sf, "events"), "user_id", 6 * 3600.0)


_LED = f"""WITH RECURSIVE p AS (SELECT p_partkey % 20 AS video_id, p_partkey AS seq, {_PERTURBED} AS name FROM part), u AS (SELECT DISTINCT name FROM p),
    s AS (SELECT x.name AS a, list(y.name) AS near FROM u x JOIN u y ON x.name <> y.name AND 200 * least(len(x.name), len(y.name)) >= 88 * (len(x.name) + len(y.name))
        AND 200 * {_LCS.format(a="x.name", b="y.name")} >= 88 * (len(x.name) + len(y.name)) GROUP BY x.name),
    f AS (SELECT video_id, name, row_number() OVER (PARTITION BY video_id ORDER BY min(seq)) AS n FROM p GROUP BY video_id, name),
    d AS (SELECT f.*, coalesce(near, []) AS near FROM f LEFT JOIN s ON a = name),
    g AS (SELECT video_id, name, n, name AS leader, [name] AS found FROM d WHERE n = 1
        UNION ALL SELECT video_id, name, n, coalesce(lead, name), CASE WHEN lead IS NULL THEN list_append(found, name) ELSE found END
        FROM (SELECT d.*, g.found, list_filter(g.found, lambda k: list_contains(d.near, k))[1] AS lead FROM g JOIN d ON d.video_id = g.video_id AND d.n = g.n + 1))
    SELECT video_id, seq, name, leader FROM p JOIN g USING (video_id, name)"""


def _named(spark, sf):
    return _perturbed(spark, sf).select((F.col("p_partkey") % 20).alias("video_id"), F.col("p_partkey").alias("seq"), "name")


@query(_LED)
def greedy_cluster(spark, sf):
    return cluster.with_leader(_named(spark, sf), "video_id", "name", ["seq"])


@query(_LED)
def greedy_cluster_split(spark, sf):
    """As a group of any size is led that no single task is to hold."""
    return cluster.with_leader(_named(spark, sf), "video_id", "name", ["seq"], small=0)


# ---- the others' rows follow from the comment view


@query("SELECT DISTINCT replace(p_name, ' ', '') AS tag, p_name AS phrase, p_name < 'm' AS known FROM part")
def segment_hashtags(spark, sf):
    cat = catalogue.index(view.catalogue_rows(spark, sf).where("canonical < 'm'"))
    tags = table(spark, sf, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("tag")).distinct()
    return metadata.segment(tags, cat, words.frequencies(table(spark, sf, "part"), "p_name")).select("tag", F.array_join("words", " ").alias("phrase"), "known")


def _library(spark: SparkSession, sf: str):
    return catalogue.index(view.catalogue_rows(spark, sf)), words.frequencies(table(spark, sf, "documents"))


@query(f"""WITH {view.SQL}, w AS (SELECT unnest(string_split({_FOLD.format(t="text")}, ' ')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word), z AS (SELECT word, log10(n * 1e9 / (SELECT sum(n) FROM n)) AS zipf FROM n),
    a AS (SELECT title, min(coalesce(zipf, 0)) - 1.2 * (count(*) - 1) AS ambiguity FROM (SELECT title, unnest(string_split(title, ' ')) AS word FROM (SELECT DISTINCT title FROM c)) LEFT JOIN z USING (word) GROUP BY title)
    SELECT video_id::VARCHAR AS video_id, comment_id AS seq, title AS canonical, 'exact' AS method, 100.0::DOUBLE AS score, round(ambiguity, 6)::DOUBLE AS ambiguity, CASE comment_id % 6 WHEN 0 THEN 6 WHEN 2 THEN 5 ELSE 2 END AS evidence FROM c JOIN a USING (title) WHERE comment_id % 6 < 4""")
def extract_mentions(spark, sf):
    cat, freq = _library(spark, sf)
    return extract.mentions(view.threads(spark, sf), cat, freq).select("video_id", "seq", "canonical", "method", "score", F.round("ambiguity", 6).alias("ambiguity"), "evidence")


@query()
def discover_titles(spark, sf):
    return discover.discover(view.threads(spark, sf), words.frequencies(table(spark, sf, "documents"))).select("video_id", "rank", "title", "commenters", "likes", "strength")


@query()
def analyze_videos(spark, sf):
    cat, freq = _library(spark, sf)
    return fusion.analyze(view.threads(spark, sf), cat, freq).select("video_id", "rank", "title", "confidence", "commenters", "likes")


@query(f"""WITH {view.SQL}, m AS (SELECT o_custkey % 50 AS v, title, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM titled),
    t AS (SELECT v::VARCHAR AS video_id, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM m WHERE n = 1)
    SELECT video_id, unnest([name, 'Title : ' || name, 'some tag']) AS text, unnest(['title', 'description', 'tag']) AS source, unnest([0.85, 0.68, 0.4])::DOUBLE AS confidence, unnest([1, 2, 3]) AS ord FROM t""")
def metadata_candidates(spark, sf):
    cat, freq = _library(spark, sf)
    return metadata.candidates(_meta(spark, sf), cat, freq).select("video_id", "text", "source", "confidence", "ord")


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    t = view.titled(spark, sf).withColumn("n", F.row_number().over(W.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey"))).where("n = 1")
    name = F.initcap("title")
    return t.select((F.col("o_custkey") % 50).cast("string").alias("id"), F.concat(F.lit("Ep 3 | "), name, F.lit(" | MBC #"), F.replace("title", F.lit(" "), F.lit(""))).alias("title"), F.lit("ch").alias("channel"), F.concat(F.lit("Title : "), name, F.lit("\nmore")).alias("description"), F.array(F.lit("some tag")).alias("tags"), F.lit(1).alias("comment_count"))


def _works(spark: SparkSession, sf: str) -> DataFrame:
    """A title-database cache over the part names: those below 'm' are works under their capitalised name, those from 'm' to
    's' are known to the database as nothing of the kind (of a country and year that fits no video), others not at all."""
    name = F.col("key")
    media = F.struct(
        F.abs(F.xxhash64("key")).alias("id"), F.lit("ANIME").alias("type"), F.lit("TV").alias("format"), F.when(name < "m", "KR").otherwise("US").alias("countryOfOrigin"), F.struct(F.initcap("key").alias("english")).alias("title"),
        F.array(F.concat(F.lit("The Tale of "), F.initcap("key"))).alias("synonyms"), F.struct(F.lit(2015).alias("year")).alias("startDate"), F.lit(5).alias("popularity"), F.lit("u").alias("siteUrl"),
    )
    titles = table(spark, sf, "part").select(F.col("p_name").alias("key")).distinct().where("key < 's'")
    return titles.select(F.lit("anilist").alias("source"), "key", F.to_json(F.array(media)).alias("payload"))


@query()
def report_titles(spark, sf):
    ranked, _ = report.build(_sweep(spark, sf), words.frequencies(table(spark, sf, "part"), "p_name"), _works(spark, sf).select(*[f.split()[0] for f in store.SCHEMA.split(", ")]))
    return ranked.select("confirmed", "rank", "key", "title", "videos", "commenters", "likes", "demand", "confidence", "kind")


@query()
def learned_titles(spark, sf):
    cat = catalogue.index(view.catalogue_rows(spark, sf).where("canonical < 'm'"))
    return learn.learned(_sweep(spark, sf), cat, spark.createDataFrame([], "word string, zipf double")).select("canonical", "kind", F.array_join("aliases", ",").alias("aliases"))


@query()
def find_answers(spark, sf):
    cat, freq = _library(spark, sf)
    comments = view.threads(spark, sf)
    answers = settled(fusion.analyze(comments, cat, freq))
    empty = spark.createDataFrame([], store.SCHEMA)
    found = finder.find(answers, comments, _meta(spark, sf), cat, freq, empty)
    return found.select("video_id", "title", "shown", "confidence", "note", "step", "status")
