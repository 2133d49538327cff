"""Works known to title databases: cached answers to entity rows, which of them a title names, and the one that fits a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions.lineage import settled
from ..sources import readers

# ---- fixed values: kinds, countries and article suffixes

WIKI_KINDS = (
    ("telenovela", "drama"), ("anime", "anime"), ("donghua", "donghua"), ("manhwa", "manhwa"), ("webtoon", "manhwa"), ("manhua", "manhua"), ("manga", "manga"),
    ("light novel", "novel"), ("web novel", "novel"), ("novel", "novel"), ("animated", "anime"), ("television film", "film"), ("film", "film"), ("movie", "film"),
    ("television series", "drama"), ("tv series", "drama"), ("web series", "drama"), ("miniseries", "drama"), ("drama", "drama"), ("soap opera", "drama"),
    ("sitcom", "drama"), ("television programme", "drama"), ("television program", "drama"), ("streaming series", "drama"), ("series", "drama"),
)
DEMONYMS = (
    ("south korean", "KR"), ("korean", "KR"), ("taiwanese", "TW"), ("hong kong", "HK"), ("chinese", "CN"), ("japanese", "JP"), ("thai", "TH"), ("indian", "IN"),
    ("hindi", "IN"), ("tamil", "IN"), ("telugu", "IN"), ("pakistani", "PK"), ("turkish", "TR"), ("mexican", "MX"), ("colombian", "CO"), ("argentine", "AR"),
    ("venezuelan", "VE"), ("chilean", "CL"), ("peruvian", "PE"), ("spanish", "ES"), ("brazilian", "BR"), ("filipino", "PH"), ("philippine", "PH"),
    ("indonesian", "ID"), ("vietnamese", "VN"), ("american", "US"), ("british", "GB"), ("english", "GB"), ("canadian", "CA"), ("australian", "AU"),
    ("french", "FR"), ("german", "DE"),
)
WIKI_SUFFIXES = ("", " (TV series)", " (South Korean TV series)", " (Chinese TV series)", " (Thai TV series)", " (Japanese TV series)", " (film)", " (web series)", " (manhwa)", " (telenovela)")
NOT_A_SERIES = r"\b(video game|game|album|song|single|band|group|book series|comic strip|character|franchise|episode)\b"
SPANISH = ("MX", "ES", "CO", "AR", "VE", "CL", "PE")
COUNTRY_OF_SEGMENT = {"Korean": ("KR",), "Chinese": ("CN", "TW", "HK"), "Chinese animation": ("CN",), "Thai": ("TH",), "Japanese": ("JP",), "Indian": ("IN", "PK"), "Turkish": ("TR",)}
FORM_OF_SEGMENT = {"Anime": ("anime", "donghua", "manga", "manhua", "manhwa", "novel"), "Manhwa/Webtoon": ("manhwa", "manhua", "manga", "anime", "donghua", "novel"), "Chinese animation": ("donghua", "manhua", "novel"), "Film": ("film",)}
DRAWN = ("Anime", "Manhwa/Webtoon", "Chinese animation")
LIVE = ("Korean", "Chinese", "Thai", "Japanese", "Indian", "Turkish", "Spanish-language", "Film")
DRAMA_LABEL = {"KR": "K-drama", "CN": "C-drama", "TW": "Taiwanese drama", "HK": "Hong Kong drama", "TH": "Thai drama", "JP": "J-drama", "IN": "Indian series", "PK": "Pakistani drama", "TR": "Turkish series", "PH": "Filipino series"}
FILM_LABEL = {"KR": "Korean film", "CN": "Chinese film", "JP": "Japanese film", "IN": "Indian film", "TH": "Thai film", "US": "American film"}
SOURCE_NAME = {"anilist": "AniList", "wikipedia": "Wikipedia", "mangadex": "MangaDex"}
FUZZY = 92.0
FUZZY_LENGTH = 12
OLD = 1995


def _map(c: Column, values: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _items(cache: DataFrame, source: str, schema: str) -> DataFrame:
    """(title_key, rank, m) of a source's cached answers; the key is behind the source's name."""
    own = cache.where(F.col("source") == source).select(F.regexp_replace("key", "^[a-z]+:", "").alias("title_key"), "key", F.from_json("payload", schema).alias("ms"))
    return own.select("title_key", "key", F.posexplode("ms").alias("rank", "m"))


def _entity(df: DataFrame, **columns: Column) -> DataFrame:
    named = {f.split(": ")[0].strip() if ":" in f else f.split()[0]: f.split()[-1] for f in readers.ENTITY.split(", ")}
    null = {"spanish": F.lit(False), "searched": F.lit(False), "popularity": F.lit(0)}
    return df.select("title_key", *(columns.get(n, null.get(n, F.lit(None))).cast(t if n != "names" else "array<string>").alias(n) for n, t in named.items()))


def anilist(cache: DataFrame) -> DataFrame:
    m = F.col("m")
    t, country = m["title"], m["countryOfOrigin"]
    kind = F.when(m["type"] == "ANIME", F.when(country == "CN", "donghua").otherwise("anime")).when(m["format"] == "NOVEL", "novel")
    kind = kind.otherwise(_map(country, {"KR": "manhwa", "CN": "manhua", "TW": "manhua"}, F.lit("manga")))
    names = F.filter(F.concat(F.array(t["english"], t["romaji"], t["native"]), F.coalesce(m["synonyms"], F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return _entity(_items(cache, "anilist", readers.ANILIST), source=F.lit("anilist"), id=F.concat(F.lit("anilist:"), m["id"]), name=F.coalesce(F.get(names, F.lit(0)), F.lit("")), names=names, kind=kind, country=country, year=m["startDate"]["year"], url=F.coalesce(m["siteUrl"], F.lit("")), rank=F.col("rank"), popularity=F.coalesce(m["popularity"], F.lit(0)))


def mangadex(cache: DataFrame) -> DataFrame:
    m = F.col("m")
    alts = F.coalesce(m["altTitles"], F.array().cast("array<map<string,string>>"))
    names = F.concat(F.map_values(m["title"]), F.flatten(F.transform(alts, F.map_values)))
    english = F.filter(F.transform(alts, lambda a: a["en"]), lambda x: x.isNotNull())
    country = _map(m["lang"], {"ko": "KR", "zh": "CN", "zh-hk": "CN", "ja": "JP"}, F.lit(None).cast("string"))
    kind = _map(country, {"KR": "manhwa", "CN": "manhua"}, F.lit("manga"))
    name = F.coalesce(m["title"]["en"], F.get(english, F.lit(0)), F.get(names, F.lit(0)), F.lit(""))
    return _entity(_items(cache, "mangadex", readers.MANGADEX), source=F.lit("mangadex"), id=F.concat(F.lit("mangadex:"), m["id"]), name=name, names=names, kind=kind, country=country, year=m["year"], url=F.concat(F.lit("https://mangadex.org/title/"), m["id"]), rank=F.col("rank"))


def _wiki(items: DataFrame, searched: bool) -> DataFrame:
    m = F.col("m")
    paren = r"\s*\(([^)]*)\)\s*$"
    hint = F.lower(F.concat_ws(" ", F.regexp_extract(m["title"], paren, 1), F.coalesce(m["description"], F.lit(""))))
    kind, base = T.first_match_kind(hint, WIKI_KINDS), F.trim(F.regexp_replace(m["title"], paren, ""))
    year = F.nullif(F.regexp_extract(hint, r"\b(19[3-9]\d|20[0-4]\d)\b", 1), F.lit("")).cast("int")
    names = F.array_prepend(F.transform(F.coalesce(m["redirects"], F.array().cast("array<string>")), lambda r: F.trim(F.regexp_replace(r, paren, ""))), base)
    kept = items.where(~F.coalesce(m["disambiguation"], F.lit(False)) & kind.isNotNull() & ~((kind == "drama") & hint.rlike(NOT_A_SERIES)))
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace(m["title"], F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))
    return _entity(kept, source=F.lit("wikipedia"), id=F.concat(F.lit("wikipedia:"), m["title"]), name=base, names=names, kind=kind, country=T.first_match_kind(hint, DEMONYMS), year=year, url=url, spanish=hint.contains("spanish-language") | hint.contains("telenovela"), rank=F.col("rank"), searched=F.lit(searched))


def wikipedia_searched(cache: DataFrame) -> DataFrame:
    own = _items(cache.where("key like 'wikipedia:%'"), "wikipedia", readers.WIKIPEDIA)
    return _wiki(own, True)


def wiki_variants(titles: DataFrame) -> DataFrame:
    """(title, index, variant): the article titles under which a work may be found."""
    each = titles.select("title", F.posexplode(T.title_forms(F.col("title"))).alias("form", "f"))
    return each.select("title", "form", "f", F.posexplode(F.array(*map(F.lit, WIKI_SUFFIXES))).alias("suffix", "s")).select("title", (F.col("form") * len(WIKI_SUFFIXES) + F.col("suffix")).alias("index"), F.concat("f", "s").alias("variant"))


def redirected(wanted: DataFrame, hops: DataFrame, most: int = 4) -> DataFrame:
    """``wanted`` (variant) with ``page``: after up to ``most`` hops (from, to)."""
    out = wanted.withColumn("page", F.col("variant"))
    for _ in range(most):
        step = hops.select(F.col("from").alias("page"), F.col("to").alias("_to"))
        out = out.join(step, "page", "left").withColumn("page", F.coalesce("_to", "page")).drop("_to")
    return out


def wikipedia_exact(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """Entities of the cached articles at a title's variants, each page once."""
    schema = "title string, index int, description string, disambiguation boolean, redirects array<string>, missing boolean"
    pages = cache.where("source = 'wikipedia' and key like 'wikititle:%'").select(F.expr("substring(key, 11)").alias("variant"), F.from_json("payload", schema).alias("m"))
    found = wiki_variants(titles).join(pages, "variant").where(~F.coalesce(F.col("m")["missing"], F.lit(False)))
    one = found.withColumn("_n", F.row_number().over(W.partitionBy("title", F.col("m")["title"]).orderBy("index"))).where("_n = 1")
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("title").orderBy("index")) - 1)
    return _wiki(ranked.select(F.lower("title").alias("title_key"), "rank", "m"), False)


def name_keys(entities: DataFrame) -> DataFrame:
    """(title_key, id, main, key): the group keys of an entity's names and of their part before a subtitle."""
    each = entities.select("title_key", "id", "name", F.explode(F.array_distinct(F.array_prepend("names", F.col("name")))).alias("n"))
    parts = F.array_distinct(F.array("n", F.get(F.split("n", ":"), F.lit(0)), F.get(F.split("n", " - "), F.lit(0)), F.get(F.split("n", " – "), F.lit(0))))
    return T.with_group_key(each.select("title_key", "id", (F.col("n") == F.col("name")).alias("main"), F.explode(parts).alias("p")), "p", "key").where("key <> ''").drop("p")


def matching(titles: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities`` that ``titles`` (title) name, with title and ``primary`` (by the entity's own name): equal keys, equal
    without spaces, or, from 12 characters on, a ratio of 92. The three tests are joined apart and then united."""
    keyed = T.with_group_key(titles.select("title").distinct(), "title", "k").where("k <> ''").withColumn("title_key", F.lower("title"))
    names = name_keys(entities)
    both = keyed.join(names, "title_key")
    glued = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    exact = both.where((F.col("k") == F.col("key")) | (glued("k") == glued("key")))
    loose = both.where((F.char_length("k") >= FUZZY_LENGTH) & (F.char_length("key") >= FUZZY_LENGTH) & S.can_reach(F.col("k"), F.col("key"), FUZZY)).where(S.ratio("k", "key") >= FUZZY)
    own = F.max((F.col("main") & (F.col("k") == F.col("key"))).cast("int")) == 1
    hits = exact.union(loose).groupBy("title", "title_key", "id").agg(own.alias("primary"))
    return settled(hits.join(entities, ["title_key", "id"]))


def lookup(titles: DataFrame, cache: DataFrame) -> DataFrame:
    """Every entity that each title names, with the sources' fallbacks: searched articles only without an exact one,
    MangaDex only without AniList."""
    titles = settled(titles.select("title").distinct())
    first = matching(titles, anilist(cache))
    exact = matching(titles, wikipedia_exact(titles, cache))
    rest = titles.join(exact.select("title"), "title", "left_anti")
    searched = matching(rest, wikipedia_searched(cache))
    last = matching(titles.join(first.select("title"), "title", "left_anti"), mangadex(cache))
    return first.unionByName(exact).unionByName(searched).unionByName(last)


def live_action(segments: Column, context: Column) -> Column:
    lit = lambda v: F.array(*map(F.lit, v))
    return ~F.arrays_overlap(segments, lit(DRAWN)) & (F.arrays_overlap(segments, lit(LIVE)) | F.lower(context).rlike("drama|movie|film|scene|series"))


def fits(segments: Column) -> tuple[Column, Column]:
    """(whether an entity fits a video of these segments, whether by a known country)."""
    has = lambda s: F.array_contains(segments, s)
    country, kind = F.col("country"), F.col("kind")
    by_country = [(s, country.isin(*c)) for s, c in COUNTRY_OF_SEGMENT.items()] + [("Spanish-language", F.col("spanish") | country.isin(*SPANISH))]
    by_form = [(s, kind.isin(*k) | ((country == "KR") if s == "Manhwa/Webtoon" else F.lit(False))) for s, k in FORM_OF_SEGMENT.items()]
    some = lambda tests: F.coalesce(F.greatest(*((has(s) & F.coalesce(t, F.lit(False))) for s, t in tests)), F.lit(False))
    any_of = lambda tests: F.greatest(*(has(s) for s, _ in tests))
    old = kind.isin("drama", "film") & F.coalesce(F.col("year") < OLD, F.lit(False))
    drawn = [t for t in by_form if t[0] != "Film"]
    lenient = country.isNull() & kind.isin("drama", "film") & ~old & ~F.col("searched") & (~any_of(drawn) | some(drawn))
    known = any_of(by_country) & some(by_country)
    return F.when(any_of(by_country), some(by_country) | lenient).when(any_of(by_form), some(by_form) & ~old).otherwise(~old), known


def choose(videos: DataFrame, entities: DataFrame) -> DataFrame:
    """``videos`` (vid, title, segments, live) with status and the entity chosen (struct ``entity``, or null): the best of
    those that fit; "contradicted" if there are only others, "unconfirmed" if there are none."""
    joined = videos.join(entities, "title", "left")
    fit, known = fits(F.col("segments"))
    animated, drawn = F.array_contains("segments", "Anime") | F.array_contains("segments", "Chinese animation"), F.array_contains("segments", "Manhwa/Webtoon")
    wanted = F.when(animated, F.col("kind").isin("anime", "donghua")).when(drawn, F.col("kind").isin("manhwa", "manhua")).when(F.col("live"), F.col("kind").isin("drama", "film")).otherwise(False)
    place = _map(F.col("source"), {"wikipedia": 0, "anilist": 1, "mangadex": 2}, F.lit(3)).cast("int")
    source = F.when(F.col("live"), -place).otherwise((place == 1).cast("int"))
    weight = F.when(F.col("source") == "anilist", F.col("popularity")).otherwise(-F.col("rank"))
    order = F.struct(F.col("primary").cast("int"), known.cast("int"), wanted.cast("int"), source, weight, F.col("id"))
    columns = [f.split()[0].rstrip(":") for f in readers.ENTITY.split(", ")]
    ok = F.col("id").isNotNull() & fit
    got = joined.groupBy("vid", "title").agg(F.count("id").alias("n"), F.max_by(F.when(ok, F.struct(*columns, "primary")), F.when(ok, order)).alias("entity"))
    status = F.when(F.col("entity").isNotNull(), "confirmed").when(F.col("n") > 0, "contradicted").otherwise("unconfirmed")
    return videos.join(got.select("vid", "title", "entity", status.alias("status")), ["vid", "title"])


def kind_label(kind: Column, country: Column, spanish: Column) -> Column:
    drama = F.when(F.coalesce(spanish, F.lit(False)) | F.coalesce(country.isin(*SPANISH), F.lit(False)), "Telenovela").otherwise(_map(country, DRAMA_LABEL, F.lit("TV series")))
    return F.when(kind == "drama", drama).when(kind == "film", _map(country, FILM_LABEL, F.lit("Film"))).otherwise(F.initcap(kind))
