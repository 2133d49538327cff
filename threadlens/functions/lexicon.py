"""Word lists. All of them are fixed values: results depend on every entry, so they are kept together, as plain text."""

from __future__ import annotations


def _w(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text.split()))


# ---- fixed values: words that say what kind of work is meant, and serial numbering

MEDIA_WORDS = _w("""
    manhwa manga manhua webtoon anime novel ln wn lightnovel book books movie movies film show series comic webcomic
    adaptation manwha shonen shounen seinen shoujo josei isekai oneshot webnovel donghua read author
""")
SERIAL_NOISE = r"\b(?:season|s|ep|episode|chapter|ch|vol|volume|part|pt|arc)\s*\.?\s*\d+\b"
LEADING_ARTICLES = ("the", "a", "an")

# ---- fixed values: words that are no title by themselves, and words that no title span begins or ends with

STOPLIKE = _w("""
    this that these those one it im i me my you your he she they we us them what who yes no yeah nah ok okay lol lmao bro
    fr peak goat cinema fire trash mid good bad best worst first last next same also too very really thanks thank please
    pls need want like love hate everyone someone anyone nobody everything nothing name title titles list video comment
    comments season episode chapter part arc op ed sub dub recommendation recommendations underrated overrated top
""") + MEDIA_WORDS
EDGE_FUNCTION = _w("""
    a an the is was are were be and or but if so than then that this of in on at to for with from by as it its i me my
    you your he she they them we us our his her not no too very just only also even still about after before all any
    both some such
""")

# ---- fixed values: ambiguity and evidence

TITLE_STOPWORDS = _w("of the a an at in to and x no wa")
ACRONYM_SKIP = _w("of the a an at in to and x")
FUNCTION_WORDS = _w("""
    a an the is was are were be been being am and or but if so than then that this these those of in on at to for with
    from by as it its i me my you your he she they them their we us our his her him not no nor too very just only also
    even still yet about after before over under up down out off again once all any both each more most other some such
    one two when where who what why how which everything nothing something anything everyone someone anyone nobody else
    here there now ever never always really actually literally tbh imo lol
""")
SERIAL_WORDS = _w("""
    season seasons episode episodes ep eps chapter chapters ch vol volume volumes part pt arc arcs s1 s2 s3 manga
    spoilers ending finale
""")
DOMAIN_WORDS = _w("""
    oscar oscars director directed cinematography screenplay soundtrack netflix theater theatre rewatch rewatched prequel
    trilogy boxoffice casting subbed dubbed panels artstyle scanlation scanlations raws protagonist worldbuilding
    powerscaling serialization webtoons mangaka paperback audiobook prose scifi spoilers adaptation pages chapters volumes
    arcs visuals tropes isekai
""")
CUE_WORDS = _w("""
    read reading watch watching watched try trying recommend rec recs check binge binged bingeing start started starting
    pick picked finish finished reread rewatch adaptation adapted
""")
VERB_STEMS = _w("""
    make made change go went get got come came take took give gave see saw know knew think thought look want use find
    found tell told ask work seem feel felt try leave left call keep kept let begin began help talk turn start show hear
    heard play run ran move live believe hold held bring brought happen write wrote provide sit sat stand stood lose lost
    pay paid meet met include continue set learn lead led understand watch follow stop create speak spoke read spend grow
    grew open walk win won teach taught offer remember consider appear buy bought serve die send sent build built stay
    fall fell cut reach kill raise pass sell sold decide return explain hope develop carry break broke receive agree
    support hit produce eat ate cover catch caught draw drew choose chose cause drive drove destroy destroyed sweep swept
    slap hate love like need deserve oblige obliged plays played ruin ruined save saved
""")


def inflected(stems: tuple[str, ...]) -> tuple[str, ...]:
    """The stems and their regular verb forms."""
    forms = {}
    for stem in stems:
        endings = [stem] + [stem + e for e in ("s", "ed", "ing", "es")]
        if stem[-1] == "e":
            endings += [stem + "d", stem[:-1] + "ing"]
        elif stem[-1] == "y":
            endings += [stem[:-1] + e for e in ("ies", "ied")]
        forms |= dict.fromkeys(endings)
    return tuple(forms)


VERB_WORDS = inflected(VERB_STEMS)

# ---- fixed values: open discovery

QUESTION_WORDS = _w("""
    kya kaunsi konsi kon qué que cual cuál como cómo qual quel quelle was wie cosa come что как какой ما وش ايش أيش apa
    apakah ne nedir hangi gì อะไร 뭐 뭐야 何 什么 ano jaki naam? name? title?
""")
DETERMINERS = _w("""
    the a an this that la el las los un una esta este esa ese o as os um uma essa esse le les des du cette ce der die das
    ein eine il lo gli questa questo ye yeh bu şu ini itu
""")
MINOR_WORDS = _w("a an the of in on to and or for at by is i")
JUNK_SLOTS = tuple(x.strip() for x in """
    the, this, that, it, he, she, they, what, who, why, name, title, drama, show, movie, series, manhwa, webtoon, manga,
    anime, book, novel, kdrama, k drama, same, me too, yes, no, lol, omg, bro, please, pls, thanks, thank you, anyone,
    someone, everyone, nothing, something, idk, good, best, peak, fire, trash, mid, season, episode, part one,
    i love this, so true, real, facts, watch, read, netflix, la serie, el nombre, o nome, la pelicula, la película,
    el anime, название, фильм, сериал, аниме, манга, дорама, мультик, manhwa ka, movie ka, dizi, مسلسل, المسلسل, انمي,
    فيلم, pelicula, película, serie, novela, drama coreano, dorama, doramas, dizisi, telenovela, seriya, сериала, film,
    judul, pamagat, tytul, tytuł, 제목, タイトル, por favor, plis, bhai, please tell, tell me, sana, ang
""".split(","))
STRONG_FRAMES = ("named", "called", "onplat", "replyto")

# ---- fixed values: alternate names

ALIAS_STOP = _w("""
    the a an same it this that different better good amazing peak fire not no yes called titled named english korean
    japanese chinese
""")

# ---- fixed values: metadata

GENERIC_TAGS = tuple(x.strip() for x in """
    shorts, short, fyp, foryou, foryoupage, viral, trending, edit, edits, amv, fmv, clip, clips, scene, scenes, funny,
    comedy, drama, kdrama, cdrama, jdrama, anime, manhwa, manga, webtoon, movie, movies, film, series, netflix, reels,
    reel, tiktok, youtube, youtubeshorts, explore, fy, subscribe, like, follow, new, best, top, love, sad, mbc, kbs, sbs,
    tvn, jtbc, ocn, ena, viki, viu, iqiyi, wetv, youku, mango, hulu, prime, disney, crunchyroll, romance, action, korean,
    korea, chinese, japanese, indian, bollywood, hollywood, edittutorial, aftereffects, capcut, turkishdrama,
    chinesedrama, koreandrama, japanesedrama, thaidrama, indiandrama, turkish drama, chinese drama, korean drama,
    japanese drama, thai drama, kdramascene, dramascene, shortvideo, shortsfeed, shortsvideo, viralvideo, animeedit,
    kdramaedit, dramaedit, moviescene, status, whatsapp
""".split(","))
NATIONALITY = _w("""
    turkish chinese korean japanese indian thai spanish mexican filipino russian french german italian arabic vietnamese
    indonesian brazilian pakistani asian hindi tamil telugu urdu punjabi latino african american british taiwanese
    malaysian persian iranian egyptian
""")
FORM_WORDS = _w("""
    drama dramas series serial serials show shows movie movies film films clip clips scene scenes edit edits song songs
    novel novels webtoon anime manhwa manga manhua donghua telenovela kdrama cdrama
""")
FAMILY_NAMES = _w("""
    kim lee park choi jung jeong kang cho jo yoon yun jang lim im han oh seo shin kwon hwang ahn an song ryu hong jeon jun
    ko go moon mun son yang bae baek heo nam sim noh ha gu koo min chae cha ju joo yu yoo byun ji jin sung seong woo pyo
    wang li zhang liu chen huang zhao wu zhou xu sun ma zhu hu guo lin he gao luo zheng liang xie tang deng feng cao peng
    zeng xiao tian dong yuan pan jiang cai yan bai cheng shen lu fan wei ren qin xia
""")

# ---- fixed values: report

TIER_WEIGHT = {"high": 1.0, "medium": 0.5, "low": 0.0}
TIER_ORDER = {"high": 0, "medium": 1, "low": 2}
#: In order: the first key that a search query contains names its segment.
GENRES = (
    ("kdrama", "Korean"), ("korean", "Korean"), ("cdrama", "Chinese"), ("chinese", "Chinese"), ("anime", "Anime"), ("donghua", "Chinese animation"),
    ("manhwa", "Manhwa/Webtoon"), ("webtoon", "Manhwa/Webtoon"), ("turkish", "Turkish"), ("telenovela", "Spanish-language"), ("bollywood", "Indian"),
    ("indian", "Indian"), ("thai", "Thai"), ("japanese", "Japanese"), ("jdrama", "Japanese"), ("movie", "Film"), ("what drama", "Identification query"),
    ("school", "School drama"), ("romance", "Romance"), ("revenge", "Revenge"), ("drama", "General drama"),
)
