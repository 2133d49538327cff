"""Regular expressions that results depend on: fixed values, kept together as plain text.

They are written for Spark's (Java's) engine by ``rx``: case-insensitive and Unicode-aware unless said otherwise. A frame
is a phrasing whose first group is the slot in which people put a title.
"""

from __future__ import annotations


def rx(pattern: str, any_case: bool = True) -> str:
    return ("(?iU)" if any_case else "(?U)") + pattern


# ---- fixed values: comment cleaning

URL = r"https?://\S+|www\.\S+"
TIMESTAMP = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]+"
SLOT_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{200B}]+"
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
REPLY_HANDLE = r"^(?:\s*@?[\w.\-]*\d[\w.\-]*[,:]?\s+|\s*@[\w.\-]+[,:]?\s*)+"
LEAD_HANDLE = r"^\s*@[\w.\-]+"
SLOT_EDGE = " \\t\\-–—:;,.!?\"'“”‘’()\\[\\]"

# ---- fixed values: candidate spans and evidence

QUOTED_SPAN = r"[\"“”'‘’]([^\"“”'‘’]{2,60})[\"“”'‘’]"
CUE_AFTER = (
    r"\b(?:read|reading|watch|watching|try|check\s+out|recommend|rec|look\s+up|start(?:ed)?(?:\s+with)?|pick\s+up|binge[d]?)\b"
    r"[:\s]+([A-Za-z0-9][\w'’\-\. ]{1,50})"
)
CAPS_TOKEN = r"\b[A-Z]{2,6}\b"
PAIRED_QUOTE = r"[\"“”]([^\"“”]{2,60})[\"“”]|(?<![A-Za-z])['‘]([^'‘’]{2,60})['’](?![A-Za-z])"
YEAR_IN_BRACKETS = r"\(\s*(19|20)\d{2}\s*\)"
BY_AUTHOR = r"\bby\s+[A-Z][a-z]+"

# ---- fixed values: open discovery

MEDIA = r"(?:k-?drama|drama|show|movie|film|series|manhwa|manhua|webtoon|manga|anime|book|novel)"
LANGUAGE_FRAMES = [
    ("es", r"se\s+llama[n]?\s*:?\s*([^\n.!?¡¿]{2,60})"),
    ("es", r"(?:el\s+)?(?:nombre|t[ií]tulo)\s+(?:es|de\s+la\s+serie\s+es)\s*:?\s*([^\n.!?¡¿]{2,60})"),
    ("es", r"(?:nombre|t[ií]tulo)\s*:\s*([^\n.!?¡¿]{2,60})"),
    ("pt", r"se\s+chama\s*:?\s*([^\n.!?]{2,60})"),
    ("pt", r"(?:o\s+)?nome\s+(?:é|eh|e)\s*:?\s*([^\n.!?]{2,60})"),
    ("ru", r"называется\s*:?\s*([^\n.!?]{2,60})"),
    ("ru", r"назван[ие]{2}\s*[:\-]\s*([^\n.!?]{2,60})"),
    ("tr", r"(?:dizinin|filmin|animenin|dizi|film)\s+(?:ad[ıi]|ismi)\s*:?\s*([^\n.!?]{2,60})"),
    ("tr", r"(?:ad[ıi]|ismi)\s*:\s*([^\n.!?]{2,60})"),
    ("hi", r"na+m\s*[:\-]\s*([^\n.!?]{2,60})"),
    ("hi", r"([^\n.!?]{2,50}?)\s+na+m\s+ha[iy]\b"),
    ("hi", r"na+m\s+([^\n.!?]{2,50}?)\s+ha[iy]\b"),
    ("ar", r"اسم\s+(?:المسلسل|الفيلم|الانمي|الأنمي)\s*:?\s*([^\n.!?]{2,60})"),
    ("id", r"judul(?:nya)?\s*:?\s*([^\n.!?]{2,60})"),
    ("fr", r"(?:ça|ca|cela)\s+s'appelle\s*:?\s*([^\n.!?]{2,60})"),
    ("fr", r"le\s+(?:nom|titre)\s+est\s*:?\s*([^\n.!?]{2,60})"),
    ("de", r"hei(?:ß|ss)t\s*:?\s*([^\n.!?]{2,60})"),
    ("it", r"si\s+chiama\s*:?\s*([^\n.!?]{2,60})"),
    ("vi", r"t[êe]n\s+(?:phim|truy[eệ]n)\s+l[àa]\s*:?\s*([^\n.!?]{2,60})"),
    ("th", r"ชื่อเรื่อง\s*:?\s*([^\n.!?]{2,60})"),
    ("ko", r"제목\s*(?:은|는)?\s*:?\s*([^\n.!?]{2,60})"),
    ("ja", r"タイトルは\s*:?\s*([^\n.!?]{2,60})"),
    ("zh", r"(?:名字|片名)\s*(?:是|叫)?\s*:?\s*([^\n.!?]{2,60})"),
    ("tl", r"pamagat\s*(?:ay)?\s*:?\s*([^\n.!?]{2,60})"),
    ("pl", r"tytu[łl]\s*:?\s*([^\n.!?]{2,60})"),
]
#: name, pattern, whether in any case
ENGLISH_FRAMES = [
    ("named", rf"\b(?:{MEDIA}|the)\s+(?:full\s+)?(?:name|title)\s*(?:is|:|-|=)\s*[\"“']?([^\n\"“”']{{2,60}})", True),
    ("named", r"(?:^|\n)\s*(?:name|title)\s*[:\-=]\s*[\"“']?([^\n\"“”']{2,60})", True),
    ("called", r"\b(?:it'?s|its|it is|this is)\s+called\s+[\"“']?([^\n\"“”'.!?]{2,60})", True),
    ("quoted", r"[\"“]([^\"“”]{2,60})[\"”]", False),
    ("onplat", r"\b([A-Z][^\n\"“”'.!?]{1,58}?)\s+(?:is\s+)?(?:available\s+)?on\s+(?i:netflix|viki|disney|prime|crunchyroll|webtoon|tapas)\b", False),
    ("premedia", rf"\b([A-Z][A-Za-z0-9'’!?:\- ]{{2,58}}?)\s+{MEDIA}\b", False),
    ("watchrec", r"\b(?:watch|read|search|look\s+up)\s+[\"“']?([A-Z][^\n\"“”'.!?]{2,58})", False),
]
FRAMES = [(f"lang:{lang}", rx(p)) for lang, p in LANGUAGE_FRAMES] + [(name, rx(p, any_case)) for name, p, any_case in ENGLISH_FRAMES]
#: For each of FRAMES, words of which every match holds one, in lower case and with ı for i and ſ for s: a comment without
#: any of them need not be tried. Follows from the patterns.
_WORK_WORDS = "drama show movie film series manhwa manhua webtoon manga anime book novel"
FRAME_WORDS = [
    tuple(x.split())
    for x in (
        "llama", "nombre título titulo", "nombre título titulo", "chama", "nome", "называется", "назван", "adi ismi", "adi ismi", "nam aam", "nam aam", "nam aam", "اسم", "judul",
        "s'appelle", "nom titre", "heißt heisst", "chiama", "phim truy", "ชื่อเรื่อง", "제목", "タイトルは", "名字 片名", "pamagat", "tytu",
        "name title", "name title", "called", '" “', "netflix viki disney prime crunchyroll webtoon tapas", _WORK_WORDS, "watch read search look",
    )
]
SLOT_TRAIL = rx(
    r"(?:\s+|\s*\()(?:on\s+)?(?:netflix|viki|disney\+?|prime|crunchyroll|tapas|webtoons?|available|and\s|but\s|its\s|it'?s\s|thanks?\s|you\s+can\s|from\s+\d{4}"
    r"|\(?\d{4}\)?|season\s*\d|ep\s*\d|episode\s*\d|y\s|e\s|et\s|und\s|и\s|ve\s|dan\s|v[àa]\s|و\s|aur\s|por\s+favor|plis|pls|gracias)\b.*$"
)
QUESTION = rx(
    r"what(?:'?s| is)\s+(?:the\s+)?(?:name|title|drama|show|movie|anime)|name\s*\?|title\s*\?"
    r"|c[óo]mo\s+se\s+llama|cu[áa]l\s+es\s+el\s+nombre|nombre\s*(?:\?|plis|pls|porfa|por\s+favor)"
    r"|qual\s+[ée]\s+o\s+nome|nome\s*\?"
    r"|как\s+(?:\w+\s+){0,2}называется|назван[ие]{2}\s*(?:\?|плиз|плз|пожалуйста)"
    r"|ad[ıi]\s+ne|ismi\s+ne"
    r"|na+m\s+kya|kya\s+na+m|na+m\s+(?:bta|batao|bolo)"
    r"|(?:وش|ما)\s*اسم|اسم\s*(?:المسلسل|الانمي)\s*\?"
    r"|judul(?:nya)?\s+(?:apa|apakah)\b|judul(?:nya)?\s*\?"
    r"|t[êe]n\s+phim\s+(?:l[àa]\s+)?g[ìi]"
    r"|제목\s*(?:이)?\s*뭐|タイトル\s*(?:は)?\s*\?|叫什么"
    r"|anong\s+(?:title|pamagat)"
)
CHATTER = rx(r"\b(?:thanks?|thank|thx|ty|welcome|sorry|np|yw|please|pls|lol|lmao|i'?m|you'?re|i'?ve|we'?re|it'?s\s+not|agree|exactly|same|me\s+too|idk|dunno|nope|yeah|yep|nah)\b")
SONG = rx(r"\b(?:songs?|music|audio|sound|remix|phonk|montagem|funk|lyrics|cancion|canci[oó]n|musica|m[uú]sica|gaana|gana)\b")

# ---- fixed values: alternate names

LANGUAGES = r"korean|japanese|chinese|english|spanish|french|german|hindi|thai|vietnamese|indonesian|original|japan|korea|china"
ALIAS_FRAMES = [
    ("translated", rx(rf"\b(?:in|the)\s+(?:{LANGUAGES})\s*(?:,\s*)?(?:the\s+)?(?:title|name|version)?\s*(?:is|:|it'?s|was)\s*[\"“']?([^\n\"“”'.!?]{{2,60}})")),
    ("translated", rx(rf"\b(?:{LANGUAGES})\s+(?:title|name)\s*(?:is|:)\s*[\"“']?([^\n\"“”'.!?]{{2,60}})")),
    ("aka", rx(r"\b(?:a\.?k\.?a\.?|also\s+known\s+as|otherwise\s+known\s+as)\s*[:\-]?\s*[\"“']?([^\n\"“”'.!?]{2,60})")),
    ("source", rx(r"\bbased\s+on\s+(?:the\s+)?(?:manhwa|manga|webtoon|novel|book|comic)\s+[\"“']?([^\n\"“”'.!?]{2,60})")),
    ("source", rx(r"\bthe\s+(?:manhwa|manga|webtoon|novel)\s+(?:is\s+)?(?:called|named|titled)\s+[\"“']?([^\n\"“”'.!?]{2,60})")),
    ("original", rx(r"\boriginal(?:ly)?\s+(?:title|name)?\s*(?:is|was|called|titled)\s*[:\-]?\s*[\"“']?([^\n\"“”'.!?]{2,60})")),
]

# ---- fixed values: video metadata

TITLE_BAR = r"\s*[|｜·•‧⧸/]\s*|\s+[-–—]\s+"
HASHTAG = rx(r"#(\w{3,40})", False)
META_NOISE = rx(r"\b(?:ep|episode|part|pt|season|s)\s*\.?\s*\d+\b")
WORK = r"(?:manhwa|manhua|manga|anime|webtoon|donghua|novel|comic|series|manhwa\s*/\s*manhua)"
LABEL = rx(rf"^[^\w]*(?:{WORK}(?:\s*(?:name|title))?|(?:name|title)(?:\s+of\s+(?:the\s+|this\s+)?{WORK})?|original\s+title)\s*[:：=\-–—]+\s*(.+)$")
LABEL_CUT = rx(r"\s*(?:[|#]|https?://|\(ch|\bch(?:apter)?\.?\s*\d|\bep(?:isode)?\.?\s*\d).*$")
NOT_A_NAME = rx(r"^(?:ongoing|completed?|hiatus|unknown|n/?a|in\s+description|comment|below|pinned|see|check|webtoons?|tapas|naver|kakao(?:page)?|bilibili|crunchyroll|netflix|youtube|tiktok|google)\b")
LABEL_PREFIX = rx(rf"^\s*(?:{WORK}\s*)?(?:name|title)\s*[:：\-–—]\s*")
UPLOADER_SPLIT = r"[|《》「」【】\[\]•]|\s[-–—]\s"
UPLOADER_NOISE = rx(r"(?:\s+(?:4k|hd|amv|fmv|edit|edits|scene|scenes|recap|explained|shorts?|manhwa|manhua|manga|anime|webtoon|clip|part\s*\d+|ep\.?\s*\d+))+\s*$")
NOT_TEXT = r"(?U)[^\w\s'’:&!?,.\-–—()]+"
VIDEO_ID = r"(?:v=|youtu\.be/|shorts/|embed/)([A-Za-z0-9_-]{11})"
