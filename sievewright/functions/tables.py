"""Fixed values of the data model: names, spellings and markers that results must agree on."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# --- fixed values: look-alike letters (Cyrillic and Greek to Latin) -------------------------
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏѵԛԝ" + "АВЕКМНОРСТУХІЈЅԚԜ" + "ορν" + "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖ",
        "aeopcyxijsdhlvqw" + "ABEKMHOPCTYXIJSQW" + "opv" + "ABEHIKMNOPTXYZ",
        strict=True,
    )
)
# inside host names five more lower-case letters count as look-alikes
HOST_LOOKALIKES = LOOKALIKES | dict(zip("вкмнт", "bkmht", strict=True))
LATIN_TO_CYRILLIC = dict(zip("abcehkmoptxyABCEHKMOPTXY", "авсенкмортхуАВСЕНКМОРТХУ", strict=True))
# letters typed for digits
DIGIT_LOOKALIKES = dict(zip("боОзЗІl", "6003311", strict=True))

# --- fixed values: hosts ---------------------------------------------------------------------
HOST_SYNONYMS = {
    "threads.net": "threads.com",
    "twitter.com": "x.com",
    "x.twitter.com": "x.com",
    "vk.ru": "vk.com",
    "telegram.me": "t.me",
    "telegram.dog": "t.me",
    "fb.com": "facebook.com",
    "fb.me": "facebook.com",
    "instagr.am": "instagram.com",
    "vm.tiktok.com": "tiktok.com",
    "vt.tiktok.com": "tiktok.com",
    "odnoklassniki.ru": "ok.ru",
    "treads.com": "threads.com",
    "theads.com": "threads.com",
    "threads.eom": "threads.com",
    "tiktok.eom": "tiktok.com",
    "youtube.eom": "youtube.com",
    "yotube.com": "youtube.com",
    "youtub.com": "youtube.com",
    "instgram.com": "instagram.com",
    "intagram.com": "instagram.com",
    "instagramm.com": "instagram.com",
    "facebok.com": "facebook.com",
    "faceboook.com": "facebook.com",
    "twiter.com": "x.com",
}
SERVICE_PREFIXES = ("www.", "m.", "web.", "l.", "mobile.", "ru-ru.", "en.", "ru.")
PLATFORM_OF_HOST = {
    "t.me": "telegram",
    "instagram.com": "instagram",
    "vk.com": "vk",
    "facebook.com": "facebook",
    "tiktok.com": "tiktok",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
    "ok.ru": "ok",
    "odnoklassniki.ru": "ok",
    "x.com": "x",
    "threads.com": "threads",
    "linkedin.com": "linkedin",
    "soundcloud.com": "soundcloud",
    "linktr.ee": "linktree",
    "taplink.cc": "taplink",
    "patreon.com": "patreon",
    "invite.viber.com": "viber",
}
SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "cutt.ly", "is.gd", "tinyurl.ru", "clck.ru")
GENERIC_HOSTS = (
    "apps.apple.com", "play.google.com", "itunes.apple.com", "archive.is", "archive.org", "web.archive.org",
    "cdn.ampproject.org", "ampproject.org", "docs.google.com", "drive.google.com", "sites.google.com",
    *SHORTENERS, "anchor.fm", "podcasts.apple.com", "open.spotify.com", "wa.me", "chat.whatsapp.com",
)
KNOWN_TLDS = tuple(
    dict.fromkeys(
        (
            "by ru ua pl lt lv ee de fr uk eu us ca cz sk md ge kz am "
            "com net org info biz name pro site online top live life news media "
            "io me cc tv co app link click space website store blog press "
            "team world today info page one xyz art fm ga tk ml cf"
        ).split()
    )
)

# --- fixed values: what the scanners of running text look for (patterns of Java) -------------
URL_PATTERN = "(?i)(?:https?://|www\\.)[^\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000<>\"'«»]+"
DOMAIN_PATTERN = r"(?U)(?<![\w/@.-])((?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,12})(?![\w@.-])"
HANDLE_PATTERN = r"(?U)(?<![\w/@.])@([A-Za-z][\w.]{3,31})\b"
SPELLED_ID_PATTERN = r"(?iU)последовательност[ьи]\s+цифр\s*:?\s*(\d[\d\s]*)"

# --- fixed values: path words that name no account -------------------------------------------
RESERVED = {
    "telegram": ("s", "c", "joinchat", "addstickers", "share", "proxy", "socks"),
    "vk": ("wall", "video", "videos", "album", "albums", "photo", "topic", "away"),
    "facebook": ("groups", "profile.php", "people", "share", "pages", "watch", "pg"),
    "ok": ("group", "profile", "video", "videos", "topic", "dk"),
    "instagram": ("p", "reel", "reels", "tv", "stories", "explore"),
    "tiktok": ("video", "tag", "music", "discover"),
    "x": ("i", "status", "hashtag", "search", "intent"),
}

# --- fixed values: edges of addresses in running text ----------------------------------------
EDGE_JUNK = ".,;:!?«»\"'()[]<>–—“”„"
INVISIBLE = "\u00ad\u200b\ufeff"

# --- fixed values: wording of the reference list ---------------------------------------------
HEADER_MARKERS = ("вид экстремистских материалов", "наименование суда")
CANCELLED_WORD = "отменен[оа]"
OFFLINE_MARKERS = (
    "книжное издание", "книжные издания", "печатное издание", "печатные издания", "музыкальн",
    "аудиозапис", "cd-r", "dvd", "брошюр", "листовк",
)

# --- fixed values: labels --------------------------------------------------------------------
TRACE_LABELS = {
    "subscription": "подписка",
    "like": "лайк",
    "repost": "переслано вами",
    "repost_received": "переслано вам (получено)",
    "view": "история просмотров",
    "link": "ссылка, отправленная вами",
    "link_received": "ссылка, полученная в переписке",
    "saved": "сохранённое или закладки",
    "search": "поисковый запрос",
    "comment": "комментарий",
    "visit": "посещение сайта",
}
EXACT, PROBABLE = "exact", "probable"
CONFIDENCE_LABELS = {EXACT: "точное совпадение", PROBABLE: "вероятное совпадение"}
BOUND_KINDS = ("numeric_id", "channel_id", "video", "post", "invite")
MIN_SHARED_LENGTH = 5
SUBSCRIPTION_CLASSES = ("Channel", "Chat", "ChatForbidden", "ChannelForbidden")


@lru_cache(maxsize=1)
def delimiter_aliases() -> str:
    """Characters whose compatibility form contains a delimiter of addresses; hosts with them are refused."""
    return "".join(c for c in map(chr, range(128, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and set(unicodedata.normalize("NFKC", c)) & set("/?#@:"))
