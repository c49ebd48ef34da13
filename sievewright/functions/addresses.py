"""Addresses to identifiers.

``with_identifiers`` adds an array of (platform, kind, value, raw, notes) to each row by a chain of
projections, so that each step is evaluated once and Catalyst can prune what is not used. Platforms are told
apart by host; each has one expression that reads the path's segments and the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as t
from . import text as x

IDENTIFIER = "array<struct<platform:string,kind:string,value:string,raw:string,notes:array<string>>>"
_PAIRS = "array<struct<kind:string,value:string,note:string>>"
_TEMP = ("_raw", "_found", "_address", "_netloc", "_path", "_query", "_host", "_platform", "_segments", "_odd", "_notes", "_pairs")


def _pair(kind: str, value: Column, note: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), (F.lit(None).cast("string") if note is None else note).alias("note"))


def _one(kind: str, value: Column) -> Column:
    return F.array(_pair(kind, value))


def _handle(value: Column) -> Column:
    return _one("handle", F.lower(value))


def _none() -> Column:
    return F.array().cast(_PAIRS)


def numeric_or_handle(value: Column) -> Column:
    """A number, or both readings of one with a few letters in it, or a handle."""
    count = F.length(F.regexp_replace(value, r"(?U)[^\d]", ""))
    readings = F.array_distinct(F.filter(F.array(x.translate(value, t.DIGIT_LOOKALIKES), F.regexp_replace(value, r"(?U)[^\d]", "")), lambda r: r.rlike(r"(?U)^\d+$")))
    spoilt = (count >= 4) & (count / F.length(value) > 0.7) & (F.size(readings) > 0)
    return (
        F.when(value.rlike(r"(?U)^\d+$"), _one("numeric_id", value))
        .when(spoilt, F.transform(readings, lambda r: _pair("numeric_id", r, F.lit("digits:letters"))))
        .otherwise(_handle(value))
    )


def parameter(query: Column, name: str) -> Column:
    """The first value of a query parameter that is not blank, decoded; else NULL."""
    parts = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 0) & (F.length(_after(p)) > 0) & (x.form_decode(F.substring_index(p, "=", 1)) == name))
    return x.form_decode(_after(F.get(parts, F.lit(0))))


def _after(p: Column) -> Column:
    return F.regexp_replace(p, "^[^=]*=", "")


def fix_path_segment(c: Column) -> Column:
    """Decoded, cut at the first blank, look-alikes repaired. May become empty."""
    return x.fix_segment(cut_segment(c))


def cut_segment(c: Column) -> Column:
    return F.split(x.percent_decode(c), rf"(?U)\u00a0|{x.SPACE}", 2)[0]


def _reserved(platform: str, low: Column) -> Column:
    return low.isin(*t.RESERVED[platform])


def _telegram(seg: Callable[[int], Column], more: Callable[[int], Column], query: Column) -> Column:
    low, digits = F.lower(x.to_latin(seg(0))), F.regexp_replace(seg(1), r"(?U)[^\d]", "")
    return (
        F.when((low == "s") & more(2), _handle(seg(1)))
        .when((low == "c") & more(2), F.when(digits != "", _one("numeric_id", digits)).otherwise(_none()))
        .when((low == "joinchat") & more(2), _one("invite", seg(1)))
        .when(seg(0).startswith("+"), _one("invite", F.substring(seg(0), 2, 1 << 20)))
        .when((low == "addstickers") & more(2), _one("stickerset", F.lower(seg(1))))
        .when(_reserved("telegram", low), _none())
        .otherwise(_handle(seg(0)))
    )


def _vk(seg, more, query) -> Column:
    low = F.lower(seg(0))
    owner, item = r"(?U)^(?:public|club|id|event|group)(\d+)$", r"(?U)^(?:wall|video|photo|album|topic)-?(\d+)_\d+$"
    return (
        F.when(low.rlike(owner), _one("numeric_id", F.regexp_extract(low, owner, 1)))
        .when(low.rlike(item), _one("numeric_id", F.regexp_extract(low, item, 1)))
        .when(_reserved("vk", low), _none())
        .otherwise(_handle(seg(0)))
    )


def _facebook(seg, more, query) -> Column:
    low, page, video = F.lower(seg(0)), parameter(query, "id"), parameter(query, "v")
    return (
        F.when(low == "profile.php", F.when(page.isNotNull(), _one("numeric_id", x.strip(page))).otherwise(_none()))
        .when((low == "groups") & more(2), _one("group", F.lower(seg(1))))
        .when((low == "people") & more(3), _one("numeric_id", seg(2)))
        .when((low == "pg") & more(2), _handle(seg(1)))
        .when(low == "watch", F.when(video.isNotNull(), _one("video", video)).otherwise(_none()))
        .when(low.rlike(r"(?U)^\d+$"), _one("numeric_id", low))
        .when(_reserved("facebook", low), _none())
        .otherwise(_handle(seg(0)))
    )


def _instagram(seg, more, query) -> Column:
    name = F.ltrim(seg(0), F.lit("@"))
    low = F.lower(name)
    return F.when(low.isin("p", "reel", "reels", "tv") & more(2), _one("post", seg(1))).when(_reserved("instagram", low), _none()).otherwise(_handle(name))


def _tiktok(segments: Column, seg, more, query) -> Column:
    at = lambda p, i: (
        F.when(p.startswith("@") & (F.length(p) > 1), _pair("handle", F.lower(F.substring(p, 2, 1 << 20))))
        .when((F.lower(p) == "video") & (i + 1 < F.size(segments)), _pair("video", F.get(segments, i + 1)))
    )
    found = F.filter(F.transform(segments, at), lambda p: p.isNotNull())
    return F.when(F.size(found) > 0, found).when(_reserved("tiktok", F.lower(seg(0))), _none()).otherwise(_handle(seg(0)))


def _youtube(host: Column, seg, more, query) -> Column:
    low, video = F.lower(seg(0)), parameter(query, "v")
    note = F.when(x.is_misspelt(cut_segment(video)), F.lit("path:lookalikes"))
    return (
        F.when(host == "youtu.be", _one("video", seg(0)))
        .when((low == "channel") & more(2), _one("channel_id", seg(1)))
        .when(low.isin("c", "user") & more(2), _handle(seg(1)))
        .when(seg(0).startswith("@") & (F.length(seg(0)) > 1), _handle(F.substring(seg(0), 2, 1 << 20)))
        .when(low == "watch", F.when(video.isNotNull(), F.array(_pair("video", fix_path_segment(video), note))).otherwise(_none()))
        .when((low == "shorts") & more(2), _one("video", seg(1)))
        .when(low.isin("playlist", "results"), _none())
        .otherwise(_handle(seg(0)))
    )


def _ok(seg, more, query) -> Column:
    low, glued = F.lower(seg(0)), r"(?U)^(?:group|profile)(\d.*)$"
    old = F.coalesce(*[parameter(query, p) for p in ("st.groupId", "st.groupid", "st.friendId")])
    return (
        F.when(low.isin("group", "profile") & more(2), numeric_or_handle(seg(1)))
        .when(low.rlike(glued), numeric_or_handle(F.regexp_extract(low, glued, 1)))
        .when(low == "dk", F.when(old.isNotNull(), _one("numeric_id", old)).otherwise(_none()))
        .when(_reserved("ok", low), _none())
        .otherwise(_handle(seg(0)))
    )


def _x(seg, more, query) -> Column:
    name = F.ltrim(seg(0), F.lit("@"))
    return F.when(_reserved("x", F.lower(name)), _none()).otherwise(_handle(name))


def _pairs_of(platform: Column, host: Column, segments: Column, query: Column) -> Column:
    seg = lambda i: F.get(segments, F.lit(i))
    more = lambda n: F.size(segments) >= n
    site = F.when(host.isin(*t.SHORTENERS) & more(1), F.array(_pair("shortlink", F.concat(host, F.lit("/"), seg(0)), F.lit("shortlink")))).when(x.is_checkable_host(host), _one("domain", host)).otherwise(_none())
    return (
        F.when(platform.isNull(), site)
        .when(~more(1), _none())
        .when(platform == "telegram", _telegram(seg, more, query))
        .when(platform == "vk", _vk(seg, more, query))
        .when(platform == "facebook", _facebook(seg, more, query))
        .when(platform == "instagram", _instagram(seg, more, query))
        .when(platform == "tiktok", _tiktok(segments, seg, more, query))
        .when(platform == "youtube", _youtube(host, seg, more, query))
        .when(platform == "ok", _ok(seg, more, query))
        .when(platform == "x", _x(seg, more, query))
        .otherwise(_handle(F.ltrim(seg(0), F.lit("@"))))
    )


@lru_cache(maxsize=4)
def _steps(gateway: int) -> tuple[dict[str, Column], ...]:
    """The projections of ``with_identifiers``, each on what the ones before it made.

    They name temporary columns only, so they are built once for a JVM (thousands of gateway calls) and used
    for every table.
    """
    c = F.col
    form = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    full = F.when(F.instr(c("_address"), "//") > 0, c("_address")).otherwise(F.concat(F.lit("https://"), c("_address")))
    odd = x.any_of(t.delimiter_aliases() + "[]")
    split = F.filter(F.split(c("_path"), "/"), lambda s: s != "")
    path_notes = F.transform(F.filter(c("_segments"), x.is_misspelt), lambda s: F.lit("path:lookalikes"))
    platform = F.coalesce(c("_platform"), F.lit("web"))

    def identifier(p: Column, value: Column, note: Column) -> Column:
        notes = F.filter(F.concat(c("_notes"), F.array(p["note"], note)), lambda n: n.isNotNull())
        return F.struct(platform.alias("platform"), p["kind"].alias("kind"), value.alias("value"), c("_raw").alias("raw"), notes.alias("notes"))

    plain = F.lit(None).cast("string")
    mixed = F.filter(c("_pairs"), lambda p: (p["kind"] != "domain") & x.is_mixed_script(p["value"]))
    twins = F.flatten(F.transform(mixed, lambda p: F.array(identifier(p, x.latin_variant(p["value"]), F.lit("variant:latin")), identifier(p, x.cyrillic_variant(p["value"]), F.lit("variant:cyrillic")))))
    found = F.concat(F.transform(c("_pairs"), lambda p: identifier(p, p["value"], plain)), F.filter(twins, lambda i: i["value"].isNotNull()))
    return (
        {"_address": x.clean_address(c("_raw"))},
        {"_address": F.when(c("_address") != "", full)},
        {f"_{n}": F.regexp_extract(c("_address"), form, i) for i, n in enumerate(("netloc", "path", "query"), 1)},
        {"_netloc": F.when(~c("_netloc").rlike(odd), F.substring_index(F.substring_index(c("_netloc"), "@", 1), ":", 1))},
        {"_host": F.when(c("_netloc") != "", x.normalize_host(c("_netloc"))), "_odd": x.is_odd(c("_path")), "_segments": split},
        {"_segments": F.when(c("_odd"), F.transform(c("_segments"), cut_segment)).otherwise(c("_segments"))},
        {
            "_platform": x.looked_up(c("_host"), t.PLATFORM_OF_HOST),
            "_notes": F.concat(x.host_notes(c("_netloc"), c("_host")), F.when(c("_odd"), path_notes).otherwise(F.array().cast("array<string>"))),
            "_segments": F.when(c("_odd"), F.transform(c("_segments"), x.fix_segment)).otherwise(c("_segments")),
        },
        {"_pairs": F.when(c("_host").isNotNull(), _pairs_of(c("_platform"), c("_host"), c("_segments"), c("_query"))).otherwise(_none())},
        {"_found": found},
    )


def with_identifiers(df: DataFrame, address: str, out: str = "identifiers") -> DataFrame:
    """``df`` with the identifiers of the address in column ``address``; none for NULL and for what is no address."""
    df = df.withColumn("_raw", F.col(address))
    for step in _steps(id(df.sparkSession.sparkContext._gateway)):
        df = df.withColumns(step)
    return df.withColumn(out, F.col("_found")).drop(*_TEMP)
