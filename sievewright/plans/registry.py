"""Query and oracle registry of the screening engine: each query with the DuckDB SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import addresses as a
from ..functions import tables as t
from ..functions import text as x
from ..operators import matching, observations, reference_list, report
from ..sources import browser, documents
from ..streaming import live
from . import files
from . import inputs as i

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- addresses ---------------------------------------------------------------------------------------
@query(f"SELECT 'web:domain:' || {i.PAGE_HOST_SQL} AS key, count(*) AS n FROM pages GROUP BY 1")
def visited_domain_counts(spark, sf_dir):
    found = observations.of_visits(i.table(spark, sf_dir, "pages").select("url"), "url")
    return found.groupBy(x.key(F.col("platform"), F.col("kind"), F.col("value")).alias("key")).agg(F.count("*").alias("n"))


_TAILS = ["", ".", ";второй", ", далее", "»"]


@query(
    "SELECT page_id, trim(split_part(split_part(split_part('  «' || url || CASE page_id % 5 WHEN 1 THEN '.' WHEN 2 THEN ';второй' WHEN 3 THEN ', далее' WHEN 4 THEN '»' ELSE '' END || ' слово', ' «', 2), ' ', 1), ',', 1).split_part(';', 1), '.,;:!?«»\"''()[]<>–—“”„') AS address FROM pages"
)
def clean_address(spark, sf_dir):
    pages = i.table(spark, sf_dir, "pages")
    dirty = F.concat(F.lit("  «"), "url", i.by_case(F.col("page_id"), [F.lit(s) for s in _TAILS]), F.lit(" слово"))
    return pages.select("page_id", x.clean_address(dirty).alias("address"))


_SYNONYMS = list(t.HOST_SYNONYMS.items())
_PREFIXES = ["", "www.", "m.", "www.m.", "mobile."]


@query(
    "WITH v(n, typed, meant) AS (VALUES "
    + ", ".join(f"({n}, '{k}', '{v}')" for n, (k, v) in enumerate(_SYNONYMS))
    + f") SELECT n_nationkey, p.n AS prefix, meant AS host FROM nation, (VALUES {', '.join(f'({n})' for n in range(len(_PREFIXES)))}) p(n), v WHERE v.n = n_nationkey % {len(_SYNONYMS)}"
)
def host_spellings(spark, sf_dir):
    nation = i.table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(p) for p in _PREFIXES])).alias("prefix", "p"))
    typed = F.element_at(F.array(*[F.lit(k) for k, _ in _SYNONYMS]), F.col("n_nationkey") % len(_SYNONYMS) + 1)
    return nation.select("n_nationkey", "prefix", x.normalize_host(F.concat("p", typed)).alias("host"))


@query(
    """WITH s AS (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z]+', '_', 'g') AS slug FROM part),
m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN slug WHEN 1 THEN translate(slug, 'aeopc', 'аеорс') || 'z' ELSE 'жук_' || slug END AS word,
             CASE p_partkey % 3 WHEN 0 THEN slug WHEN 1 THEN slug || 'z' ELSE 'жук_' || slug END AS fixed FROM s)
SELECT p_partkey, word, fixed, nullif(translate(word, 'аеорсухАВЕКМНОРСТХ', 'aeopcyxABEKMHOPCTX'), word) AS latin,
       nullif(translate(word, 'abcehkmoptxyABCEHKMOPTXY', 'авсенкмортхуАВСЕНКМОРТХУ'), word) AS cyrillic FROM m"""
)
def lookalike_words(spark, sf_dir):
    slug = F.regexp_replace("p_name", "[^A-Za-z]+", "_")
    word = i.by_case(F.col("p_partkey"), [slug, F.concat(F.translate(slug, "aeopc", "аеорс"), F.lit("z")), F.concat(F.lit("жук_"), slug)])
    w = F.col("word")
    return i.table(spark, sf_dir, "part").select("p_partkey", word.alias("word")).select("p_partkey", "word", x.fix_segment(w).alias("fixed"), x.latin_variant(w).alias("latin"), x.cyrillic_variant(w).alias("cyrillic"))


_HOSTS = ["site.example.by", "bit.ly", "apps.apple.com", "x.cdn.ampproject.org", "nodots", "a.by", "archive.org"]


@query(
    "WITH h AS (SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'site.example.by' WHEN 1 THEN 'bit.ly' WHEN 2 THEN 'apps.apple.com' WHEN 3 THEN 'x.cdn.ampproject.org' WHEN 4 THEN 'nodots' WHEN 5 THEN 'a.by' ELSE 'archive.org' END AS host FROM nation) SELECT n_nationkey, host, n_nationkey % 7 = 0 AS checkable FROM h"
)
def checkable_hosts(spark, sf_dir):
    host = i.by_case(F.col("n_nationkey"), [F.lit(h) for h in _HOSTS])
    return i.table(spark, sf_dir, "nation").select("n_nationkey", host.alias("host")).withColumn("checkable", x.is_checkable_host(F.col("host")))


#: For each platform, addresses and the identifiers that they give.
ADDRESSES: dict[str, list[tuple[str, list[tuple[str, str]]]]] = {
    "telegram": [
        ("https://t.me/{H}.", [("handle", "{h}")]), ("t.me/s/{H}", [("handle", "{h}")]), ("https://t.me/joinchat/{H}", [("invite", "{H}")]),
        ("https://t.me/c/{k}/5", [("numeric_id", "{k}")]), ("telegram.me/addstickers/{H}", [("stickerset", "{h}")]), ("https://t.me/+{H};", [("invite", "{H}")]), ("https://t.me/share/{H}", []),
    ],
    "vk": [
        ("https://vk.com/{H}", [("handle", "{h}")]), ("https://m.vk.com/public{k}", [("numeric_id", "{k}")]), ("vk.ru/wall-{k}_17", [("numeric_id", "{k}")]),
        ("https://vk.com/id{k}?w=1", [("numeric_id", "{k}")]), ("https://vk.com/albums", []), ("https://vk.соm/{H},", [("handle", "{h}")]),
    ],
    "facebook": [
        ("https://www.facebook.com/{H}/", [("handle", "{h}")]), ("fb.com/profile.php?id={k}", [("numeric_id", "{k}")]), ("https://facebook.com/groups/{H}", [("group", "{h}")]),
        ("https://facebook.com/people/Name/{k}", [("numeric_id", "{k}")]), ("https://facebook.com/pg/{H}", [("handle", "{h}")]), ("https://facebook.com/watch?x=&v={k}", [("video", "{k}")]), ("https://facebook.com/share/x", []),
    ],
    "instagram": [
        ("https://instagram.com/@{H}", [("handle", "{h}")]), ("instagram.com/p/{H}", [("post", "{H}")]), ("https://www.instagram.com/reel/{H}/", [("post", "{H}")]), ("https://instagram.com/explore/x", []),
    ],
    "tiktok": [
        ("https://www.tiktok.com/@{H}/video/{k}", [("handle", "{h}"), ("video", "{k}")]), ("https://vm.tiktok.com/{H}", [("handle", "{h}")]), ("https://tiktok.com/tag/{H}", []),
    ],
    "youtube": [
        ("https://youtu.be/{H}?t=1", [("video", "{H}")]), ("https://www.youtube.com/channel/{H}", [("channel_id", "{H}")]), ("https://youtube.com/c/{H}", [("handle", "{h}")]), ("https://youtube.com/@{H}", [("handle", "{h}")]),
        ("https://m.youtube.com/watch?a=1&v={H}", [("video", "{H}")]), ("https://youtube.com/shorts/{H}", [("video", "{H}")]), ("https://youtube.com/playlist?list={k}", []),
    ],
    "ok": [
        ("https://ok.ru/{H}", [("handle", "{h}")]), ("https://ok.ru/group/4471{k}", [("numeric_id", "4471{k}")]), ("ok.ru/profile4471{k}", [("numeric_id", "4471{k}")]),
        ("https://ok.ru/dk?st.cmd=x&st.groupId={k}", [("numeric_id", "{k}")]), ("https://ok.ru/group/4471{k}б0001", [("numeric_id", "4471{k}60001"), ("numeric_id", "4471{k}0001")]), ("https://odnoklassniki.ru/video", []),
    ],
    "x": [("https://twitter.com/{H}/status/{k}", [("handle", "{h}")]), ("https://x.com/@{H}", [("handle", "{h}")]), ("https://x.com/hashtag/{H}", [])],
    "linkedin": [("https://www.linkedin.com/in/{H}", [("handle", "in")]), ("linkedin.com/@{H}", [("handle", "{h}")])],
    "threads": [("https://www.threads.net/@{H}", [("handle", "{h}")]), ("https://theads.com/{H}", [("handle", "{h}")])],
    "patreon": [("https://patreon.com/{H}", [("handle", "{h}")])],
    "soundcloud": [("https://soundcloud.com/{H}/sets/x", [("handle", "{h}")])],
    "linktree": [("https://linktr.ee/{H}", [("handle", "{h}")])],
    "taplink": [("taplink.cc/@{H}", [("handle", "{h}")])],
    "viber": [("https://invite.viber.com/{H}?g2=x", [("handle", "{h}")])],
}


def _address_query(platform: str) -> None:
    cases = ADDRESSES[platform]

    def run(spark, sf_dir):
        s = i.suppliers(spark, sf_dir)
        address = i.by_case(F.col("s_suppkey"), [i.filled(c, H=F.col("as_typed"), h=F.col("as_handle"), k=F.col("k")) for c, _ in cases])
        found = a.with_identifiers(s.withColumn("address", address), "address")
        return observations.unrolled(found, ["s_suppkey"], "identifiers").select("s_suppkey", "ident_pos", "_i.platform", "_i.kind", "_i.value")

    parts = [
        f"SELECT s_suppkey, {pos} AS ident_pos, '{platform}' AS platform, '{kind}' AS kind, {i.filled_sql(value, **i.SQL_NAMES)} AS value FROM s WHERE s_suppkey % {len(cases)} = {n}"
        for n, (_, expected) in enumerate(cases)
        for pos, (kind, value) in enumerate(expected)
    ]
    run.__name__ = f"parse_{platform}"
    query(f"WITH {i.SUPPLIERS_SQL} {' UNION ALL '.join(parts)}")(run)


for _platform in ADDRESSES:
    _address_query(_platform)


@query("WITH d AS (SELECT s_suppkey, (10000000 + s_suppkey * 37)::VARCHAR AS n FROM supplier) SELECT s_suppkey, 0 AS pos, 'numeric_id' AS kind, left(n, 5) || '6' || substr(n, 6) AS value FROM d UNION ALL SELECT s_suppkey, 1, 'numeric_id', n FROM d")
def numeric_readings(spark, sf_dir):
    n = (F.col("s_suppkey") * 37 + 10_000_000).cast("string")
    typed = F.concat(F.substring(n, 1, 5), F.lit("б"), F.substring(n, 6, 20))
    found = i.table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(a.numeric_or_handle(typed)).alias("pos", "f"))
    return found.select("s_suppkey", "pos", "f.kind", "f.value")


@query(
    """SELECT conv_id, turn, 'https://t.me/u' || conv_id || ',' AS urls, 'site' || conv_id || '.info' AS domains, '77' || conv_id AS ids, 'user' || conv_id || 'x' AS handles FROM conversations"""
)
def text_scanners(spark, sf_dir):
    c = F.col("conv_id")
    tail = i.filled(" см. https://t.me/u{c}, site{c}.info, a@site{c}.info, файл{c}.wmv последовательность  цифр: 7 7{c} и @user{c}x", c=c)
    rows = i.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("s"))
    joined = lambda f: F.array_join(f(F.col("s")), " ")
    return rows.select("conv_id", "turn", joined(x.find_urls).alias("urls"), joined(x.find_bare_domains).alias("domains"), joined(x.find_spelled_ids).alias("ids"), joined(x.find_bare_handles).alias("handles"))


@query("SELECT doc_id, 0 AS n_handles, 0 AS n_domains FROM documents")
def document_negatives(spark, sf_dir):
    """Running prose has mail addresses and no handles or hosts."""
    d = i.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(x.find_bare_handles(F.col("text"))).alias("n_handles"), F.size(x.find_bare_domains(F.col("text"))).alias("n_domains"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS folded FROM conversations")
def folded_texts(spark, sf_dir):
    return i.table(spark, sf_dir, "conversations").select("conv_id", "turn", x.fold_text(F.col("text")).alias("folded"))


@query(f"WITH {i.SUPPLIERS_SQL} SELECT s_suppkey, 'telegram:handle:s' || h AS segment, 'youtube:video:' || H_ AS video, '[]' AS nothing FROM s")
def decoded_segments(spark, sf_dir):
    """Percent escapes and blanks in paths and in a query."""
    s = i.suppliers(spark, sf_dir)
    cases = {"segment": "https://t.me/%73{H}%20tail", "video": "https://youtube.com/watch?v={H}+x", "nothing": "https://t.me/%20{H}"}
    for name, template in cases.items():
        found = a.with_identifiers(s.withColumn("_u", i.filled(template, H=F.col("as_typed"))), "_u", "_ids")
        one = F.when(F.size("_ids") == 0, F.lit("[]")).otherwise(F.array_join(F.transform("_ids", lambda p: x.key(p["platform"], p["kind"], p["value"])), " "))
        if name == "nothing":  # a segment that becomes empty is kept as an empty handle, which never matches
            one = F.when(F.size(F.filter("_ids", lambda p: p["value"] != "")) == 0, F.lit("[]")).otherwise(one)
        s = found.withColumn(name, one).drop("_u", "_ids")
    return s.select("s_suppkey", *cases)


@query(
    f"""WITH {i.SUPPLIERS_SQL}, v AS (SELECT s_suppkey, lower('жук_' || H_) AS v FROM s)
SELECT s_suppkey, 0 AS ident_pos, v AS value, '' AS note FROM v
UNION ALL SELECT s_suppkey, 1, translate(v, 'аеорсух', 'aeopcyx'), 'variant:latin' FROM v
UNION ALL SELECT s_suppkey, 2, translate(v, 'abcehkmoptxy', 'авсенкмортху'), 'variant:cyrillic' FROM v"""
)
def spelling_variants(spark, sf_dir):
    s = i.suppliers(spark, sf_dir).withColumn("_u", F.concat(F.lit("https://t.me/жук_"), F.col("as_typed")))
    found = observations.unrolled(a.with_identifiers(s, "_u", "_ids"), ["s_suppkey"])
    return found.select("s_suppkey", "ident_pos", "_i.value", F.array_join("_i.notes", " ").alias("note"))


@query(f"WITH {i.SUPPLIERS_SQL} SELECT s_suppkey, h AS handle, k AS number, s_suppkey % 2 = 0 AS mixed, CASE WHEN s_suppkey % 2 = 0 THEN 'B (' || k || ')' ELSE 'B' END AS profile, s_suppkey % 3 || ' days ago' AS age FROM s WHERE s_suppkey % 3 > 1 UNION ALL SELECT s_suppkey, h, k, s_suppkey % 2 = 0, CASE WHEN s_suppkey % 2 = 0 THEN 'B (' || k || ')' ELSE 'B' END, CASE s_suppkey % 3 WHEN 0 THEN 'today' ELSE 'yesterday' END FROM s WHERE s_suppkey % 3 < 2")
def typed_values(spark, sf_dir):
    """Handles and numbers known without an address, mixed scripts, labels of profiles and ages."""
    s, k = i.suppliers(spark, sf_dir), F.col("s_suppkey")
    now = F.lit("2024-05-10 12:00:00").cast("timestamp")
    built = F.date_format(now - F.make_dt_interval((k % 3).cast("int")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return s.select(
        "s_suppkey", observations.handle_value(F.concat(F.lit(" @"), "as_typed", F.lit("\n"))).alias("handle"), observations.number_value(F.concat(F.lit("-"), "k", F.lit(" "))).alias("number"),
        x.is_mixed_script(F.concat("as_typed", F.when(k % 2 == 0, F.lit("ж")).otherwise(""))).alias("mixed"), x.profile_label(F.lit("B"), F.when(k % 2 == 0, F.col("k"))).alias("profile"), x.age_label(built, now).alias("age"),
    )


@query(r"SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g')) AS t FROM documents)")
def shortened_texts(spark, sf_dir):
    return i.table(spark, sf_dir, "documents").select("doc_id", x.shorten(F.col("text"), 80).alias("short"))


# --- sources -----------------------------------------------------------------------------------------
_PAGE_HEAD, _PAGE_ROW = "<table><tr><th>Вид</th></tr><tr><td>", "<p>x</p></td><td><a href='"
_PAGE_TAIL = "'>see</a> &amp; more</td><td>c</td></tr></table>"
_HTML_SQL = f"""'{_PAGE_HEAD}' || page_id || '{_PAGE_ROW.replace("'", "''")}' || replace(url, '&', '&amp;') || '{_PAGE_TAIL.replace("'", "''")}'"""


@query(
    f"""WITH f AS (SELECT page_id, url, sha256({_HTML_SQL}) AS digest FROM pages)
SELECT page_id, 'html' AS kind, digest, 0 AS row_index, 'Вид' AS cells FROM f
UNION ALL SELECT page_id, 'html', digest, 1, page_id || chr(10) || 'x' || chr(10) || '|' || ' ' || url || ' see & more|c' FROM f"""
)
def list_html_rows(spark, sf_dir):
    """Lists of one page each, told apart by content, with the digests of their files."""
    content = F.concat(F.lit(_PAGE_HEAD), "page_id", F.lit(_PAGE_ROW), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(_PAGE_TAIL)).cast("binary")
    all_ = i.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("path"), content.alias("content"))
    rows = documents.rows_of(all_).select("path", "row_index", F.array_join("cells", "|").alias("cells"))
    named = all_.select("page_id", "path", documents.kind_of(F.col("content"), F.col("path")).alias("kind"), documents.file_digest(F.col("content")).alias("digest"))
    return named.join(rows, "path").select("page_id", "kind", "digest", "row_index", "cells")


def _composed(spark, sf_dir, make, suffix: str) -> DataFrame:
    """A file for each supplier: s_suppkey, path, content."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{k}{suffix}" for k in cols[0]]), pa.array([make(*r) for r in zip(*cols, strict=True)], pa.binary())], names=["s_suppkey", "path", "content"])

    return i.suppliers(spark, sf_dir).select("s_suppkey", "as_typed", "as_handle", "k").mapInArrow(run, "s_suppkey long, path string, content binary")


def _listed(all_: DataFrame) -> DataFrame:
    rows = documents.rows_of(all_).select("path", "row_index", F.array_join("cells", "|").alias("cells"))
    return all_.select("s_suppkey", "path", documents.kind_of(F.col("content"), F.col("path")).alias("kind")).join(rows, "path").select("s_suppkey", "kind", "row_index", "cells")


@query(f"WITH {i.SUPPLIERS_SQL} SELECT s_suppkey, 'docx' AS kind, 0 AS row_index, chr(10) || 'вид' || '|' || chr(10) || 'a & b' AS cells FROM s UNION ALL SELECT s_suppkey, 'docx', 1, chr(10) || k || '|' || chr(10) || ' https://vk.com/' || h || '?a=1&b=2 ' || H_ || '|' || chr(10) || 'суд' FROM s")
def list_docx_rows(spark, sf_dir):
    return _listed(_composed(spark, sf_dir, lambda key, typed, handle, k: files.docx([["вид", "a & b"], [k, f"@{typed}", "суд"]], f"https://vk.com/{handle}?a=1&b=2"), ".bin"))


@query(f"WITH {i.SUPPLIERS_SQL} SELECT s_suppkey, 'doc' AS kind, 0 AS row_index, '“' || k || '” – …|see  https://t.me/' || h || ' here' || chr(10) || 'on 7|court' AS cells FROM s UNION ALL SELECT s_suppkey, 'doc', 1, 'суд|' || k FROM s")
def list_doc_rows(spark, sf_dir):
    """Word 97 files: sectors, small streams, pieces of one and two bytes, fields, cell marks."""
    narrow = lambda handle, k: f"“{k}” – …\x07see \x13 HYPERLINK \"https://t.me/{handle}\" \x14here\x15\x0bon \x13 PAGE \x147\x15\x07court\x07\x07"
    made = _composed(spark, sf_dir, lambda key, typed, handle, k: files.doc(narrow(handle, k), f"суд\x07{k}\x07\x07"), "")
    return _listed(made)


@query(f"WITH {i.SUPPLIERS_SQL} SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'Ёлка ≤ ' ELSE 'Ёлка ' END || h AS text FROM s")
def list_encodings(spark, sf_dir):
    """UTF-8, then the two Cyrillic code pages: the second one by a byte that the first has not."""

    def make(key, typed, handle, k):
        text = ("Ёлка ≤ " if key % 3 == 2 else "Ёлка ") + handle
        return text.encode(("utf-8", "cp1251", "koi8-r")[key % 3])

    return _composed(spark, sf_dir, make, ".txt").select("s_suppkey", documents.decoded(F.col("content")).alias("text"))


@query("SELECT s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.odt' WHEN 1 THEN '.docx' ELSE '.doc' END AS path FROM supplier ORDER BY path LIMIT 10")
def list_first_errors(spark, sf_dir):
    """Files that can't be read give an error row each; a reader is shown the first ten."""
    made = _composed(spark, sf_dir, lambda key, typed, handle, k: (b"junk", b"PK\x03\x04" + handle.encode(), bytes.fromhex("D0CF11E0A1B11AE1") + b"short")[key % 3], "")
    made = made.withColumn("path", F.concat("path", i.by_case(F.col("s_suppkey"), [F.lit(e) for e in (".odt", ".docx", ".doc")])))
    return documents.first_errors(documents.rows_of(made)).select("path")


def _history(engine: str, epoch: int):
    # by name, as modules of the package would travel whole
    compose, ask, sql = files.history, browser.query, browser.HISTORY[engine]

    def run(spark, sf_dir):
        import pyarrow as pa

        def read(key, table):
            rows = table.sort_by("page_id").to_pydict()
            found = compose(list(zip(rows["url"], rows["micros"], rows["n"], strict=True)), engine, lambda path, _: ask(path, sql))
            url, micros, n = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            return pa.table({"profile": pa.array([key[0].as_py()] * len(url), pa.int64()), "seq": pa.array(range(len(url)), pa.int64()), "url": pa.array(url, pa.string()), "micros": pa.array(micros, pa.int64()), "n": pa.array(n, pa.int64())})

        p = F.col("page_id")
        micros = F.when(p % 5 != 0, (p + 20_000) * 86_400_000_000 + epoch * 1_000_000)
        url = F.col("url") if engine == browser.CHROMIUM else F.when(p % 7 != 0, F.col("url"))
        pages = i.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), micros.alias("micros"), F.when(p % 4 != 0, p % 3).cast("long").alias("n"), (F.floor(p / 100)).alias("profile"))
        raw = pages.groupBy("profile").applyInArrow(read, "profile long, seq long, url string, micros long, n long")
        return browser.history_of(raw, engine).groupBy("url").agg(F.count("*").alias("n_rows"), F.sum("visit_count").alias("visits"), F.max("occurred_at").alias("occurred_at"))

    run.__name__ = f"{engine}_history"
    kept = "" if engine == browser.CHROMIUM else "WHERE page_id % 7 <> 0"
    query(f"SELECT url, count(*) AS n_rows, sum(CASE WHEN page_id % 4 = 0 OR page_id % 3 = 0 THEN 1 ELSE page_id % 3 END)::BIGINT AS visits, max(CASE WHEN page_id % 5 <> 0 THEN DATE '1970-01-01' + (page_id + 20000)::INTEGER END) AS occurred_at FROM pages {kept} GROUP BY 1")(run)


_history(browser.CHROMIUM, 11_644_473_600)
_history(browser.FIREFOX, 0)


@query("SELECT page_id, 0 AS place, url FROM pages UNION ALL SELECT page_id, 1, url || '#2' FROM pages UNION ALL SELECT page_id, 2, url || '#3' FROM pages")
def chromium_bookmarks(spark, sf_dir):
    """Trees of folders, a file for each page."""
    node = lambda tail: F.struct(F.lit("url").alias("type"), F.concat("url", F.lit(tail)).alias("url"))
    folder = F.struct(F.lit("folder").alias("type"), F.array(node("#2")).alias("children"))
    mixed = F.to_json(F.struct(F.struct(F.struct(F.lit("folder").alias("type"), F.array(F.to_json(node("")), F.to_json(folder)).alias("children")).alias("bar"), node("#3").alias("other")).alias("roots")))
    plain = F.regexp_replace(F.regexp_replace(F.replace(mixed, F.lit('\\"'), F.lit('"')), '"\\{', "{"), '\\}"', "}")

    read = browser.tree_urls

    @F.pandas_udf("array<string>")
    def urls(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return i.table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls(plain)).alias("place", "url"))


@query("SELECT p_partkey AS seq, url FROM part JOIN pages ON page_id = p_partkey % 97 WHERE p_partkey % 3 <> 0")
def firefox_bookmarks(spark, sf_dir):
    k = F.col("p_partkey")
    marks = i.table(spark, sf_dir, "part").select(k.alias("seq"), (k % 97).alias("fk"), F.when(k % 3 == 0, 2).otherwise(1).alias("type"))
    return browser.join_bookmarks(marks, i.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


# --- the list ----------------------------------------------------------------------------------------
@query(f"WITH {i.REFERENCE_SQL} SELECT id, row_index, material_type, description, court, is_cancelled, is_offline FROM e")
def list_entries(spark, sf_dir):
    e = reference_list.entries_of(i.list_cells(spark, sf_dir))
    return e.select("id", "row_index", "material_type", "description", "court", "is_cancelled", "is_offline")


@query(f"WITH {i.REFERENCE_SQL} SELECT entry_id, ident_pos, ident_id, platform, kind, value FROM i")
def list_identifiers(spark, sf_dir):
    return i.reference(spark, sf_dir)[1].select("entry_id", "ident_pos", "ident_id", "platform", "kind", "value")


@query(
    f"""WITH {i.REFERENCE_SQL}, n AS (SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE value LIKE '4471%') AS repaired FROM i GROUP BY 1)
SELECT count(*) AS entries, count(*) FILTER (WHERE is_cancelled) AS cancelled, count(*) FILTER (WHERE is_offline) AS offline,
       count(*) FILTER (WHERE NOT is_cancelled AND NOT is_offline AND n IS NULL) AS without_identifiers,
       coalesce(sum(n), 0)::BIGINT AS identifiers, coalesce(sum(repaired), 0)::BIGINT AS repaired FROM e LEFT JOIN n ON e.id = n.entry_id"""
)
def list_summary(spark, sf_dir):
    return reference_list.summary(*i.reference(spark, sf_dir))


@query(f"WITH {i.REFERENCE_SQL} SELECT platform, count(*) AS n, min(ident_id) AS first_id FROM i GROUP BY 1")
def platform_frequencies(spark, sf_dir):
    return reference_list.frequencies(i.reference(spark, sf_dir)[1], "platform")


@query(f"WITH {i.REFERENCE_SQL} SELECT kind, count(*) AS n, min(ident_id) AS first_id FROM i GROUP BY 1")
def kind_frequencies(spark, sf_dir):
    return reference_list.frequencies(i.reference(spark, sf_dir)[1], "kind")


@query(f"WITH {i.REFERENCE_SQL} SELECT entry_id, ident_id FROM i WHERE entry_id IN (SELECT id FROM e WHERE NOT is_cancelled AND is_offline)")
def offline_identifiers(spark, sf_dir):
    """The index semi-join, on offline entries in force."""
    entries, found = i.reference(spark, sf_dir)
    return reference_list.active_identifiers(entries.where("is_offline"), found).select("entry_id", "ident_id")


@query(f"WITH {i.REFERENCE_SQL} SELECT platform, count(*) AS n, min(value) AS sample FROM i GROUP BY 1 HAVING count(*) > 10")
def platform_samples(spark, sf_dir):
    found = i.reference(spark, sf_dir)[1]
    return found.groupBy("platform").agg(F.count("*").alias("n"), F.min("value").alias("sample")).where("n > 10")


@query(
    f"""WITH {i.SUPPLIERS_SQL}, r AS (SELECT s_suppkey, h FROM s)
SELECT s_suppkey, 0 AS ident_pos, 'instagram:handle:' || h || '.info' AS key FROM r UNION ALL SELECT s_suppkey, 1, 'web:domain:site-' || h || '.info' FROM r WHERE false
UNION ALL SELECT s_suppkey, 1, 'web:domain:own.example.org' FROM r UNION ALL SELECT s_suppkey, 2, 'telegram:handle:' || h FROM r"""
)
def suppressed_hosts(spark, sf_dir):
    """Bare hosts of platforms and of go-betweens are none; one that is also a handle of its row is its twin."""
    name = F.replace("as_handle", F.lit("_"), F.lit("-"))
    s = i.suppliers(spark, sf_dir).withColumn("text", F.concat(F.lit("https://instagram.com/"), "as_handle", F.lit(".info , vk.com, bit.ly; own.example.org "), F.lit("own.example.org x"), name.substr(1, 0), F.lit(" @"), "as_handle"))
    found = reference_list.extract_identifiers(s, "text", "s_suppkey")
    return found.select("s_suppkey", "ident_pos", x.key(F.col("platform"), F.col("kind"), F.col("value")).alias("key"))


@query(f"WITH {i.REFERENCE_SQL} SELECT 'entry_count' AS key, count(*)::VARCHAR AS value FROM e UNION ALL SELECT 'identifier_count', count(*)::VARCHAR FROM i UNION ALL SELECT 'source_name', 'list.html' UNION ALL SELECT 'source_sha256', '00' UNION ALL SELECT 'builder_version', '1'")
def snapshot_meta(spark, sf_dir):
    return reference_list.snapshot_meta(*i.reference(spark, sf_dir), "list.html", "00").where("key <> 'built_at'")


@query(f"WITH {i.REFERENCE_SQL} SELECT (SELECT count(*) FROM e) AS entry_count, (SELECT count(*) FROM i) AS identifier_count, 'today' AS age")
def snapshot_summary(spark, sf_dir):
    meta = reference_list.snapshot_meta(*i.reference(spark, sf_dir), "list.html", "00")
    return reference_list.describe_snapshot(meta).select("entry_count", "identifier_count", "age")


@query(
    f"""WITH {i.REFERENCE_SQL}, n AS (SELECT entry_id, count(*) AS n, count(*) FILTER (WHERE value LIKE '4471%') AS repaired FROM i GROUP BY 1),
t AS (SELECT count(*) AS entries, count(*) FILTER (WHERE is_cancelled) AS cancelled, count(*) FILTER (WHERE is_offline) AS offline, count(*) FILTER (WHERE NOT is_cancelled AND NOT is_offline AND n IS NULL) AS without_identifiers,
             coalesce(sum(n), 0)::BIGINT AS identifiers, coalesce(sum(repaired), 0)::BIGINT AS repaired FROM e LEFT JOIN n ON e.id = n.entry_id)
SELECT 'list' AS section, place::INTEGER AS place, label, n FROM t, LATERAL (VALUES (0, 'entries', entries), (1, 'cancelled', cancelled), (2, 'offline', offline), (3, 'without_identifiers', without_identifiers), (4, 'identifiers', identifiers), (5, 'repaired', repaired)) v(place, label, n)
UNION ALL SELECT 'platform', (row_number() OVER (ORDER BY count(*) DESC, min(ident_id)) - 1)::INTEGER, platform, count(*) FROM i GROUP BY platform
UNION ALL SELECT 'kind', (row_number() OVER (ORDER BY count(*) DESC, min(ident_id)) - 1)::INTEGER, kind, count(*) FROM i GROUP BY kind"""
)
def summary_lines(spark, sf_dir):
    return reference_list.summary_lines(*i.reference(spark, sf_dir))


# --- observations ------------------------------------------------------------------------------------
@query(f"WITH {i.TRACES_CTE} SELECT phase, obs_seq, ident_pos, platform, kind, value FROM o")
def trace_observations(spark, sf_dir):
    return observations.of_visits(i.traces(spark, sf_dir), "url").select("phase", "obs_seq", "ident_pos", "platform", "kind", "value")


@query(
    f"""WITH v AS (SELECT page_id, url, {i.PAGE_HOST_SQL} AS value, 1 + page_id % 7 AS c, DATE '2024-01-01' + (page_id % 30)::INTEGER AS d FROM pages)
SELECT value, sum(c)::BIGINT AS visits, max(d) AS occurred_at, arg_min(url, page_id) AS raw, min(page_id) AS obs_seq FROM v GROUP BY 1"""
)
def history_collapse(spark, sf_dir):
    pages = i.table(spark, sf_dir, "pages")
    visits = pages.select(F.col("page_id").alias("obs_seq"), "url", (F.col("page_id") % 7 + 1).alias("visit_count"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")).alias("occurred_at"))
    return observations.collapse_visits(observations.of_visits(visits, "url")).select("value", "visits", "occurred_at", "raw", "obs_seq")


@query(f"WITH v AS (SELECT page_id, {i.PAGE_HOST_SQL} AS value FROM pages) SELECT value, min(page_id) AS obs_seq FROM v GROUP BY 1")
def bookmarks_first(spark, sf_dir):
    marks = i.table(spark, sf_dir, "pages").select(F.col("page_id").alias("obs_seq"), "url")
    return observations.first_by_key(observations.of_visits(marks, "url"), "obs_seq", "ident_pos").select("value", "obs_seq")


@query("SELECT event_id, ts::DATE AS d1601, CASE WHEN event_id % 10 <> 0 THEN ts::DATE END AS d1970 FROM events")
def epoch_dates(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return i.table(spark, sf_dir, "events").select("event_id", x.date_of_1601(micros + 11_644_473_600_000_000).alias("d1601"), x.date_of_1970(F.when(F.col("event_id") % 10 == 0, 0).otherwise(micros)).alias("d1970"))


@query("SELECT event_id, event_type AS code, event_type AS label FROM events WHERE event_type NOT IN ('like', 'view', 'search', 'comment', 'link', 'visit', 'saved', 'repost', 'subscription') UNION ALL SELECT event_id, event_type, CASE event_type WHEN 'like' THEN 'лайк' WHEN 'view' THEN 'история просмотров' WHEN 'search' THEN 'поисковый запрос' WHEN 'comment' THEN 'комментарий' WHEN 'link' THEN 'ссылка, отправленная вами' WHEN 'visit' THEN 'посещение сайта' WHEN 'saved' THEN 'сохранённое или закладки' WHEN 'repost' THEN 'переслано вами' ELSE 'подписка' END FROM events WHERE event_type IN ('like', 'view', 'search', 'comment', 'link', 'visit', 'saved', 'repost', 'subscription')")
def trace_labels(spark, sf_dir):
    return i.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), x.trace_label(F.col("event_type")).alias("label"))


# --- messenger ---------------------------------------------------------------------------------------
def _dialogs(spark, sf_dir):
    c = F.col("conv_id")
    cls = i.by_case(c, [F.lit("Channel"), F.lit("Chat"), F.lit("User"), F.lit("ChannelForbidden")])
    name = lambda n: F.struct(n.alias("username"))
    entity = F.struct(
        cls.alias("cls"), F.when(c % 2 == 0, -(c + 1_001_400_000_000)).otherwise(c + 5000).alias("id"), F.concat(F.lit("T"), c).alias("title"),
        F.when(c % 3 != 0, F.concat(F.lit("Chan_"), c)).alias("username"), F.when(c % 2 == 0, F.array(name(F.concat(F.lit("Chan_"), c)), name(F.concat(F.lit("Alt_"), c)))).alias("usernames"),
    )
    return i.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(c.alias("seq"), F.concat(F.lit("d"), c).alias("name"), entity.alias("entity"))


def _messages(spark, sf_dir):
    c, n = F.col("conv_id"), F.col("turn")
    url = F.struct(F.concat(F.lit("https://vk.com/bar"), c).alias("url"))
    peer = F.struct(F.when(n % 4 == 0, c + 7000).alias("channel_id"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("chat_id"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(n % 3 == 0, F.concat(F.lit(" https://t.me/Foo_"), c)).otherwise(""))
    return i.table(spark, sf_dir, "conversations").select(
        (c * 1000 + n).alias("seq"), F.concat(F.lit("d"), c).alias("dialog"), text.alias("message"), F.when(n % 5 == 0, F.array(url)).alias("entities"),
        F.struct(peer.alias("from_id"), F.lit(None).cast("string").alias("from_name")).alias("fwd_from"), F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp").alias("date"), (F.col("role") == "user").alias("out"),
    )


_DIALOGS_SQL = """c AS (SELECT DISTINCT conv_id FROM conversations),
u AS (SELECT conv_id, 'handle' AS kind, lower('Chan_' || conv_id) AS value, 0 AS ident_pos FROM c WHERE conv_id % 4 <> 2 AND (conv_id % 3 <> 0 OR conv_id % 2 = 0)
      UNION ALL SELECT conv_id, 'handle', lower('Alt_' || conv_id), 1 FROM c WHERE conv_id % 4 <> 2 AND conv_id % 2 = 0
      UNION ALL SELECT conv_id, 'numeric_id', CASE WHEN conv_id % 2 = 0 THEN 1400000000 + conv_id ELSE conv_id + 5000 END::VARCHAR,
                       CASE WHEN conv_id % 2 = 0 THEN 2 WHEN conv_id % 3 <> 0 THEN 1 ELSE 0 END FROM c WHERE conv_id % 4 <> 2)"""
_MESSAGES_SQL = """m AS (SELECT conv_id * 1000 + turn AS obs_seq, 0 AS part, 'telegram' AS platform, 'numeric_id' AS kind, (conv_id + 7000)::VARCHAR AS value,
        CASE WHEN role = 'user' THEN 'repost' ELSE 'repost_received' END AS trace_type, DATE '2024-01-01' + turn::INTEGER AS occurred_at FROM conversations WHERE turn % 4 = 0
      UNION ALL SELECT conv_id * 1000 + turn, 1, 'telegram', 'handle', 'foo_' || conv_id, CASE WHEN role = 'user' THEN 'link' ELSE 'link_received' END, DATE '2024-01-01' + turn::INTEGER FROM conversations WHERE turn % 3 = 0
      UNION ALL SELECT conv_id * 1000 + turn, CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END, 'vk', 'handle', 'bar' || conv_id, CASE WHEN role = 'user' THEN 'link' ELSE 'link_received' END, DATE '2024-01-01' + turn::INTEGER FROM conversations WHERE turn % 5 = 0)"""


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN (1400000000 + conv_id)::VARCHAR ELSE (1001000 + conv_id)::VARCHAR END AS chat_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def chat_ids(spark, sf_dir):
    c = F.col("conv_id")
    return i.table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", x.chat_id(F.when(c % 2 == 0, -(c + 1_001_400_000_000)).otherwise(c + 1_001_000)).alias("chat_id"))


@query(f"WITH {_DIALOGS_SQL} SELECT conv_id AS obs_seq, ident_pos, kind, value FROM u")
def dialog_observations(spark, sf_dir):
    return observations.dialog_observations(_dialogs(spark, sf_dir)).select("obs_seq", "ident_pos", "kind", "value")


@query(f"WITH {_MESSAGES_SQL} SELECT * FROM m")
def message_observations(spark, sf_dir):
    return observations.message_observations(_messages(spark, sf_dir)).select("obs_seq", "part", "platform", "kind", "value", "trace_type", "occurred_at")


@query("SELECT conv_id * 1000 + turn AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def newest_messages(spark, sf_dir):
    return observations.newest_messages(_messages(spark, sf_dir), 2).select("seq")


@query("SELECT conv_id * 1000 + turn AS seq FROM conversations WHERE role = 'user' AND (turn % 3 = 0 OR turn % 5 = 0)")
def quick_own_messages(spark, sf_dir):
    return observations.readable_messages(_messages(spark, sf_dir), own_only=True, quick=True).select("seq")


@query(
    f"""WITH {_DIALOGS_SQL}, {_MESSAGES_SQL}, b AS (
  SELECT 0 AS phase, conv_id AS obs_seq, 0 AS part, ident_pos, 'telegram' AS platform, kind, value, 'subscription' AS trace_type FROM u
  UNION ALL SELECT 1, obs_seq, part, 0, platform, kind, value, trace_type FROM m)
SELECT platform, kind, value, trace_type, obs_seq FROM b QUALIFY row_number() OVER (PARTITION BY platform, kind, value ORDER BY phase, obs_seq, part, ident_pos) = 1"""
)
def first_wins(spark, sf_dir):
    return observations.messenger_observations(_dialogs(spark, sf_dir), _messages(spark, sf_dir)).select("platform", "kind", "value", "trace_type", "obs_seq")


# --- matching ----------------------------------------------------------------------------------------
_OBS = "phase, obs_seq, ident_pos"
_MATCH_SQL = f"""{i.REFERENCE_SQL}, {i.TRACES_CTE},
p AS (SELECT o.phase, o.obs_seq, o.ident_pos, o.platform AS obs_platform, o.kind AS obs_kind, i.entry_id, i.ident_id, i.platform, i.kind, o.value, o.platform = i.platform AND o.kind = i.kind AS exact,
        o.kind NOT IN ('numeric_id', 'channel_id', 'video', 'post', 'invite') AND i.kind NOT IN ('numeric_id', 'channel_id', 'video', 'post', 'invite') AND length(o.value) >= 5 AS shared
      FROM o JOIN i ON o.value = i.value),
m AS (SELECT {_OBS}, obs_platform, obs_kind, entry_id, ident_id, CASE WHEN exact THEN 'exact' ELSE 'probable' END AS confidence, platform, kind, value FROM p WHERE exact OR shared
      QUALIFY row_number() OVER (PARTITION BY {_OBS}, entry_id ORDER BY exact DESC, ident_id) = 1)"""


def _matches(spark, sf_dir):
    seen = observations.of_visits(i.traces(spark, sf_dir), "url")
    return matching.match(seen, *i.reference(spark, sf_dir))


@query(f"WITH {_MATCH_SQL} SELECT * FROM m")
def match_all(spark, sf_dir):
    return matching.in_order(_matches(spark, sf_dir)).select("phase", "obs_seq", "ident_pos", "obs_platform", "obs_kind", "entry_id", "ident_id", "confidence", "platform", "kind", "value")


@query(f"WITH {_MATCH_SQL} SELECT {_OBS}, entry_id, ident_id FROM m WHERE confidence = 'exact'")
def match_exact(spark, sf_dir):
    return _matches(spark, sf_dir).where("confidence = 'exact'").select("phase", "obs_seq", "ident_pos", "entry_id", "ident_id")


@query(f"WITH {_MATCH_SQL} SELECT {_OBS}, entry_id, ident_id, platform, obs_platform FROM m WHERE confidence = 'probable'")
def match_probable(spark, sf_dir):
    return _matches(spark, sf_dir).where("confidence = 'probable'").select("phase", "obs_seq", "ident_pos", "entry_id", "ident_id", "platform", "obs_platform")


@query(f"WITH {_MATCH_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'exact') AS exact, count(*) FILTER (WHERE confidence <> 'exact') AS probable, count(DISTINCT entry_id) AS entries FROM m")
def match_summary(spark, sf_dir):
    return matching.summary(_matches(spark, sf_dir))


@query(f"WITH {_MATCH_SQL}, g AS (SELECT confidence, entry_id, count(*) AS n_matches, min(obs_seq) AS first_obs FROM m GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY entry_id)::INTEGER AS number FROM g")
def report_groups(spark, sf_dir):
    return matching.by_entry(_matches(spark, sf_dir))


@query(f"WITH {_MATCH_SQL} SELECT {_OBS}, m.entry_id, e.description, e.court FROM m JOIN e ON m.entry_id = e.id")
def matched_entries(spark, sf_dir):
    """Matches with the entries that they meet."""
    entries, identifiers = i.reference(spark, sf_dir)
    found = matching.match(observations.of_visits(i.traces(spark, sf_dir), "url"), entries, identifiers)
    return found.join(entries.select(F.col("id").alias("entry_id"), "description", "court"), "entry_id").select("phase", "obs_seq", "ident_pos", "entry_id", "description", "court")


@query(
    f"""WITH {_MATCH_SQL} SELECT {_OBS}, entry_id, CASE WHEN confidence = 'exact' THEN 'same identifier' WHEN platform = obs_platform THEN 'same name, listed as ' || kind
ELSE 'same name, listed on ' || platform END AS reason, CASE confidence WHEN 'exact' THEN 'точное совпадение' ELSE 'вероятное совпадение' END AS label FROM m"""
)
def match_reasons(spark, sf_dir):
    return _matches(spark, sf_dir).select("phase", "obs_seq", "ident_pos", "entry_id", "reason", x.confidence_label(F.col("confidence")).alias("label"))


@query(
    f"""WITH {_MATCH_SQL}, w AS (SELECT m.*, CASE WHEN confidence = 'exact' THEN '' WHEN platform = obs_platform THEN ' (same name, listed as ' || kind || ')' ELSE ' (same name, listed on ' || platform || ')' END AS why,
  CASE phase WHEN 0 THEN 'посещение сайта' ELSE 'сохранённое или закладки' END AS label, CASE phase WHEN 0 THEN 'history' ELSE 'bookmarks' END AS source, u.url FROM m JOIN ({i.TRACE_URLS_SQL}) u ON u.obs_seq = m.obs_seq),
g AS (SELECT confidence, entry_id, count(*)::INTEGER AS n_seen, string_agg('  - ' || obs_platform || ', ' || label || ': ' || url || ' <- ' || source || why, chr(10) ORDER BY obs_platform, phase, w.obs_seq, ident_pos, ident_id) AS seen FROM w GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY entry_id)::INTEGER AS number FROM g)
SELECT confidence, number, n_seen, number || ') ' || trim(regexp_replace(e.description, '\\s+', ' ', 'g')) || ' / ' || e.court || chr(10) || seen AS body FROM k JOIN e ON k.entry_id = e.id"""
)
def report_lines(spark, sf_dir):
    entries, identifiers = i.reference(spark, sf_dir)
    found = matching.match(observations.of_visits(i.traces(spark, sf_dir), "url"), entries, identifiers)
    return report.lines(found, entries)


@query(
    f"""WITH {i.REFERENCE_SQL}, v AS (SELECT page_id AS obs_seq, 'web' AS platform, 'domain' AS kind, {i.PAGE_HOST_SQL} AS value, 1 + page_id % 7 AS c FROM pages
  UNION ALL SELECT s_suppkey + 100000, 'web', 'domain', 'site-' || s_suppkey || '.info', 2 FROM supplier),
o AS (SELECT 0 AS phase, platform, kind, value, min(obs_seq) AS obs_seq, ': history, visits ' || sum(c) AS how FROM v GROUP BY 2, 3, 4 UNION ALL SELECT 1, platform, kind, value, min(obs_seq), ': bookmarks' FROM v GROUP BY 2, 3, 4)
SELECT phase, o.obs_seq, o.value, 'B' || how AS source, i.entry_id, 'exact' AS confidence FROM o JOIN i ON i.platform = o.platform AND i.kind = o.kind AND i.value = o.value"""
)
def browser_matches(spark, sf_dir):
    """One profile's history and bookmarks, collapsed by key, against the list."""
    pages = i.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", (F.col("page_id") % 7 + 1).alias("visit_count"))
    sites = i.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000).alias("seq"), F.concat(F.lit("https://www.site-"), "s_suppkey", F.lit(".info/a?b=1&amp;c=2")).alias("url"), F.lit(2).cast("long").alias("visit_count"))
    history = pages.unionByName(sites).withColumn("occurred_at", F.lit(None).cast("date"))
    found = matching.match(observations.browser_observations(history, history.select("seq", "url"), "B"), *i.reference(spark, sf_dir))
    return found.select("phase", "obs_seq", "value", "source", "entry_id", "confidence")


@query(f"WITH {_MATCH_SQL} SELECT phase, obs_seq, ident_pos, entry_id, ident_id, confidence FROM m WHERE obs_seq >= 1000000000")
def stream_matches(spark, sf_dir):
    """The composed addresses as a stream, matched statelessly; all that is there is read, then the stream ends."""
    import uuid

    schema = i.table(spark, sf_dir, "part").select("p_partkey").schema
    # a glob, as the source of files asks for a folder or one
    parts = spark.readStream.schema(schema).parquet(f"{sf_dir}/part.parque[t]")
    seen = live.match_stream(i.trace_parts(parts), *i.reference(spark, sf_dir))
    name = f"stream_{uuid.uuid4().hex}"
    seen.select("phase", "obs_seq", "ident_pos", "entry_id", "ident_id", "confidence").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
