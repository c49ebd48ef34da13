"""Address cases: what is typed, and the keys that must come of it."""

import pytest
from pyspark.sql import functions as F

from sievewright.functions import addresses, text

CASES = [
    ("https://vk.соm/river_page,", ["vk:handle:river_page"]),
    ("www.Instagram.com/Foo/", ["instagram:handle:foo"]),
    ("t.me/s/bar", ["telegram:handle:bar"]),
    ("https://t.me/+AbC%2Bd", ["telegram:invite:AbC+d"]),
    ("http://t.me/с/123456", ["telegram:numeric_id:123456"]),
    ("t.me/c/xx", []),
    ("https://ok.ru/group/4471200б31207", ["ok:numeric_id:4471200631207", "ok:numeric_id:447120031207"]),
    ("ok.ru/dk?st.cmd=alt&st.groupId=733", ["ok:numeric_id:733"]),
    ("https://www.m.facebook.com/profile.php?id=100&x=1", ["facebook:numeric_id:100"]),
    ("https://fb.com/watch?v=", []),
    ("https://www.youtube.com/watch?v=раra1", ["youtube:video:para1"]),
    ("tiktok.com/@Foo/video/77", ["tiktok:handle:foo", "tiktok:video:77"]),
    ("linkedin.com/in/foo", ["linkedin:handle:in"]),
    ("https://bit.ly/abC", ["web:shortlink:bit.ly/abC"]),
    ("bit.ly", []),
    ("https://foo.cdn.ampproject.org/", []),
    ("https://forum.example@someone/x", ["web:domain:forum.example"]),
    ("www.foo.com/a//b", []),
    ("http://[::1]/x", []),
    ("https://a／b.com/x", []),
    ("https://Site.Example.by:8080/p?q#f", ["web:domain:site.example.by"]),
    ("https://threads.net/@Name;сосед", ["threads:handle:name"]),
    ("t.me/НАШАMOBA", ["telegram:handle:нашаmoba", "telegram:handle:нaшamoba", "telegram:handle:нашамова"]),
    ("https://youtube.com/c/ОбществоГород", ["youtube:handle:обществогород"]),
    ("t.me/a%20b", ["telegram:handle:a"]),
    ("t.me/a%zz", ["telegram:handle:a%zz"]),
    ("https://t.me/&quot;foo", ['telegram:handle:"foo']),
    ("", []),
    (None, []),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)], "i int, u string")
    found = {r.i: [f"{p.platform}:{p.kind}:{p.value}" for p in r.identifiers] for r in addresses.with_identifiers(df, "u").collect()}
    assert {u: found[i] for i, (u, _) in enumerate(CASES)} == dict(CASES)


def test_notes_tell_what_was_repaired(spark):
    df = spark.createDataFrame([("https://vk.соm/раvес77",), ("https://twitter.com/abc",), ("https://vk.com/abc",)], "u string")
    notes = {r.u: list(r.identifiers[0].notes) for r in addresses.with_identifiers(df, "u").collect()}
    assert notes == {"https://vk.соm/раvес77": ["host:lookalikes", "path:lookalikes"], "https://twitter.com/abc": ["host:synonym"], "https://vk.com/abc": []}


@pytest.mark.parametrize(
    ("host", "want"),
    [("www.m.facebook.com", "facebook.com"), ("m.com", "m.com"), ("www.com", "www.com"), ("оk.ru", "ok.ru"), ("vк.соm", "vk.com"), (" Example.ORG. ", "example.org"), ("m.www.youtube.com", "youtube.com")],
)
def test_host(spark, host, want):
    once = text.normalize_host(F.lit(host))
    assert spark.range(1).select(once, text.normalize_host(once)).first() == (want, want)


def test_character_references(spark):
    import html
    import random

    rng = random.Random(3)
    parts = ["&", "amp", ";", "#", "x", "copy", "reg", "not", "notit;", "AElig;", "lt", "gt;", "123", "128;", "x80", "0", "xD800;", "1114112;", "x10FFFF", "65535;", "99999999999999999999;", "ngE;", "NotEqualTilde;", " ", "<", "é", "=1", "frac12", "zzzz" * 9 + ";", "#38;", "#x26", "#0;", "#11;", "#150;", "#xFDD0;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)] + ["?x=1&copy=2&reg=1", "&" + "a" * 40 + ";", "&&&", "&nbsp;", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", text.decode_entities(F.col("t")).alias("d")).collect():
        assert r.d == (None if texts[r.i] is None else html.unescape(texts[r.i])), texts[r.i]


def test_addresses_stay_in_the_jvm(spark):
    plan = addresses.with_identifiers(spark.createDataFrame([("x",)], "u string"), "u")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "pythonUDF" not in plan


def test_scanners(spark):
    s = "см. https://t.me/x, www.a.by/b и site.info, foo.by; @handle_one (a@b.com) последовательность цифр 733 914 2086. clip.wmv 2011г. чат @ab quiet-pond.info."
    c = F.lit(s)
    row = spark.range(1).select(text.find_urls(c), text.find_bare_domains(c), text.find_spelled_ids(c), text.find_bare_handles(c)).first()
    assert [list(v) for v in row] == [["https://t.me/x,", "www.a.by/b"], ["site.info", "foo.by"], ["7339142086"], ["handle_one"]]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.chat_id(F.lit("-1007339142086")), text.chat_id(F.lit("1001")), text.chat_id(F.lit("")),
        text.date_of_1601(F.lit(0)), text.date_of_1601(F.lit(13_300_000_000_000_000)), text.date_of_1970(F.lit(None).cast("long")), text.date_of_1970(F.lit(9_000_000_000_000_000_000)),
        text.shorten(F.lit("a  b\n" + "x" * 300), 10), text.tidy(F.lit(" a b\n \n\n c\t d ")), text.trace_label(F.lit("unknown")), text.fold_text(F.lit("Ёлка-ТЕСТ, é!")),
        text.profile_label(F.lit("B"), F.lit("")), text.profile_label(F.lit("B"), F.lit("P")),
    ).first()
    assert [str(v) for v in row] == ["7339142086", "1001", "", "None", "2022-06-18", "None", "None", "a b xxxxx…", "a b\n c d", "unknown", "елка тест e", "B", "B (P)"]
