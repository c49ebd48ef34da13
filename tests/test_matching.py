"""Observations, matching and report on small tables, and matching against a plain loop."""

import random

from pyspark.sql import functions as F

from sievewright.functions import tables as t
from sievewright.operators import matching, observations, report
from sievewright.streaming import live

ENTRY = "id long, description string, court string, is_cancelled boolean"
IDENT = "entry_id long, ident_id long, platform string, kind string, value string, raw string"
OBS = "obs_seq long, platform string, kind string, value string, trace_type string, source string, raw string, occurred_at date"


def by_loop(obs, entries, idents):
    live_ids = {e[0] for e in entries if not e[3]}
    out = set()
    for o in obs:
        if not o[3]:
            continue
        exact = [i for i in idents if i[0] in live_ids and i[2:5] == o[1:4]]
        done = {i[0] for i in exact}
        out |= {(o[0], i[0], i[1], "exact") for i in exact}
        if o[2] in t.BOUND_KINDS or len(o[3]) < 5:
            continue
        for i in sorted(idents, key=lambda i: i[1]):
            if i[4] == o[3] and i[0] in live_ids and i[0] not in done and i[3] not in t.BOUND_KINDS and i[2:4] != o[1:3]:
                done.add(i[0])
                out.add((o[0], i[0], i[1], "probable"))
    return out


def test_match_against_loop(spark):
    rng = random.Random(5)
    values = ["name_one", "name_two", "abc", "12345678", "site.info", ""]
    pick = lambda: (rng.choice(["telegram", "vk", "web"]), rng.choice(["handle", "numeric_id", "domain"]), rng.choice(values))
    entries = [(e, f"d{e}", f"c{e}", e % 7 == 0) for e in range(1, 31)]
    keys = {(e, *pick()) for e in range(1, 31) for _ in range(4)}
    idents = [(e, n, p, k, v, v) for n, (e, p, k, v) in enumerate(sorted(keys), 1)]
    obs = [(n, *pick(), "visit", "s", "r", None) for n in range(80)]
    frames = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(idents, IDENT)
    found = matching.match(spark.createDataFrame(obs, OBS), *frames)
    assert {(r.obs_seq, r.entry_id, r.ident_id, r.confidence) for r in found.collect()} == by_loop(obs, entries, idents)
    s = matching.summary(found).first()
    assert s.total == s.exact + s.probable and s.total == found.count()
    assert report.HEADINGS[t.EXACT] in report.render(found, frames[0], {"entry_count": "30"})


def test_match_with_repeated_numbers(spark):
    """Observations that share obs_seq match on their own: identifiers of one address, a page visited and saved, parts of a message."""
    rng = random.Random(6)
    pick = lambda: (rng.choice(["telegram", "tiktok"]), rng.choice(["handle", "video"]), rng.choice(["name_one", "name_two", "7777777"]))
    entries = [(e, f"d{e}", f"c{e}", False) for e in range(1, 8)]
    keys = sorted({(e, *pick()) for e in range(1, 8) for _ in range(4)})
    idents = [(e, n, p, k, v, v) for n, (e, p, k, v) in enumerate(keys, 1)]
    places = [(phase, seq, part, pos) for phase in (0, 1) for seq in range(3) for part in (0, 1) for pos in (0, 1)]
    obs = [(*place, *pick(), "visit", "s", "r", None) for place in places]
    frames = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(idents, IDENT)
    found = matching.match(spark.createDataFrame(obs, "phase int, obs_seq long, part int, ident_pos int, " + OBS.split(", ", 1)[1]), *frames).collect()
    want = by_loop([(o[:4], *o[4:]) for o in obs], entries, idents)
    assert len(found) == len(want) and {((r.phase, r.obs_seq, r.part, r.ident_pos), r.entry_id, r.ident_id, r.confidence) for r in found} == want


def test_two_identifiers_of_one_address_and_a_page_seen_twice(spark):
    entries = spark.createDataFrame([(1, "d", "c", False)], ENTRY)
    idents = spark.createDataFrame([(1, 1, "tiktok", "handle", "foofoo", "r"), (1, 2, "tiktok", "video", "7777777", "r"), (1, 3, "web", "domain", "aa.example.org", "r")], IDENT)
    history = spark.createDataFrame([(0, "https://tiktok.com/@foofoo/video/7777777", 2), (1, "https://aa.example.org/", 1)], "seq long, url string, visit_count long").withColumn("occurred_at", F.lit(None).cast("date"))
    marks = spark.createDataFrame([(1, "https://aa.example.org/")], "seq long, url string")
    found = matching.match(observations.browser_observations(history, marks, "B"), entries, idents)
    assert sorted((r.phase, r.obs_seq, r.value) for r in found.collect()) == [(0, 0, "7777777"), (0, 0, "foofoo"), (0, 1, "aa.example.org"), (1, 1, "aa.example.org")]
    text = report.render(found, entries)
    assert text.count("  - ") == 4 and "4 exact and 0 probable matches with 1 entries" in text and "B: bookmarks" in text


def test_report_of_nothing(spark):
    none = matching.match(spark.createDataFrame([], OBS), spark.createDataFrame([], ENTRY), spark.createDataFrame([], IDENT))
    assert report.SCOPE in report.render(none, spark.createDataFrame([], ENTRY))


def test_visits_collapse(spark):
    rows = [(0, "https://aa.example.org/", 47, "2024-01-02"), (1, "https://aa.example.org/x", 3, "2024-01-05"), (2, "https://aa.example.org/y", 1, None), (3, "bare apps.apple.com", 1, None)]
    history = spark.createDataFrame(rows, "seq long, url string, visit_count long, d string").withColumn("occurred_at", F.to_date("d")).drop("d")
    marks = spark.createDataFrame([(0, "https://aa.example.org/m"), (1, "https://aa.example.org/n")], "seq long, url string")
    found = {(r.trace_type, r.value): (r.source, r.raw, str(r.occurred_at)) for r in observations.browser_observations(history, marks, "B").collect()}
    assert found == {
        ("visit", "aa.example.org"): ("B: history, visits 51", "https://aa.example.org/", "2024-01-05"),
        ("visit", "apps.apple.com"): ("B: history, visits 1", "bare apps.apple.com", "None"),
        ("saved", "aa.example.org"): ("B: bookmarks", "https://aa.example.org/m", "None"),
    }


def test_no_column_names_a_person(spark):
    assert not {"user", "user_id", "person", "owner", "subject"} & set(observations.COLUMNS)


def test_stream(spark, tmp_path):
    """A stream gives what the same rows give as a table, the choice of one identifier an entry included."""
    rows = [(1, "https://t.me/name_one"), (2, "https://tiktok.com/@name_one"), (3, "https://example.org/"), (4, "https://vk.com/name_one"), (4, "https://vk.com/name_one")]
    visits = spark.createDataFrame(rows, "obs_seq long, url string")
    visits.repartition(3).write.parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([(1, "d", "c", False), (2, "d", "c", True)], ENTRY)
    index = spark.createDataFrame([(1, 1, "telegram", "handle", "name_one", "r"), (1, 2, "vk", "handle", "name_one", "r"), (2, 3, "vk", "handle", "name_one", "r")], IDENT)
    stream = live.match_stream(spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), entries, index)
    q = stream.writeStream.format("memory").queryName("live_matches").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    found = sorted((r.obs_seq, r.entry_id, r.ident_id, r.confidence) for r in spark.table("live_matches").collect())
    assert found == [(1, 1, 1, "exact"), (2, 1, 1, "probable"), (4, 1, 2, "exact"), (4, 1, 2, "exact")]
    table = matching.match(observations.of_visits(visits, "url"), entries, index)
    assert found == sorted((r.obs_seq, r.entry_id, r.ident_id, r.confidence) for r in table.collect())


def test_first_seen_in_a_stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 11:00:00"), (3, "b", "2024-01-01 12:00:00")]
    seen = spark.createDataFrame(rows, "obs_seq long, value string, at string").selectExpr("obs_seq", "'web' platform", "'domain' kind", "value", "cast(at as timestamp) at")
    seen.coalesce(1).write.parquet(str(tmp_path / "in"))
    first = live.first_seen(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")), "at")
    q = first.writeStream.format("memory").queryName("live_first").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.value for r in spark.table("live_first").collect()) == ["a", "b"]
