"""Each registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sievewright.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["visited_domain_counts", "clean_address", "host_spellings", "lookalike_words", "parse_tiktok", "text_scanners", "list_entries", "list_summary", "history_collapse", "first_wins", "match_all", "folded_texts", "list_html_rows", "list_docx_rows", "list_doc_rows", "list_encodings", "list_first_errors", "chromium_history", "firefox_bookmarks", "chromium_bookmarks", "spelling_variants", "suppressed_hosts", "summary_lines", "report_lines", "browser_matches", "stream_matches"])
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, want))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
