"""Reading the owner's own browser files: history and bookmarks of two engines.

Databases are copied, with their side files, to a temporary folder of the task that reads them, and the copies
are removed whatever happens. A broken file gives no rows and does not stop the others. Paths are given by the
caller; nothing is searched for.
"""

from __future__ import annotations

import contextlib
import json
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x

CHROMIUM, FIREFOX = "chromium", "firefox"
HISTORY = {
    CHROMIUM: "SELECT url, last_visit_time, visit_count FROM urls",
    FIREFOX: "SELECT url, last_visit_date, visit_count FROM moz_places WHERE url IS NOT NULL",
}
_PLACES = "SELECT id, url FROM moz_places WHERE url IS NOT NULL"
_MARKS = "SELECT fk, type FROM moz_bookmarks ORDER BY id"


@contextlib.contextmanager
def private_copy(path: str) -> Iterator[Path]:
    folder = Path(tempfile.mkdtemp(prefix="own-"))
    try:
        for side in ("", "-wal", "-shm"):
            if Path(path + side).exists():
                shutil.copy2(path + side, folder / ("copy" + side))
        yield folder / "copy"
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def query(path: str, sql: str) -> list[tuple]:
    """Rows of a query on a private copy; none if the database is broken."""
    with private_copy(path) as copy:
        connection = sqlite3.connect(f"file:{copy}?mode=ro", uri=True)
        try:
            return connection.execute(sql).fetchall()
        except sqlite3.DatabaseError:
            return []
        finally:
            connection.close()


def _rows(spark: SparkSession, path: str, schema: str, fields: list[tuple[str, pa.DataType]], read) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                rows = [(i, *r) for i, r in enumerate(read(p))]
                columns = list(zip(*rows, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, schema)


def read_history(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """(seq, url, occurred_at, visit_count); a count of zero or NULL stands for one visit."""
    raw = _rows(spark, path, "seq long, url string, micros long, n long", [("seq", pa.int64()), ("url", pa.string()), ("micros", pa.int64()), ("n", pa.int64())], lambda p: query(p, HISTORY[engine]))
    return history_of(raw, engine)


def history_of(raw: DataFrame, engine: str) -> DataFrame:
    """(seq, url, micros, n) as a browser keeps them to (seq, url, occurred_at, visit_count)."""
    date = x.date_of_1601 if engine == CHROMIUM else x.date_of_1970
    count = F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(F.col("n"))
    return raw.select("seq", "url", date(F.col("micros")).alias("occurred_at"), count.alias("visit_count"))


def bookmark_urls(node) -> Iterator[str]:
    """Addresses of a tree of folders, in order: children where there are any, else all values."""
    todo = [node]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get("type") == "url" and node.get("url"):
                yield node["url"]
                continue
            children = node.get("children")
            node = list(node.values()) if children is None else children
        if isinstance(node, (list, dict)):
            todo.extend(reversed(list(node)))


def tree_urls(text: str) -> list[str]:
    """Addresses of a file of bookmarks; none if it is broken."""
    try:
        return list(bookmark_urls(json.loads(text).get("roots", {})))
    except (ValueError, AttributeError):
        return []


def _tree(path: str) -> list[tuple[str]]:
    try:
        return [(u,) for u in tree_urls(Path(path).read_text(encoding="utf-8"))]
    except (OSError, ValueError):
        return []


def read_bookmarks(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """(seq, url) of one profile's bookmarks."""
    if engine == CHROMIUM:
        return _rows(spark, path, "seq long, url string", [("seq", pa.int64()), ("url", pa.string())], _tree)
    places = _rows(spark, path, "n long, id long, url string", [("n", pa.int64()), ("id", pa.int64()), ("url", pa.string())], lambda p: query(p, _PLACES))
    marks = _rows(spark, path, "seq long, fk long, type long", [("seq", pa.int64()), ("fk", pa.int64()), ("type", pa.int64())], lambda p: query(p, _MARKS))
    return join_bookmarks(marks, places)


def join_bookmarks(marks: DataFrame, places: DataFrame) -> DataFrame:
    """Bookmarks (seq, fk, type) of type 1 with their places (id, url)."""
    named = places.where("url is not null").select(F.col("id").alias("fk"), "url")
    return marks.where("type = 1").join(named, "fk").select("seq", "url")
