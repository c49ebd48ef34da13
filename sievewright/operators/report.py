"""The report: rows in Spark, put together as text only for one reader; saving is a separate, explicit act.

Exact and probable matches are sections of their own, each with its entries numbered in the list's order and, below
an entry, what was seen. What the report says of missing matches holds for the loaded data alone.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from . import matching

SCOPE = "Only the loaded data were compared with the list; whatever was not loaded has not been looked at."
PRIVATE = "These lines tell of one person's own traces. They are kept nowhere unless you save them; if you do, keep them private."
HEADINGS = {t.EXACT: "Exact matches: platform, kind and value agree", t.PROBABLE: "Probable matches: only the name agrees, so look for yourself"}


def sections(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of the report in order: tier, number, shortened entry and court, then the observation."""
    numbered = matches.join(matching.by_entry(matches).select("confidence", "entry_id", "number"), ["confidence", "entry_id"])
    named = numbered.join(entries.select(F.col("id").alias("entry_id"), x.shorten(F.col("description")).alias("entry"), x.shorten(F.col("court"), 150).alias("court")), "entry_id")
    return named.withColumn("label", x.trace_label(F.col("trace_type"))).orderBy(F.col("confidence") != t.EXACT, "number", "obs_platform", *matching.arrival(matches), "ident_id")


def _seen() -> Column:
    """One observation as a line."""
    why = F.when(F.col("confidence") == t.PROBABLE, F.concat(F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise("")
    day = F.coalesce(F.concat(F.lit(", "), F.col("occurred_at").cast("string")), F.lit(""))
    shown = F.coalesce(F.nullif("raw", F.lit("")), "value")
    return F.concat(F.lit("  - "), "obs_platform", F.lit(", "), "label", day, F.lit(": "), shown, F.lit(" <- "), "source", why)


def lines(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """(confidence, number, n_seen, body): a row for each tier and entry, its body a heading with a line for each observation."""
    order = F.struct("obs_platform", *matching.arrival(matches), "ident_id", _seen().alias("line"))
    # all that one reader's data show of one entry
    groups = sections(matches, entries).groupBy("confidence", "number").agg(F.first("entry").alias("entry"), F.first("court").alias("court"), F.sort_array(F.collect_list(order)).alias("seen"))
    heading = F.concat(F.col("number").cast("string"), F.lit(") "), "entry", F.lit(" / "), "court")
    return groups.select("confidence", "number", F.size("seen").alias("n_seen"), F.concat(heading, F.lit("\n"), F.array_join(F.transform("seen", lambda o: o["line"]), "\n")).alias("body"))


def render(matches: DataFrame, entries: DataFrame, meta: dict[str, str] | None = None) -> str:
    """The report as text, in memory."""
    list_of = [f"List of {meta.get('built_at', '?')}, {meta.get('entry_count', '?')} entries"] if meta else []
    found = {tier: lines(matches, entries).where(F.col("confidence") == tier).orderBy("number").collect() for tier in HEADINGS}
    parts = ["Self-check", *list_of]
    if not any(found.values()):
        return "\n\n".join([*parts, "No match.", SCOPE])
    counts = matching.summary(matches).first()
    parts.append(f"{counts['exact']} exact and {counts['probable']} probable matches with {counts['entries']} entries")
    for tier, rows in found.items():
        if rows:
            parts += [HEADINGS[tier], *[r["body"] for r in rows]]
    return "\n\n".join([*parts, SCOPE, PRIVATE])


def save(text: str, destination: str) -> Path:
    """Writes the report; only ever called by explicit choice of its reader."""
    path = Path(destination)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path
