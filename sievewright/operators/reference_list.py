"""The reference list: rows of cells to entries and identifiers, their snapshot and its figures.

Order is semantic: entries are numbered by row, identifiers by scanner and place, and every choice of a first
one names the columns that order it.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from ..functions.addresses import IDENTIFIER, with_identifiers
from ..session import cut_lineage


#: Numbers of rows that one window counts.
BLOCK = 1 << 16


def shape_rows(cells: DataFrame) -> DataFrame:
    """(row_index, cells array) to material_type, description, court; rows without cells go."""
    c = F.transform("cells", x.tidy)
    n = F.size("cells")
    rows = cells.where(n > 0).select(
        *[k for k in cells.columns if k != "cells"],
        F.get(c, F.lit(0)).alias("material_type"),
        F.when(n > 2, F.array_join(F.slice(c, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n")).otherwise("").alias("description"),
        F.when(n > 1, F.try_element_at(c, F.lit(-1))).otherwise("").alias("court"),
    )
    return rows


def is_header() -> Column:
    low = F.lower(F.concat_ws(" ", "material_type", "court"))
    return F.lit(False) | low.contains(t.HEADER_MARKERS[0]) | low.contains(t.HEADER_MARKERS[1])


def is_cancelled() -> Column:
    word = rf"(?iU)\b{t.CANCELLED_WORD}\b"
    return F.col("description").rlike(word) | F.col("material_type").rlike(word)


def is_offline() -> Column:
    low = F.lower("description")
    return F.exists(F.array(*[F.lit(m) for m in t.OFFLINE_MARKERS]), lambda m: F.contains(low, m))


def numbered(rows: DataFrame, name: str, by: str, *then: str) -> DataFrame:
    """``rows`` numbered from 1 as ``name`` in the order of the whole number ``by``, then of ``then``.

    Blocks of ``by`` are numbered each for itself, and start where the counts of the blocks before them end: no
    window holds more than one block's rows, or a row for each block. The rows are read twice and so written first.
    """
    blocked = cut_lineage(rows.withColumn("_block", F.floor(F.col(by) / BLOCK)))
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_block", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(by, *then))
    found = blocked.join(starts, "_block").withColumn(name, (place + F.col("_before")).cast("long"))
    return found.drop("_block", "_before")


def entries_of(cells: DataFrame) -> DataFrame:
    """Shaped rows without headers, flagged and numbered from 1 in row order as ``id``."""
    rows = shape_rows(cells).where(~is_header())
    return numbered(rows.withColumns({"is_cancelled": is_cancelled(), "is_offline": is_offline()}), "id", "row_index")


@lru_cache(maxsize=4)
def _named(gateway: int) -> Column:
    """The identifiers of a find, by its scanner; built once for a JVM, as it names working columns only."""
    host = x.normalize_host(F.when(F.col("_scan") == 1, F.col("_find")))
    usable = ~host.isin(*t.PLATFORM_OF_HOST) & x.is_checkable_host(host)

    def single(platform: str, kind: str, value: Column, raw: Column, notes: Column | None = None) -> Column:
        one = F.struct(F.lit(platform).alias("platform"), F.lit(kind).alias("kind"), value.alias("value"), raw.alias("raw"), (F.array().cast("array<string>") if notes is None else notes).alias("notes"))
        return F.array(one).cast(IDENTIFIER)

    f, scan = F.col("_find"), F.col("_scan")
    bare = F.when(usable, single("web", "domain", host, f, x.host_notes(f))).otherwise(F.array().cast(IDENTIFIER))
    return F.when(scan == 0, F.col("identifiers").cast(IDENTIFIER)).when(scan == 1, bare).when(scan == 2, single("telegram", "numeric_id", f, f)).otherwise(single("telegram", "handle", F.lower(f), F.concat(F.lit("@"), f)))


def extract_identifiers(rows: DataFrame, text: str, row: str) -> DataFrame:
    """One row for each identifier in ``text``, first of its key: row, ident_pos, platform, kind, value, raw, notes.

    Four scanners in turn: addresses, bare hosts, numbers in words, bare handles; their finds go through one pass.
    A host that is also a handle of the same row is its twin and goes.
    """
    finds = lambda n, found: F.transform(found(F.col(text)), lambda f, i: F.struct(F.lit(n).alias("scan"), i.alias("pos"), f.alias("found")))
    every = F.concat(finds(0, x.find_urls), finds(1, x.find_bare_domains), finds(2, x.find_spelled_ids), finds(3, x.find_bare_handles))
    found = rows.select(F.col(row).alias("_row"), F.explode_outer(every).alias("_f")).where("_f is not null").select("_row", F.col("_f.scan").alias("_scan"), F.col("_f.pos").alias("_pos"), F.col("_f.found").alias("_find"))
    parsed = with_identifiers(found.withColumn("_url", F.when(F.col("_scan") == 0, F.col("_find"))), "_url")
    named = _named(id(rows.sparkSession.sparkContext._gateway))
    flat = parsed.select("_row", "_scan", "_pos", F.posexplode_outer(named).alias("_sub", "i")).where("_sub is not null").select("_row", "_scan", "_pos", "_sub", "i.*")
    order = [F.col(k) for k in ("_scan", "_pos", "_sub")]
    first = F.row_number().over(Window.partitionBy("_row", "platform", "kind", "value").orderBy(*order))
    twin = F.max(F.when(F.col("kind") == "handle", 1)).over(Window.partitionBy("_row", "value"))
    kept = flat.withColumn("_first", first).where("_first = 1").withColumn("_twin", twin).where("not (kind = 'domain' and _twin is not null)")
    position = F.row_number().over(Window.partitionBy("_row").orderBy(*order)) - 1
    return kept.select(F.col("_row").alias(row), position.alias("ident_pos"), "platform", "kind", "value", "raw", "notes")


def identifiers_of(entries: DataFrame) -> DataFrame:
    """Identifiers of entries that are not cancelled, numbered from 1 as ``ident_id``."""
    found = extract_identifiers(entries.where("not is_cancelled"), "description", "id").withColumnRenamed("id", "entry_id")
    return numbered(found, "ident_id", "entry_id", "ident_pos")


def active_identifiers(entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Identifiers whose entry is in force."""
    return identifiers.join(entries.where("not is_cancelled").select(F.col("id").alias("entry_id")), "entry_id", "left_semi")


def summary(entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row of figures; offline entries are counted whether cancelled or not."""
    having = identifiers.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.size("notes") > 0).alias("repaired"))
    joined = entries.select("id", "is_cancelled", "is_offline").join(having, "id", "left")
    return joined.agg(
        F.count("*").alias("entries"),
        F.count_if("is_cancelled").alias("cancelled"),
        F.count_if("is_offline").alias("offline"),
        F.count_if(~F.col("is_cancelled") & ~F.col("is_offline") & F.col("n").isNull()).alias("without_identifiers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("identifiers"),
        F.coalesce(F.sum("repaired"), F.lit(0)).alias("repaired"),
    )


def frequencies(identifiers: DataFrame, by: str) -> DataFrame:
    """Counts by platform or kind, most frequent first, ties in order of first appearance."""
    return identifiers.groupBy(by).agg(F.count("*").alias("n"), F.min("ident_id").alias("first_id")).orderBy(F.desc("n"), "first_id")


def summary_lines(entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The list's figures as rows (section, place, label, n): totals, then frequencies by platform and by kind."""
    totals = summary(entries, identifiers)
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("label"), F.col(c).cast("long").alias("n")) for i, c in enumerate(totals.columns)])
    out = totals.select(F.lit("list").alias("section"), F.inline(rows))
    for by in ("platform", "kind"):
        place = F.row_number().over(Window.orderBy(F.desc("n"), "first_id")) - 1  # a row for each platform or kind
        out = out.unionByName(frequencies(identifiers, by).select(F.lit(by).alias("section"), place.alias("place"), F.col(by).alias("label"), "n"))
    return out


def text_summary(entries: DataFrame, identifiers: DataFrame) -> str:
    rows = sorted(summary_lines(entries, identifiers).collect(), key=lambda r: (("list", "platform", "kind").index(r["section"]), r["place"]))
    return "\n".join(f"{r['section']:<9}{r['label'].replace('_', ' ')}: {r['n']}" for r in rows)


# --- snapshot --------------------------------------------------------------------------------------
VERSION = "1"


def snapshot_meta(entries: DataFrame, identifiers: DataFrame, source_name: str, source_sha256: str) -> DataFrame:
    """(key, value): version, time, source and its digest, and the numbers of entries and identifiers."""
    counts = [df.agg(F.count("*").cast("string").alias("value")).select(F.lit(key).alias("key"), "value") for key, df in (("entry_count", entries), ("identifier_count", identifiers))]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    fixed = entries.sparkSession.range(1).select(F.explode(F.create_map(F.lit("builder_version"), F.lit(VERSION), F.lit("built_at"), now, F.lit("source_name"), F.lit(source_name), F.lit("source_sha256"), F.lit(source_sha256))))
    return counts[0].unionByName(counts[1]).unionByName(fixed)


def write_snapshot(entries: DataFrame, identifiers: DataFrame, path: str, source_name: str, source_sha256: str) -> DataFrame:
    """Writes the tables entries, identifiers and meta under ``path``; returns meta."""
    spark = entries.sparkSession
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    identifiers.write.mode("overwrite").parquet(f"{path}/identifiers")
    written = (spark.read.parquet(f"{path}/{name}") for name in ("entries", "identifiers"))
    snapshot_meta(*written, source_name, source_sha256).write.mode("overwrite").parquet(f"{path}/meta")
    return spark.read.parquet(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries in force, their identifiers, meta). A snapshot with repeated keys in an entry is refused."""
    entries = spark.read.parquet(f"{path}/entries")
    identifiers = active_identifiers(entries, spark.read.parquet(f"{path}/identifiers"))
    if not identifiers.groupBy("entry_id", "platform", "kind", "value").count().where("count > 1").isEmpty():
        raise ValueError("an entry of the snapshot has the same key twice")
    return entries.where("not is_cancelled"), identifiers, spark.read.parquet(f"{path}/meta")


def describe_snapshot(meta: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: entry_count, identifier_count, built_at as dd.mm.yyyy, age."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    one = meta.agg(value("entry_count").alias("e"), value("identifier_count").alias("i"), value("built_at").alias("b"))
    built = F.try_to_timestamp("b")
    return one.select(
        F.coalesce(F.col("e").try_cast("long"), F.lit(0)).alias("entry_count"),
        F.coalesce(F.col("i").try_cast("long"), F.lit(0)).alias("identifier_count"),
        F.coalesce(F.date_format(built, "dd.MM.yyyy"), "b", F.lit("")).alias("built_at"),
        x.age_label(F.col("b"), F.current_timestamp() if now is None else now).alias("age"),
    )
