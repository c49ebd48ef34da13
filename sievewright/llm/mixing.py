"""Mixing sources to target weights.

Each document gets a hash-random key. Equal ranges of keys cut a source's order, as many as the rows of the largest
source ask for, so sorting and summing go range by range: token counts are summed for each (source, range),
prefix sums over the ranges give where each range starts, and a window inside each range gives where each document
starts. No window spans a source, so a source with a third of all rows is spread over all its ranges. Where many
rows share a key (NULL or repeated ids), the key is a range of its own, split by size. Rows meet their range's
start and its window in one exchange. The mix takes whole epochs of a source while the budget allows and cuts the
last one at the budget's exact word.

Targets: sources in code-point order (NULL last) weigh 5, 2, 1, 5, ...; the mix holds 150 % of all words;
no source gives more than twice its words, and what is over is shared anew by weight. Sorted by
cap / weight, the capped sources come first; the common level of the others has a closed form.

Defined cases: NULL or blank texts have no words and are never taken; NULL sources are one source; equal
keys are ordered by id and size, so repeated rows are interchangeable; an empty table gives an empty result; further
columns are kept, whatever their names (``plan_mix`` replaces source_size, target and taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, set_aside

WEIGHTS = (5, 2, 1)
EPOCHS = 2
SEED = "mix-1"
#: Rows of a range of the largest source at most, about, how many times that makes a range heavy, and the least number
#: of ranges of a source.
RANGE_ROWS, HEAVY, RANGES = 50_000, 8, 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source, so its windows are small."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = 3 * F.sum("source_size").over(every) - 2 * F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = 2 * (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", left / weight_left).withColumn("capped", F.col("level") >= F.col("ratio"))
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.select(*sizes.columns, target.alias("target"))


def _ranged(rows: DataFrame, range_rows: int) -> DataFrame:
    """``rows`` (with m_id, m_source, size) with m_key, m_home (a name of the source that is never NULL) and m_range.

    Names of ranges sort as their keys do. A key that is a range of its own stands between the smaller and the
    larger keys of its range, which "~" sorts behind.
    """
    key = F.md5(F.concat(F.coalesce(F.col("m_id").cast("string"), F.lit("")), F.lit(f":{SEED}")).cast("binary"))
    home = F.coalesce(F.concat(F.lit("="), F.col("m_source")), F.lit("-"))
    rows = rows.withColumns({"m_key": key, "m_home": home})
    largest = rows.groupBy("m_home").count().agg(F.max("count")).first()[0] or 0
    ranges = max(RANGES, -(-largest // range_rows))
    place = F.floor(F.conv(F.substring("m_key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32))
    rows = rows.withColumn("m_range", F.lpad(place.cast("string"), 10, "0"))
    full = rows.groupBy("m_home", "m_range").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY * range_rows).select("m_home", "m_range")
    if full.isEmpty():
        return rows
    often = rows.select("m_home", "m_range", "m_key").join(full, ["m_home", "m_range"], "left_semi").groupBy("m_home", "m_range", "m_key").agg(F.count("*").alias("n")).where(F.col("n") > range_rows)
    hot = often.groupBy("m_home", "m_range").agg(F.sort_array(F.collect_list("m_key")).alias("m_hot"))
    rows = rows.join(hot, ["m_home", "m_range"], "left")
    # the last hot key that is not behind the row's own
    last = F.try_element_at(F.filter("m_hot", lambda k: k <= F.col("m_key")), F.lit(-1))
    own = F.concat("m_key", F.lit(":"), F.lpad(F.col("size").cast("string"), 19, "0"))
    tail = F.when(last == F.col("m_key"), own).otherwise(F.concat(last, F.lit("~")))
    name = F.when(last.isNull(), F.col("m_range")).otherwise(F.concat("m_range", F.lit(":"), tail))
    return rows.withColumn("m_range", name).drop("m_hot")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of ``docs`` (with doc_id, source and size) and ``source_size``, ``target``, ``taken`` (words, repeats counted)."""
    plain, names, _ = set_aside(docs.drop("source_size", "target", "taken"))
    rows = plain.withColumnsRenamed({names["doc_id"]: "m_id", names["source"]: "m_source", names["size"]: "size"})
    names |= {"doc_id": "m_id", "source": "m_source", "size": "size"}
    rows = _ranged(rows, range_rows)
    ranges = rows.groupBy("m_home", "m_range").agg(F.sum("size").alias("range_size"), F.first("m_source").alias("source"))
    targets = source_targets(ranges.groupBy("m_home").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")), weights, epochs)
    start = F.coalesce(F.sum("range_size").over(Window.partitionBy("m_home").orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("range_start", start).join(targets.select("m_home", "source_size", "target"), "m_home")
    # the join deals rows by range, as the window asks
    joined = rows.join(ranges.select("m_home", "m_range", "range_start", "source_size", "target"), ["m_home", "m_range"])
    inside = F.sum("size").over(Window.partitionBy("m_home", "m_range").orderBy("m_key", "m_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    joined = joined.withColumn("inside", inside)
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_start") - F.col("inside")))
    return joined.select(*[F.col(new).alias(old) for old, new in names.items()], "source_size", "target", (whole * F.col("size") + cut).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; n of at least 1."""
    rest = F.element_at(F.split(text, F.lit(WORD), (n + 1).cast("int")), -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(rest))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of ``docs``: whole copies, then the copy that the budget cuts."""
    rows, names, back = set_aside(docs)
    text = names["text"]
    sized = rows.withColumnsRenamed({names["doc_id"]: "doc_id", names["source"]: "source"}).withColumn("size", n_words(F.col(text)))
    planned = plan_mix(sized, **options).where("taken > 0").withColumnsRenamed({"doc_id": names["doc_id"], "source": names["source"]})
    copies = planned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    copies = copies.withColumn(text, F.when(words < F.col("size"), first_words(F.col(text), words)).otherwise(F.col(text)))
    if "n_chars" in names:
        copies = copies.withColumn(names["n_chars"], F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return back(copies)


def op8(docs: DataFrame) -> DataFrame:
    # ids, sources and sizes are written once: the texts are read and matched once
    sized = cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return plan_mix(sized).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat(doc_id::VARCHAR, ':mix-1')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER b, 0))::DOUBLE
             / (2 * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)))::DOUBLE AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, struct_pack(ratio := ratio, n := source IS NULL, source := source)) AS level FROM l WHERE level < ratio),
t AS (SELECT source, source_size, CASE WHEN l.level >= ratio THEN cap::DOUBLE ELSE m.level * weight END AS target FROM l, m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END::BIGINT AS taken
FROM p
"""
