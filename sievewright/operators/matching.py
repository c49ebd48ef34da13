"""Two-tier matching: exact and probable, never mixed.

One equi-join on the value serves both tiers. A pair is exact if platform and kind agree too; else it is
probable, unless the kinds are bound to their platform or the value is short. Of the identifiers of one entry
that an observation meets, the exact one stands, else the first. The list is grouped by value and entry before the
join, so that this choice is made inside a row: each observation matches on its own, whatever numbers it shares with
others, nothing is shuffled after the join, and streams match as tables do.

The reference list is broadcast while its size is checked to be small; beyond that the planner joins by
shuffle. Either way the one-sided parts of the probable rule are tested before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t

#: Where an observation stands.
PLACE = ("phase", "obs_seq", "part", "ident_pos")
#: Bytes of identifiers that may be broadcast, and their number where bytes are not known before they are made.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 200_000


def _sized(index: DataFrame) -> DataFrame:
    """The list, to be broadcast behind a check of its size: what a snapshot or a cache says of it, else a count."""
    known = int(str(index._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(index) if known <= BROADCAST_BYTES or index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else index


def match(observations: DataFrame, entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Observations, of a table or a stream, against the list: a row for each observation and entry that it meets."""
    live = identifiers.join(entries.where("not is_cancelled").select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    shareable = lambda kind: ~F.col(kind).isin(*t.BOUND_KINDS)
    listed = F.struct("ident_id", "platform", "kind", "raw", shareable("kind").alias("shared"))
    index = live.groupBy("value", "entry_id").agg(F.sort_array(F.collect_list(listed)).alias("_listed"))
    seen = observations.where("value <> ''").withColumn("_shares", shareable("kind") & (F.length("value") >= t.MIN_SHARED_LENGTH))
    pairs = seen.join(_sized(index), "value")
    same = F.filter("_listed", lambda i: (i["platform"] == F.col("platform")) & (i["kind"] == F.col("kind")))
    other = F.filter("_listed", lambda i: F.col("_shares") & i["shared"])
    pairs = pairs.withColumn("_same", F.get(same, F.lit(0))).withColumn("_pick", F.coalesce("_same", F.get(other, F.lit(0)))).where("_pick is not null")
    best = pairs.select("*", F.col("_same").isNotNull().alias("_exact"), F.col("_pick.ident_id").alias("ident_id"), F.col("_pick.platform").alias("list_platform"), F.col("_pick.kind").alias("list_kind"), F.col("_pick.raw").alias("registry_raw"))
    reason = (
        F.when(F.col("_exact"), F.lit("same identifier"))
        .when(F.col("platform") == F.col("list_platform"), F.concat(F.lit("same name, listed as "), F.col("list_kind")))
        .otherwise(F.concat(F.lit("same name, listed on "), F.col("list_platform")))
    )
    return best.select(
        *[c for c in PLACE if c in observations.columns], "entry_id", "ident_id",
        F.when(F.col("_exact"), F.lit(t.EXACT)).otherwise(F.lit(t.PROBABLE)).alias("confidence"),
        F.col("list_platform").alias("platform"), F.col("list_kind").alias("kind"), "value", "registry_raw", reason.alias("reason"),
        F.col("platform").alias("obs_platform"), F.col("kind").alias("obs_kind"), *[c for c in ("trace_type", "source", "raw", "occurred_at") if c in observations.columns],
    )


def arrival(matches: DataFrame) -> list[str]:
    """The columns that tell the order of arrival."""
    return [c for c in PLACE if c in matches.columns]


def in_order(matches: DataFrame) -> DataFrame:
    """Exact ones first, then by the observation's platform, then as they came."""
    return matches.orderBy(F.col("confidence") != t.EXACT, "obs_platform", *arrival(matches), "ident_id")


def summary(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence") == t.EXACT).alias("exact"),
        F.count_if(F.col("confidence") != t.EXACT).alias("probable"),
        F.countDistinct("entry_id").alias("entries"),
    )


def by_entry(matches: DataFrame) -> DataFrame:
    """Matches grouped by tier and entry, numbered from 1 inside a tier."""
    groups = matches.groupBy("confidence", "entry_id").agg(F.count("*").alias("n_matches"), F.min("obs_seq").alias("first_obs"))
    return groups.withColumn("number", F.row_number().over(Window.partitionBy("confidence").orderBy("entry_id")))
