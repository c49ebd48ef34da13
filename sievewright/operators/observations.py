"""Observations: what one data owner's own tables show, in the same form as the reference list.

No observation names a person. ``obs_seq`` carries the order of arrival, on which first-wins rules depend.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions import text as x
from ..functions.addresses import with_identifiers

COLUMNS = ("obs_seq", "ident_pos", "platform", "kind", "value", "trace_type", "source", "raw", "occurred_at")


def unrolled(df: DataFrame, columns: list[str], array: str = "_ids") -> DataFrame:
    """One row for each element, as ``_i`` at ``ident_pos``.

    The outer form with a filter on its output: for the plain one Catalyst infers a filter on the array and
    pushes it below the parsing, which it would then write out over and over.
    """
    return df.select(*columns, F.posexplode_outer(array).alias("ident_pos", "_i")).where("ident_pos is not null")


def of_addresses(df: DataFrame, address: str) -> DataFrame:
    """Rows (obs_seq, trace_type, source, occurred_at, address) to one row for each identifier, ``ident_pos`` in order."""
    parsed = with_identifiers(df, address, "_ids")
    return unrolled(parsed, df.columns).select(*df.columns, "ident_pos", "_i.platform", "_i.kind", "_i.value", F.coalesce(F.nullif(F.col("_i.raw"), F.lit("")), "_i.value").alias("raw"))


@lru_cache(maxsize=16)
def _bare_host(gateway: int, address: str) -> Column:
    """The first bare host in a text as an array of one identifier, or NULL; built once for a JVM."""
    host = x.normalize_host(F.get(x.find_bare_domains(F.col(address)), F.lit(0)))
    return F.when(host.isNotNull(), F.array(F.struct(F.lit("web").alias("platform"), F.lit("domain").alias("kind"), host.alias("value"))))


def of_visits(df: DataFrame, address: str) -> DataFrame:
    """As ``of_addresses``; an address without identifiers gives the first bare host in it, whatever it is."""
    parsed = with_identifiers(df, address, "_ids")
    bare = _bare_host(id(df.sparkSession.sparkContext._gateway), address)
    parsed = parsed.withColumn("_ids", F.transform("_ids", lambda i: F.struct(i["platform"].alias("platform"), i["kind"].alias("kind"), i["value"].alias("value"))))
    parsed = parsed.withColumn("_ids", F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(bare))
    return unrolled(parsed, df.columns).select(*df.columns, "ident_pos", "_i.*", F.col(address).alias("raw"))


def handle_value(c: Column) -> Column:
    """A handle known without its address: no repair of spelling."""
    return F.lower(F.ltrim(x.strip(c), F.lit("@")))


def number_value(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(?U)[^\d]", "")


# --- visits and bookmarks ------------------------------------------------------------------------
def collapse_visits(visits: DataFrame) -> DataFrame:
    """Observations of visits with ``visit_count`` to one row a key: visits summed, latest date, first sample.

    Partial sums are taken before the shuffle, so a host visited by a third of all rows is no hot spot.
    """
    seq = F.struct("obs_seq", "ident_pos")
    return visits.groupBy("platform", "kind", "value").agg(
        F.sum("visit_count").alias("visits"),
        F.max("occurred_at").alias("occurred_at"),
        F.min_by("raw", seq).alias("raw"),
        F.min("obs_seq").alias("obs_seq"),
        F.min_by("ident_pos", seq).alias("ident_pos"),
    )


def first_by_key(observations: DataFrame, *order: str) -> DataFrame:
    """The first observation of each key; ``order`` must be total. Partial minima are taken before the shuffle."""
    rows = observations.groupBy("platform", "kind", "value").agg(F.min_by(F.struct(*observations.columns), F.struct(*order)).alias("_first"))
    return rows.select("_first.*")


def browser_observations(history: DataFrame, bookmarks: DataFrame, label: str) -> DataFrame:
    """(seq, url, occurred_at, visit_count) and (seq, url) of one profile to observations."""
    base = {"trace_type": F.lit("visit"), "source": F.lit(label)}
    visits = of_visits(history.withColumnRenamed("seq", "obs_seq").withColumns(base), "url")
    visits = collapse_visits(visits).withColumns({"trace_type": F.lit("visit"), "source": F.concat(F.lit(f"{label}: history, visits "), F.col("visits").cast("string"))})
    saved = of_visits(bookmarks.withColumnRenamed("seq", "obs_seq").withColumns({"trace_type": F.lit("saved"), "source": F.lit(f"{label}: bookmarks"), "occurred_at": F.lit(None).cast("date")}), "url")
    saved = first_by_key(saved, "obs_seq", "ident_pos")
    return visits.select(F.lit(0).alias("phase"), *COLUMNS).unionByName(saved.select(F.lit(1).alias("phase"), *COLUMNS))


# --- dialogs and messages ------------------------------------------------------------------------
def dialog_observations(dialogs: DataFrame) -> DataFrame:
    """(seq, name, entity struct) to subscriptions: each user name once, then the id."""
    e = F.col("entity")
    extra = F.transform(F.coalesce(e["usernames"], F.array().cast(dict(dialogs.select("entity.usernames").dtypes)["usernames"])), lambda u: u["username"])
    names = F.filter(F.array_distinct(F.concat(F.array(e["username"]), extra)), lambda n: n.isNotNull() & (n != ""))
    where = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(e["title"], F.lit("")), F.lit("untitled"))
    chat = x.chat_id(e["id"])
    pick = lambda kind, value, raw: F.struct(F.lit(kind).alias("kind"), value.alias("value"), raw.alias("raw"))
    found = F.concat(F.transform(names, lambda n: pick("handle", F.lower(n), F.concat(F.lit("@"), n))), F.filter(F.array(pick("numeric_id", chat, e["id"].cast("string"))), lambda i: i["value"] != ""))
    rows = dialogs.where(e["cls"].isin(*t.SUBSCRIPTION_CLASSES)).select(F.col("seq").alias("obs_seq"), F.concat(F.lit("telegram: followed, "), where).alias("source"), F.posexplode(found).alias("ident_pos", "i"))
    return rows.select("obs_seq", "ident_pos", F.lit("telegram").alias("platform"), "i.kind", "i.value", F.lit("subscription").alias("trace_type"), "source", "i.raw", F.lit(None).cast("date").alias("occurred_at"))


def newest_messages(messages: DataFrame, limit: int = 3000) -> DataFrame:
    """The newest ``limit`` messages of each dialog: a reader's setting, not a guard against skew."""
    place = F.row_number().over(Window.partitionBy("dialog").orderBy(F.desc("date"), F.desc("seq")))
    return messages.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def readable_messages(messages: DataFrame, own_only: bool = False, quick: bool = False, subscriptions_only: bool = False) -> DataFrame:
    """Reader modes: only own messages; only those with a link; none."""
    if subscriptions_only:
        return messages.where(F.lit(False))
    if own_only:
        messages = messages.where("out")
    if quick:
        hidden = F.exists(F.coalesce("entities", F.array().cast(dict(messages.dtypes)["entities"])), lambda u: F.coalesce(u["url"] != "", F.lit(False)))
        messages = messages.where((F.size(x.find_urls(F.coalesce("message", F.lit("")))) > 0) | hidden)
    return messages


def message_observations(messages: DataFrame) -> DataFrame:
    """(seq, dialog, message, entities, fwd_from, date, out) to the forward's origin, then links in and behind the text.

    What was received stays apart from what was sent.
    """
    out = F.coalesce("out", F.lit(False))
    author = F.when(out, F.lit("sent")).otherwise(F.lit("received"))
    label = lambda what: F.concat(F.lit("telegram: "), author, F.lit(f" {what}, "), F.col("dialog"))
    base = messages.withColumns({"obs_seq": F.col("seq"), "occurred_at": F.to_date("date")})
    peer = F.col("fwd_from.from_id")
    some = lambda c: F.when(c != 0, c)
    origin = x.chat_id(F.coalesce(some(peer["channel_id"]), some(peer["user_id"]), some(peer["chat_id"])))
    forwards = base.withColumn("value", origin).where(F.col("value") != "").select(
        "obs_seq", F.lit(0).alias("part"), F.lit(0).alias("ident_pos"), F.lit("telegram").alias("platform"), F.lit("numeric_id").alias("kind"), "value",
        F.when(out, F.lit("repost")).otherwise(F.lit("repost_received")).alias("trace_type"), label("forward").alias("source"), F.coalesce(F.nullif(F.col("fwd_from.from_name"), F.lit("")), F.col("value")).alias("raw"), "occurred_at",
    )
    empty = F.array().cast("array<string>")
    hidden = F.filter(F.transform("entities", lambda u: u["url"]), lambda u: u.isNotNull() & (u != ""))
    urls = F.concat(x.find_urls(F.coalesce("message", F.lit(""))), F.coalesce(hidden, empty))
    links = base.select("obs_seq", "occurred_at", F.when(out, F.lit("link")).otherwise(F.lit("link_received")).alias("trace_type"), label("link").alias("source"), F.posexplode(urls).alias("_pos", "url"))
    links = of_addresses(links, "url").withColumn("part", F.col("_pos") + 1)
    names = ("obs_seq", "part", "ident_pos", "platform", "kind", "value", "trace_type", "source", "raw", "occurred_at")
    return forwards.select(*names).unionByName(links.select(*names))


def messenger_observations(dialogs: DataFrame, messages: DataFrame) -> DataFrame:
    """Subscriptions, then messages; a key seen before, in either phase, is dropped."""
    subs = dialog_observations(dialogs).withColumns({"phase": F.lit(0), "part": F.lit(0)})
    msgs = message_observations(messages).withColumn("phase", F.lit(1))
    return first_by_key(subs.unionByName(msgs), "phase", "obs_seq", "part", "ident_pos")
