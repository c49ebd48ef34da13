"""Matching a stream of observations against the static list."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.matching import match
from ..operators.observations import of_visits


def match_stream(visits: DataFrame, entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """A stream (obs_seq, url and what else an observation has) joined with the list; stateless, with the results of
    ``matching.match`` on the same rows as a table."""
    return match(of_visits(visits, "url"), entries, identifiers)


def first_seen(observations: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first observation of each key within the watermark's delay; an extension with bounded state."""
    return observations.withWatermark(time, delay).dropDuplicatesWithinWatermark(["platform", "kind", "value"])
