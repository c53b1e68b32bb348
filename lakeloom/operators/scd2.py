"""Slowly changing dimensions of type 2: every version of a row with its validity interval.

The history of a key is a function of the set of its changes. Merging a batch therefore means: add the batch to the
stored changes, drop repeats, and chain the intervals again, for the keys of the batch alone: the versions of all other keys
stay as they are and are not shuffled. Replays, late changes, several changes in a batch, and delete followed by re-creation all
come out the same however the changes were batched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.cdc import SEQUENCE
from lakeloom.operators.dedupe import keep_last
from lakeloom.operators.merge import touched_rows
from lakeloom.operators.timeline import with_neighbour

INTERVAL = ["valid_from", "valid_to", "is_current"]


def versions(changes: DataFrame, keys: list[str], tracked: list[str] | None = None, **skew) -> DataFrame:
    """All versions: the change columns plus valid_from, valid_to (timestamps, half-open, open end null), is_current.

    Deletes are kept as rows with `deleted` set, so that a late change before the delete finds its end; `visible`
    hides them. With `tracked`, a change that leaves these columns as they were opens no version; this is meant for
    views, since dropping such changes from a stored history would give a wrong result when a late change arrives.
    """
    fields = [name for name in changes.columns if name not in INTERVAL]
    payload = [name for name in fields if name not in (*keys, *SEQUENCE, "deleted")]
    dated = changes.select(*fields).withColumn("valid_from", F.timestamp_millis("ts_ms").cast("timestamp_ntz"))
    events = keep_last(dated, [*keys, *SEQUENCE], ["deleted", *payload])
    skew = {"examine": dated, **skew}  # before the shuffle of the deduplication
    if tracked is not None:
        events = _drop_unchanged(events, keys, tracked, skew)
    chained = with_neighbour(events, keys, SEQUENCE, {"valid_to": "valid_from"}, **skew)
    return chained.withColumn("is_current", F.col("valid_to").isNull() & ~F.col("deleted"))


def _drop_unchanged(events: DataFrame, keys: list[str], tracked: list[str], skew: dict) -> DataFrame:
    seen = {f"_was_{name}": name for name in ["deleted", *tracked]}
    paired = with_neighbour(events, keys, SEQUENCE, seen, forward=False, **skew)
    differs = F.col("_was_deleted").isNull() | (F.col("_was_deleted") != F.col("deleted"))
    for name in tracked:
        differs = differs | ~F.col(f"_was_{name}").eqNullSafe(F.col(name))
    return paired.filter(differs).drop(*seen)


def scd2(history: DataFrame | None, changes: DataFrame, keys: list[str], **skew) -> DataFrame:
    """The history after a batch of changes. Both are read several times, so they should be tables rather than long plans."""
    if history is None:
        return versions(changes, keys, **skew)
    touched, others = touched_rows(history, changes, keys)
    stored = touched.drop(*INTERVAL)
    chained = versions(stored.unionByName(changes.select(*stored.columns)), keys, **skew)
    return others.unionByName(chained.select(*history.columns))


def visible(history: DataFrame) -> DataFrame:
    """Versions as readers see them, without delete markers and bookkeeping columns."""
    return history.filter(~F.col("deleted")).drop("deleted", *SEQUENCE)


def current(history: DataFrame) -> DataFrame:
    return history.filter(F.col("is_current"))
