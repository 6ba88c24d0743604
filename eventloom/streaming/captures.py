"""Pages that are captured again and again: only what changed goes on, and late captures are known once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 24 * 3600 * 1000


def changed_captures(captures: DataFrame, key: str, content: list[str], at: str, keep_days: int = 90) -> DataFrame:
    """The captures of a stream whose content differs from the last one of the same key.

    What is remembered of a key is a digest of its last content and its time
    `at`, until other keys have been captured keep_days later; then the key
    counts as new. Within a batch, captures of a key are taken in order of time;
    one that is older than the last one taken is late and dropped. Nulls in the
    content are values; a null key is a key. Captures without a time are dropped.
    """
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    # Captures of one key may be late by any time, as long as the key is remembered.
    rows = captures.filter(F.col(at).isNotNull()).withWatermark(at, f"{keep_days} days")
    rows = rows.withColumns({"_digest": digest, "_order": F.unix_millis(at)})
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    columns = captures.columns

    def changed(_, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, before = state.get if state.exists else (None, None)
        pages = pd.concat(list(batches)).sort_values("_order", kind="stable")
        kept = []
        for n, (found, when) in enumerate(zip(pages["_digest"], pages["_order"])):
            if before is not None and when < before:
                continue
            if found != last:
                kept.append(n)
            last, before = found, int(when)
        state.update((last, before))
        state.setTimeoutTimestamp(max(before, state.getCurrentWatermarkMs()) + DAY_MS)
        yield pages.iloc[kept][columns]

    kinds = T.StructType([T.StructField("digest", T.StringType()), T.StructField("before", T.LongType())])
    return rows.groupBy("_key").applyInPandasWithState(changed, captures.schema, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def once_within(captures: DataFrame, keys: list[str], event_time: str, delay: str = "2 days") -> DataFrame:
    """The captures of a stream without repeats of `keys` that come within `delay` of each other in event time.

    Captures later than that are dropped by the watermark; the stream's progress counts them.
    """
    return captures.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def late_rows(progress: list[dict]) -> int:
    """Rows that the watermark dropped, from the progress of a query's batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
