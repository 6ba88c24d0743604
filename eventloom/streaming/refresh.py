"""The recurring refresh: extract new captures as they arrive.

All extractors are narrow and stateless, so the batch functions run unchanged
on a stream of capture files. Each run takes what is new since the last one,
appends the raw events and stops; resolution then runs on the appended table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def refresh(
    spark: SparkSession,
    captures: str,
    schema: str,
    extract: Callable[[DataFrame], DataFrame],
    out: str,
    progress: str,
    fmt: str = "parquet",
) -> int:
    """Append the raw events of new captures to `out`; returns the number of captures read.

    `progress` is the folder that remembers which captures were taken; a run
    that was cut short is completed by the next one, without repeats.
    """
    new = spark.readStream.schema(schema).format(fmt).load(captures)
    run = (
        extract(new)
        .writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(out)
    )
    # Spark remembers the last hundred batches only, so they are counted as they end.
    rows: dict[int, int] = {}
    ended = False
    while not ended:
        ended = run.awaitTermination(1)
        for p in run.recentProgress:
            rows[p["batchId"]] = max(rows.get(p["batchId"], 0), p["numInputRows"])
    return sum(rows.values())
