"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.storage import run_dir


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that are Python objects at a time, and about how many bytes they have; a single row may have more.
SMALL_ROWS, SMALL_BYTES = 1_000, 1 << 20


def small(batches: Iterator[pa.RecordBatch], most: int = SMALL_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes, so that few texts are in memory twice."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = batch.slice(at, SMALL_ROWS)
            # Halved until it fits, as long texts may stand together.
            while rows.num_rows > 1 and rows.nbytes > most:
                rows = rows.slice(0, -(-rows.num_rows // 2))
            yield rows
            at += rows.num_rows


def _as_bytes(column: pa.Array) -> pa.Array:
    kind = {pa.string(): pa.binary(), pa.large_string(): pa.large_binary()}.get(column.type)
    return column.cast(kind) if kind else column


def map_text(
    docs: DataFrame,
    scan: Callable[[Iterator[tuple[pa.Array, pa.Array]]], Iterator[tuple[pa.Array, dict]]],
    fields: str,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Run scan over batches of (rows, texts as bytes), with a batch of results for each.

    The columns in keep (all, if None) travel in one struct `row`, so that no
    name of theirs can clash with a result. scan yields (rows, results by name).
    A text that is kept travels only there.
    """
    keep = docs.columns if keep is None else keep
    row = F.struct(*[docs[c] for c in keep]).alias("row")
    place = keep.index(text) if text in keep and docs.schema[text].dataType in (T.StringType(), T.BinaryType()) else None
    rows = docs.select(row, docs[text].cast("binary").alias("body")) if place is None else docs.select(row)
    extra = T._parse_datatype_string(fields)
    schema = T.StructType([rows.schema["row"], *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = {f.name: to_arrow_type(f.dataType) for f in extra.fields}
        pairs = ((b.column(0), b.column(1) if place is None else _as_bytes(b.column(0).field(place))) for b in small(batches))
        for kept, out in scan(pairs):
            columns = [v if isinstance(v := out[n], pa.Array) else pa.array(v, t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays([kept, *columns], names=["row", *types])

    return rows.mapInArrow(run, schema)


def hot_threshold(counts: DataFrame, column: str, most: int) -> int:
    """The least power of two such that at most `most` rows have a count of that or more."""
    bins = counts.groupBy(F.length(F.bin(column)).alias("bits")).count().collect()  # at most 63 rows
    total, bits = 0, 64
    for row in sorted(bins, key=lambda r: -r["bits"]):
        if total + row["count"] > most:
            break
        total, bits = total + row["count"], row["bits"]
    return min(1 << (bits - 1), (1 << 63) - 1)


#: How tables of the driver are found.
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
