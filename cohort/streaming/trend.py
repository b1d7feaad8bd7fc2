"""Windowed trend of a value over time, on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohort.functions.columns import column


def stream_trend(
    stream: DataFrame, time: str, value: str, by: Sequence[str] = (), window: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Mean and row count per tumbling window; rows later than ``lateness`` are left out.

    State holds one line per open window and group.
    """
    kind = dict(stream.dtypes)[time]
    stamped = stream.withColumn(time, column(time).cast("timestamp")) if kind == "timestamp_ntz" else stream  # watermarks need instants
    marked = stamped.withWatermark(time, lateness)
    return marked.groupBy(F.window(column(time), window).alias("_w"), *[column(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(column(value)).alias("mean")
    ).select(F.col("_w.start").alias("start"), *[column(b) for b in by], "n", "mean")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: int | None = None) -> None:
    """Process everything available, then stop; progress survives in ``checkpoint``.

    After ``timeout`` seconds the query is stopped and an error says that the result is partial.
    """
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not finish within {timeout} s; {path} holds a part of it")
