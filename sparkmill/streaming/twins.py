"""Streams whose result, run with availableNow, equals their batch twin.

State is bounded by watermarks; sinks are idempotent by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.session import scratch_path
from sparkmill.sources.sinks import upsert


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str, name: str) -> DataFrame:
    """All that the stream has now, written to the shared folder and read back."""
    out = scratch_path(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_of(spark: SparkSession, path: str, files_at_a_time: int = 4) -> DataFrame:
    """A stream over the files of a Parquet table, or over the one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time)
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """keys, start, n: counts of tumbling windows; rows later than the watermark are left out of their window."""
    return events.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, time: str, keys: list[str], width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(*keys, F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """keys, start, n: sessions that a pause of at least gap ends."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Replays dropped: one row per key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def changes_only(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, value of rows whose value differs from the key's last one; the last value of each key is state that outlives the batch. Nulls store nothing."""

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        d = pd.concat(list(batches)).sort_values(order)
        keep = []
        for v in d[value]:
            new = isinstance(v, str) and v != last
            keep.append(new)
            if new:
                last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: d[key], order: d[order], value: d[value]})[keep]

    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} string"
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, f"{value} string", "append", "NoTimeout")


def guarded_upserts(stream: DataFrame, spark: SparkSession, keys: list[str], order: list[str], previous: int | None, drop: float = 0.4) -> tuple[DataFrame, list[tuple[int, int, bool]]]:
    """The table after all batches were put in by key, and of every batch its number, rows, and whether it was written: a batch with fewer than 1 - drop of the last written one's rows is logged and left out. A replayed batch overwrites its own version."""
    out = scratch_path(spark, "table")
    log: list[tuple[int, int, bool]] = []
    versions: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        n = batch.count()
        last = next((r for _, r, ok in reversed(log) if ok), previous)
        ok = not last or (last - n) <= drop * last
        log.append((number, n, ok))
        if ok:
            table = spark.read.parquet(f"{out}/v{versions[-1]}") if versions else batch.limit(0)
            upsert(table, batch, keys, order).write.mode("overwrite").parquet(f"{out}/v{number}")
            versions.append(number)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return (spark.read.parquet(f"{out}/v{versions[-1]}") if versions else spark.createDataFrame([], stream.schema)), log
