"""The journal of a live session as a stream: readers with their own cursors, exactly-once sinks, stateful limiting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.tables import cut_lineage


def read_events(spark, folder: str, schema: T.StructType, table: str = "live_events", files: int = 64) -> DataFrame:
    """A stream over the files of the journal, at most ``files`` a batch. Each query has a cursor of its own.

    The journal is either a file of the folder or a folder in it.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if spark.read.parquet(f"{folder}/{table}.parquet").inputFiles()[0].rstrip("/").endswith(f"{table}.parquet"):
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{table}.parquet")


def read_json_journal(spark, folder: str, schema: T.StructType) -> DataFrame:
    """A stream over a journal of JSON lines with one wide schema; unknown fields are ignored, broken lines give NULLs."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(folder)


def _folder(spark, name: str) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return f"{sc.getCheckpointDir()}/{name}"


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is and give its complete result. Each batch replaces the table written before."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession, name)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/table/none")
    state = {"at": f"{out}/table/none"}

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/{number}")
        state["at"] = f"{out}/table/{number}"

    run = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(state["at"])


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is into a file sink, which takes every row exactly once, and read it."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession, name)
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def limited(events: DataFrame, key: str, time: str, tie: str, limit: int, span: float) -> DataFrame:
    """Calls admitted by a limiter per key of ``limit`` calls in ``span`` seconds; refused calls don't count.

    The state of a key is the times of its open calls, ``limit`` at most.
    """
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField(time, T.DoubleType()), T.StructField(tie, T.LongType())])
    state = T.StructType([T.StructField("open", T.ArrayType(T.DoubleType()))])

    def admit(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(batches)).drop_duplicates(tie).sort_values([time, tie])
        open_ = list(held.get[0]) if held.exists else []
        kept = []
        for t, x in zip(calls[time], calls[tie]):
            open_ = [o for o in open_ if o > t - span]
            if len(open_) < limit:
                open_.append(t)
                kept.append((k[0], t, x))
        held.update((open_,))
        yield pd.DataFrame(kept, columns=[key, time, tie])

    picked = events.select(key, F.col(time).cast("double").alias(time), tie).filter(F.col(time).isNotNull())
    return picked.groupBy(key).applyInPandasWithState(admit, out, state, "append", "NoTimeout")
