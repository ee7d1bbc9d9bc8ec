"""Structured Streaming forms of ingest, logs, state and roll-ups.

Every job is a function from a streaming (or batch) frame to a frame; ``run_to_table`` runs one with
availableNow to its end and returns what it wrote, so that a test can hold it against a batch query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import shared_dir


def shared(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream of its files; a table of one file is picked out of its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(path.rsplit("/", 1)[0])


def run_to_table(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over all that is there. append: to files; complete: the last state; update: each key's last row."""
    spark, at = df.sparkSession, shared(df.sparkSession)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{at}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    writer.foreachBatch(put).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    if mode == "update":
        rest = [c for c in out.columns if c not in (*keys, "__batch")]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")
    return out.drop("__batch")


def timed(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return timed(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return timed(events).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def by_session(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return timed(events, "2 days").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each id once within the watermark; ids that come again later would be passed."""
    return timed(events).dropDuplicatesWithinWatermark([key]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def newer_than(events: DataFrame, watermark) -> DataFrame:
    return events.filter(F.col("ts") > F.lit(watermark))


def conversation_state(turns: DataFrame, last: int = 20) -> DataFrame:
    """conv_id, turns, last_turn, chars of its latest ``last`` turns: a bounded state for each conversation."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = (state.get[0], list(zip(state.get[1], state.get[2]))) if state.exists else (0, [])
        for part in parts:
            n += len(part)
            kept += list(zip(part["turn"].tolist(), part["chars"].tolist()))
        kept = sorted(kept)[-last:]
        state.update((n, [a for a, _ in kept], [b for _, b in kept]))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "last_turn": [kept[-1][0]], "chars": [sum(b for _, b in kept)]})

    sized = turns.select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    return sized.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long, last_turn long, chars long", "n long, turns array<long>, chars array<long>", "update", GroupStateTimeout.NoTimeout)


def append_log(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream to JSON lines, up to what is there now."""
    df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


Job = Callable[[DataFrame], DataFrame]
