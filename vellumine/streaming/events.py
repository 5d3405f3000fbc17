"""Event streams: replay of a table, windows, duplicates, upserts and per-key state.

Each function takes a streaming DataFrame (or a static one, where the operators allow it). ``drain`` runs a stream
to the end of what there is and returns the result as a table in the shared folder.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"


def replay(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A Parquet table as a stream; its time column becomes a timestamp."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path has to be a folder
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def complete(stream: DataFrame, name: str) -> DataFrame:
    """The last complete result, kept by a batch function that overwrites by batch and is read back."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    newest = rows.agg(F.max("batch").alias("newest"))  # one row
    return rows.join(F.broadcast(newest), F.col("batch") == F.col("newest"), "left_semi").select(*stream.columns)


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by event time; rows later than the watermark drop out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), "n")


def distinct_events(events: DataFrame, key: list[str], late: str = "30 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def last_kinds(events: DataFrame) -> DataFrame:
    """user_id, n, kind: a running fold per key in arbitrary state; a row per key and batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, kind = state.get if state.exists else (0, "", "")
        for pdf in frames:
            n += len(pdf)
            top = max(zip(pdf["at"], pdf["event_type"]), default=(at, kind))
            at, kind = max((at, kind), top)
        state.update((n, at, kind))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "kind": [kind]})

    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    rows = events.select("user_id", "event_type", at.alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, kind string", "n long, at string, kind string", "update", GroupStateTimeout.NoTimeout)


def upsert_into(stream: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """The newest row per key after all batches: each batch appends its own newest, and a read settles the rest."""
    spark, out = stream.sparkSession, folder(stream.sparkSession, name)

    def newest(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def put(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")  # a repeated batch replaces itself

    stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return newest(spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*").select(*stream.columns))


def within(left: DataFrame, right: DataFrame, hours: int) -> DataFrame:
    """Stream-stream join: rows of right up to some hours after rows of left of the same user."""
    a = left.select(F.col("event_id").alias("first"), F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", "1 hour")
    b = right.select(F.col("event_id").alias("second"), "user_id", "ts").withWatermark("ts", "1 hour")
    return a.join(b, (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("t")) & (F.col("ts") <= F.col("t") + F.expr(f"INTERVAL {hours} HOURS")) & (F.col("first") != F.col("second"))).select("first", "second")
