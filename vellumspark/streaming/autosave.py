"""Autosave sessions as a structured stream: events of a user no more than a gap apart, closed by the watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "2 days") -> DataFrame:
    """(user_id, first_ts, last_ts, n) of a stream of events; those later than ``late`` are left out, as the watermark defines."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("last_ts"), "n")


def sessions_now(spark: SparkSession, sf_dir: str, gap: str = "60 minutes", late: str = "2 days") -> DataFrame:
    """Runs the stream over the files that are there and gives all sessions, from a table under the checkpoint folder.

    A second source holds one row, the end of the input, so far after the last event that the watermark closes every
    session of the events; the row's own session stays open and is never given. All files are read in one batch, so no
    event is late. Events without a time are in no session.
    """
    folder = f"{checkpoint_folder(spark)}/autosave_{uuid.uuid4().hex}"
    ntz = SCHEMA.replace("ts timestamp", "ts timestamp_ntz")
    ts = F.col("ts").cast("timestamp")
    end = spark.read.schema(ntz).parquet(f"{sf_dir}/events.parquet").agg(F.max(ts).alias("ts"))
    end = end.select(F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr(f"interval '{late}' + interval '{gap}' + interval '{gap}'")).alias("ts"))
    end.write.parquet(f"{folder}/end")
    source = spark.readStream.schema(ntz).parquet(f"{sf_dir}/events.parque[t]").select("user_id", ts.alias("ts"))
    stream = sessions(source.unionByName(spark.readStream.schema(end.schema).parquet(f"{folder}/end")), gap, late)
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/sessions")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/sessions")
