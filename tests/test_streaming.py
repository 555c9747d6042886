"""The autosave stream gives every session, those that are open at the end of the input too."""

import datetime
import os

from pyspark.sql import functions as F

from vellumspark.operators import workflow
from vellumspark.plans.registry import QUERIES
from vellumspark.sources.tables import read_table
from vellumspark.streaming.autosave import SCHEMA

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
T0 = datetime.datetime(2024, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_open_sessions_are_given(spark, tmp_path):
    at = lambda k, hours, user=1: (k, T0 + datetime.timedelta(hours=hours), user, "view", None, None)
    d = write(spark, tmp_path, [at(1, 0), at(2, 0.5), at(3, 200), at(4, 200.5), at(5, 201, None), at(6, 170, 2)])
    got = {(r.user_id, r.n) for r in QUERIES["autosave_stream"](spark, d).collect()}
    assert got == {(1, 2), (None, 1), (2, 1)} and QUERIES["autosave_stream"](spark, d).count() == 4


def test_no_events(spark, tmp_path):
    assert QUERIES["autosave_stream"](spark, write(spark, tmp_path, [])).count() == 0


def test_sessions_hold_every_event(spark):
    events = read_table(spark, DATA, "events")
    got = QUERIES["autosave_stream"](spark, DATA)
    assert got.agg(F.sum("n")).first()[0] == events.count()
    batch = workflow.sessions(events, 3600).select("user_id", "first_ts", "n")
    key = lambda df: sorted((r.user_id, r.first_ts.isoformat(), r.n) for r in df.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).collect())
    assert key(got) == key(batch)
