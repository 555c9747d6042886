"""Runs, versions and their lines: newest deliveries, versions, differences, sessions, transitions, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import SECTIONS
from .lines import latest

LINE = ["run_id", "version_no", "line_idx"]


def newest_lines(rich: DataFrame) -> DataFrame:
    """The last delivery of each line; late and repeated ones make no difference."""
    return latest(rich, LINE, "received_at", "line_id")


def slot_texts(lines: DataFrame) -> DataFrame:
    """(run_id, version_no, slot, text): the lines of a section of a version in order, one under the other."""
    rows = F.array_sort(F.collect_list(F.struct("line_idx", F.coalesce("text", F.lit("")).alias("text"))))
    return lines.filter("kind = 'p'").groupBy("run_id", "version_no", F.coalesce("slot", F.lit(0)).alias("slot")).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def version_diff(lines: DataFrame) -> DataFrame:
    """(run_id, version_no, slot, before, after) of the sections that changed against the version before; missing texts are empty."""
    texts = slot_texts(lines)
    versions = lines.select("run_id", "version_no").distinct()
    before = versions.withColumn("previous", F.lag("version_no").over(Window.partitionBy("run_id").orderBy("version_no"))).filter("previous is not null")
    now = before.join(texts, ["run_id", "version_no"]).select("run_id", "version_no", "slot", F.col("text").alias("after"))
    old = before.join(texts.withColumnRenamed("version_no", "previous"), ["run_id", "previous"]).select("run_id", "version_no", "slot", F.col("text").alias("before"))
    both = now.join(old, ["run_id", "version_no", "slot"], "full")
    out = both.select("run_id", "version_no", "slot", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    return out.filter("before <> after")


def versions(lines: DataFrame) -> DataFrame:
    """(run_id, latest, next_no, n_versions)"""
    return lines.groupBy("run_id").agg(F.max("version_no").alias("latest"), (F.coalesce(F.max("version_no"), F.lit(0)) + 1).alias("next_no"), F.count_distinct("version_no").alias("n_versions"))


def resolve_version(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, version_no): of a finished run its last version, of others the last but one if there is one."""
    w = Window.partitionBy("run_id").orderBy(F.desc("version_no"))
    v = lines.select("run_id", "version_no").distinct().withColumn("n", F.row_number().over(w)).filter("n <= 2").groupBy("run_id").agg(F.max("version_no").alias("last"), F.min("version_no").alias("before"))
    return v.join(runs.select("run_id", "status").distinct(), "run_id").select("run_id", F.when(F.col("status") == "done", F.col("last")).otherwise(F.col("before")).alias("version_no"))


def numbered(lines: DataFrame) -> DataFrame:
    """(run_id, version_no, kind, number): versions of a run numbered through, the last marked as draft."""
    w = Window.partitionBy("run_id").orderBy("version_no")
    v = lines.select("run_id", "version_no").distinct()
    return v.select("run_id", "version_no", F.when(F.lead("version_no").over(w).isNull(), "draft").otherwise("frozen").alias("kind"), F.row_number().over(w).alias("number"))


def sessions(events: DataFrame, seconds: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, session, n, first_ts, last_ts): events of a key no more than ``seconds`` apart, coalesced."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    s = events.withColumn("session", F.sum(F.when(gap.isNull() | (gap > seconds), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def transitions(events: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(from_state, to_state, valid, n): how often each change of state happens to a key, and whether it may."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select("user_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state")).filter("from_state is not null")
    valid = F.lit(False)
    for a, bs in allowed.items():
        valid = valid | ((F.col("from_state") == a) & F.col("to_state").isin(bs))
    return steps.groupBy("from_state", "to_state").agg(F.count("*").alias("n")).withColumn("valid", valid)


def newest_within(df: DataFrame, key: str, order: Column, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key: the eviction rule of a store with a fixed number of places."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order.desc(), "run_id"))).filter(F.col("place") <= keep)


def drop_repeats(events: DataFrame, seconds: int) -> DataFrame:
    """Events but those that repeat the type of the user's last event within ``seconds``."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= seconds)).drop("_gap")


def time_ago(ts: Column, now: Column) -> Column:
    m = F.timestamp_diff("MINUTE", ts, now)
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).when(m < 10080, F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago"))).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def section_titles() -> Column:
    return F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
