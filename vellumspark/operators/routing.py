"""Sections of documents: headings, intervals below them, forward fill, as-of joins and routing of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import GENERIC_SIGNALS, TABLE_SIGNALS, heading_rows


def heading_table(spark: SparkSession) -> DataFrame:
    """(slot_id, heading); a heading of several sections is given to the first."""
    return spark.createDataFrame(heading_rows(), "slot_id int, heading string").groupBy("heading").agg(F.min("slot_id").alias("slot_id"))


def heading_key(c: Column) -> Column:
    """A line without numbering, colon and stop, in small letters."""
    return F.regexp_replace(F.regexp_replace(F.lower(T.strip(c)), r"^(\d+[.)]\s*|[ivx]+\.\s+)", ""), r"\s*[:.\-–]*\s*$", "")


def heading_of() -> Column:
    """What a line would be as a heading: what stands before a colon and a text, else the whole line."""
    before = F.regexp_extract(F.lower(T.strip(F.col("text"))), r"^(?:\d+[.)]\s*|[ivx]+\.\s+)?([^:]{3,60}):\s+\S", 1)
    return F.coalesce(F.nullif(before, F.lit("")), heading_key(F.col("text")))


def headings(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, slot_id, heading) of lines that are a known heading, bare or with a text after a colon; an equi-join on the heading."""
    return lines.select("doc_id", "line_idx", heading_of().alias("heading")).filter("length(heading) between 3 and 80").join(heading_table(spark), "heading").select("doc_id", "line_idx", "slot_id", "heading")


def section_index(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, slot_id): each line's section, which is that of the last heading before it; lines before the first have none."""
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    own = lines.select("doc_id", "line_idx", F.when(F.length(heading_of()).between(3, 80), heading_of()).alias("heading")).join(heading_table(spark), "heading", "left")
    return own.select("doc_id", "line_idx", F.last("slot_id", True).over(w).alias("slot_id"))


def section_spans(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, slot_id, start, stop): from each heading to the next, which the window over the headings alone finds."""
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    size = lines.groupBy("doc_id").agg((F.max("line_idx") + 1).alias("n"))
    spans = headings(spark, lines).withColumn("next", F.lead("line_idx").over(w)).join(size, "doc_id")
    return spans.select("doc_id", "slot_id", F.col("line_idx").alias("start"), F.coalesce("next", "n").alias("stop"))


def first_claims(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, slot_id, line_idx): the first line that claims each section; of a line that several want, the lowest section has it."""
    found = headings(spark, lines)
    first = found.groupBy("doc_id", "slot_id").agg(F.min("line_idx").alias("line_idx"))
    return first.groupBy("doc_id", "line_idx").agg(F.min("slot_id").alias("slot_id"))


def forward_fill(rich: DataFrame) -> DataFrame:
    """(run_id, version_no, line_idx, slot): lines without a section take that of the last line before them that has one."""
    w = Window.partitionBy("run_id", "version_no").orderBy("line_idx")
    own = F.nullif("slot", F.lit(0))
    return rich.select("run_id", "version_no", "line_idx", F.coalesce(F.last(own, True).over(w), F.lit(0)).alias("slot"))


def as_of(events: DataFrame, left: str = "purchase", right: str = "view") -> DataFrame:
    """(event_id, matched_id): for each event of type ``left`` the last one of type ``right`` of the same user, at the same time or before.

    One window over both sides, so that the join needs one shuffle by user. Of equal times the highest event_id counts.
    """
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == right, 0).otherwise(1), "event_id")
    both = events.filter(F.col("event_type").isin(left, right)).withColumn("matched_id", F.last(F.when(F.col("event_type") == right, F.col("event_id")), True).over(w))
    return both.filter(F.col("event_type") == left).select("event_id", "user_id", "matched_id")


def between_marks(events: DataFrame, mark: str = "signup", wanted: str = "click") -> DataFrame:
    """(mark_id, first_id, n): for each mark of a user the first wanted event before the next mark, and their number; an interval join as one window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = events.filter(F.col("event_type").isin(mark, wanted)).withColumn("mark_id", F.last(F.when(F.col("event_type") == mark, F.col("event_id")), True).over(w))
    return own.filter((F.col("event_type") == wanted) & F.col("mark_id").isNotNull()).groupBy("mark_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.count("*").alias("n"))


def flat_cells(table: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.flatten(table)))


def table_rows(slots: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, cells) of the tables of distinct slots."""
    return slots.select("doc_id", "slot_id", F.posexplode("content_tables").alias("table_idx", "cells")).distinct()


def table_class(tables: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, class, hits): the section with the most different signals in a table's cells, 0 on a tie or without, -1 for general tables."""
    text = flat_cells(F.col("cells"))
    hits = {slot: sum((F.when(text.contains(k), 1).otherwise(0) for k in words), F.lit(0)) for slot, words in TABLE_SIGNALS.items()}
    general = sum((F.when(text.contains(k), 1).otherwise(0) for k in GENERIC_SIGNALS), F.lit(0))
    out = tables.select("doc_id", "slot_id", "table_idx", general.alias("g"), *[h.alias(f"h{s}") for s, h in hits.items()])
    top = F.greatest(*[F.col(f"h{s}") for s in hits])
    ties = sum((F.when(F.col(f"h{s}") == top, 1).otherwise(0) for s in hits), F.lit(0))
    cls = F.when((top == 0) & (F.col("g") >= 2), -1).when((top == 0) | (ties > 1), 0)
    for s in hits:
        cls = cls.when(F.col(f"h{s}") == top, s)
    return out.select("doc_id", "slot_id", "table_idx", cls.alias("class"), top.alias("hits"))


def row_chunks(tables: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, row_idx, phrase): each row below the header as phrases of header and value; tables of fewer than two rows give none.

    Three wordings take turns by column; rows shorter or longer than the header are filled or cut to its width.
    """
    t = tables.filter(F.size("cells") >= 2).withColumn("header", F.element_at("cells", 1))
    rows = t.select("doc_id", "slot_id", "table_idx", "header", F.posexplode("cells").alias("row_idx", "row")).filter("row_idx > 0")
    value = lambda i: F.coalesce(F.get("row", i), F.lit(""))
    pair = F.transform("header", lambda h, i: F.when(i % 3 == 0, F.concat(h, F.lit(": "), value(i))).when(i % 3 == 1, F.concat(F.lit("the "), h, F.lit(" is "), value(i))).otherwise(F.concat(h, F.lit(" equals "), value(i))))
    return rows.select("doc_id", "slot_id", "table_idx", "row_idx", F.array_join(pair, "; ").alias("phrase"))


def padded(tables: DataFrame) -> DataFrame:
    """The tables with all rows filled to the widest: width and cells as one text."""
    width = F.array_max(F.transform("cells", lambda r: F.size(r)))
    rows = F.transform("cells", lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), F.col("width") - F.size(r))), " | "))
    return tables.withColumn("width", width).withColumn("text", F.array_join(rows, "\n")).select("doc_id", "slot_id", "table_idx", F.col("width").cast("bigint").alias("width"), "text")


def prose_overlap(slots: DataFrame) -> DataFrame:
    """(doc_id, slot_id, para_idx): paragraphs of at least 20 characters 70 % of whose different words stand in a table of the same slot."""
    words = F.array_distinct(T.tokens(flat_cells(F.flatten(F.col("content_tables")))))
    p = slots.filter(F.size("content_tables") > 0).select("doc_id", "slot_id", words.alias("words"), F.posexplode("content_paragraphs").alias("para_idx", "text"))
    own = F.array_distinct(T.tokens(F.col("text")))
    return p.filter((F.length("text") >= 20) & (F.size(own) > 0) & (F.size(F.array_intersect(own, "words")) / F.size(own) >= 0.7)).select("doc_id", "slot_id", "para_idx").distinct()
