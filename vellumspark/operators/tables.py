"""Tables of sections: their shape, whether they are rows of labels, which section they belong to, and the same table in several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import GENERIC_SIGNALS, LABEL_ROW_WORDS, TABLE_SIGNALS, heading_rows
from .routing import flat_cells

TABLE_SLOTS = (9, 10, 14)


def cell(c: Column) -> Column:
    return F.coalesce(T.strip(c), F.lit(""))


def label_word(c: Column) -> Column:
    return F.regexp_replace(F.lower(cell(c)), ":+$", "").isin(list(LABEL_ROW_WORDS))


def has_shape(t: Column) -> Column:
    """At least one row with cells and one cell with text."""
    return F.coalesce(F.exists(t, lambda r: F.exists(r, lambda c: cell(c) != "")), F.lit(False))


def is_transposed(t: Column) -> Column:
    """Labels in the first row and values in the second: three columns or more, at most three rows, two labels, half as many values."""
    width = F.array_max(F.transform(t, lambda r: F.size(r)))
    labels = F.size(F.filter(F.get(t, 0), label_word))
    filled = F.size(F.filter(F.get(t, 1), lambda c: cell(c) != ""))
    return (F.size(t) >= 2) & (width >= 3) & (F.size(t) <= 3) & (labels >= 2) & (filled >= F.greatest(F.lit(1), F.floor(labels / 2)))


def is_label_table(t: Column) -> Column:
    """Rows of a label and a value: transposed; or of two columns, every row with a label and half of at least two rows with one of up to five words; or half of
    the rows, and two at least, with a known label."""
    rows = F.filter(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda r: (F.size(r) >= 2) & ((cell(F.get(r, 0)) != "") | (cell(F.get(r, 1)) != "")))
    named = F.filter(rows, lambda r: cell(F.get(r, 0)) != "")
    short = F.size(F.filter(named, lambda r: F.size(F.split(cell(F.get(r, 0)), r"\s+")) <= 5))
    structural = (F.size(named) == F.size(rows)) & (F.size(named) >= 2) & (short / F.size(named) >= 0.5)
    data = F.size(F.filter(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda r: F.exists(r, lambda c: F.coalesce(F.length(c) > 0, F.lit(False)))))
    known = F.size(F.filter(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda r: label_word(F.get(r, 0))))
    by_word = (F.size(named) == F.size(rows)) & (data > 0) & (known >= F.greatest(F.lit(2.0), data * 0.5))
    return F.coalesce(is_transposed(t) | ((F.size(t) >= 2) & (F.size(F.get(t, 0)) == 2) & (structural | by_word)), F.lit(False))


def signals(t: Column, words) -> Column:
    flat = flat_cells(t)
    return sum((F.when(flat.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def content_class(t: Column) -> Column:
    """9 or 10, whichever has more signals in the cells; -1 for a general table of neither; 0 for tables of labels, ties and others."""
    a, b, g = signals(t, TABLE_SIGNALS[9]), signals(t, TABLE_SIGNALS[10]), signals(t, GENERIC_SIGNALS)
    return F.when((flat_cells(t) == "") | is_label_table(t), 0).when(a > b, 9).when(b > a, 10).when(a > 0, 0).when(g >= 2, -1).otherwise(0)


def signature(t: Column) -> Column:
    """The cells of the first row in small letters."""
    return F.transform(F.get(t, 0), lambda c: F.lower(cell(c)))


def described(tables: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, n_rows, width, shaped, label_table, general, class, cells)"""
    t = F.col("cells")
    general = (signals(t, GENERIC_SIGNALS) >= 2) & (signals(t, TABLE_SIGNALS[9]) == 0) & (signals(t, TABLE_SIGNALS[10]) == 0)
    return tables.select(
        "doc_id", "slot_id", "table_idx", F.size(t).alias("n_rows"), F.coalesce(F.array_max(F.transform(t, lambda r: F.size(r))), F.lit(0)).alias("width"),
        has_shape(t).alias("shaped"), is_label_table(t).alias("label_table"), general.alias("general"), content_class(t).alias("class"), "cells",
    )


def routed(tables: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, to_slot): the section that each table goes to, its content before its place; null if none takes it.

    General tables outside section 9 go nowhere, nor do tables of labels and those without text. Of the tables of a document with one first row the
    first has its section and the others none, so no table is given twice.
    """
    d = described(tables)
    own = F.when(F.col("slot_id").isin(*TABLE_SLOTS), F.col("slot_id"))
    to = F.when(~F.col("shaped") | F.col("label_table") | (F.col("general") & (F.col("slot_id") != 9)), None).when(F.col("class") > 0, F.col("class")).when(F.col("class") == -1, None).otherwise(own)
    place = F.row_number().over(Window.partitionBy("doc_id", "to", "key").orderBy("slot_id", "table_idx"))
    return d.withColumn("to", to).withColumn("key", signature(F.col("cells"))).withColumn("place", place).select("doc_id", "slot_id", "table_idx", F.when(F.col("place") == 1, F.col("to")).alias("to_slot"))


def repeated(tables: DataFrame) -> DataFrame:
    """(doc_id, key, n, first_slot): tables of a document that have one first row, and how many there are."""
    k = tables.filter(F.size("cells") > 0).select("doc_id", "slot_id", F.array_join(signature(F.col("cells")), " | ").alias("key"))
    return k.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("slot_id").alias("first_slot"))


def label_lines(tables: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, row_idx, text): tables of labels as lines of a label and its value, transposed ones column by column."""
    t = F.col("cells")
    line = lambda a, b: F.concat(F.regexp_replace(cell(a), ":+$", ""), F.lit(": "), cell(b))
    across = F.zip_with(F.get(t, 0), F.get(t, 1), line)
    down = F.transform(t, lambda r: line(F.get(r, 0), F.get(r, 1)))
    rows = tables.filter(is_label_table(t)).select("doc_id", "slot_id", "table_idx", F.posexplode(F.when(is_transposed(t), across).otherwise(down)).alias("row_idx", "text"))
    return rows.filter(~F.col("text").rlike(r"^: ?$"))


def header_hits(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """(doc_id, slot_id, table_idx, named_slot, hits): how many cells of the first row are a heading of a section."""
    heads = spark.createDataFrame(heading_rows(), "named_slot int, heading string")
    cells = tables.select("doc_id", "slot_id", "table_idx", F.explode(signature(F.col("cells"))).alias("heading"))
    return cells.join(heads, "heading").groupBy("doc_id", "slot_id", "table_idx", "named_slot").agg(F.count("*").alias("hits"))
