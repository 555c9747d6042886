"""Re-joining of lines by rules that depend on what has been joined so far, as a fold over the lines of a document.

The lines of a document are one array, in which the fold runs on the JVM; a document is bounded by what its row can hold, as in the table it comes from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: a line of a label and a value.
LABEL_LINE = r"^[A-Za-z][A-Za-z0-9 ()/&.,'\-_]*\s*[:\t]\s*\S"


def ended(c: Column) -> Column:
    return c.rlike(r"[.!?;:]\s*$")


def goes_on(before: Column, line: Column, aggressive: bool = True) -> Column:
    """Whether a line continues the text before it: that has no end mark and the line begins with a small letter or, aggressively, has at most 240 characters."""
    rule = line.rlike(r"^\p{Ll}")
    return ~ended(before) & (rule | (F.length(line) <= 240) if aggressive else rule)


def folded(lines: DataFrame, joins: Callable[[Column, Column], Column], blank: str) -> DataFrame:
    """(doc_id, para_idx, text): lines joined by spaces as long as ``joins`` holds for the text so far and the next line.

    blank: ``break`` ends a text at a blank line and drops it, ``keep`` takes it as an empty text. Null lines are blank.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", T.strip(F.coalesce("text", F.lit(""))).alias("s")))), lambda x: x["s"])
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        done = F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        more = acc["cur"].isNotNull() & joins(acc["cur"], s)
        if blank == "break":
            flush = s == ""
            return F.struct(F.when(~flush & more, acc["done"]).otherwise(done).alias("done"), F.when(flush, None).when(more, F.concat(acc["cur"], F.lit(" "), s)).otherwise(s).alias("cur"))
        more = more & (s != "")
        return F.struct(F.when(more, acc["done"]).otherwise(done).alias("done"), F.when(more, F.trim(F.concat(acc["cur"], F.lit(" "), s))).otherwise(s).alias("cur"))

    end = lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
    return lines.groupBy("doc_id").agg(F.aggregate(texts, start, add, end).alias("out")).select("doc_id", F.posexplode("out").alias("para_idx", "text"))


def stitched(lines: DataFrame, most: int = 600) -> DataFrame:
    """Lines that begin with a small letter go to an unfinished line before them, as long as the text stays under ``most`` characters."""
    return folded(lines, lambda cur, s: goes_on(cur, s, False) & (F.length(cur) + 1 + F.length(s) < most), "break")


def blocks(lines: DataFrame, most: int = 1200) -> DataFrame:
    """(doc_id, para_idx, kind, text): texts between blank lines, joined across broken lines, as a label row or a paragraph."""
    out = folded(lines, lambda cur, s: goes_on(cur, s) & (F.length(cur) + 1 + F.length(s) < most), "break")
    return out.select("doc_id", "para_idx", F.when(F.col("text").rlike(LABEL_LINE), "label_row").otherwise("paragraph").alias("kind"), "text")


def continued(lines: DataFrame) -> DataFrame:
    """Short lines go to the text before them if that is unfinished or they begin with a small letter, but a label with its value begins anew.

    The text so far may have at most 200 characters, the line 120.
    """
    return folded(lines, lambda cur, s: ~s.rlike(LABEL_LINE) & (s.rlike(r"^\p{Ll}") | ~ended(cur)) & (F.length(s) <= 120) & (F.length(cur) <= 200), "keep")


def clauses(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each clause with a number of several parts (2.1. and the like) and each square bullet: ``clause_idx`` and ``clause``."""
    marked = F.regexp_replace(F.regexp_replace(F.col(text), r"(^|[^\d.])(\d+(?:\.\d+)+\.?\s+[A-Z])", "$1\x01$2"), r"\s*▪\s*", "\x01▪ ")
    parts = F.filter(F.split(marked, "\x01"), lambda x: F.length(F.trim(F.regexp_replace(x, "^▪ ", ""))) > 0)
    return df.select("*", F.posexplode(parts).alias("clause_idx", "_c")).withColumn("clause", T.with_stop(F.col("_c"))).drop("_c")
