"""From lines to one row for each document and section, and checks of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import LABELS, SECTIONS
from .lines import clean
from .routing import heading_of, heading_table
from .values import valid_values

# The labels of the two sections that are rows of labels, and the text of a section that a document lacks.
LABEL_SECTIONS = {
    1: ("Type:", "Policy Title:", "Policy Number:", "Applicable Sector(s):", "Functional Area(s):"),
    3: ("Effective Date/Period:", "Approved by:", "Prepared by:", "Responsible Function(s):", "Responsible Function Officer(s):", "Supersedes:", "Last Reviewed:", "Applies to:"),
}
NOT_FOUND = "Data is not found in source file"
TABLE_SLOTS = (9, 10, 14)


def document_sections(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, slot_id, n_lines, backend, text): fifteen rows for each document with a line.

    The lines that the cleaning keeps go to the section of the last heading before them, those of labels give the sections 1 and 3, and section 15 is the picture. A section
    without lines has the text of a missing one. One shuffle by document serves the index and the grouping.
    """
    kept = clean(lines).filter("reason is null").select("doc_id", "line_idx", "text")
    heads = kept.withColumn("heading", F.when(F.length(heading_of()).between(3, 80), heading_of())).join(heading_table(spark), "heading", "left")
    placed = heads.withColumn("slot_id", F.last("slot_id", True).over(Window.partitionBy("doc_id").orderBy("line_idx"))).filter("slot_id is not null")
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", T.strip(F.coalesce("text", F.lit(""))).alias("s"))))
    body = placed.filter(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0).groupBy("doc_id", "slot_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(ordered, lambda x: x["s"]), "\n").alias("text"), F.lit("heading").alias("backend"))
    slot = F.coalesce(*[F.when(F.col("label").isin(list(ls)), F.lit(s)) for s, ls in LABEL_SECTIONS.items()])
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    rows = F.array_sort(F.collect_list(F.struct(place.alias("k"), F.concat("label", F.lit(" "), "value").alias("s"))))
    labels = valid_values(spark, lines).withColumn("slot_id", slot).filter("slot_id is not null").groupBy("doc_id", "slot_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(rows, lambda x: x["s"]), "\n").alias("text"), F.lit("label_row").alias("backend"))
    every = lines.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(len(SECTIONS)))).alias("slot_id"))
    found = body.filter(~F.col("slot_id").isin(*LABEL_SECTIONS, 15)).unionByName(labels)
    out = every.join(found, ["doc_id", "slot_id"], "left")
    backend = F.when(F.col("slot_id") == 15, "logo").otherwise(F.coalesce("backend", F.lit("missing")))
    return out.select("doc_id", "slot_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), backend.alias("backend"), F.when(F.col("slot_id") != 15, F.coalesce("text", F.lit(NOT_FOUND))).alias("text"))


def checks(sections: DataFrame) -> DataFrame:
    """(doc_id, name, ok): what a finished document must fulfil."""
    a = sections.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("slot_id").alias("slots"), F.count_if(F.col("backend") == "missing").alias("missing"), F.count_if(F.col("backend") == "heading").alias("by_heading"),
        F.count_if((F.col("slot_id") == 1) & (F.col("backend") == "label_row") & F.col("text").contains("Policy Title:")).alias("titled"), F.count_if(F.coalesce(T.garbled(F.col("text")), F.lit(False))).alias("garbled"),
    )
    rules = {"fifteen_sections": (F.col("n") == 15) & (F.col("slots") == 15), "has_title": F.col("titled") == 1, "some_heading": F.col("by_heading") > 0, "nothing_garbled": F.col("garbled") == 0, "nothing_missing": F.col("missing") == 0}
    return a.select("doc_id", F.explode(F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), v)])).alias("name", "ok"))


def body_of(slots: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, slot_id, n_given, body): the first ``most`` paragraphs of a section, none where a table stands for them."""
    has_table = F.col("slot_id").isin(*TABLE_SLOTS) & (F.coalesce(F.size("content_tables"), F.lit(0)) > 0)
    given = F.coalesce("content_paragraphs", F.array().cast("array<string>"))
    body = F.when(has_table, F.array().cast("array<string>")).otherwise(F.slice(given, 1, most))
    return slots.select("doc_id", "slot_id", "content_paragraphs", "content_tables").distinct().select("doc_id", "slot_id", F.size(given).alias("n_given"), F.size(body).alias("n_body"), F.array_join(body, "\n").alias("body"))


def empty_slots(slots: DataFrame) -> DataFrame:
    """(doc_id, slot_id): sections without a paragraph of more than twelve characters with a letter and without a cell with text."""
    text = F.exists(F.coalesce("content_paragraphs", F.array().cast("array<string>")), lambda p: F.coalesce((F.length(T.strip(p)) > 12) & p.rlike(r"\p{L}"), F.lit(False)))
    cell = F.exists(F.flatten(F.flatten(F.coalesce("content_tables", F.array().cast("array<array<array<string>>>")))), lambda c: F.coalesce(F.length(T.strip(c)) > 0, F.lit(False)))
    return slots.filter(~text & ~cell).select("doc_id", "slot_id").distinct()


def provenance(cleaned: DataFrame, extracted_lines: DataFrame) -> DataFrame:
    """(doc_id, n_kept, n_same, n_prefix): kept paragraphs, and how many are, or begin like, the extracted one that they come from."""
    k = cleaned.select("doc_id", "paragraphs", "original_indices").distinct().select("doc_id", F.explode(F.arrays_zip("paragraphs", "original_indices")).alias("x")).select("doc_id", F.col("x.paragraphs").alias("kept"), F.col("x.original_indices").alias("line_idx"))
    j = k.join(extracted_lines, ["doc_id", "line_idx"], "left")
    same = F.coalesce(F.col("kept") == F.col("text"), F.lit(False))
    begins = F.coalesce(F.left("kept", F.lit(20)) == F.left("text", F.lit(20)), F.lit(False))
    return j.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.count_if(same).alias("n_same"), F.count_if(begins).alias("n_prefix"))


def overlay(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(run_id, place, before, after): the paragraphs of a run with the lines of its last version laid over them in order; lines without a paragraph are dropped."""
    w = Window.partitionBy("run_id").orderBy("line_idx")
    rows = lines.filter("kind = 'p'").select("run_id", F.row_number().over(w).alias("place"), F.col("text").alias("after"))
    return paragraphs.select("run_id", (F.col("line_idx") + 1).alias("place"), F.col("text").alias("before")).join(rows, ["run_id", "place"])


def free_zone(lines: DataFrame) -> DataFrame:
    """(run_id, version_no, line_id, place): the lines in the order of the page, those without a section first, each in its own order."""
    slot = F.coalesce("slot", F.lit(0))
    w = Window.partitionBy("run_id", "version_no").orderBy(F.when(slot == 0, 0).otherwise(1), slot, "line_idx", "line_id")
    return lines.select("run_id", "version_no", "line_id", F.row_number().over(w).alias("place"))


def newer_of(lines: DataFrame) -> DataFrame:
    """(run_id, chosen, newer): of the last two versions of a run the one that was changed last, of equal ones the higher, and whether that is the last."""
    v = lines.groupBy("run_id", "version_no").agg(F.max("modified_at").alias("at"))
    two = v.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("version_no")))).filter("n <= 2")
    best = F.max_by("version_no", F.struct("at", "version_no"))
    return two.groupBy("run_id").agg(best.alias("chosen"), (best == F.max("version_no")).alias("newer"))


def chunk_candidates(chunks: DataFrame, assignments: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, early, late): chunks that a search may give: of at least 30 characters, no line of contents or footnote, and not reserved by an assignment
    of their paragraph; with the boost of their place for the sections at the beginning (5 to 9) and at the end (12 to 14)."""
    c = chunks.filter("text is not null and source_idx is not null").select("doc_id", "chunk_id", "source_idx", "text").distinct()
    place = F.col("source_idx") / F.greatest(F.max("source_idx").over(Window.partitionBy("doc_id")), F.lit(1))
    c = c.withColumn("pos", place).filter((F.length(T.strip(F.col("text"))) >= 30) & ~F.col("text").rlike(T.CONTENTS_LINE) & ~((F.length("text") >= 50) & F.col("text").rlike(T.FOOTNOTE)))
    reserved = assignments.filter("source_idx is not null").select("doc_id", "source_idx").distinct()
    left = c.join(reserved, ["doc_id", "source_idx"], "left_anti")
    return left.select("doc_id", "chunk_id", F.round(0.1 * (1 - F.col("pos")), 6).alias("early"), F.round(0.1 * F.col("pos"), 6).alias("late"))


def bindings(slots: DataFrame, assignments: DataFrame) -> DataFrame:
    """(doc_id, slot_id, text, bound): the text of a section, or what an assignment binds to it in its place; of several the best score, then the first chunk."""
    a = assignments.filter("chunk_text is not null").groupBy("doc_id", "slot_id").agg(F.max_by("chunk_text", F.struct(F.coalesce("score", F.lit(-1.0)), -F.coalesce("chunk_id", F.lit(0)), "chunk_text")).alias("bound_text"))
    s = slots.select("doc_id", "slot_id", F.array_join("content_paragraphs", "\n").alias("own")).distinct().groupBy("doc_id", "slot_id").agg(F.max("own").alias("own"))
    return s.join(a, ["doc_id", "slot_id"], "left").select("doc_id", "slot_id", F.coalesce("bound_text", "own").alias("text"), F.col("bound_text").isNotNull().alias("bound"))
