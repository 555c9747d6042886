"""Documents as lines, cleaning of lines with reasons, and re-segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import NAME_STOPWORDS


def latest(docs: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last delivery of each key; equal ones are told apart by the further columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return docs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_idx, text) of the last delivery of each document. Null and empty lists give no line, null lines are kept."""
    newest = F.max_by("paragraphs", F.struct(F.col("extracted_at").isNotNull(), "extracted_at", F.col("run_id").isNotNull(), "run_id")).alias("paragraphs")
    return docs.groupBy("doc_id").agg(newest).select("doc_id", F.posexplode("paragraphs").alias("line_idx", "text"))


def is_proper_name(c: Column) -> Column:
    s = T.strip(c)
    words = F.split(F.lower(s), r"\s+")
    return s.rlike(T.PROPER_NAME) & (F.length(s) <= 60) & ~F.arrays_overlap(words, F.array(*map(F.lit, NAME_STOPWORDS)))


def clean(lines: DataFrame, threshold: int = 3) -> DataFrame:
    """The lines with ``reason``: null for kept lines, blank ones among them, else the first rule that applies.

    Rules in order: page_number, version_page_noise, header_repeat (a trimmed line of at most 120 characters, no personal name, that stands
    at least ``threshold`` times in its document), garbled. Null lines are kept.
    """
    s = T.strip(F.col("text"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_s")) >= threshold
    out = lines.withColumn("_s", s).withColumn("_repeated", repeated & (F.length("_s") <= 120) & ~is_proper_name(F.col("text")))
    reason = (
        F.when(F.length(F.coalesce("_s", F.lit(""))) == 0, None)
        .when(F.col("text").rlike(T.PAGE_NUMBER), "page_number")
        .when(F.col("text").rlike(T.NOISE), "version_page_noise")
        .when(F.col("_repeated"), "header_repeat")
        .when(T.garbled(F.col("text")), "garbled")
    )
    return out.withColumn("reason", reason).drop("_s", "_repeated")


def repeated_lines(lines: DataFrame, threshold: int = 3) -> DataFrame:
    """(doc_id, line, n) of the lines that stand at least ``threshold`` times in a document."""
    s = lines.select("doc_id", T.strip(F.col("text")).alias("line")).filter("length(line) between 1 and 120")
    return s.filter(~is_proper_name(F.col("line"))).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)


def join_lines(lines: DataFrame) -> DataFrame:
    """Lines that go on in the next one are joined: the line before has no end mark and the next begins with a small letter."""
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    s = lines.withColumn("s", T.strip(F.col("text"))).filter("length(s) > 0")
    before = F.lag("s").over(w)
    goes_on = before.isNotNull() & ~before.rlike(r"[.!?;:]$") & F.col("s").rlike(r"^\p{Ll}")
    s = s.withColumn("part", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "s"))), lambda x: x["s"]), " ")
    return s.groupBy("doc_id", "part").agg(F.min("line_idx").alias("line_idx"), F.count("*").alias("n_lines"), joined.alias("text")).drop("part")


def bullets(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each bullet of a text of several lines: ``item_idx`` and ``item``; lines without a marker go on with the item before."""
    marked = F.regexp_replace(F.regexp_replace(T.strip(F.col(text)), r"\s*\n\s*", "\n"), rf"(^|\n)[{T.BULLETS}]\s*", "\x01")
    parts = F.filter(F.split(F.regexp_replace(marked, "\n", " "), "\x01"), lambda x: F.length(F.trim(x)) > 0)
    return df.select("*", F.posexplode(parts).alias("item_idx", "_item")).withColumn("item", F.trim("_item")).drop("_item")


def sentence_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each sentence: ``sentence_idx`` and ``sentence``."""
    return df.select("*", F.posexplode(T.sentences(T.normalize(F.col(text)))).alias("sentence_idx", "sentence")).filter("length(sentence) > 0")


def pack(pieces: Column, target: int) -> Column:
    """Pieces packed greedily to texts of at most ``target`` characters, a longer piece being one of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, x: Column) -> Column:
        fits = (F.length(acc["cur"]) == 0) | (F.length(acc["cur"]) + F.length(x) + 1 <= target)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(F.length(acc["cur"]) == 0, x).when(fits, F.concat(acc["cur"], F.lit(" "), x)).otherwise(x).alias("cur"),
        )

    return F.aggregate(pieces, empty, add, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["cur"])), lambda x: F.length(x) > 0))


def chunk_lines(lines: DataFrame, target: int = 300, overlap: int = 50) -> DataFrame:
    """(doc_id, para_idx, bullet_idx, piece_idx, chunk_id, text): bullets, then sentences (words where there is one sentence) packed to the target size,
    each piece after the first with the tail of the one before it."""
    items = bullets(lines.filter("length(trim(text)) > 0"))
    item = T.normalize(F.col("item"))
    split = T.sentences(item)
    pieces = F.when(F.length(item) <= target, F.array(item)).otherwise(pack(F.when(F.size(split) > 1, split).otherwise(F.split(item, " ")), target))
    rows = items.select("doc_id", F.col("line_idx").alias("para_idx"), F.col("item_idx").alias("bullet_idx"), F.posexplode(pieces).alias("piece_idx", "piece"))
    before = F.lag("piece").over(Window.partitionBy("doc_id", "para_idx", "bullet_idx").orderBy("piece_idx"))
    tail = F.when(F.length(before) > overlap, F.concat(F.ltrim(F.right(before, F.lit(overlap))), F.lit(" "), F.col("piece"))).otherwise(F.col("piece"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", "bullet_idx", "piece_idx")) - 1
    return rows.select("doc_id", "para_idx", "bullet_idx", "piece_idx", number.alias("chunk_id"), tail.alias("text"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text) of texts split at blank lines."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), T.strip), lambda x: F.length(x) > 0)
    return docs.select("doc_id", F.posexplode(parts).alias("para_idx", "text"))


def predicates(lines: DataFrame) -> DataFrame:
    """For each document how many lines look like which kind."""
    c, s = F.col("text"), T.strip(F.col("text"))
    kinds = {
        "n_page_number": c.rlike(T.PAGE_NUMBER),
        "n_title": (F.length(s).between(1, 80)) & ~s.contains(":") & ~(s.endswith(".") & (F.length(s) > 30)),
        "n_footnote": (F.length(s) >= 50) & s.rlike(T.FOOTNOTE),
        "n_contents": c.rlike(T.CONTENTS_LINE),
        "n_boundary": c.rlike(T.BOUNDARY),
        "n_heading_like": (F.length(s).between(1, 60)) | s.rlike(":|–| - "),
        "n_unfinished": c.rlike(T.UNFINISHED),
        "n_cut": (F.length(s) >= 30) & s.contains(" ") & s.rlike(T.CUT_LINE),
        "n_proper_name": is_proper_name(c),
    }
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in kinds.items()])


def titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title, score): the line that looks most like a title, the first of equal ones."""
    s, pos = T.strip(F.col("text")), F.col("line_idx")
    score = F.length(s) + F.when((s == F.upper(s)) & s.rlike("[A-Za-z]"), 60).otherwise(0) - F.when(F.length(s) > 120, 80).otherwise(0) + F.when(pos < 3, 100).when(pos < 6, 50).otherwise(-5 * pos)
    candidates = lines.filter(F.length(s).between(8, 200) & ~s.contains(":") & ~s.rlike(rf"^[{T.BULLETS}]") & s.rlike(r"\p{L}")).select("doc_id", "line_idx", s.alias("title"), score.cast("bigint").alias("score"))
    return candidates.groupBy("doc_id").agg(F.max_by(F.struct("title", "score"), F.struct("score", -F.col("line_idx"))).alias("x")).select("doc_id", "x.*")
