"""Labelled fields: label lookup, values of documents, their shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import LABELS, TYPE_WORDS, label_rows

MISSING = "[Missing]"


def label_table(spark: SparkSession) -> DataFrame:
    """(norm, label, ord): each normalised spelling with the first label that has it."""
    rows = spark.createDataFrame(label_rows(), "label string, spelling string, ord int").withColumn("norm", T.label_key(F.col("spelling")))
    return rows.groupBy("norm").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))


def labelled_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, raw_label, value) of lines that begin with up to 40 characters and a colon or a tab."""
    c = T.strip(F.col("text"))
    out = lines.select("doc_id", "line_idx", T.strip(F.regexp_extract(c, r"^([^:\t\n]{2,40})\s*[:\t]", 1)).alias("raw_label"), T.strip(F.regexp_extract(c, r"^[^:\t\n]{2,40}\s*[:\t]([^\n]*)", 1)).alias("value"))
    return out.filter("raw_label <> ''")


def canonical(spark: SparkSession, labelled: DataFrame) -> DataFrame:
    """Labelled lines with their canonical ``label``: that of the same spelling, else of the longest spelling of at least four letters that begins it, else null.

    The prefix case takes the longest spelling by one pattern of all, longest first.
    """
    dim = label_table(spark)
    keyed = labelled.withColumn("norm", T.label_key(F.col("raw_label")))
    # The dictionary has a fixed number of spellings, so it is looked up as one literal map in each row: no shuffle, no hot key.
    known = {r.norm: r.label for r in dim.collect()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    prefixes = "|".join(sorted((k for k in known if len(k) >= 4), key=lambda k: (-len(k), k)))
    at = lambda k: F.try_element_at(table, k)
    by_prefix = at(F.regexp_extract("norm", f"^({prefixes})", 1))
    label = F.when(F.col("norm") != "", F.coalesce(at(F.col("norm")), by_prefix))
    return keyed.select("doc_id", "line_idx", "raw_label", label.alias("label"), "value")


def field_values(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, label, value): the first value that isn't empty of each label of a document."""
    c = canonical(spark, labelled_lines(lines)).filter("label is not null and value <> ''")
    return c.groupBy("doc_id", "label").agg(F.min_by("value", "line_idx").alias("value"))


def label_rows_filled(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, label, value): every label of every document, with a placeholder where the document has none."""
    every = lines.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    return every.join(field_values(spark, lines), ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce("value", F.lit(MISSING)).alias("value"))


def shape(c: Column) -> Column:
    """date, department, person, reference or text, the first that fits."""
    return F.when(c.rlike(T.DATE), "date").when(c.rlike(T.DEPARTMENT), "department").when(c.rlike(T.PERSON), "person").when(c.rlike(T.REFERENCE) & c.rlike(r"\d"), "reference").otherwise("text")


def type_word(c: Column) -> Column:
    """The longest of the last three, two or one words that names a type of document."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z\- ]+", " ")), r"\s+")
    known = list(TYPE_WORDS)
    last = lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " "))
    return F.coalesce(*[F.when(last(n).isin(known), last(n)) for n in (3, 2, 1)])


def multi_values(c: Column) -> Column:
    """The values of a list written with commas, semicolons, and, &."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\s+and\s+", ","), r"\s+&\s+", ",")
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,;]"), T.strip), lambda x: F.length(x) > 0))


def alternating_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, label, value): lines that are only a label, with the next line as value if that is none itself."""
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    s = lines.select("doc_id", "line_idx", T.strip(F.col("text")).alias("s")).filter("length(s) > 0")
    only = F.col("s").rlike(r"^[^:\t.]{2,40}:$")
    after = F.lead("s").over(w)
    return s.withColumn("value", after).filter(only & F.col("value").isNotNull() & ~F.col("value").rlike(r"^[^:\t.]{2,40}:$")).select("doc_id", "line_idx", F.regexp_replace("s", ":$", "").alias("label"), "value")
