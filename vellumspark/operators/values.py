"""Values of labels: what shape they have, whether a label may have them, and how they are cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import PHRASE_STARTS, REVIEW_CYCLES, ROLE_WORDS, SECTION_MARKERS, TITLE_STARTS, TYPE_WORDS, VERBS
from .fields import canonical, labelled_lines

# Dates without a day, and values that begin with a version.
PARTIAL_DATE = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b|\bQ[1-4]\s+\d{4}\b|\b\d{4}\b|\b(?:H[12]|FY)\s*\d{2,4}\b"
VERSION_FIRST = r"(?i)^v?\d+(\.\d+)*(\s|$)"


def trimmed_end(c: Column) -> Column:
    """Without the marks . , ; : and blanks at the end."""
    return F.regexp_replace(T.strip(c), r"[.,;:]+\s*$", "")


def first_word(c: Column) -> Column:
    return F.lower(F.element_at(F.split(T.strip(c), r"\s+"), 1))


def is_noun_phrase(c: Column) -> Column:
    """At least two characters with a letter; no colon, line break, leading digit, inner stop or small word at its small-letter start."""
    v = F.regexp_replace(T.strip(c), r"\s*\.$", "")
    return (F.length(v) >= 2) & ~v.rlike(r"[:\n.]") & ~v.rlike(r"^\p{Nd}") & v.rlike(r"\p{L}") & ~(v.rlike(r"^\p{Ll}") & first_word(v).isin(list(PHRASE_STARTS)))


def has_verb(c: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, VERBS)))


def has_section_marker(c: Column) -> Column:
    return F.lower(c).rlike(r"\b(" + "|".join(SECTION_MARKERS) + r")\b")


def is_role(c: Column) -> Column:
    """Whether the last word is that of an office."""
    v = F.regexp_replace(T.strip(c), r"[.,;:]+$", "")
    return F.regexp_replace(F.lower(F.element_at(F.split(v, r"\s+"), -1)), r"[.,;:]+$", "").isin(list(ROLE_WORDS))


def is_replaced(c: Column) -> Column:
    """Whether a text may name a replaced document: a reference, date or version, or a title that doesn't begin with a small word."""
    v = T.strip(c)
    return (v != "") & ~v.contains("\n") & (v.rlike(T.REFERENCE) | v.rlike(T.DATE) | v.rlike(VERSION_FIRST) | ~first_word(v).isin(list(TITLE_STARTS)))


def parts(c: Column) -> Column:
    """The parts of a list written with commas, semicolons, and, &, in order, equal ones too."""
    c = F.regexp_replace(F.regexp_replace(T.strip(c), r"(?i)\s+and\s+", ","), r"\s+&\s+", ",")
    return F.filter(F.transform(F.split(c, "[,;]"), T.strip), lambda x: F.length(x) > 0)


def kept(c: Column, rule) -> Column:
    """The parts that a rule accepts, joined by commas; null for none."""
    good = F.filter(parts(c), rule)
    return F.when(F.size(good) > 0, F.array_join(good, ", "))


def classification(c: Column) -> Column:
    """The type of document that a value names: all of it, or its last three, two or one words; else a single noun."""
    v = F.regexp_replace(T.strip(c), r"[.,;:]+$", "")
    words = F.split(v, r"\s+")
    last = lambda n: F.array_join(F.slice(words, -n, n), " ")
    known = [F.when((F.size(words) >= n) & (F.size(words) <= 8) & F.lower(last(n)).isin(list(TYPE_WORDS)), F.concat(F.upper(F.left(last(n), F.lit(1))), F.substr(last(n), F.lit(2)))) for n in (3, 2, 1)]
    return F.when(F.lower(v).isin(list(TYPE_WORDS)), v).otherwise(F.coalesce(*known, F.when((F.size(words) == 1) & is_noun_phrase(v), v)))


def checked_value(label: Column, raw: Column) -> Column:
    """The cleaned value if the label may have it, else null. Null and blank values are null."""
    v = T.strip(raw)
    title = F.when(~v.contains(":") & ~has_section_marker(v) & (F.length(v) >= 4) & v.rlike(r"\p{L}"), F.left(v, F.lit(200)))
    only_heading = v.endswith(":") & (F.size(F.split(v, r"\s+")) <= 4)
    bare = T.strip(F.regexp_replace(F.regexp_replace(v, r"^\"([\s\S]*)\"$", "$1"), r"^'([\s\S]*)'$", "$1"))
    replaced_list = F.filter(F.filter(F.transform(F.split(bare, ";"), T.strip), lambda x: x != ""), is_replaced)
    replaced = F.when(v.contains("\n"), None).when(bare.contains(";"), F.when(F.size(replaced_list) > 0, F.array_join(replaced_list, "; "))).when(is_replaced(bare), bare)
    phrase = lambda x: is_noun_phrase(x) & ~has_verb(x)
    officer = lambda x: ~has_verb(x) & (x.rlike(T.PERSON) | is_role(x) | x.rlike(T.DEPARTMENT) | is_noun_phrase(x))
    reviewed = F.when(v.rlike(T.DATE) | v.rlike(PARTIAL_DATE) | F.regexp_replace(F.lower(v), r"[.,;:]+$", "").isin(list(REVIEW_CYCLES)), v)
    sectors = F.when(v.contains("&") & ~v.contains(","), F.array_join(parts(v), " & ")).otherwise(F.array_join(parts(v), ", "))
    out = (
        F.when(label == "Type:", F.when(~has_verb(v), classification(v))).when(label.isin("Functional Area(s):", "Responsible Function(s):", "Applies to:"), kept(v, phrase))
        .when(label == "Brief Description:", F.when(~only_heading, F.left(v, F.lit(500)))).when(label == "Reason for Policy:", F.when(~only_heading, F.left(v, F.lit(1000))))
        .when(label == "Policy Title:", title).when(label == "Last Reviewed:", reviewed).when(label == "Supersedes:", replaced).when(label == "Responsible Function Officer(s):", kept(v, officer))
        .when(label == "Applicable Sector(s):", F.nullif(sectors, F.lit(""))).when(label.isin("Approved by:", "Prepared by:"), F.left(v, F.lit(200))).otherwise(F.left(v, F.lit(500)))
    )
    return F.when(F.length(v) > 0, out)


def valid_values(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc_id, label, value): the first value of each label of a document that the label may have, cleaned."""
    c = canonical(spark, labelled_lines(lines)).filter("label is not null").withColumn("value", checked_value(F.col("label"), F.col("value"))).filter("value is not null")
    return c.groupBy("doc_id", "label").agg(F.min_by("value", "line_idx").alias("value"))


def compare_key(c: Column) -> Column:
    """Small letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def without_prefix(c: Column) -> Column:
    """A title without one to four capitalised words and a dash or colon before it."""
    v = T.strip(c)
    rest = F.regexp_extract(v, r"^[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,3}\s*[–—:-]\s+(\S.*)$", 1)
    return F.when(rest == "", v).otherwise(rest)


def refined(values: DataFrame) -> DataFrame:
    """(doc_id, label, value, changed): values set right against each other in one row a document.

    Parts of who a document applies to that are its functional areas or responsible functions are taken out, and so is a title's prefix; a description that says
    the same as the title is dropped. ``changed`` says whether a rule did anything.
    """
    labels = ("Applies to:", "Functional Area(s):", "Responsible Function(s):", "Policy Title:", "Brief Description:")
    w = Window.partitionBy("doc_id")
    of = {x: F.max(F.when(F.col("label") == x, F.col("value"))).over(w) for x in labels}
    owners = F.transform(F.concat(F.coalesce(parts(of[labels[1]]), F.array().cast("array<string>")), F.coalesce(parts(of[labels[2]]), F.array().cast("array<string>"))), compare_key)
    v = values.withColumn("owners", owners).withColumn("title", of["Policy Title:"])
    left = F.filter(parts(F.col("value")), lambda x: ~F.array_contains(F.col("owners"), compare_key(x)))
    new = (
        F.when(F.col("label") == "Applies to:", F.when(F.size(left) > 0, F.array_join(left, ", "))).when(F.col("label") == "Policy Title:", without_prefix(F.col("value")))
        .when((F.col("label") == "Brief Description:") & (compare_key(F.col("value")) == compare_key(F.col("title"))), None).otherwise(F.col("value"))
    )
    return v.withColumn("new", new).select("doc_id", "label", F.col("new").alias("value"), (~F.col("value").eqNullSafe(F.col("new"))).alias("changed"))


def split_label(c: Column) -> tuple[Column, Column]:
    """What stands before and after the first colon or tab; all of it and null without one."""
    at = F.regexp_extract(c, r"^([^:\t]*)[:\t]", 1)
    has = c.rlike(r"[:\t]")
    return T.strip(F.when(has, at).otherwise(c)), F.when(has, T.strip(F.regexp_replace(c, r"^[^:\t]*[:\t]", "")))


def clean_tail(c: Column) -> Column:
    """A line of a label and a value without lost characters, dashes and closing brackets at its end; other lines stay."""
    s = T.strip(c)
    pattern = r"^([A-Za-z][A-Za-z0-9 ()/&.,'\-_]*?)\s*:\s*([^\n]*)$"
    value = F.regexp_extract(s, pattern, 2)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[\x{FFFD}\x{E000}-\x{F8FF}]+$", ""), r"[–—\-)\]}]+\s*$", ""), r"\s+$", "")
    return F.when(s.rlike(pattern) & (F.instr(F.left(s, F.lit(80)), ":") > 0) & (clean != value), T.strip(F.concat(T.strip(F.regexp_extract(s, pattern, 1)), F.lit(": "), clean))).otherwise(c)


def department_phrases(lines: DataFrame) -> DataFrame:
    """(doc_id, phrase, n): runs of one to three capitalised words that end in the name of a unit."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"(?:\b[A-Z][a-z]+ ){0,2}\b(?:Department|Team|Division|Unit|Group|Office|Committee|Board|Branch|Desk)\b"), F.lit(0))
    return lines.select("doc_id", F.explode(found).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def missing_ratio(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(label, n_docs, n_missing, ratio) over all documents with a line."""
    docs = lines.select("doc_id").distinct()
    n = docs.agg(F.count("*").alias("n_docs"))
    by = valid_values(spark, lines).groupBy("label").agg(F.count("*").alias("n_found"))
    from ..functions.dictionaries import LABELS

    every = spark.createDataFrame([(x,) for x in LABELS], "label string").crossJoin(F.broadcast(n))  # one row a label
    found = F.coalesce("n_found", F.lit(0))
    return every.join(by, "label", "left").select("label", "n_docs", (F.col("n_docs") - found).alias("n_missing"), F.round((F.col("n_docs") - found) / F.col("n_docs"), 6).alias("ratio"))


def lost_values(cleaned: DataFrame) -> DataFrame:
    """(doc_id, index, text): dropped lines that may be a value that was lost: 1 to 200 characters, no label, no page number or noise, dropped under three times in the document."""
    d = cleaned.select("doc_id", F.explode("dropped").alias("d")).select("doc_id", F.col("d.index").alias("index"), T.strip(F.col("d.text")).alias("text")).distinct()
    n = F.count("*").over(Window.partitionBy("doc_id", "text"))
    return d.withColumn("n", n).filter(F.length("text").between(1, 200) & ~F.col("text").rlike(r":\s*$") & ~F.col("text").rlike(T.PAGE_NUMBER) & ~F.col("text").rlike(T.NOISE) & (F.col("n") < 3)).select("doc_id", "index", "text")
