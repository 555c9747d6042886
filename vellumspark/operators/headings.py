"""Which lines are headings: of a section, of any section, boundaries of sections; and headings apart from their text.

All rules are columns. The dictionary has a fixed number of headings, so those of a section are one pattern that a line is held against once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dictionaries import BARE_HEADINGS, HEADINGS, SENTENCE_WORDS

#: Sections that are found by a heading before them.
ANCHORED = (5, 6, 7, 8, 9, 10, 12, 13, 14)
# What may stand before a heading, and lines of one bracket that are no text of a section.
NUMBER = r"(?:\d+\.\s*|\d+\)\s*|[IVXivx]+\.\s*)?"
NUMBER_OR_SECTION = r"(?:\d+\.\s*|\d+\)\s*|[IVXivx]+\.\s*|[Ss][Ee][Cc][Tt][Ii][Oo][Nn]\s+\d+\s*:?\s*)?"
MARKER = (
    r"(?i)^\s*[\[(]\s*(?:english|burmese|myanmar|japanese|chinese|french|spanish|german|page\s+\d+|page\s+\d+\s+of\s+\d+|toc|table\s+of\s+contents"
    r"|continued|end\s+of\s+document|confidential|draft|internal\s+use)\s*[\])]\s*$"
)
NUMBERED = r"^(\d+\.\s+|\d+\)\s+|[IVX]+\.\s+)[A-Z]"
NUMBERED_TITLE = r"^\d+(\.\d+)*\.\s+[A-Z][A-Za-z\s\-&/]{0,50}\s*[:\-]\s*$"


def any_of(words: list[str]) -> str:
    """The words as a pattern, longest first."""
    return "(?:" + "|".join(re.sub(r"([.()&+*?\[\]])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def first_line(c: Column) -> Column:
    """The first line that isn't blank, without blanks at its ends; empty for none."""
    return T.strip(F.regexp_extract(c, r"^\s*(\S[^\n\r]*)", 1))


def is_contents(c: Column) -> Column:
    return c.rlike(T.CONTENTS_LINE)


def is_heading_of(c: Column, slot: int) -> Column:
    """Whether the first line is a heading of the section: alone, with a colon or dash, with a stop and at most 120 further characters, with a
    capitalised rest of under 60, or with a number after it in a line of at most 200. Lines of a table of contents are none."""
    first = first_line(c)
    begin = rf"^(?i:{NUMBER_OR_SECTION}{any_of(list(HEADINGS[slot]))})"
    found = first.rlike(rf"{begin}(?:$|[:\-\x{{FFFD}}]|\.(?:[:\-\x{{FFFD}}]|.{{0,120}}$)|\s(?:$|[:\-\x{{FFFD}}]|\p{{Lu}}.{{0,58}}$))") | (first.rlike(rf"{begin}\s[\d\s]") & (F.length(first) <= 200))
    if slot == 6:
        found = found | first.rlike(r"(?i)^policy\s*[:\-.\x{A9}\x{FFFD}]?\s*$")
    return F.coalesce(found & ~is_contents(c), F.lit(False))


def slots_of(c: Column) -> Column:
    """The sections that the line is a heading of."""
    return F.array_compact(F.array(*[F.when(is_heading_of(c, s), F.lit(s)) for s in ANCHORED]))


def reads_like_heading(c: Column) -> Column:
    s = T.strip(c)
    return (F.length(s) <= 60) | c.contains(":") | c.contains("–") | c.contains(" - ")


def is_section_start(c: Column) -> Column:
    """Whether a text begins like a section of any kind: a bare number, capitals, a numbered title, a known heading alone, or a short title above a longer text."""
    text = T.strip(c)
    first = T.strip(F.substring_index(text, "\n", 1))
    rest = T.strip(F.regexp_replace(text, r"^[^\n]*\n?", ""))
    words = F.split(F.lower(first), r"\s+")
    bare = F.regexp_replace(F.regexp_replace(first, r"[:.\-\x{FFFD}]+$", ""), r"\s+$", "")
    title = (
        F.length(first).between(3, 50) & (F.length(rest) > 3 * F.length(first)) & first.rlike(r"^\p{Lu}") & ~first.contains(":") & ~first.endswith(".")
        & (F.size(F.filter(words, lambda w: w.isin(list(SENTENCE_WORDS)))) <= 1) & (F.size(words) <= 8)
    )
    long = first.rlike(r"^[A-Z][A-Z][A-Z][A-Z\s]*$") | first.rlike(NUMBERED) | (F.lower(bare).isin(list(BARE_HEADINGS)) & ~first.contains(":")) | first.rlike(NUMBERED_TITLE) | title
    return F.coalesce(first.rlike(r"^\d+\.\s*$") | ((F.length(first) >= 3) & long), F.lit(False))


def is_boundary(c: Column) -> Column:
    """Whether a text ends the section before it: a numbered line, a line of capitals, a known heading, or the start of any section."""
    first = first_line(c)
    known = rf"^{NUMBER}(?i:{any_of([w for ws in HEADINGS.values() for w in ws])})"
    found = (
        first.rlike(r"^(\d+\.|\d+\)|[IVXivx]+\.)\s+[A-Za-z]") | first.rlike(r"^[A-Z][A-Z][A-Z][A-Z\s]{3,}\s*[:\-.\x{FFFD}]?\s*$")
        | first.rlike(rf"{known}(?:[:\-.\x{{FFFD}}]|$)") | (first.rlike(rf"{known}\s") & reads_like_heading(first))
    )
    return F.coalesce((first != "") & ~is_contents(c) & (found | is_section_start(c)), F.lit(False))


def without_heading(c: Column, slot: int) -> Column:
    """The text without the heading of the section before it; a text that is only the heading stays."""
    rest = F.regexp_extract(c, rf"(?s)^\s*(?i:{NUMBER_OR_SECTION}{any_of(list(HEADINGS[slot]))})\s*[:\-.\x{{FFFD}}]\s*(\S.*)$", 1)
    return F.when(F.lower(T.strip(c)).isin(list(HEADINGS[slot])) | (rest == ""), c).otherwise(rest)


def inline_body(c: Column, slot: int) -> Column:
    """What stands after the heading in its line: after a colon, or at most 100 characters after a stop, or after a dash if it doesn't look like a heading; else empty."""
    text = T.strip(c)
    head = rf"(?s)^(?i:{any_of(list(HEADINGS[slot]))})"
    colon, stop, dash = (F.regexp_extract(text, rf"{head}{sep}\s*(\S.*)$", 1) for sep in (":", r"\.", " - "))
    short = lambda x: F.when((x != "") & (F.length(x) <= 100), x)
    dashed = F.when(~((F.length(dash) <= 60) & dash.rlike(r"^\p{Lu}")), short(dash))
    return F.when(F.lower(text).isin(list(HEADINGS[slot])), "").otherwise(F.coalesce(F.nullif(colon, F.lit("")), short(stop), dashed, F.lit("")))


def heading_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, slot_id): each section that a line is a heading of."""
    return lines.select("doc_id", "line_idx", F.explode(slots_of(F.col("text"))).alias("slot_id"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """For each document the lines that begin a section, end one, or are only a marker. Null lines are none of these."""
    c = F.col("text")
    none = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return lines.groupBy("doc_id").agg(none(is_section_start(c)).alias("n_starts"), none(is_boundary(c)).alias("n_boundaries"), none(c.rlike(MARKER)).alias("n_markers"), none(is_contents(c)).alias("n_contents"))


def heading_bodies(lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, slot_id, body, inline): headings with their text by the looser and the stricter rule."""
    found = heading_lines(lines).join(lines, ["doc_id", "line_idx"])
    by = lambda f: F.coalesce(*[F.when(F.col("slot_id") == s, f(F.col("text"), s)) for s in ANCHORED])
    return found.select("doc_id", "line_idx", "slot_id", by(without_heading).alias("body"), by(inline_body).alias("inline"))


def intro_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, text): the first line of prose before the first heading of a section; prose has at least 40 characters and ends in a stop."""
    c = F.col("text")
    kinds = lines.select("doc_id", "line_idx", "text", (F.size(slots_of(c)) > 0).alias("head"), ((F.length(T.strip(c)) >= 40) & T.strip(c).rlike(r"[.!?]$") & ~is_section_start(c)).alias("prose"))
    first = kinds.groupBy("doc_id").agg(F.min(F.when(F.col("head"), F.col("line_idx"))).alias("head_idx"), F.min(F.when(F.col("prose") & ~F.col("head"), F.struct("line_idx", "text"))).alias("x"))
    return first.filter("x is not null and (head_idx is null or x.line_idx < head_idx)").select("doc_id", "x.line_idx", "x.text")
