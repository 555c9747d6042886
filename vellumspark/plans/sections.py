"""Queries of headings and sections; their oracles join the dictionary where the operators hold a pattern against each line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..operators import headings
from .registry import LINES, STRIP, doc_lines, query, sql_text, values

big = lambda *names: {n: F.col(n).cast("bigint") for n in names}
FIRST = STRIP.format(r"regexp_extract(text, '^\s*(\S[^\n\r]*)', 1)")
DICT = f"dict AS (SELECT * FROM {values([(s, w) for s, ws in D.HEADINGS.items() for w in ws])} AS t(slot_id, word))"
HEADS = rf"""{LINES}, {DICT}, fl AS (SELECT doc_id, line_idx, text, {FIRST} AS first FROM lines WHERE NOT regexp_matches(text, '\.{{4,}}\s*\d+\s*$')),
    begun AS (SELECT *, first AS body FROM fl UNION SELECT *, regexp_replace(first, '^(\d+\.\s*|\d+\)\s*|[IVXivx]+\.\s*|(?i:section)\s+\d+\s*:?\s*)', '') FROM fl),
    cand AS (SELECT doc_id, line_idx, text, first, slot_id, substr(body, length(word) + 1, 1) AS sep, substr(body, length(word) + 2) AS rest FROM begun JOIN dict ON starts_with(lower(body), word)),
    heads AS (SELECT DISTINCT doc_id, line_idx, slot_id, text FROM (SELECT * FROM cand WHERE slot_id IN (5, 6, 7, 8, 9, 10, 12, 13, 14) AND (sep IN ('', ':', '-', chr(65533)) OR (sep IN ('.', ' ') AND (rest = '' OR rest[1] IN (':', '-', chr(65533))))
      OR (sep = '.' AND length(rest) <= 120) OR (sep = ' ' AND regexp_matches(rest, '^\p{{Lu}}') AND length(rest) < 60) OR (sep = ' ' AND regexp_matches(rest, '^[\d\s]') AND length(first) <= 200))
      UNION ALL SELECT doc_id, line_idx, text, first, 6, '', '' FROM fl WHERE regexp_matches(first, '(?i)^policy\s*[:\-.\x{{A9}}\x{{FFFD}}]?\s*$')))"""


@query(f"WITH {HEADS} SELECT doc_id, line_idx, slot_id FROM heads")
def slot_headings(spark, d):
    """Lines that are a heading of a section by the whole rule, with what follows the heading."""
    return headings.heading_lines(doc_lines(spark, d)).withColumns(big("line_idx"))


START = rf"""{LINES}, st AS (SELECT doc_id, line_idx, text, {STRIP.format('text')} AS t FROM lines), s2 AS (SELECT *, {STRIP.format("split_part(t, chr(10), 1)")} AS first, {STRIP.format("CASE WHEN contains(t, chr(10)) THEN substr(t, instr(t, chr(10)) + 1) ELSE '' END")} AS rest FROM st),
    s3 AS (SELECT *, string_split_regex(lower(first), '\s+') AS ws FROM s2), s4 AS (SELECT *, coalesce(regexp_matches(first, '^\d+\.\s*$') OR (length(first) >= 3 AND (regexp_matches(first, '^[A-Z][A-Z][A-Z][A-Z\s]*$')
      OR regexp_matches(first, '^(\d+\.\s+|\d+\)\s+|[IVX]+\.\s+)[A-Z]') OR (lower(rtrim(rtrim(first, ':.-' || chr(65533)))) IN ({', '.join(map(sql_text, D.BARE_HEADINGS))}) AND NOT contains(first, ':'))
      OR regexp_matches(first, '^\d+(\.\d+)*\.\s+[A-Z][A-Za-z\s\-&/]{{0,50}}\s*[:\-]\s*$') OR (length(first) BETWEEN 3 AND 50 AND length(rest) > 3 * length(first) AND regexp_matches(first, '^\p{{Lu}}') AND NOT contains(first, ':') AND NOT suffix(first, '.')
      AND len(list_filter(ws, lambda w: w IN ('is', 'are', 'was', 'were', 'has', 'have', 'had', 'will', 'would', 'should', 'could', 'may', 'might', 'must', 'can', 'the', 'a', 'an'))) <= 1 AND len(ws) <= 8))), false) AS begins FROM s3)"""


@query(rf"""WITH {START}, {DICT}, fl AS (SELECT *, {FIRST} AS line FROM s4), words AS (SELECT doc_id, line_idx, bool_or(sep IN ('', ':', '-', '.', chr(65533)) OR (sep IN (' ', chr(9)) AND (length(line) <= 60 OR contains(line, ':') OR contains(line, '–') OR contains(line, ' - ')))) AS hit
      FROM (SELECT DISTINCT doc_id, line_idx, line, word, substr(body, length(word) + 1, 1) AS sep FROM (SELECT *, line AS body FROM fl UNION SELECT *, regexp_replace(line, '^(\d+\.\s*|\d+\)\s*|[IVXivx]+\.\s*)', '') FROM fl) JOIN dict ON starts_with(lower(body), word)) GROUP BY 1, 2),
    b AS (SELECT fl.*, line <> '' AND NOT regexp_matches(text, '\.{{4,}}\s*\d+\s*$') AND (coalesce(hit, false) OR begins OR regexp_matches(line, '^(\d+\.|\d+\)|[IVXivx]+\.)\s+[A-Za-z]') OR regexp_matches(line, '^[A-Z][A-Z][A-Z][A-Z\s]{{3,}}\s*[:\-.\x{{FFFD}}]?\s*$')) AS ends FROM fl LEFT JOIN words USING (doc_id, line_idx))
    SELECT doc_id, count_if(begins) AS n_starts, count_if(ends) AS n_boundaries, count_if(regexp_matches(text, '(?i)^\s*[\[(]\s*(english|burmese|myanmar|japanese|chinese|french|spanish|german|page\s+\d+|page\s+\d+\s+of\s+\d+|toc|table\s+of\s+contents|continued|end\s+of\s+document|confidential|draft|internal\s+use)\s*[\])]\s*$')) AS n_markers,
      count_if(regexp_matches(text, '\.{{4,}}\s*\d+\s*$')) AS n_contents FROM b GROUP BY 1""")
def section_starts(spark, d):
    """How many lines of each document begin a section of any kind, end one, are markers, or belong to a table of contents."""
    return headings.line_kinds(doc_lines(spark, d))


@query(rf"""WITH {HEADS}, w AS (SELECT h.doc_id, h.line_idx, h.slot_id, h.text, max(length(word)) FILTER (starts_with(lower({STRIP.format('text')}), word) AND substr({STRIP.format('text')}, length(word) + 1, 1) = ':') AS colon, bool_or(lower({STRIP.format('text')}) = word) AS alone
      FROM heads h JOIN dict USING (slot_id) GROUP BY ALL) SELECT doc_id, line_idx, slot_id, {STRIP.format(f"substr({STRIP.format('text')}, colon + 2)")} AS body FROM w WHERE colon IS NOT NULL AND NOT alone AND {STRIP.format(f"substr({STRIP.format('text')}, colon + 2)")} <> ''""")
def heading_colon_bodies(spark, d):
    """The text after a heading and its colon; both rules give the same there."""
    c = headings.heading_bodies(doc_lines(spark, d)).join(doc_lines(spark, d), ["doc_id", "line_idx"])
    alike = [(F.col("slot_id") == s) & F.col("text").rlike(rf"^\s*(?i:{headings.any_of(list(D.HEADINGS[s]))}):\s*\S") for s in headings.ANCHORED]
    both = alike[0]
    for x in alike[1:]:
        both = both | x
    return c.filter(both & (F.rtrim("body") == F.rtrim("inline"))).select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), "slot_id", F.rtrim("body").alias("body"))


@query(rf"""WITH {HEADS}, {START.replace(LINES + ', ', '', 1)}, k AS (SELECT s4.doc_id, s4.line_idx, s4.text, h.doc_id IS NOT NULL AS head, length(t) >= 40 AND regexp_matches(t, '[.!?]$') AND NOT begins AS prose FROM s4 LEFT JOIN (SELECT DISTINCT doc_id, line_idx FROM heads) h USING (doc_id, line_idx)),
    f AS (SELECT doc_id, min(line_idx) FILTER (head) AS h, min(line_idx) FILTER (prose AND NOT head) AS p FROM k GROUP BY 1) SELECT doc_id, line_idx, text FROM k JOIN f USING (doc_id) WHERE line_idx = p AND (h IS NULL OR p < h)""")
def intro_paragraph(spark, d):
    """The first prose of a document before its first heading."""
    return headings.intro_paragraphs(doc_lines(spark, d)).withColumns(big("line_idx"))


GUARDS = {14: r"(?i)^(version|revision|document|amendment|change)\s+(history|log)|^(?i:history|changelog)\b", 9: r"(?i)^(exclusions?|exceptions?|limitations?)\b", 13: r"(?i)^(related|references|see also)\b", 5: r"(?i)^(introduction|preamble)\b", 6: r"(?i)^(policy statement|statement of policy)\b"}


@query(rf"WITH {LINES} SELECT doc_id, " + ", ".join(f"coalesce(bool_or(regexp_matches({FIRST}, {sql_text(p)})), false) AS has_{s}" for s, p in GUARDS.items()) + " FROM lines GROUP BY 1")
def section_presence(spark, d):
    """Whether a document has a line that may begin each of the guarded sections, a condition of looking for their text."""
    first = headings.first_line(F.col("text"))
    return doc_lines(spark, d).groupBy("doc_id").agg(*[F.coalesce(F.bool_or(first.rlike(p)), F.lit(False)).alias(f"has_{s}") for s, p in GUARDS.items()])


@query(rf"""WITH t AS (SELECT line_id, coalesce({STRIP.format("text")}, '') AS x FROM (SELECT *, row_number() OVER (PARTITION BY run_id, version_no, line_idx ORDER BY received_at DESC NULLS LAST, line_id DESC NULLS LAST) AS n FROM rich_paragraphs) WHERE n = 1), u AS (SELECT line_id, upper(replace(replace(x, 'ﬁ', 'fi'), 'ﬂ', 'fl')) AS x FROM t),
    c AS (SELECT line_id, CASE WHEN x = 'INTRODUCTION' OR starts_with(x, 'INTRODUCTION ') THEN 5 WHEN x = 'POLICY STATEMENT' OR starts_with(x, 'POLICY STATEMENT ') THEN 6 WHEN x = 'DEFINITIONS' OR starts_with(x, 'DEFINITIONS ') THEN 12 WHEN x = 'HISTORY' OR starts_with(x, 'HISTORY ') THEN 14
      WHEN starts_with(x, 'RELATED POLICIES') THEN 13 WHEN starts_with(x, '1. PURPOSE') OR x = 'PURPOSE' THEN 7 WHEN starts_with(x, '2. SCOPE') OR x = 'SCOPE & BENEFICIARIES' THEN 8 WHEN starts_with(x, '3. EXCLUSIONS') OR x = 'EXCLUSIONS' THEN 9
      WHEN starts_with(x, '4. AWARD STRUCTURE') OR x = 'AWARD STRUCTURE & PAYOUT TIERS' THEN 10 WHEN starts_with(x, 'POLICY REVIEW NOTE') THEN 11 ELSE 0 END AS slot_id FROM u) SELECT slot_id, count(*) AS n, min(line_id) AS first_id FROM c GROUP BY 1""")
def slot_inference(spark, d):
    """The section that an edited line says it is of, by its text alone."""
    from .registry import rich_lines
    from ..functions.text import slot_of_text

    return rich_lines(spark, d).groupBy(slot_of_text(F.col("text")).alias("slot_id")).agg(F.count("*").alias("n"), F.min("line_id").alias("first_id"))
