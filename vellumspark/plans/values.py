"""Queries of the values of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as T
from ..operators import fields, values
from ..sources.tables import read_table
from .registry import LABELLED, LINES, STRIP, S, doc_lines, query, sql_text

WORDS = lambda ws: ", ".join(map(sql_text, ws))
WORD1 = r"lower(string_split_regex({0}, '\s+')[1])"


def noun(x: str) -> str:
    v = f"regexp_replace({STRIP.format(x)}, '\\s*\\.$', '')"
    return rf"(length({v}) >= 2 AND NOT regexp_matches({v}, '[:\n.]') AND NOT regexp_matches({v}, '^\p{{Nd}}') AND regexp_matches({v}, '\p{{L}}') AND NOT (regexp_matches({v}, '^\p{{Ll}}') AND {WORD1.format(STRIP.format(v))} IN ({WORDS(D.PHRASE_STARTS)})))"


def verb(x: str) -> str:
    return f"list_has_any(regexp_extract_all(lower({x}), '[a-z]+'), [{WORDS(D.VERBS)}])"


def role(x: str) -> str:
    return rf"(regexp_replace(lower(string_split_regex(regexp_replace({STRIP.format(x)}, '[.,;:]+$', ''), '\s+')[-1]), '[.,;:]+$', '') IN ({WORDS(D.ROLE_WORDS)}))"


def replaced(x: str) -> str:
    v = STRIP.format(x)
    return rf"({v} <> '' AND NOT contains({v}, chr(10)) AND (regexp_matches({v}, {sql_text(T.REFERENCE)}) OR regexp_matches({v}, {sql_text(T.DATE)}) OR regexp_matches({v}, '(?i)^v?\d+(\.\d+)*(\s|$)') OR {WORD1.format(v)} NOT IN ({WORDS(D.TITLE_STARTS)})))"


PARTS = rf"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({{0}}, '(?i)\s+and\s+', ',', 'g'), '\s+&\s+', ',', 'g'), '[,;]'), lambda x: {STRIP.format('x')}), lambda x: length(x) > 0)"
P = PARTS.format("v")
PARTIAL = sql_text(values.PARTIAL_DATE)


def joined(rule: str) -> str:
    return f"nullif(array_to_string(list_filter({P}, lambda x: {rule}), ', '), '')"


TAIL = r"array_to_string(ws[-{0}:], ' ')"
KIND = "CASE WHEN lower(e) IN ({0}) THEN e {1} WHEN len(ws) = 1 AND {2} THEN e END".format(WORDS(D.TYPE_WORDS), " ".join(f"WHEN len(ws) BETWEEN {n} AND 8 AND lower({TAIL.format(n)}) IN ({WORDS(D.TYPE_WORDS)}) THEN upper(substr({TAIL.format(n)}, 1, 1)) || substr({TAIL.format(n)}, 2)" for n in (3, 2, 1)), noun("e"))
CHECKED = rf"""vv AS (SELECT doc_id, line_idx, label, v, regexp_replace(v, '[.,;:]+$', '') AS e, string_split_regex(regexp_replace(v, '[.,;:]+$', ''), '\s+') AS ws, {STRIP.format("CASE WHEN length(v) > 1 AND (v[1] = chr(34) AND v[-1] = chr(34) OR v[1] = chr(39) AND v[-1] = chr(39)) THEN substr(v, 2, length(v) - 2) ELSE v END")} AS bare
      FROM (SELECT doc_id, line_idx, label, {STRIP.format('value')} AS v FROM can WHERE label IS NOT NULL) WHERE length(v) > 0),
    ck AS (SELECT doc_id, line_idx, label, CASE WHEN label = 'Type:' THEN CASE WHEN NOT {verb('v')} THEN {KIND} END WHEN label IN ('Functional Area(s):', 'Responsible Function(s):', 'Applies to:') THEN {joined(f"{noun('x')} AND NOT {verb('x')}")}
      WHEN label IN ('Brief Description:', 'Reason for Policy:') THEN CASE WHEN NOT (v[-1] = ':' AND len(string_split_regex(v, '\s+')) <= 4) THEN substr(v, 1, CASE WHEN label = 'Brief Description:' THEN 500 ELSE 1000 END) END
      WHEN label = 'Policy Title:' THEN CASE WHEN NOT contains(v, ':') AND NOT regexp_matches(lower(v), '\b({"|".join(D.SECTION_MARKERS)})\b') AND length(v) >= 4 AND regexp_matches(v, '\p{{L}}') THEN substr(v, 1, 200) END
      WHEN label = 'Last Reviewed:' THEN CASE WHEN regexp_matches(v, {sql_text(T.DATE)}) OR regexp_matches(v, {PARTIAL}) OR regexp_replace(lower(v), '[.,;:]+$', '') IN ({WORDS(D.REVIEW_CYCLES)}) THEN v END
      WHEN label = 'Supersedes:' THEN CASE WHEN contains(v, chr(10)) THEN NULL WHEN contains(bare, ';') THEN nullif(array_to_string(list_filter(list_filter(list_transform(string_split(bare, ';'), lambda x: {STRIP.format('x')}), lambda x: x <> ''), lambda x: {replaced('x')}), '; '), '') WHEN {replaced('bare')} THEN bare END
      WHEN label = 'Responsible Function Officer(s):' THEN {joined(f"NOT {verb('x')} AND (regexp_matches(x, {sql_text(T.PERSON)}) OR {role('x')} OR regexp_matches(x, {sql_text(T.DEPARTMENT)}) OR {noun('x')})")}
      WHEN label = 'Applicable Sector(s):' THEN nullif(CASE WHEN contains(v, '&') AND NOT contains(v, ',') THEN array_to_string({P}, ' & ') ELSE array_to_string({P}, ', ') END, '') WHEN label IN ('Approved by:', 'Prepared by:') THEN substr(v, 1, 200) ELSE substr(v, 1, 500) END AS value FROM vv),
    good AS (SELECT doc_id, label, arg_min(value, line_idx) AS value FROM ck WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {LABELLED}, {CHECKED} SELECT * FROM good")
def field_values_valid(spark, d):
    """The values that their labels may have, cleaned."""
    return values.valid_values(spark, doc_lines(spark, d))


KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""WITH {LABELLED}, {CHECKED}, own AS (SELECT doc_id, max(value) FILTER (label = 'Policy Title:') AS title, max(value) FILTER (label = 'Functional Area(s):') AS a, max(value) FILTER (label = 'Responsible Function(s):') AS r FROM good GROUP BY 1),
    o AS (SELECT doc_id, title, list_transform(list_concat(coalesce({PARTS.format('a')}, []), coalesce({PARTS.format('r')}, [])), lambda x: {KEY.format('x')}) AS owners FROM own),
    n AS (SELECT doc_id, label, value, CASE WHEN label = 'Applies to:' THEN nullif(array_to_string(list_filter({PARTS.format('value')}, lambda x: NOT list_contains(owners, {KEY.format('x')})), ', '), '')
      WHEN label = 'Policy Title:' THEN coalesce(nullif(regexp_extract({STRIP.format('value')}, '^[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){{0,3}}\s*[–—:-]\s+(\S.*)$', 1), ''), {STRIP.format('value')}) WHEN label = 'Brief Description:' AND {KEY.format('value')} = {KEY.format('title')} THEN NULL ELSE value END AS new FROM good JOIN o USING (doc_id))
    SELECT doc_id, label, new AS value, value IS DISTINCT FROM new AS changed FROM n""")
def field_values_refined(spark, d):
    """The values of a document set right against each other."""
    return values.refined(values.valid_values(spark, doc_lines(spark, d)))


@query(f"WITH {LABELLED}, {CHECKED}, n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM lines), every AS (SELECT unnest([{WORDS(D.LABELS)}]) AS label) SELECT label, n_docs, n_docs - count(good.doc_id) AS n_missing, round((n_docs - count(good.doc_id)) / n_docs, 6) AS ratio FROM every LEFT JOIN good USING (label), n GROUP BY label, n_docs")
def missing_ratio(spark, d):
    """How many documents lack a valid value of each label."""
    return values.missing_ratio(spark, doc_lines(spark, d))


@query(rf"""WITH d AS (SELECT DISTINCT doc_id, x.index AS index, {STRIP.format('x.text')} AS text FROM (SELECT doc_id, unnest(dropped) AS x FROM cleaned_documents)), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text) AS n FROM d)
    SELECT doc_id, index, text FROM c WHERE length(text) BETWEEN 1 AND 200 AND NOT regexp_matches(text, ':\s*$') AND NOT regexp_matches(text, {sql_text(T.PAGE_NUMBER)}) AND NOT regexp_matches(text, {sql_text(T.NOISE)}) AND n < 3""")
def lost_values(spark, d):
    """Dropped lines that may be a lost value."""
    return values.lost_values(read_table(spark, d, "cleaned_documents"))


@query(rf"""WITH {LINES}, f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\b[A-Z][a-z]+ ){{0,2}}\b(?:Department|Team|Division|Unit|Group|Office|Committee|Board|Branch|Desk)\b')) AS phrase FROM lines) SELECT doc_id, phrase, count(*) AS n FROM f GROUP BY 1, 2""")
def department_phrases(spark, d):
    return values.department_phrases(doc_lines(spark, d))


@query(rf"""WITH {LINES}, s AS (SELECT doc_id, line_idx, text, regexp_matches(text, '[:\t]') AS has, least(CASE WHEN instr(text, ':') = 0 THEN 1000000000 ELSE instr(text, ':') END, CASE WHEN instr(text, chr(9)) = 0 THEN 1000000000 ELSE instr(text, chr(9)) END) AS pos FROM lines WHERE text IS NOT NULL)
    SELECT doc_id, line_idx, {STRIP.format("CASE WHEN has THEN substr(text, 1, pos - 1) ELSE text END")} AS label, CASE WHEN has THEN {STRIP.format("substr(text, pos + 1)")} END AS value FROM s""")
def label_value_split(spark, d):
    """Every line as what stands before and after its first colon or tab."""
    label, value = values.split_label(F.col("text"))
    return doc_lines(spark, d).filter("text is not null").select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), label.alias("label"), value.alias("value"))


@query(rf"""WITH {LINES}, m AS (SELECT doc_id, line_idx, text, {S} AS s, regexp_extract({S}, '^([A-Za-z][A-Za-z0-9 ()/&.,''\-_]*?)\s*:\s*([^\n]*)$', ['label', 'value']) AS x, regexp_matches({S}, '^([A-Za-z][A-Za-z0-9 ()/&.,''\-_]*?)\s*:\s*([^\n]*)$') AND contains(left({S}, 80), ':') AS ok FROM lines),
    c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x.value, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]+$', ''), '[–—\-)\]}}]+\s*$', ''), '\s+$', '') AS v FROM m WHERE ok)
    SELECT doc_id, line_idx, {STRIP.format(f"{STRIP.format('x.label')} || ': ' || v")} AS text FROM c WHERE v <> x.value""")
def column_wrap_tails(spark, d):
    """Lines of a label and a value that end in remains of a second column, cleaned."""
    new = values.clean_tail(F.col("text"))
    return doc_lines(spark, d).filter(new != F.col("text")).select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), new.alias("text"))
