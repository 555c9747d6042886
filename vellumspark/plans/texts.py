"""Queries of folds over lines and of tables; the oracles of folds are recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..operators import folds, routing, tables
from ..sources.tables import read_table
from .registry import LINES, STRIP, TABLES, _hits, doc_lines, query, sql_text, values

LABEL = r"regexp_matches(s, '^[A-Za-z][A-Za-z0-9 ()/&.,''\-_]*\s*[:\t]\s*\S')"
ENDED = r"regexp_matches(cur, '[.!?;:]\s*$')"
LOWER = r"regexp_matches(s, '^\p{Ll}')"


def fold(joins: str, keep_blank: bool) -> str:
    """A fold over the lines as a recursive query: (doc_id, part, cur), the last row of each part is its text. part 0: nothing so far."""
    begun = "cur IS NOT NULL"
    more = f"({begun} AND s <> '' AND coalesce({joins}, false))"
    new = f"CASE WHEN {more} THEN trim(cur || ' ' || s) ELSE s END" if keep_blank else f"CASE WHEN s = '' THEN NULL WHEN {more} THEN cur || ' ' || s ELSE s END"
    step = f"CASE WHEN {more} THEN part ELSE part + 1 END" if keep_blank else f"CASE WHEN s = '' OR {more} THEN part ELSE part + 1 END"
    return rf"""{LINES}, num AS (SELECT doc_id, coalesce({STRIP.format('text')}, '') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS i FROM lines),
      rec AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS part, NULL::VARCHAR AS cur FROM num UNION ALL SELECT num.doc_id, num.i, {step}, {new} FROM rec JOIN num ON num.doc_id = rec.doc_id AND num.i = rec.i + 1),
      joined AS (SELECT doc_id, part - 1 AS para_idx, arg_max(cur, i) AS text FROM rec WHERE cur IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {fold(f'NOT {ENDED} AND {LOWER} AND length(cur) + 1 + length(s) < 600', False)} SELECT * FROM joined")
def stitched_lines(spark, d):
    return folds.stitched(doc_lines(spark, d)).withColumn("para_idx", F.col("para_idx").cast("bigint"))


@query(f"WITH RECURSIVE {fold(f'NOT {ENDED} AND ({LOWER} OR length(s) <= 240) AND length(cur) + 1 + length(s) < 1200', False)} SELECT doc_id, para_idx, CASE WHEN {LABEL.replace('(s,', '(text,')} THEN 'label_row' ELSE 'paragraph' END AS kind, text FROM joined")
def text_blocks(spark, d):
    return folds.blocks(doc_lines(spark, d)).withColumn("para_idx", F.col("para_idx").cast("bigint"))


@query(f"WITH RECURSIVE {fold(f'NOT {LABEL} AND ({LOWER} OR NOT {ENDED}) AND length(s) <= 120 AND length(cur) <= 200', True)} SELECT * FROM joined")
def continued_lines(spark, d):
    return folds.continued(doc_lines(spark, d)).withColumn("para_idx", F.col("para_idx").cast("bigint"))


@query(rf"""WITH c AS (SELECT DISTINCT doc_id, chunk_id, text FROM chunks WHERE text IS NOT NULL), m AS (SELECT doc_id, chunk_id, list_filter(string_split(regexp_replace(regexp_replace(text, '(^|[^\d.])(\d+(?:\.\d+)+\.?\s+[A-Z])', '\1' || chr(1) || '\2', 'g'), '\s*▪\s*', chr(1) || '▪ ', 'g'), chr(1)), lambda x: length(trim(regexp_replace(x, '^▪ ', ''))) > 0) AS p FROM c),
    r AS (SELECT doc_id, chunk_id, unnest(generate_series(0, len(p) - 1)) AS clause_idx, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS x FROM m) SELECT DISTINCT doc_id, chunk_id, clause_idx, CASE WHEN x = '' OR regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END AS clause FROM r""")
def source_clauses(spark, d):
    c = read_table(spark, d, "chunks").filter("text is not null").select("doc_id", "chunk_id", "text").distinct()
    return folds.clauses(c).select("doc_id", "chunk_id", F.col("clause_idx").cast("bigint").alias("clause_idx"), "clause").distinct()


CELL = "coalesce(" + STRIP.format("{0}") + ", '')"
KNOWN = "regexp_replace(lower(" + CELL + "), ':+$', '') IN (" + ", ".join(map(sql_text, D.LABEL_ROW_WORDS)) + ")"
C1, C2 = CELL.format("r[1]"), CELL.format("r[2]")
SHAPES = rf"""{TABLES}, t0 AS (SELECT *, lower(array_to_string(flatten(cells), ' ')) AS x, len(cells) AS n_rows, coalesce(list_max(list_transform(cells, lambda r: len(r))), 0) AS width, cells[2:] AS body FROM tabs),
    t1 AS (SELECT *, {_hits(D.TABLE_SIGNALS[9])} AS h9, {_hits(D.TABLE_SIGNALS[10])} AS h10, {_hits(D.GENERIC_SIGNALS)} AS g, len(list_filter(flatten(cells), lambda c: {CELL.format('c')} <> '')) > 0 AS shaped,
      len(list_filter(cells[1], lambda c: {KNOWN.format('c')})) AS first_labels, len(list_filter(cells[2], lambda c: {CELL.format('c')} <> '')) AS second_filled,
      list_filter(body, lambda r: len(r) >= 2 AND ({C1} <> '' OR {C2} <> '')) AS rows2, len(list_filter(body, lambda r: len(list_filter(r, lambda c: length(c) > 0)) > 0)) AS n_data, len(list_filter(body, lambda r: {KNOWN.format('r[1]')})) AS n_known FROM t0),
    t2 AS (SELECT *, n_rows BETWEEN 2 AND 3 AND width >= 3 AND first_labels >= 2 AND second_filled >= greatest(1, first_labels // 2) AS across, list_filter(rows2, lambda r: {C1} <> '') AS named FROM t1),
    shapes AS (SELECT *, coalesce(across OR (n_rows >= 2 AND len(cells[1]) = 2 AND len(named) = len(rows2) AND ((len(named) >= 2 AND len(list_filter(named, lambda r: len(string_split_regex({C1}, '\s+')) <= 5)) / len(named) >= 0.5) OR (n_data > 0 AND n_known >= greatest(2, n_data * 0.5)))), false) AS label_table, g >= 2 AND h9 = 0 AND h10 = 0 AS general FROM t2),
    described AS (SELECT *, CASE WHEN x = '' OR label_table THEN 0 WHEN h9 > h10 THEN 9 WHEN h10 > h9 THEN 10 WHEN h9 > 0 THEN 0 WHEN g >= 2 THEN -1 ELSE 0 END AS class FROM shapes)"""


def section_tables(spark, d):
    return routing.table_rows(read_table(spark, d, "section_slots")).withColumn("table_idx", F.col("table_idx").cast("bigint"))


@query(f"WITH {SHAPES} SELECT doc_id, slot_id, table_idx, n_rows, width, shaped, label_table, general, class FROM described")
def table_shapes(spark, d):
    return tables.described(section_tables(spark, d)).drop("cells").withColumns({c: F.col(c).cast("bigint") for c in ("n_rows", "width")})


SIGN = f"list_transform(cells[1], lambda c: lower({CELL.format('c')}))"


@query(f"""WITH {SHAPES}, r AS (SELECT *, CASE WHEN NOT shaped OR label_table OR (general AND slot_id <> 9) THEN NULL WHEN class > 0 THEN class WHEN class = -1 THEN NULL WHEN slot_id IN (9, 10, 14) THEN slot_id END AS dest, {SIGN} AS key FROM described)
    SELECT doc_id, slot_id, table_idx, CASE WHEN row_number() OVER (PARTITION BY doc_id, dest, key ORDER BY slot_id, table_idx) = 1 THEN dest END AS to_slot FROM r""")
def table_routing(spark, d):
    """The section that each table goes to."""
    return tables.routed(section_tables(spark, d))


@query(f"WITH {TABLES} SELECT doc_id, array_to_string({SIGN}, ' | ') AS key, count(*) AS n, min(slot_id) AS first_slot FROM tabs WHERE len(cells) > 0 GROUP BY 1, 2")
def table_identity(spark, d):
    return tables.repeated(section_tables(spark, d))


LINE = f"regexp_replace({CELL.format('{0}')}, ':+$', '') || ': ' || {CELL.format('{1}')}"


@query(f"""WITH {SHAPES}, l AS (SELECT doc_id, slot_id, table_idx, CASE WHEN across THEN list_transform(generate_series(1, greatest(len(cells[1]), len(cells[2]))), lambda i: {LINE.format('cells[1][i]', 'cells[2][i]')}) ELSE list_transform(cells, lambda r: {LINE.format('r[1]', 'r[2]')}) END AS ls FROM described WHERE label_table),
    u AS (SELECT doc_id, slot_id, table_idx, unnest(generate_series(0, len(ls) - 1)) AS row_idx, unnest(ls) AS text FROM l) SELECT * FROM u WHERE NOT regexp_matches(text, '^: ?$')""")
def label_table_lines(spark, d):
    return tables.label_lines(section_tables(spark, d)).withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query(f"WITH {TABLES}, c AS (SELECT doc_id, slot_id, table_idx, unnest({SIGN}) AS heading FROM tabs) SELECT doc_id, slot_id, table_idx, named_slot, count(*) AS hits FROM c JOIN {values(D.heading_rows())} AS t(named_slot, heading) USING (heading) GROUP BY ALL")
def table_header_hits(spark, d):
    return tables.header_hits(spark, section_tables(spark, d))
