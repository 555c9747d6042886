"""Queries of the engine's operators over the whole tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as T
from ..functions.myanmar import reorder_marks
from ..operators import fields, lines, retrieval, routing, workflow
from ..sources import documents as files
from ..sources.tables import read_table
from ..streaming import autosave

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(sql_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.document_lines(read_table(spark, d, "extracted_documents"))


def rich_lines(spark: SparkSession, d: str) -> DataFrame:
    return workflow.newest_lines(read_table(spark, d, "rich_paragraphs"))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
LINES = """docs AS (SELECT * FROM (SELECT doc_id, paragraphs, row_number() OVER (PARTITION BY doc_id ORDER BY extracted_at DESC NULLS LAST, run_id DESC NULLS LAST) AS n FROM extracted_documents) WHERE n = 1),
    lines AS (SELECT doc_id, unnest(generate_series(0, len(paragraphs) - 1)) AS line_idx, unnest(paragraphs) AS text FROM docs)"""
RICH = """rich AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, version_no, line_idx ORDER BY received_at DESC NULLS LAST, line_id DESC NULLS LAST) AS n FROM rich_paragraphs) WHERE n = 1)"""
S = STRIP.format("text")
NAME = rf"(regexp_matches({S}, {sql_text(T.PROPER_NAME)}) AND length({S}) <= 60 AND NOT list_has_any(regexp_split_to_array(lower({S}), '\s+'), [{', '.join(map(sql_text, D.NAME_STOPWORDS))}]))"
CLEAN = rf"""{LINES}, counted AS (SELECT *, {S} AS s, count(*) OVER (PARTITION BY doc_id, {S}) AS c, {NAME} AS is_name FROM lines),
    clean AS (SELECT doc_id, line_idx, text, CASE WHEN length(coalesce(s, '')) = 0 THEN NULL WHEN regexp_matches(text, {sql_text(T.PAGE_NUMBER)}) THEN 'page_number'
      WHEN regexp_matches(text, {sql_text(T.NOISE)}) THEN 'version_page_noise' WHEN c >= 3 AND length(s) <= 120 AND NOT is_name THEN 'header_repeat'
      WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, {sql_text(T.UNPRINTABLE)}, '', 'g'))) / length(text) >= 0.3 THEN 'garbled' END AS reason FROM counted)"""


@query(f"WITH {CLEAN} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM clean GROUP BY 1")
def clean_drop_reasons(spark, d):
    return lines.clean(doc_lines(spark, d)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


LETTER = "regexp_matches(substr(text, {0}, 1), '[A-Za-z]')"
FFFD = f"""CASE WHEN contains(text, '�') THEN array_to_string(list_transform(generate_series(1, length(text)), lambda i: CASE WHEN substr(text, i, 1) <> '�' THEN substr(text, i, 1)
    WHEN i > 1 AND {LETTER.format('i - 1')} AND {LETTER.format('i + 1')} THEN '’' WHEN (i > 1 AND {LETTER.format('i - 1')}) OR {LETTER.format('i + 1')} THEN '?' ELSE '–' END), '') ELSE text END"""


@query(f"WITH {CLEAN} SELECT doc_id, line_idx, {FFFD} AS text FROM clean WHERE reason IS NULL")
def clean_survivors(spark, d):
    kept = lines.clean(doc_lines(spark, d)).filter("reason is null")
    return kept.select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"), T.repair_replacement_marks(F.col("text")).alias("text"))


@query(f"WITH {LINES} SELECT doc_id, {S} AS line, count(*) AS n FROM lines WHERE length({S}) BETWEEN 1 AND 120 AND NOT {NAME} GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines(spark, d):
    return lines.repeated_lines(doc_lines(spark, d))


@query(f"WITH {LINES} SELECT DISTINCT doc_id, {S} AS name FROM lines WHERE {NAME}")
def proper_name_lines(spark, d):
    return doc_lines(spark, d).filter(lines.is_proper_name(F.col("text"))).select("doc_id", T.strip(F.col("text")).alias("name")).distinct()


@query(rf"""WITH {LINES}, s AS (SELECT doc_id, line_idx, {S} AS s FROM lines), s1 AS (SELECT * FROM s WHERE length(s) > 0),
    m AS (SELECT *, lag(s) OVER w AS b FROM s1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)),
    p AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND NOT regexp_matches(b, '[.!?;:]$') AND regexp_matches(s, '^\p{{Ll}}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS part FROM m)
    SELECT doc_id, min(line_idx) AS line_idx, count(*) AS n_lines, string_agg(s, ' ' ORDER BY line_idx) AS text FROM p GROUP BY doc_id, part""")
def line_join_groups(spark, d):
    return lines.join_lines(doc_lines(spark, d)).withColumn("line_idx", F.col("line_idx").cast("bigint"))


MARK = f"[{T.BULLETS}]"


@query(rf"""WITH v AS (SELECT DISTINCT doc_id, slot_id, para_idx, text FROM (SELECT doc_id, slot_id, unnest(generate_series(0, len(content_paragraphs) - 1)) AS para_idx, unnest(content_paragraphs) AS text FROM section_slots)),
    i AS (SELECT doc_id, slot_id, para_idx, list_filter(string_split(replace(regexp_replace(regexp_replace({S}, '\s*\n\s*', chr(10), 'g'), '(^|\n){MARK}\s*', chr(1), 'g'), chr(10), ' '), chr(1)), lambda x: length(trim(x)) > 0) AS items FROM v)
    SELECT doc_id, slot_id, para_idx, unnest(generate_series(0, len(items) - 1)) AS item_idx, trim(unnest(items)) AS item FROM i""")
def bullet_split(spark, d):
    v = read_table(spark, d, "section_slots").select("doc_id", "slot_id", F.posexplode("content_paragraphs").alias("para_idx", "text")).distinct()
    return lines.bullets(v).select("doc_id", "slot_id", F.col("para_idx").cast("bigint").alias("para_idx"), F.col("item_idx").cast("bigint").alias("item_idx"), "item")


@query(r"""WITH c AS (SELECT DISTINCT doc_id, chunk_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM chunks WHERE text IS NOT NULL),
    r AS (SELECT doc_id, chunk_id, unnest(generate_series(0, len(p) - 1)) AS sentence_idx, unnest(p) AS sentence FROM c) SELECT * FROM r WHERE length(sentence) > 0""")
def sentence_split(spark, d):
    c = read_table(spark, d, "chunks").filter("text is not null").select("doc_id", "chunk_id", "text").distinct()
    return lines.sentence_rows(c).select("doc_id", "chunk_id", F.col("sentence_idx").cast("bigint").alias("sentence_idx"), "sentence").distinct()


@query()
def chunk_greedy_pack(spark, d):
    """Chunks of the cleaned lines; checked against a plain loop in the tests."""
    kept = lines.clean(doc_lines(spark, d)).filter("reason is null")
    return lines.chunk_lines(kept)


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {STRIP.format('x')}), lambda x: length(x) > 0) AS p FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS para_idx, unnest(p) AS text FROM p""")
def paragraph_blocks(spark, d):
    return lines.paragraphs(read_table(spark, d, "documents")).withColumn("para_idx", F.col("para_idx").cast("bigint"))


@query(rf"""WITH {LINES} SELECT doc_id, count(*) AS n_lines, count_if(regexp_matches(text, {sql_text(T.PAGE_NUMBER)})) AS n_page_number,
    count_if(length({S}) BETWEEN 1 AND 80 AND NOT contains({S}, ':') AND NOT (suffix({S}, '.') AND length({S}) > 30)) AS n_title, count_if(length({S}) >= 50 AND regexp_matches({S}, {sql_text(T.FOOTNOTE)})) AS n_footnote,
    count_if(regexp_matches(text, {sql_text(T.CONTENTS_LINE)})) AS n_contents, count_if(regexp_matches(text, {sql_text(T.BOUNDARY)})) AS n_boundary,
    count_if(length({S}) BETWEEN 1 AND 60 OR regexp_matches({S}, ':|–| - ')) AS n_heading_like, count_if(regexp_matches(text, {sql_text(T.UNFINISHED)})) AS n_unfinished,
    count_if(length({S}) >= 30 AND contains({S}, ' ') AND regexp_matches({S}, '\p{{Ll}}$')) AS n_cut, count_if({NAME}) AS n_proper_name FROM lines GROUP BY 1""")
def line_predicates(spark, d):
    return lines.predicates(doc_lines(spark, d))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, line_idx, {S} AS title FROM lines), s AS (SELECT *, length(title) + CASE WHEN title = upper(title) AND regexp_matches(title, '[A-Za-z]') THEN 60 ELSE 0 END - CASE WHEN length(title) > 120 THEN 80 ELSE 0 END
      + CASE WHEN line_idx < 3 THEN 100 WHEN line_idx < 6 THEN 50 ELSE -5 * line_idx END AS score FROM c WHERE length(title) BETWEEN 8 AND 200 AND NOT contains(title, ':') AND NOT regexp_matches(title, '^{MARK}') AND regexp_matches(title, '\p{{L}}'))
    SELECT doc_id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_idx) AS n FROM s) WHERE n = 1""")
def title_score(spark, d):
    return lines.titles(doc_lines(spark, d))


@query(rf"WITH {LINES}, f AS (SELECT doc_id, line_idx, text FROM lines WHERE line_idx < 5 AND length({S}) BETWEEN 8 AND 80) SELECT doc_id, arg_min({S}, line_idx) AS title FROM f GROUP BY 1")
def first_title(spark, d):
    s = T.strip(F.col("text"))
    return doc_lines(spark, d).filter((F.col("line_idx") < 5) & F.length(s).between(8, 80)).groupBy("doc_id").agg(F.min_by(s, "line_idx").alias("title"))


TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
POSTINGS = f"""tok AS (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents WHERE text IS NOT NULL), occ AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok),
    post AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM occ GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), one AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM tok),
    q AS (SELECT * FROM {values(D.query_rows())} AS t(query_id, slot_id, query)), qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM q) GROUP BY 1, 2)"""
BM25 = f"""{POSTINGS}, bm AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al)) * qf), 6) AS score FROM post JOIN dfs USING (term) JOIN qt USING (term), one GROUP BY 1, 2),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1")
def term_stats(spark, d):
    return retrieval.term_stats(read_table(spark, d, "documents"), "doc_id")


@query(f"WITH {BM25} SELECT query_id, doc_id AS key, rank, round(score, 3) AS score FROM bmr WHERE rank <= 10")
def bm25_topk(spark, d):
    return retrieval.bm25_top(spark, read_table(spark, d, "documents"), "doc_id").select("query_id", "key", F.col("rank").cast("bigint").alias("rank"), F.round("score", 3).alias("score"))


GRAMS = f"""g AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(ts, CASE WHEN len(ts) > 1 THEN list_transform(generate_series(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1]) ELSE [] END)) AS term FROM tok) GROUP BY 1, 2),
    gd AS (SELECT term, count(*) AS df FROM g GROUP BY 1), gw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM g JOIN gd USING (term), one WHERE df <= 0.95 * n),
    gn AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM gw GROUP BY 1), tw AS (SELECT doc_id, term, raw / norm AS weight FROM gw JOIN gn USING (doc_id))"""


@query(f"WITH {POSTINGS}, {GRAMS} SELECT doc_id AS key, count(*) AS n_terms, round(max(weight), 5) AS top_weight, round(sum(weight), 3) AS total FROM tw GROUP BY 1")
def tfidf_weights(spark, d):
    w = retrieval.tfidf(read_table(spark, d, "documents"), "doc_id")
    return w.groupBy("key").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 5).alias("top_weight"), F.round(F.sum("weight"), 3).alias("total"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def knn_cosine_topk(spark, d):
    return retrieval.cosine_neighbours(read_table(spark, d, "embeddings")).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 3).alias("score"))


@query(f"""WITH {BM25}, {GRAMS}, lex AS (SELECT query_id, doc_id, 0.3 * score / coalesce(nullif(max(score) OVER (PARTITION BY query_id), 0), 1) AS part FROM bmr WHERE rank <= 20),
    qn AS (SELECT query_id, sqrt(sum((1 + ln(qf)) * (1 + ln(qf)))) AS qnorm FROM qt GROUP BY 1), cs AS (SELECT query_id, doc_id, round(sum(weight * (1 + ln(qf)) / qnorm), 6) AS score FROM tw JOIN qt USING (term) JOIN qn USING (query_id) GROUP BY 1, 2),
    den AS (SELECT query_id, doc_id, 0.7 * score AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM cs) WHERE r <= 20),
    tot AS (SELECT slot_id, doc_id, round(sum(part), 4) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) JOIN q USING (query_id) GROUP BY 1, 2)
    SELECT slot_id, doc_id AS key, r AS rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, doc_id) AS r FROM tot) WHERE r <= 5""")
def hybrid_fusion(spark, d):
    return retrieval.fusion(spark, read_table(spark, d, "documents"), "doc_id").select("slot_id", "key", F.col("rank").cast("bigint").alias("rank"), F.round("score", 3).alias("score"))


@query(f"""WITH {BM25}, p AS (SELECT query_id, doc_id, list_distinct({TOKENS.format('query')}) AS a, list_distinct(ts) AS b FROM bmr JOIN q USING (query_id) JOIN tok USING (doc_id) WHERE rank <= 20),
    j AS (SELECT query_id, doc_id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS jaccard FROM p)
    SELECT query_id, doc_id AS key, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, doc_id) AS r FROM j) WHERE r <= 5""")
def jaccard_rerank(spark, d):
    return retrieval.rerank(spark, read_table(spark, d, "documents"), "doc_id").select("query_id", "key", "jaccard")


@query(f"SELECT slot_id, arg_max(query, length(query) * 1000 - query_id) AS query FROM {values(D.query_rows())} AS t(query_id, slot_id, query) GROUP BY 1")
def longest_query(spark, d):
    return retrieval.query_table(spark).groupBy("slot_id").agg(F.max_by("query", F.struct(F.length("query"), -F.col("query_id"))).alias("query"))


NORM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
LABELLED = rf"""{LINES}, ll AS (SELECT doc_id, line_idx, {STRIP.format(rf"regexp_extract({S}, '^([^:{chr(9)}{chr(10)}]{{2,40}})\s*[:{chr(9)}]', 1)")} AS raw_label, {STRIP.format(rf"regexp_extract({S}, '^[^:{chr(9)}{chr(10)}]{{2,40}}\s*[:{chr(9)}]([^{chr(10)}]*)', 1)")} AS value FROM lines),
    lk AS (SELECT *, {NORM.format('raw_label')} AS norm FROM ll WHERE raw_label <> ''), dim AS (SELECT {NORM.format('spelling')} AS norm, arg_min(label, ord) AS label FROM {values(D.label_rows())} AS t(label, spelling, ord) GROUP BY 1),
    px AS (SELECT l.norm, arg_max(d.label, length(d.norm)) AS label FROM (SELECT DISTINCT norm FROM lk WHERE norm <> '') l JOIN dim d ON starts_with(l.norm, d.norm) AND length(d.norm) >= 4 GROUP BY 1),
    can AS (SELECT lk.doc_id, lk.line_idx, lk.raw_label, coalesce(dim.label, px.label) AS label, lk.value FROM lk LEFT JOIN dim USING (norm) LEFT JOIN px USING (norm)),
    fv AS (SELECT doc_id, label, arg_min(value, line_idx) AS value FROM can WHERE label IS NOT NULL AND value <> '' GROUP BY 1, 2)"""


@query(f"WITH {LABELLED} SELECT doc_id, line_idx, raw_label, label, value FROM can")
def label_lookup(spark, d):
    return fields.canonical(spark, fields.labelled_lines(doc_lines(spark, d))).withColumn("line_idx", F.col("line_idx").cast("bigint"))


@query(f"WITH {LABELLED} SELECT * FROM fv")
def field_values(spark, d):
    return fields.field_values(spark, doc_lines(spark, d))


@query(f"WITH {LABELLED}, every AS (SELECT DISTINCT doc_id, unnest([{', '.join(map(sql_text, D.LABELS))}]) AS label FROM lines) SELECT doc_id, label, coalesce(value, '[Missing]') AS value FROM every LEFT JOIN fv USING (doc_id, label)")
def label_row_fill(spark, d):
    return fields.label_rows_filled(spark, doc_lines(spark, d))


@query(f"""WITH {LABELLED} SELECT label, CASE WHEN regexp_matches(value, {sql_text(T.DATE)}) THEN 'date' WHEN regexp_matches(value, {sql_text(T.DEPARTMENT)}) THEN 'department' WHEN regexp_matches(value, {sql_text(T.PERSON)}) THEN 'person'
    WHEN regexp_matches(value, {sql_text(T.REFERENCE)}) AND regexp_matches(value, '\\d') THEN 'reference' ELSE 'text' END AS shape, count(*) AS n FROM fv GROUP BY 1, 2""")
def value_shapes(spark, d):
    return fields.field_values(spark, doc_lines(spark, d)).groupBy("label", fields.shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))


WORDS = r"regexp_split_to_array(trim(regexp_replace(lower(p_name || ' ' || v), '[^a-z\- ]+', ' ', 'g')), '\s+')"


@query(rf"""WITH t AS (SELECT p_partkey, unnest(['Policy', 'Code of Conduct', 'rules', 'Standard Operating Procedure', 'memo']) AS v, p_name FROM part), w AS (SELECT p_partkey, v, {WORDS} AS w FROM t),
    k AS (SELECT [{', '.join(map(sql_text, D.TYPE_WORDS))}] AS known)
    SELECT p_partkey, v, CASE WHEN len(w) >= 3 AND list_contains(known, array_to_string(w[-3:], ' ')) THEN array_to_string(w[-3:], ' ') WHEN len(w) >= 2 AND list_contains(known, array_to_string(w[-2:], ' ')) THEN array_to_string(w[-2:], ' ')
      WHEN list_contains(known, w[-1]) THEN w[-1] END AS type_word FROM w, k""")
def type_words(spark, d):
    wordings = F.array(*map(F.lit, ("Policy", "Code of Conduct", "rules", "Standard Operating Procedure", "memo")))
    p = read_table(spark, d, "part").select("p_partkey", F.explode(wordings).alias("v"), "p_name")
    return p.select("p_partkey", "v", fields.type_word(F.concat_ws(" ", "p_name", "v")).alias("type_word"))


@query(rf"""WITH p AS (SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' and ' || c_mktsegment || '; ' || c_name || ' & Co', '(?i)\s+and\s+', ',', 'g'), '\s+&\s+', ',', 'g') AS v FROM customer),
    u AS (SELECT c_custkey, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(v, '[,;]'), lambda x: trim(x)), lambda x: length(x) > 0))) AS value FROM p) SELECT c_custkey, value FROM u""")
def multi_value_split(spark, d):
    c = read_table(spark, d, "customer")
    text = F.concat("c_name", F.lit(" and "), "c_mktsegment", F.lit("; "), "c_name", F.lit(" & Co"))
    return c.select("c_custkey", F.explode(fields.multi_values(text)).alias("value"))


@query(rf"""WITH {LINES}, s AS (SELECT doc_id, line_idx, {S} AS s FROM lines), t AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY line_idx) AS value FROM s WHERE length(s) > 0)
    SELECT doc_id, line_idx, regexp_replace(s, ':$', '') AS label, value FROM t WHERE regexp_matches(s, '^[^:{chr(9)}.]{{2,40}}:$') AND value IS NOT NULL AND NOT regexp_matches(value, '^[^:{chr(9)}.]{{2,40}}:$')""")
def alternating_pairs(spark, d):
    return fields.alternating_pairs(doc_lines(spark, d)).withColumn("line_idx", F.col("line_idx").cast("bigint"))


HEAD = rf"""{LINES}, hd AS (SELECT heading, min(slot_id) AS slot_id FROM {values(D.heading_rows())} AS t(slot_id, heading) GROUP BY 1),
    hk AS (SELECT doc_id, line_idx, coalesce(nullif(regexp_extract(lower({S}), '^(?:\d+[.)]\s*|[ivx]+\.\s+)?([^:]{{3,60}}):\s+\S', 1), ''), regexp_replace(regexp_replace(lower({S}), '^(\d+[.)]\s*|[ivx]+\.\s+)', ''), '\s*[:.\-–]*\s*$', '')) AS heading FROM lines),
    hs AS (SELECT doc_id, line_idx, slot_id, heading FROM hk JOIN hd USING (heading) WHERE length(heading) BETWEEN 3 AND 80)"""


@query(f"WITH {HEAD} SELECT doc_id, line_idx, slot_id, heading FROM hs")
def section_headings(spark, d):
    return routing.headings(spark, doc_lines(spark, d)).withColumn("line_idx", F.col("line_idx").cast("bigint"))


@query(f"WITH {HEAD}, m AS (SELECT l.doc_id, l.line_idx, h.slot_id FROM lines l LEFT JOIN hs h USING (doc_id, line_idx)) SELECT doc_id, line_idx, last_value(slot_id IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_idx) AS slot_id FROM m")
def section_index(spark, d):
    return routing.section_index(spark, doc_lines(spark, d)).withColumn("line_idx", F.col("line_idx").cast("bigint"))


@query(f"WITH {HEAD}, z AS (SELECT doc_id, max(line_idx) + 1 AS n FROM lines GROUP BY 1) SELECT doc_id, slot_id, line_idx AS start, coalesce(lead(line_idx) OVER (PARTITION BY doc_id ORDER BY line_idx), n) AS stop FROM hs JOIN z USING (doc_id)")
def section_spans(spark, d):
    return routing.section_spans(spark, doc_lines(spark, d)).select("doc_id", "slot_id", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query(f"WITH {HEAD}, f AS (SELECT doc_id, slot_id, min(line_idx) AS line_idx FROM hs GROUP BY 1, 2) SELECT doc_id, line_idx, min(slot_id) AS slot_id FROM f GROUP BY 1, 2")
def first_claims(spark, d):
    return routing.first_claims(spark, doc_lines(spark, d)).withColumn("line_idx", F.col("line_idx").cast("bigint"))


@query(f"WITH {HEAD} SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM hs WHERE slot_id = 9) AND doc_id NOT IN (SELECT doc_id FROM hs WHERE slot_id = 14)")
def section_guards(spark, d):
    rows = doc_lines(spark, d)
    found = routing.headings(spark, rows)
    return rows.select("doc_id").distinct().join(found.filter("slot_id = 9"), "doc_id", "left_semi").join(found.filter("slot_id = 14"), "doc_id", "left_anti")


@query(f"WITH {RICH} SELECT run_id, version_no, line_idx, coalesce(last_value(nullif(slot, 0) IGNORE NULLS) OVER (PARTITION BY run_id, version_no ORDER BY line_idx), 0) AS slot FROM rich")
def slot_forward_fill(spark, d):
    return routing.forward_fill(rich_lines(spark, d))


@query("""SELECT p.event_id, p.user_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS matched_id FROM events p WHERE p.event_type = 'purchase'""")
def asof_last_view(spark, d):
    return routing.as_of(read_table(spark, d, "events"))


@query("""WITH m AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS mark_id FROM events WHERE event_type IN ('signup', 'click'))
    SELECT mark_id, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS n FROM m WHERE event_type = 'click' AND mark_id IS NOT NULL GROUP BY 1""")
def interval_recover(spark, d):
    return routing.between_marks(read_table(spark, d, "events"))


TABLES = "tabs AS (SELECT DISTINCT doc_id, slot_id, table_idx, cells FROM (SELECT doc_id, slot_id, unnest(generate_series(0, len(content_tables) - 1)) AS table_idx, unnest(content_tables) AS cells FROM section_slots))"


def _hits(text: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(x, {sql_text(k)}) THEN 1 ELSE 0 END" for k in text) + ")"


@query(f"""WITH {TABLES}, h AS (SELECT doc_id, slot_id, table_idx, {_hits(D.GENERIC_SIGNALS)} AS g, {', '.join(f'{_hits(w)} AS h{s}' for s, w in D.TABLE_SIGNALS.items())} FROM (SELECT *, lower(array_to_string(flatten(cells), ' ')) AS x FROM tabs)),
    t AS (SELECT *, greatest(h9, h10, h14) AS hits FROM h) SELECT doc_id, slot_id, table_idx, CASE WHEN hits = 0 AND g >= 2 THEN -1 WHEN hits = 0 OR (h9 = hits)::INT + (h10 = hits)::INT + (h14 = hits)::INT > 1 THEN 0 WHEN h9 = hits THEN 9 WHEN h10 = hits THEN 10 ELSE 14 END AS class, hits FROM t""")
def keyword_table_class(spark, d):
    return routing.table_class(routing.table_rows(read_table(spark, d, "section_slots"))).withColumn("table_idx", F.col("table_idx").cast("bigint"))


@query(f"""WITH {TABLES}, r AS (SELECT doc_id, slot_id, table_idx, cells[1] AS header, unnest(generate_series(1, len(cells) - 1)) AS row_idx, unnest(cells[2:]) AS row FROM tabs WHERE len(cells) >= 2)
    SELECT doc_id, slot_id, table_idx, row_idx, array_to_string(list_transform(generate_series(1, len(header)), lambda i: CASE (i - 1) % 3 WHEN 0 THEN header[i] || ': ' || coalesce(row[i], '') WHEN 1 THEN 'the ' || header[i] || ' is ' || coalesce(row[i], '') ELSE header[i] || ' equals ' || coalesce(row[i], '') END), '; ') AS phrase FROM r""")
def table_row_chunks(spark, d):
    out = routing.row_chunks(routing.table_rows(read_table(spark, d, "section_slots")))
    return out.withColumn("table_idx", F.col("table_idx").cast("bigint")).withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query(f"""WITH {TABLES}, w AS (SELECT *, list_max(list_transform(cells, lambda r: len(r))) AS width FROM tabs)
    SELECT doc_id, slot_id, table_idx, width, array_to_string(list_transform(cells, lambda r: array_to_string(list_resize(r, width, ''), ' | ')), chr(10)) AS text FROM w""")
def ragged_pad(spark, d):
    return routing.padded(routing.table_rows(read_table(spark, d, "section_slots"))).withColumn("table_idx", F.col("table_idx").cast("bigint"))


@query("""WITH p AS (SELECT doc_id, slot_id, list_distinct(regexp_extract_all(lower(array_to_string(flatten(flatten(content_tables)), ' ')), '[a-z0-9]+')) AS words, unnest(generate_series(0, len(content_paragraphs) - 1)) AS para_idx, unnest(content_paragraphs) AS text FROM section_slots WHERE len(content_tables) > 0),
    o AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS own FROM p) SELECT DISTINCT doc_id, slot_id, para_idx FROM o WHERE length(text) >= 20 AND len(own) > 0 AND len(list_intersect(own, words)) / len(own) >= 0.7""")
def prose_table_overlap(spark, d):
    return routing.prose_overlap(read_table(spark, d, "section_slots")).withColumn("para_idx", F.col("para_idx").cast("bigint"))


SLOT_TEXT = f"{RICH}, st AS (SELECT run_id, version_no, coalesce(slot, 0) AS slot, string_agg(coalesce(text, ''), chr(10) ORDER BY line_idx) AS text FROM rich WHERE kind = 'p' GROUP BY 1, 2, 3)"


@query(f"WITH {SLOT_TEXT} SELECT run_id, version_no, slot, text FROM st")
def slot_bucket_text(spark, d):
    return workflow.slot_texts(rich_lines(spark, d))


@query(f"""WITH {SLOT_TEXT}, v AS (SELECT *, lag(version_no) OVER (PARTITION BY run_id ORDER BY version_no) AS previous FROM (SELECT DISTINCT run_id, version_no FROM rich)), u AS (SELECT * FROM v WHERE previous IS NOT NULL),
    b AS (SELECT u.run_id, u.version_no, st.slot, st.text AS before FROM u JOIN st ON st.run_id = u.run_id AND st.version_no = u.previous), a AS (SELECT u.run_id, u.version_no, st.slot, st.text AS after FROM u JOIN st USING (run_id, version_no))
    SELECT run_id, version_no, slot, coalesce(before, '') AS before, coalesce(after, '') AS after FROM a FULL JOIN b USING (run_id, version_no, slot) WHERE coalesce(before, '') <> coalesce(after, '')""")
def diff_by_slot(spark, d):
    return workflow.version_diff(rich_lines(spark, d))


@query(f"WITH {RICH} SELECT run_id, max(version_no) AS latest, coalesce(max(version_no), 0) + 1 AS next_no, count(DISTINCT version_no) AS n_versions FROM rich GROUP BY 1")
def version_next(spark, d):
    return workflow.versions(rich_lines(spark, d))


@query(f"""WITH {RICH}, r AS (SELECT run_id, version_no, row_number() OVER (PARTITION BY run_id ORDER BY version_no DESC) AS n FROM (SELECT DISTINCT run_id, version_no FROM rich)),
    v AS (SELECT run_id, max(version_no) AS last, min(version_no) AS before FROM r WHERE n <= 2 GROUP BY 1) SELECT run_id, CASE WHEN status = 'done' THEN last ELSE before END AS version_no FROM v JOIN (SELECT DISTINCT run_id, status FROM runs) USING (run_id)""")
def version_resolution(spark, d):
    return workflow.resolve_version(rich_lines(spark, d), read_table(spark, d, "runs"))


@query(f"""WITH {RICH}, v AS (SELECT DISTINCT run_id, version_no FROM rich) SELECT run_id, version_no, CASE WHEN lead(version_no) OVER w IS NULL THEN 'draft' ELSE 'frozen' END AS kind, row_number() OVER w AS number FROM v WINDOW w AS (PARTITION BY run_id ORDER BY version_no)""")
def version_numbering(spark, d):
    return workflow.numbered(rich_lines(spark, d)).withColumn("number", F.col("number").cast("bigint"))


@query(f"WITH {RICH} SELECT line_id, run_id, version_no, line_idx, text FROM rich")
def upsert_newest(spark, d):
    return rich_lines(spark, d).select("line_id", "run_id", "version_no", "line_idx", "text")


@query(f"""WITH {RICH} SELECT run_id, version_no, f.id AS id, arg_min(f.body, line_idx) AS body FROM (SELECT run_id, version_no, line_idx, unnest(footnotes) AS f FROM rich) GROUP BY ALL""")
def footnotes_distinct(spark, d):
    f = rich_lines(spark, d).select("run_id", "version_no", "line_idx", F.explode("footnotes").alias("f"))
    return f.groupBy("run_id", "version_no", F.col("f.id").alias("id")).agg(F.min_by("f.body", "line_idx").alias("body"))


@query(rf"""SELECT DISTINCT line_id, {STRIP.format(r"replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&')")} AS text FROM rich_paragraphs WHERE html IS NOT NULL""")
def html_to_text(spark, d):
    return read_table(spark, d, "rich_paragraphs").filter("html is not null").select("line_id", T.html_text(F.col("html")).alias("text")).distinct()


@query("""SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
    FROM (SELECT *, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def draft_sessions(spark, d):
    s = workflow.sessions(read_table(spark, d, "events"), 3600)
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


ALLOWED = {"signup": ["view"], "view": ["click", "view"], "click": ["purchase", "view"]}


@query("""WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) SELECT from_state, to_state, count(*) AS n,
    (from_state, to_state) IN (('signup', 'view'), ('view', 'click'), ('view', 'view'), ('click', 'purchase'), ('click', 'view')) AS valid FROM s WHERE from_state IS NOT NULL GROUP BY 1, 2""")
def state_machine_valid(spark, d):
    return workflow.transitions(read_table(spark, d, "events"), ALLOWED)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since FROM events GROUP BY 1")
def current_state(spark, d):
    return read_table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"))


@query("""SELECT event_id FROM (SELECT event_id, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 1000000) AS gap FROM events) WHERE gap IS NULL OR gap >= 60""")
def idempotent_events(spark, d):
    return workflow.drop_repeats(read_table(spark, d, "events"), 60).select("event_id")


@query("SELECT run_id, filename, status, created_at FROM runs ORDER BY created_at DESC, run_id LIMIT 50")
def latest_runs(spark, d):
    return read_table(spark, d, "runs").select("run_id", "filename", "status", "created_at").orderBy(F.desc("created_at"), "run_id").limit(50)


@query("SELECT run_id, created_by_user_id, place FROM (SELECT run_id, created_by_user_id, row_number() OVER (PARTITION BY created_by_user_id ORDER BY created_at DESC, run_id) AS place FROM runs WHERE created_by_user_id IS NOT NULL AND created_at IS NOT NULL) WHERE place <= 5")
def fifo_eviction(spark, d):
    runs = read_table(spark, d, "runs").filter("created_by_user_id is not null and created_at is not null")
    return workflow.newest_within(runs, "created_by_user_id", F.col("created_at"), 5).select("run_id", "created_by_user_id", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {RICH}, k AS (SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY created_by_user_id ORDER BY created_at DESC, run_id) AS place FROM runs WHERE created_by_user_id IS NOT NULL AND created_at IS NOT NULL) WHERE place > 5) SELECT run_id, count(*) AS n_lines FROM rich WHERE run_id NOT IN (SELECT run_id FROM k) GROUP BY 1")
def cascade_evicted(spark, d):
    runs = read_table(spark, d, "runs").filter("created_by_user_id is not null and created_at is not null")
    gone = workflow.newest_within(runs, "created_by_user_id", F.col("created_at"), 1 << 30).filter("place > 5").select("run_id")
    return rich_lines(spark, d).join(gone, "run_id", "left_anti").groupBy("run_id").agg(F.count("*").alias("n_lines"))


@query("""SELECT c.c_custkey, c.c_mktsegment, n.n_name, count(o.o_orderkey) AS n_orders, count_if(o.o_orderdate > DATE '1996-01-01' OR o.o_orderstatus IS NULL) AS n_unread,
    CASE c.c_mktsegment WHEN 'BUILDING' THEN 'approver' WHEN 'AUTOMOBILE' THEN 'editor' ELSE 'viewer' END AS access FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2, 3""")
def shared_projects(spark, d):
    c, o, n = (read_table(spark, d, t) for t in ("customer", "orders", "nation"))
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.count_if(F.coalesce((F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz")) | F.col("o_orderstatus").isNull(), F.lit(False))).alias("n_unread"))
    j = c.join(per, "c_custkey", "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint")).alias(x)
    access = F.when(F.col("c_mktsegment") == "BUILDING", "approver").when(F.col("c_mktsegment") == "AUTOMOBILE", "editor").otherwise("viewer")
    return j.select("c_custkey", "c_mktsegment", "n_name", zero("n_orders"), zero("n_unread"), access.alias("access"))


@query("""SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'AUTOMOBILE' THEN 2 ELSE 1 END >= lvl AS allowed, lvl, count(*) AS n FROM customer, (VALUES (1), (2), (3)) AS t(lvl) GROUP BY 1, 2""")
def access_rank(spark, d):
    rank = F.create_map(F.lit("BUILDING"), F.lit(3), F.lit("AUTOMOBILE"), F.lit(2))
    own = F.coalesce(F.try_element_at(rank, F.col("c_mktsegment")), F.lit(1))
    c = read_table(spark, d, "customer").select(own.alias("own"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("lvl"))
    return c.groupBy((F.col("own") >= F.col("lvl")).alias("allowed"), "lvl").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT run_id, json_extract_string(audit_json, '$.filled')::BIGINT AS filled, json_extract_string(audit_json, '$.dropped')::BIGINT AS dropped FROM runs WHERE audit_json IS NOT NULL)
    SELECT run_id, filled, dropped, '{"filled":' || filled || ',"dropped":' || dropped || '}' AS again FROM f""")
def audit_json_roundtrip(spark, d):
    r = read_table(spark, d, "runs").filter("audit_json is not null").select("run_id", F.from_json("audit_json", "filled bigint, dropped bigint").alias("a"))
    return r.select("run_id", "a.filled", "a.dropped", F.to_json("a").alias("again"))


@query("SELECT status, count(*) AS n, count_if(file_size_bytes IS NULL) AS n_unknown, sum(file_size_bytes)::BIGINT AS bytes, max(sections_filled) AS most FROM runs GROUP BY 1")
def status_counts(spark, d):
    return read_table(spark, d, "runs").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("file_size_bytes").isNull()).alias("n_unknown"), F.sum("file_size_bytes").alias("bytes"), F.max("sections_filled").alias("most"))


@query("""WITH c AS (SELECT DISTINCT doc_id, paragraphs, dropped FROM cleaned_documents) SELECT doc_id, len(paragraphs) AS n_kept, coalesce(len(dropped), 0) AS n_dropped, coalesce(list_sum(list_transform(paragraphs, lambda x: length(x))), 0)::BIGINT AS kept_chars,
    coalesce(list_sum(list_transform(dropped, lambda x: length(x.text))), 0)::BIGINT AS dropped_chars FROM c WHERE paragraphs IS NOT NULL""")
def placed_dropped_totals(spark, d):
    c = read_table(spark, d, "cleaned_documents").select("doc_id", "paragraphs", "dropped").distinct().filter("paragraphs is not null")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return c.select("doc_id", F.size("paragraphs").cast("bigint").alias("n_kept"), F.coalesce(F.when(F.col("dropped").isNotNull(), F.size("dropped")), F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce(total(F.transform("paragraphs", lambda x: F.length(x))), F.lit(0)).alias("kept_chars"), F.coalesce(total(F.transform("dropped", lambda x: F.length(x["text"]))), F.lit(0)).alias("dropped_chars"))


@query("""WITH s AS (SELECT DISTINCT doc_id, slot_id, status, routing_rule FROM section_slots), a AS (SELECT DISTINCT doc_id, slot_id, backend, chunk_text IS NULL AS empty FROM slot_assignments)
    SELECT s.status, coalesce(s.routing_rule, a.backend, 'none') AS rule, a.empty, count(*) AS n FROM s LEFT JOIN a USING (doc_id, slot_id) GROUP BY 1, 2, 3""")
def assignment_rules(spark, d):
    s = read_table(spark, d, "section_slots", "doc_id", "slot_id", "status", "routing_rule").distinct()
    a = read_table(spark, d, "slot_assignments").select("doc_id", "slot_id", "backend", F.col("chunk_text").isNull().alias("empty")).distinct()
    return s.join(a, ["doc_id", "slot_id"], "left").groupBy("status", F.coalesce("routing_rule", "backend", F.lit("none")).alias("rule"), "empty").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT doc_id, line_idx FROM (SELECT doc_id, unnest(generate_series(0, len(paragraphs) - 1)) AS line_idx FROM cleaned_documents)), u AS (SELECT DISTINCT doc_id, source_idx FROM slot_assignments WHERE source_idx IS NOT NULL)
    SELECT doc_id, count(*) AS n_unused FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = c.doc_id AND u.source_idx = c.line_idx) GROUP BY 1""")
def unused_paragraphs(spark, d):
    c = read_table(spark, d, "cleaned_documents").select("doc_id", F.posexplode("paragraphs").alias("source_idx", "text")).select("doc_id", "source_idx").distinct()
    used = read_table(spark, d, "slot_assignments", "doc_id", "source_idx").filter("source_idx is not null")
    return c.join(used, ["doc_id", "source_idx"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_unused"))


@query("""SELECT doc_id, source_idx, min(slot_id) AS slot_id, count(DISTINCT slot_id) AS n_claims FROM slot_assignments WHERE source_idx IS NOT NULL GROUP BY 1, 2""")
def claim_priority(spark, d):
    a = read_table(spark, d, "slot_assignments", "doc_id", "slot_id", "source_idx").filter("source_idx is not null")
    return a.groupBy("doc_id", "source_idx").agg(F.min("slot_id").alias("slot_id"), F.count_distinct("slot_id").alias("n_claims"))


@query("""WITH c AS (SELECT DISTINCT doc_id, dropped FROM cleaned_documents), x AS (SELECT doc_id, unnest(dropped) AS d FROM c), r AS (SELECT doc_id, d."index" AS line_idx, d.text AS text, d.reason AS reason, row_number() OVER (PARTITION BY doc_id ORDER BY d."index", d.text) AS n FROM x) SELECT doc_id, line_idx, text, reason FROM r WHERE n <= 20""")
def dropped_samples(spark, d):
    """At most 20 samples of what was dropped for each document: the report keeps no more."""
    x = read_table(spark, d, "cleaned_documents").select("doc_id", "dropped").distinct().select("doc_id", F.explode("dropped").alias("d"))
    w = retrieval.Window.partitionBy("doc_id").orderBy("d.index", "d.text")
    return x.withColumn("n", F.row_number().over(w)).filter("n <= 20").select("doc_id", F.col("d.index").alias("line_idx"), F.col("d.text").alias("text"), F.col("d.reason").alias("reason"))


MY = r"[\x{1000}-\x{109F}\x{AA60}-\x{AA7F}\x{A9E0}-\x{A9FF}]"
LANG = f"""{LINES}, lc AS (SELECT doc_id, line_idx, length(regexp_replace(text, '[^' || {sql_text(MY[1:-1])} || ']', '', 'g')) AS my, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM lines),
    lg AS (SELECT doc_id, line_idx, CASE WHEN my / nullif(my + latin, 0) >= 0.3 THEN 'my' WHEN my / nullif(my + latin, 0) >= 0.1 THEN 'mixed' ELSE 'en' END AS lang FROM lc)"""


@query(f"WITH {LANG}, s AS (SELECT doc_id, count_if(lang = 'en') AS en, count_if(lang = 'my') AS my, count_if(lang = 'mixed') AS mixed, count(*) AS n FROM lg GROUP BY 1) SELECT doc_id, CASE WHEN en >= 0.1 * n AND my >= 0.1 * n THEN 'en-my' WHEN en >= my AND en >= mixed THEN 'en' WHEN my >= mixed THEN 'my' ELSE 'mixed' END AS lang FROM s")
def script_language(spark, d):
    lang = doc_lines(spark, d).select("doc_id", T.script_language(F.col("text")).alias("lang"))
    s = lang.groupBy("doc_id").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "my", "mixed")], F.count("*").alias("n"))
    verdict = F.when((F.col("en") >= 0.1 * F.col("n")) & (F.col("my") >= 0.1 * F.col("n")), "en-my").when((F.col("en") >= F.col("my")) & (F.col("en") >= F.col("mixed")), "en").when(F.col("my") >= F.col("mixed"), "my").otherwise("mixed")
    return s.select("doc_id", verdict.alias("lang"))


def _clip(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


@query(rf"""WITH t AS (SELECT doc_id, text, length(text) AS n, length(text) - length(replace(text, '်', '')) AS v, length(text) - length(regexp_replace(text, '[က-ဪ]', '', 'g')) AS c FROM documents WHERE length(text) > 0)
    SELECT doc_id, round(least(1.0, 0.30 * {_clip("(v * 100.0 / greatest(n, 1) - 2.0) / 10.0")} + 0.20 * {_clip("len(regexp_extract_all(text, '်{2,}')) / 10.0")}
      + 0.25 * {_clip(r"len(list_distinct(list_concat(regexp_extract_all(text, '\s[ါ-်]\s'), regexp_extract_all(text, '\s[ါ-်]|[ါ-်]\s')))) / 12.0")}
      + 0.15 * CASE WHEN c > 0 THEN {_clip("v / nullif(c, 0) - 0.5")} ELSE 0 END + 0.10 * {_clip(r"(length(text) - length(regexp_replace(text, '[\x{E000}-\x{F8FF}]', '', 'g'))) / 20.0")}), 6) AS score FROM t""")
def corruption_score(spark, d):
    return read_table(spark, d, "documents").filter("length(text) > 0").select("doc_id", F.round(T.corruption_score(F.col("text")), 6).alias("score"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{E000}-\x{F8FF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '\s+([ါ-်])', '\1', 'g'), '်{2,}', '်', 'g'), '(^|\s)း', '\1', 'g'), ' {2,}', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def unicode_repair(spark, d):
    return read_table(spark, d, "documents").filter("text is not null").select("doc_id", T.repair_myanmar(F.col("text")).alias("text"))


@query()
def mark_order(spark, d):
    """Lines whose Myanmar marks aren't in canonical order; checked by a property in the tests."""
    t = doc_lines(spark, d).filter(F.col("text").rlike("[က-႟]")).select("doc_id", "line_idx", "text", reorder_marks("text").alias("ordered"))
    return t.filter("text <> ordered")


@query("SELECT doc_id, sha256(array_to_string(paragraphs, chr(10))) AS digest FROM (SELECT DISTINCT doc_id, paragraphs FROM cleaned_documents) WHERE paragraphs IS NOT NULL")
def sha_digest(spark, d):
    c = read_table(spark, d, "cleaned_documents").select("doc_id", "paragraphs").distinct().filter("paragraphs is not null")
    return c.select("doc_id", F.sha2(F.array_join("paragraphs", "\n"), 256).alias("digest"))


@query(r"""SELECT run_id, CASE WHEN trim(regexp_replace(regexp_replace(filename, '\.[A-Za-z0-9]{1,5}$', ''), '[\\/:*?"<>|]', '_', 'g')) = '' THEN 'document' ELSE trim(regexp_replace(regexp_replace(filename, '\.[A-Za-z0-9]{1,5}$', ''), '[\\/:*?"<>|]', '_', 'g')) END AS safe_name,
    lower(regexp_extract(filename, '\.([A-Za-z0-9]{1,5})$', 1)) AS ext, CASE WHEN lower(regexp_extract(filename, '\.([A-Za-z0-9]{1,5})$', 1)) NOT IN ('pdf', 'docx', 'txt', 'rtf') THEN 'format' WHEN file_size_bytes > 52428800 THEN 'size' WHEN coalesce(file_size_bytes, 0) = 0 THEN 'empty' END AS reject,
    regexp_matches(replace(run_id, '-', ''), '^[0-9a-f]{32}$') AS is_uuid FROM runs WHERE filename IS NOT NULL""")
def upload_checks(spark, d):
    r = read_table(spark, d, "runs").filter("filename is not null")
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]{1,5})$", 1))
    reject = F.when(~ext.isin("pdf", "docx", "txt", "rtf"), "format").when(F.col("file_size_bytes") > 52428800, "size").when(F.coalesce("file_size_bytes", F.lit(0)) == 0, "empty")
    return r.select("run_id", T.safe_name(F.col("filename")).alias("safe_name"), ext.alias("ext"), reject.alias("reject"), F.replace("run_id", F.lit("-"), F.lit("")).rlike("^[0-9a-f]{32}$").alias("is_uuid"))


@query("""WITH m AS (SELECT event_id, ts, datediff_m(ts) AS m FROM (SELECT event_id, ts FROM events)) SELECT * FROM m""".replace("datediff_m(ts)", "floor((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 60000000)").replace("SELECT * FROM m", "SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-15 00:00:00' OR m < 1 THEN 'just now' WHEN m < 60 THEN m::BIGINT || 'm ago' WHEN m < 1440 THEN floor(m / 60)::BIGINT || 'h ago' WHEN m < 10080 THEN floor(m / 1440)::BIGINT || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM m"))
def time_ago(spark, d):
    return read_table(spark, d, "events").select("event_id", workflow.time_ago(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("ago"))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, chunk_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks WHERE text IS NOT NULL) SELECT DISTINCT doc_id, chunk_id, CASE WHEN length(t) = 0 OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS text FROM t""")
def terminal_stop(spark, d):
    return read_table(spark, d, "chunks").filter("text is not null").select("doc_id", "chunk_id", T.with_stop(F.col("text")).alias("text")).distinct()


@query("SELECT run_id, version_no, count_if(kind = 'divider') AS n_dividers, count_if(kind = 'p') AS n_paragraphs, max(line_idx) AS last_line FROM (SELECT DISTINCT run_id, version_no, line_idx, kind FROM rich_paragraphs) GROUP BY 1, 2")
def divider_counts(spark, d):
    r = read_table(spark, d, "rich_paragraphs", "run_id", "version_no", "line_idx", "kind").distinct()
    return r.groupBy("run_id", "version_no").agg(F.count_if(F.col("kind") == "divider").alias("n_dividers"), F.count_if(F.col("kind") == "p").alias("n_paragraphs"), F.max("line_idx").alias("last_line"))


@query(f"""WITH {RICH}, k AS (SELECT DISTINCT run_id FROM runs WHERE status = 'review') SELECT r.run_id, max(r.version_no) AS version_no, count(*) AS n_lines, count(DISTINCT r.modified_by) AS n_editors FROM rich r JOIN k USING (run_id) GROUP BY 1""")
def review_queue(spark, d):
    waiting = read_table(spark, d, "runs", "run_id", "status").filter("status = 'review'").select("run_id").distinct()
    return rich_lines(spark, d).join(waiting, "run_id").groupBy("run_id").agg(F.max("version_no").alias("version_no"), F.count("*").alias("n_lines"), F.count_distinct("modified_by").alias("n_editors"))


@query(f"""WITH {RICH} SELECT line_id, kind, coalesce(slot, 0) AS slot, text FROM rich""")
def lines_json_roundtrip(spark, d):
    r = rich_lines(spark, d).select("line_id", files.parse_line(files.lines_json(F.col("kind"), F.coalesce("slot", F.lit(0)), F.col("text"), F.col("html"))).alias("x"))
    return r.select("line_id", "x.kind", "x.slot", "x.text")


@query(f"""WITH {SLOT_TEXT}, t AS (SELECT * FROM {values(list(D.SECTIONS.items()))} AS t(slot, title)), b AS (SELECT st.*, CASE WHEN slot = 0 THEN text ELSE coalesce(title, '') || chr(10) || text END AS block FROM st LEFT JOIN t USING (slot))
    SELECT run_id, version_no, string_agg(block, chr(10) || chr(10) ORDER BY slot) AS text FROM b GROUP BY 1, 2""")
def source_text(spark, d):
    return files.source_text(rich_lines(spark, d))


@query("SELECT filter_kind AS kind, count(*) AS n FROM (SELECT CASE WHEN chunk_text IS NULL THEN 'empty' WHEN contains(chunk_text, chr(10)) THEN 'joined' WHEN score < 0.05 THEN 'low_confidence' ELSE 'single' END AS filter_kind FROM (SELECT DISTINCT doc_id, slot_id, chunk_text, score FROM slot_assignments)) GROUP BY 1")
def assignment_kinds(spark, d):
    a = read_table(spark, d, "slot_assignments", "doc_id", "slot_id", "chunk_text", "score").distinct()
    kind = F.when(F.col("chunk_text").isNull(), "empty").when(F.col("chunk_text").contains("\n"), "joined").when(F.col("score") < 0.05, "low_confidence").otherwise("single")
    return a.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT DISTINCT doc_id, chunk_id, string_split(regexp_replace(text, '\s+(\d+\.\d+\.?\s|▪)', chr(1) || '\1', 'g'), chr(1)) AS c FROM chunks WHERE text IS NOT NULL) SELECT doc_id, chunk_id, len(c) AS n_clauses, c[1] AS first FROM p""")
def clause_split(spark, d):
    c = read_table(spark, d, "chunks").filter("text is not null").select("doc_id", "chunk_id", F.split(F.regexp_replace("text", r"\s+(\d+\.\d+\.?\s|▪)", "\x01$1"), "\x01").alias("c")).distinct()
    return c.select("doc_id", "chunk_id", F.size("c").cast("bigint").alias("n_clauses"), F.element_at("c", 1).alias("first")).distinct()


@query("SELECT DISTINCT doc_id, chunk_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, translate(text, '•◦▪', '●●●') AS bullets FROM chunks WHERE text IS NOT NULL")
def escapes(spark, d):
    return read_table(spark, d, "chunks").filter("text is not null").select("doc_id", "chunk_id", T.html_escape(F.col("text")).alias("html"), F.translate("text", "•◦▪", "●●●").alias("bullets")).distinct()


@query("""SELECT run_id, printf('%.1f MB', round(file_size_bytes / 1048576.0, 1)) AS size, greatest(coalesce(markers_count, 0) - coalesce(sections_filled, 0), 0) AS missing FROM runs WHERE file_size_bytes IS NOT NULL""")
def run_sizes(spark, d):
    r = read_table(spark, d, "runs").filter("file_size_bytes is not null")
    return r.select("run_id", T.megabytes(F.col("file_size_bytes")).alias("size"), F.greatest(F.coalesce("markers_count", F.lit(0)) - F.coalesce("sections_filled", F.lit(0)), F.lit(0)).alias("missing"))


@query()
def autosave_stream(spark, d):
    """Sessions of autosaves as a streaming query over the whole event table, run until nothing is left."""
    return autosave.sessions_now(spark, d)
