"""Queries from lines to finished sections, and of what is done with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as T
from ..operators import pipeline
from ..sources.tables import read_table
from .registry import CLEAN, HEAD, LABELLED, LINES, RICH, STRIP, S, doc_lines, query, rich_lines, sql_text
from .values import CHECKED

long = lambda df, *names: df.withColumns({n: F.col(n).cast("bigint") for n in names})
WITHOUT_LINES = lambda cte: cte.replace(LINES + ", ", "", 1)
PLACES = "CASE label " + " ".join(f"WHEN {sql_text(x)} THEN {k}" for k, x in enumerate(D.LABELS)) + " END"
IN = lambda s: ", ".join(map(sql_text, pipeline.LABEL_SECTIONS[s]))
SECTIONS = rf"""{CLEAN}, {WITHOUT_LINES(HEAD)}, {WITHOUT_LINES(LABELLED)}, {CHECKED}, keep AS (SELECT doc_id, line_idx, text, {S} AS st FROM clean WHERE reason IS NULL),
    sx AS (SELECT k.doc_id, k.line_idx, k.st, last_value(h.slot_id IGNORE NULLS) OVER (PARTITION BY k.doc_id ORDER BY k.line_idx) AS slot_id FROM keep k LEFT JOIN hs h USING (doc_id, line_idx)),
    bd AS (SELECT doc_id, slot_id, count(*) AS n_lines, string_agg(st, chr(10) ORDER BY line_idx) AS text, 'heading' AS backend FROM sx WHERE slot_id IS NOT NULL AND slot_id NOT IN (1, 3, 15) AND length(st) > 0 GROUP BY 1, 2),
    lb AS (SELECT doc_id, CASE WHEN label IN ({IN(1)}) THEN 1 ELSE 3 END AS slot_id, count(*) AS n_lines, string_agg(label || ' ' || value, chr(10) ORDER BY {PLACES}) AS text, 'label_row' AS backend FROM good WHERE label IN ({IN(1)}, {IN(3)}) GROUP BY 1, 2),
    ev AS (SELECT doc_id, unnest(generate_series(1, 15))::INT AS slot_id FROM (SELECT DISTINCT doc_id FROM lines)),
    sections AS (SELECT doc_id, slot_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN slot_id = 15 THEN 'logo' ELSE coalesce(backend, 'missing') END AS backend, CASE WHEN slot_id <> 15 THEN coalesce(text, 'Data is not found in source file') END AS text FROM ev LEFT JOIN (SELECT * FROM bd UNION ALL SELECT * FROM lb) f USING (doc_id, slot_id))"""


@query(f"WITH {SECTIONS} SELECT * FROM sections")
def document_sections(spark, d):
    """From extracted lines to fifteen sections a document: cleaned, split to sections, labels validated."""
    return pipeline.document_sections(spark, doc_lines(spark, d))


@query(f"""WITH {SECTIONS}, a AS (SELECT doc_id, count(*) AS n, count(DISTINCT slot_id) AS slots, count_if(backend = 'missing') AS missing, count_if(backend = 'heading') AS heads, count_if(slot_id = 1 AND backend = 'label_row' AND contains(text, 'Policy Title:')) AS titled,
      count_if(coalesce(length(text) > 0 AND (length(text) - length(regexp_replace(text, {sql_text(T.UNPRINTABLE)}, '', 'g'))) / length(text) >= 0.3, false)) AS bad FROM sections GROUP BY 1),
    r AS (SELECT doc_id, unnest(['fifteen_sections', 'has_title', 'some_heading', 'nothing_garbled', 'nothing_missing']) AS name, unnest([n = 15 AND slots = 15, titled = 1, heads > 0, bad = 0, missing = 0]) AS ok FROM a) SELECT name, ok, count(*) AS n FROM r GROUP BY 1, 2""")
def document_checks(spark, d):
    """How many documents pass each check of the result."""
    return pipeline.checks(pipeline.document_sections(spark, doc_lines(spark, d))).groupBy("name", "ok").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT doc_id, slot_id, content_paragraphs, content_tables FROM section_slots), b AS (SELECT *, coalesce(content_paragraphs, []) AS p, CASE WHEN slot_id IN (9, 10, 14) AND coalesce(len(content_tables), 0) > 0 THEN [] ELSE coalesce(content_paragraphs, [])[1:12] END AS body FROM s)
    SELECT doc_id, slot_id, len(p) AS n_given, len(body) AS n_body, coalesce(array_to_string(body, chr(10)), '') AS body FROM b""")
def slot_bodies(spark, d):
    return long(pipeline.body_of(read_table(spark, d, "section_slots")), "n_given", "n_body")


@query(rf"""SELECT DISTINCT doc_id, slot_id FROM section_slots WHERE len(list_filter(coalesce(content_paragraphs, []), lambda p: length({STRIP.format('p')}) > 12 AND regexp_matches(p, '\p{{L}}'))) = 0
    AND len(list_filter(flatten(flatten(coalesce(content_tables, []))), lambda c: length({STRIP.format('c')}) > 0)) = 0""")
def empty_slots(spark, d):
    return pipeline.empty_slots(read_table(spark, d, "section_slots"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, unnest(paragraphs) AS kept, unnest(original_indices) AS line_idx FROM (SELECT DISTINCT doc_id, paragraphs, original_indices FROM cleaned_documents))
    SELECT doc_id, count(*) AS n_kept, count_if(coalesce(kept = text, false)) AS n_same, count_if(coalesce(left(kept, 20) = left(text, 20), false)) AS n_prefix FROM k LEFT JOIN lines USING (doc_id, line_idx) GROUP BY 1""")
def provenance(spark, d):
    """Kept paragraphs against the extracted ones that they come from."""
    return pipeline.provenance(read_table(spark, d, "cleaned_documents"), doc_lines(spark, d))


@query(f"""WITH {RICH}, last AS (SELECT run_id, line_idx, text FROM rich WHERE kind = 'p' AND (run_id, version_no) IN (SELECT run_id, max(version_no) FROM rich GROUP BY 1)), r AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY line_idx) AS place, text AS after FROM last),
    e AS (SELECT run_id, unnest(generate_series(1, len(paragraphs))) AS place, unnest(paragraphs) AS before FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY extracted_at DESC NULLS LAST, doc_id) AS n FROM extracted_documents WHERE run_id IS NOT NULL) WHERE n = 1)
    SELECT run_id, place, before, after FROM e JOIN r USING (run_id, place)""")
def positional_overlay(spark, d):
    """The paragraphs of a run under the lines of its last version."""
    rich = rich_lines(spark, d)
    last = rich.join(rich.groupBy("run_id").agg(F.max("version_no").alias("version_no")), ["run_id", "version_no"])
    newest = F.max_by("paragraphs", F.struct(F.col("extracted_at").isNotNull(), "extracted_at")).alias("paragraphs")
    source = read_table(spark, d, "extracted_documents").filter("run_id is not null").groupBy("run_id").agg(newest).select("run_id", F.posexplode("paragraphs").alias("line_idx", "text"))
    return long(pipeline.overlay(last, source), "place")


@query(f"WITH {RICH} SELECT run_id, version_no, line_id, row_number() OVER (PARTITION BY run_id, version_no ORDER BY CASE WHEN coalesce(slot, 0) = 0 THEN 0 ELSE 1 END, coalesce(slot, 0), line_idx, line_id) AS place FROM rich")
def free_zone(spark, d):
    """The order of the lines on the page."""
    return long(pipeline.free_zone(rich_lines(spark, d)), "place")


@query(f"""WITH {RICH}, v AS (SELECT run_id, version_no, max(modified_at) AS t0 FROM rich GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY version_no DESC) AS n FROM v)
    SELECT run_id, arg_max(version_no, (t0, version_no)) AS chosen, arg_max(version_no, (t0, version_no)) = max(version_no) AS newer FROM t WHERE n <= 2 GROUP BY 1""")
def newer_version(spark, d):
    return pipeline.newer_of(rich_lines(spark, d))


@query(rf"""WITH c AS (SELECT DISTINCT doc_id, chunk_id, source_idx, text FROM chunks WHERE text IS NOT NULL AND source_idx IS NOT NULL), p AS (SELECT *, source_idx / greatest(max(source_idx) OVER (PARTITION BY doc_id), 1) AS pos FROM c)
    SELECT doc_id, chunk_id, round(0.1 * (1 - pos), 6) AS early, round(0.1 * pos, 6) AS late FROM p WHERE length({S}) >= 30 AND NOT regexp_matches(text, '\.{{4,}}\s*\d+\s*$') AND NOT (length(text) >= 50 AND regexp_matches(text, '^\s*\p{{Nd}}+\s*[.)]?\s+\S'))
    AND NOT EXISTS (SELECT 1 FROM slot_assignments a WHERE a.doc_id = p.doc_id AND a.source_idx = p.source_idx)""")
def chunk_candidates(spark, d):
    """Chunks that a search may give, with the boost of their place."""
    return pipeline.chunk_candidates(read_table(spark, d, "chunks"), read_table(spark, d, "slot_assignments"))


@query("""WITH a AS (SELECT doc_id, slot_id, arg_max(chunk_text, (coalesce(score, -1.0), -coalesce(chunk_id, 0), chunk_text)) AS bound_text FROM slot_assignments WHERE chunk_text IS NOT NULL GROUP BY 1, 2), s AS (SELECT doc_id, slot_id, max(coalesce(array_to_string(content_paragraphs, chr(10)), CASE WHEN content_paragraphs IS NOT NULL THEN '' END)) AS own FROM section_slots GROUP BY 1, 2)
    SELECT doc_id, slot_id, coalesce(bound_text, own) AS text, bound_text IS NOT NULL AS bound FROM s LEFT JOIN a USING (doc_id, slot_id)""")
def slot_bindings(spark, d):
    """The text of a section, or what is bound to it."""
    return pipeline.bindings(read_table(spark, d, "section_slots"), read_table(spark, d, "slot_assignments"))


@query(f"""WITH {RICH}, m AS (SELECT DISTINCT run_id, modified_by FROM rich WHERE modified_by IS NOT NULL) SELECT m.modified_by, count(*) AS n_runs, count(r.run_id) AS n_known, count_if(r.status = 'done') AS n_done, max(r.created_at) AS newest
    FROM m LEFT JOIN (SELECT run_id, min(status) AS status, max(created_at) AS created_at FROM runs GROUP BY 1) r USING (run_id) GROUP BY 1""")
def editors(spark, d):
    """Who edited how many runs, and in what state those are."""
    members = rich_lines(spark, d).filter("modified_by is not null").select("run_id", "modified_by").distinct()
    runs = read_table(spark, d, "runs").groupBy("run_id").agg(F.min("status").alias("status"), F.max("created_at").alias("created_at"), F.lit(1).alias("known"))
    return members.join(runs, "run_id", "left").groupBy("modified_by").agg(F.count("*").alias("n_runs"), F.count("known").alias("n_known"), F.count_if(F.coalesce(F.col("status") == "done", F.lit(False))).alias("n_done"), F.max("created_at").alias("newest"))


@query(f"""WITH {RICH}, u AS (SELECT run_id, max(modified_at) AS seen FROM rich WHERE modified_by IS NOT NULL GROUP BY 1) SELECT r.run_id, r.status, count_if(coalesce(x.modified_at > r.created_at, false)) AS n_unread, count(x.line_id) AS n_lines
    FROM (SELECT run_id, min(status) AS status, max(created_at) AS created_at FROM runs GROUP BY 1) r LEFT JOIN rich x USING (run_id) GROUP BY 1, 2""")
def unread_lines(spark, d):
    """Lines of each run that were changed after it was made."""
    runs = read_table(spark, d, "runs").groupBy("run_id").agg(F.min("status").alias("status"), F.max("created_at").alias("created_at"))
    j = runs.join(rich_lines(spark, d).select("run_id", "line_id", "modified_at"), "run_id", "left")
    return j.groupBy("run_id", "status").agg(F.count_if(F.coalesce(F.col("modified_at") > F.col("created_at"), F.lit(False))).alias("n_unread"), F.count("line_id").alias("n_lines"))


@query(f"""WITH {RICH}, e AS (SELECT run_id, modified_at AS happened, 'line' AS kind, line_id AS id FROM rich WHERE modified_at IS NOT NULL UNION ALL SELECT run_id, created_at, 'run', 0 FROM (SELECT run_id, max(created_at) AS created_at FROM runs GROUP BY 1) WHERE created_at IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY happened DESC, kind, id) AS place FROM e) SELECT run_id, happened, kind, id, place FROM r WHERE place <= 10""")
def run_timeline(spark, d):
    """The last ten events of each run, of its making and its lines together."""
    from pyspark.sql import Window

    made = read_table(spark, d, "runs").groupBy("run_id").agg(F.max("created_at").alias("happened")).filter("happened is not null").select("run_id", "happened", F.lit("run").alias("kind"), F.lit(0).cast("bigint").alias("id"))
    changed = rich_lines(spark, d).filter("modified_at is not null").select("run_id", F.col("modified_at").alias("happened"), F.lit("line").alias("kind"), F.col("line_id").alias("id"))
    w = Window.partitionBy("run_id").orderBy(F.desc("happened"), "kind", "id")
    return long(changed.unionByName(made).withColumn("place", F.row_number().over(w)).filter("place <= 10"), "place")


@query(rf"WITH {RICH}, b AS (SELECT line_id, text, regexp_replace(text, '^(\s*)\[([^\[\]]*)\](\s*)$', '\1\2\3') AS plain FROM rich WHERE text IS NOT NULL) SELECT line_id, plain FROM b WHERE plain <> text UNION ALL SELECT -count(*), NULL FROM b WHERE plain = text")
def bracket_strip(spark, d):
    """Lines that are one pair of brackets without them, and how many are none (as a negative id)."""
    plain = F.regexp_replace("text", r"^(\s*)\[([^\[\]]*)\](\s*)$", "$1$2$3")
    b = rich_lines(spark, d).filter("text is not null").select("line_id", "text", plain.alias("plain"))
    return b.filter("plain <> text").select("line_id", "plain").unionByName(b.filter("plain = text").agg((-F.count("*")).alias("line_id"), F.lit(None).cast("string").alias("plain")))
