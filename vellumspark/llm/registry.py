"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .encoding import find_garbled
from .language import detect, wrong_labels
from .lookalike import all_forms, find_lookalikes, whole_script_words
from .mixing import mix, shares
from .split import split_oversized
from .subjects import document_subjects
from .tokenize import encode_corpus
from .truncation import by_source, cut_off


def p1_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that were cut, with their text and score."""
    return cut_off(spark, *(read_table(spark, sf_dir, n) for n in ("section_slots", "slot_assignments", "cleaned_documents")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_cut(spark, sf_dir).select("tab", "doc_id", "slot_id", "para_idx")


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return by_source(*(read_table(spark, sf_dir, n) for n in ("section_slots", "slot_assignments")), p1_found(spark, sf_dir), read_table(spark, sf_dir, "extracted_documents"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark, read_table(spark, sf_dir, "extracted_documents", "doc_id", "lang", "paragraphs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, and paragraphs with a sentence in another language."""
    return wrong_labels(_languages(spark, sf_dir))


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document."""
    return _languages(spark, sf_dir).select("doc_id", "label", F.col("main").alias("lang"), F.col("main_confidence").alias("confidence")).dropDuplicates(["doc_id"])


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each segment of every document."""
    return _languages(spark, sf_dir).filter("para_idx is not null").select("doc_id", "para_idx", "lang", "confidence", "n_chars").distinct()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled paragraphs with their repaired text."""
    return find_garbled(spark, {name: read_table(spark, sf_dir, name, "doc_id", "paragraphs") for name in ("extracted_documents", "cleaned_documents")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_repaired(spark, sf_dir).select("tab", "doc_id", "para_idx")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text of rich_paragraphs and extracted_documents."""
    return all_forms(spark, read_table(spark, sf_dir, "rich_paragraphs"), *(read_table(spark, sf_dir, n) for n in ("extracted_documents", "cleaned_documents")))


def p4_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that look like others but are made of other characters, with their consistent form."""
    return find_lookalikes(spark, read_table(spark, sf_dir, "rich_paragraphs"), *(read_table(spark, sf_dir, n) for n in ("extracted_documents", "cleaned_documents")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_changed(spark, sf_dir).select("tab", "row_key", "para_idx")


def p4_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words wholly in another script that look like Latin ones, which keep their form."""
    return whole_script_words(read_table(spark, sf_dir, "rich_paragraphs"), read_table(spark, sf_dir, "extracted_documents"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return split_oversized(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "extracted_documents"), read_table(spark, sf_dir, "chunk_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be cut: those with a second piece."""
    return p5_pieces(spark, sf_dir).filter("piece_idx = 1").select("doc_id", "chunk_id").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the listed sources: each of its documents with its number of copies."""
    return mix(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share of each source in the mix."""
    return shares(p7_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document and how many paragraphs are about each."""
    return document_subjects(spark, *(read_table(spark, sf_dir, n) for n in ("documents", "subject_areas", "subject_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {
    "p1_found": p1_found,
    "p1_cut": p1_cut,
    "p1_sources": p1_sources,
    "p2_found": p2_found,
    "p2_documents": p2_documents,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_changed": p4_changed,
    "p4_forms": p4_forms,
    "p4_words": p4_words,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_subjects": p8_subjects,
}

ORACLE = {
    "p5_found": """
        WITH lim AS (SELECT e.doc_id, min(l.max_chars) AS max_chars FROM extracted_documents e JOIN chunk_limits l USING (source_format) GROUP BY 1)
        SELECT DISTINCT c.doc_id, c.chunk_id FROM chunks c JOIN lim USING (doc_id)
        WHERE length(trim(c.text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) > max_chars""",
}
