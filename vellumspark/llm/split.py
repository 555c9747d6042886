"""Splitting oversized texts at natural boundaries.

A text over its limit is cut by a hierarchy of separators: sections (blank lines), paragraphs (line
breaks), sentences, words, characters (never between a base character and its combining marks, unless a single
cluster exceeds the limit). A unit that doesn't fit is broken by the next separator of the hierarchy, and units are
packed greedily until the limit is reached. Each piece after the first begins with the last ``overlap`` characters
of the piece before it, so that the pieces without their overlap give the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is stripped at both ends before the length is taken.
BLANKS = " \t\n\r\f\v"
#: Ends of units, coarsest first: blank lines, line breaks, sentence ends with their closing marks, white space.
SEPARATORS = (
    regex.compile(r"\n[ \t]*(?:\n[ \t]*)+"),
    regex.compile(r"\r\n|[\n\r\f\v  ]"),
    regex.compile(r"[.!?;။]['\"”’»)\]]*\s+|။"),
    regex.compile(r"\s+"),
)
CLUSTER = regex.compile(r"\X")


def unit_ends(text: str, start: int, end: int, size: int, level: int = 0) -> Iterator[int]:
    """Ends of the units of text[start:end], each no longer than ``size``, by the coarsest separators that do."""
    if end - start <= size:
        if end > start:
            yield end
        return
    if level == len(SEPARATORS):
        at = start
        last = start
        for m in CLUSTER.finditer(text, start, end):
            if m.end() - at > size:
                if last > at:
                    yield last
                    at = last
                while m.end() - at > size:
                    at += size
                    yield at
            last = m.end()
        if at < end:
            yield end
        return
    at = start
    for m in SEPARATORS[level].finditer(text, start, end):
        yield from unit_ends(text, at, m.end(), size, level + 1)
        at = m.end()
    yield from unit_ends(text, at, end, size, level + 1)


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each piece; a text within the limit is one piece.

    The overlap is cut to limit - 1 where it isn't below the limit, so that every piece brings something new.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    out: list[tuple[int, int]] = []
    start = full = 0
    for end in unit_ends(text, 0, len(text), limit - overlap):
        if end - start > limit:
            out.append((start, full))
            start = max(0, full - overlap)
        full = end
    out.append((start, full))
    return out


def measure(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """The chunks with ``body`` (text without blanks at the ends), ``n_chars``, ``max_chars`` and ``overlap_chars``.

    ``documents`` names each document's source_format; repeated deliveries count once, and of several formats of a document the
    smallest limit counts. A document without a listed format has no limit. Texts no longer than the smallest of all limits are
    left out before the join. Null texts are left out, repeated chunks count once.
    """
    body = F.btrim(chunks["text"], F.lit(BLANKS))
    smallest = limits.agg(F.min("max_chars")).scalar()
    long = chunks.select("doc_id", "chunk_id", "source_idx", body.alias("body")).filter(F.length("body") > smallest).dropDuplicates()
    of = documents.select("doc_id", "source_format").join(limits.select("source_format", "max_chars", "overlap_chars"), "source_format").filter(F.col("max_chars").isNotNull())
    of = of.groupBy("doc_id").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("limit")).select("doc_id", "limit.*")
    return long.join(of, "doc_id").withColumn("n_chars", F.length("body")).filter(F.col("n_chars") > F.col("max_chars"))


PIECES = "doc_id string, chunk_id int, source_idx int, n_chars int, max_chars int, piece_idx int, start int, stop int, piece string"


def split_oversized(chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every chunk over its document's limit, with their place in the stripped text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, chunk, source, body, limit, overlap in zip(f.doc_id, f.chunk_id, f.source_idx, f.body, f.max_chars, f.overlap_chars):
                for k, (a, b) in enumerate(spans(body, int(limit), 0 if pd.isna(overlap) else int(overlap))):
                    rows.append((doc, chunk, source, len(body), limit, k, a, b, body[a:b]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "source_idx", "n_chars", "max_chars", "piece_idx", "start", "stop", "piece"]).astype({"chunk_id": "Int32", "source_idx": "Int32"})

    return measure(chunks, documents, limits).select("doc_id", "chunk_id", "source_idx", "body", "max_chars", "overlap_chars").mapInPandas(run, PIECES)
