"""Operators on literal rows: cleaning, chunks, routing, fields, sources; nulls, empty tables and further columns."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as T
from vellumspark.functions.myanmar import MARK_ORDER, reorder
from vellumspark.operators import fields, lines, retrieval, routing, workflow
from vellumspark.sources import documents

LINES = "doc_id string, line_idx int, text string"


def rows(*docs):
    return [(d, k, t) for d, texts in docs for k, t in enumerate(texts)]


def test_cleaning_reasons(spark):
    c3 = ["One sentence. Another one."] * 1 + ["Confidential — Internal"] * 4
    df = spark.createDataFrame(rows(("c1", ["Body text A", "1", "Body text B", "2", None, ""]), ("c2", ["Body", "Page 1", "1 of 4", "IV", "Version 1.0 | Page 1 of 4", "End"]), ("c3", c3), ("c4", ["John Smith"] * 4 + ["��x"])), LINES)
    got = {(r.doc_id, r.line_idx): r.reason for r in lines.clean(df).collect()}
    assert [got["c1", k] for k in range(6)] == [None, "page_number", None, "page_number", None, None]
    assert [got["c2", k] for k in range(6)] == [None, "page_number", "page_number", "page_number", "version_page_noise", None]
    assert [got["c3", k] for k in range(5)] == [None] + ["header_repeat"] * 4
    assert [got["c4", k] for k in range(5)] == [None] * 4 + ["garbled"]


def test_replacement_marks(spark):
    df = spark.createDataFrame([("don�t 20� to�1 x�",)], "t string").select(T.repair_replacement_marks(F.col("t")).alias("t"))
    assert df.first().t == "don’t 20– to?1 x?"


def loop_chunks(text, target, overlap):
    import re

    text = " ".join(text.split())
    pieces = [text]
    if len(text) > target:
        units = re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text)
        units = units if len(units) > 1 else text.split(" ")
        pieces, cur = [], ""
        for u in units:
            if cur and len(cur) + len(u) + 1 > target:
                pieces.append(cur)
                cur = u
            else:
                cur = f"{cur} {u}" if cur else u
        pieces.append(cur)
    out = pieces[:1]
    for a, b in zip(pieces, pieces[1:]):
        out.append(f"{a[-overlap:].lstrip()} {b}" if len(a) > overlap else b)
    return out


@pytest.mark.parametrize("text", ["Hello world.", "One is here. Two is there. Three is far. Four is near. " * 4, "word " * 90, "X" * 400 + " tail. More text here."])
def test_chunks_equal_a_plain_loop(spark, text):
    df = spark.createDataFrame([("d", 0, text), ("d", 1, "  "), ("d", 2, None)], LINES)
    got = [r.text for r in lines.chunk_lines(df, 80, 10).orderBy("chunk_id").collect()]
    assert got == loop_chunks(text, 80, 10)


def test_line_joining_and_bullets(spark):
    df = spark.createDataFrame(rows(("d", ["The first part", "goes on here.", "Next one", "", "And more"])), LINES)
    assert [r.text for r in lines.join_lines(df).orderBy("line_idx").collect()] == ["The first part goes on here.", "Next one", "And more"]
    b = spark.createDataFrame([("• one\n• two\nstill two\n– three", 1)], "text string, item int").drop("item")
    assert [r.item for r in lines.bullets(b).orderBy("item_idx").collect()] == ["one", "two still two", "three"]


def test_fields(spark):
    df = spark.createDataFrame(rows(("d", ["Policy Type: Directive", "Effective Date: ", "Effective Date: 01.02.2024", "Approved by the board: HR Department", "no label here", None])), LINES)
    got = {r.label: r.value for r in fields.field_values(spark, df).collect()}
    assert got == {"Type:": "Directive", "Effective Date/Period:": "01.02.2024", "Approved by:": "HR Department"}
    filled = fields.label_rows_filled(spark, df)
    assert filled.count() == 16 and filled.filter("value = '[Missing]'").count() == 13


def test_section_index(spark):
    df = spark.createDataFrame(rows(("d", ["Title", "1. Purpose", "To do it.", "Scope:", "All.", "Exclusions: none at all", "x"])), LINES)
    got = [r.slot_id for r in routing.section_index(spark, df).orderBy("line_idx").collect()]
    assert got == [None, 7, 7, 8, 8, 9, 9]


def test_bm25_prefers_the_text_with_the_terms(spark):
    df = spark.createDataFrame([(1, "scope of this policy who it applies to"), (2, "chocolate cake recipe"), (3, None), (4, "")], "doc_id long, text string")
    top = retrieval.bm25_top(spark, df, "doc_id", 2)
    assert {r.key for r in top.collect()} == {1}


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], "extra") for k in range(120)] + [(500, None, "null")], "vec_id long, embedding array<float>, query_id string").drop("query_id")
    got = {}
    for r in retrieval.cosine_neighbours(df, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = np.round(u @ u[q], 5)
        s[q] = -2
        assert [v for _, v in sorted(got[q])] == sorted(range(120), key=lambda k: (-s[k], k))[:3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], LINES)
    assert lines.clean(empty).count() == lines.chunk_lines(empty).count() == lines.titles(empty).count() == 0
    assert fields.field_values(spark, empty).count() == routing.section_spans(spark, empty).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval.bm25_top(spark, docs, "doc_id").count() == retrieval.tfidf(docs, "doc_id").count() == 0


def test_newest_delivery_wins(spark):
    df = spark.sql("select 1L line_id, 'r' run_id, 1 version_no, 0 line_idx, 'old' text, timestamp'2024-01-01' received_at union all select 1L, 'r', 1, 0, 'new', timestamp'2024-01-02' union all select 2L, 'r', 1, 1, null, null")
    assert {(r.line_idx, r.text) for r in workflow.newest_lines(df).collect()} == {(0, "new"), (1, None)}


def test_mark_order_is_stable():
    assert reorder("က" + "".join(reversed(MARK_ORDER))) == "က" + MARK_ORDER
    assert reorder(reorder("ကို့")) == reorder("ကို့") and reorder(None) is None


def test_corruption_score(spark):
    df = spark.createDataFrame([("Group Policy (2025) - v3",), (("a" + "်" * 3 + "b") * 50,), (("hello") * 30,), ("",), (None,)], "t string").select(T.corruption_score(F.col("t")).alias("s"))
    a, b, c, d, e = [r.s for r in df.collect()]
    assert a == 0 and b > 0.2 and c > 0.05 and d == e == 0


def docx(*blocks):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(b) if isinstance(b, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in b) + "</w:tbl>" for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("eins\nzwei\n".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "b.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9\par " + b"\\u8364?10}")
    (tmp_path / "c.docx").write_bytes(docx("first", [["A", "B"], ["1", "2"]], "last"))
    (tmp_path / "d.doc").write_bytes(b"old")
    got = {r.path.rpartition("/")[2]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].paragraphs == ["eins", "zwei"] and got["a.txt"].reject is None
    assert got["bad.txt"].reject == "UnicodeDecodeError" and got["d.doc"].reject == "unsupported format: doc"
    assert got["b.rtf"].paragraphs == ["Café", "€10"]
    assert got["c.docx"].paragraphs == ["first", "last"] and got["c.docx"].tables == [[["A", "B"], ["1", "2"]]] and got["c.docx"].table_anchors == [0]


def test_old_line_json(spark):
    df = spark.createDataFrame([('["p","one"]',), ('{"kind":"p","slot":3,"text":"two"}',), ("broken",), (None,)], "j string").select(documents.parse_line(F.col("j")).alias("x")).select("x.*")
    got = [(r.kind, r.slot, r.text) for r in df.collect()]
    assert got[0] == ("p", 0, "one") and got[1] == ("p", 3, "two") and got[2][2] is None and got[3][2] is None
