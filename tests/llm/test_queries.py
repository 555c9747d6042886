"""The pN_ queries on small tables with nulls, empty and repeated rows and further columns, and on empty tables."""

import datetime

import pytest

from vellumspark.llm.registry import ORACLE, QUERIES

T0 = datetime.datetime(2024, 1, 1)
SCHEMAS = {
    "extracted_documents": "doc_id string, run_id string, source string, source_format string, source_sha256 string, lang string, paragraphs array<string>, extracted_at timestamp_ntz, text string",
    "cleaned_documents": "doc_id string, paragraphs array<string>, dropped array<struct<index:int,text:string,reason:string>>, original_indices array<int>, source_format string, source_sha256 string",
    "section_slots": "doc_id string, slot_id int, status string, content_paragraphs array<string>, content_tables array<array<array<string>>>, placed_paragraphs array<string>, routing_rule string, text string",
    "slot_assignments": "doc_id string, slot_id int, chunk_text string, chunk_id int, source_idx int, score double, backend string, table_rows array<array<string>>, assigned_at timestamp_ntz",
    "chunks": "doc_id string, chunk_id int, source_idx int, text string, max_chars int, body string",
    "rich_paragraphs": "line_id long, run_id string, version_no int, line_idx int, kind string, slot int, text string, html string, received_at timestamp_ntz, form string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, ids string",
    "subject_areas": "subject_id int, subject string, description string",
    "subject_labels": "doc_id long, subject_id int, annotator string",
    "mix_targets": "source string, weight double, max_repeats int",
    "chunk_limits": "source_format string, max_chars int, overlap_chars int",
}

EN = ["The unit head keeps the signed copy of the plan.", "Nobody may change the register without consent.", "Earlier versions stay available for reference."]
DE = ["Die Leitung bewahrt die unterschriebene Fassung auf.", "Niemand darf das Register ohne Zustimmung ändern.", "Frühere Fassungen bleiben länger einsehbar."]


def rows():
    docs = [(f"d{k}", f"r{k}", "mail" if k % 3 else None, ("pdf", "txt", None)[k % 3], None, ("en", "de-AT")[k % 2], (EN, DE)[k % 2] * 3 + [None, "", "1"], T0, "x") for k in range(30)]
    docs += docs[:2]
    docs += [("none", "r", None, "pdf", None, "en", None, T0, None), ("empty", "r", None, "pdf", None, None, [], T0, None), (None, "r", None, None, None, "en", EN, T0, None)]
    docs += [("wrong", "r", "mail", "pdf", None, "de", [*EN, "Sie gilt. " + DE[0]], T0, None), ("bad", "r", "mail", "pdf", None, "de", [*DE, DE[1].encode().decode("cp1252"), "ｅｉｎ Ｗｏｒｔ"], T0, None)]
    cleaned = [(d[0], d[6], None, None, d[3], None) for d in docs]
    slots = [(f"d{k}", 1, "Found", [(EN, DE)[k % 2][0], (EN, DE)[k % 2][1][:20], None, ""], None, None, None, None) for k in range(30)]
    slots += [("d0", 2, "Skipped", None, None, None, None, None), ("d0", 3, "Found", [], None, None, None, None), ("d0", 1, "Found", slots[0][3], None, None, None, None), (None, None, None, [EN[0]], None, None, None, None)]
    assigned = [(f"d{k}", 1, (EN, DE)[k % 2][0] + "\n" + (EN, DE)[k % 2][1], 0, None, 0.5, None, None, T0) for k in range(30)] + [("d1", 2, None, None, None, None, None, None, None)]
    chunks = [("d0", 0, 0, "A sentence here. " * 30, 1, "z"), ("d0", 0, 0, "A sentence here. " * 30, 1, "z"), ("d1", 1, None, " \t" + "x" * 20 + "\n", 1, None), ("d1", 2, None, None, None, None), ("d2", 3, 0, "y" * 900, None, None), ("d4", 4, 0, "", None, None), ("zz", 5, 0, "w" * 900, None, None), ("d3", None, 0, "v" * 5000, None, None)]
    rich = [(1, "r", 1, 0, "p", 1, "the рlan", None, T0, "f"), (1, "r", 1, 0, "p", 1, "the рlan", None, T0, "f"), (2, "r", 1, 1, "p", 1, "plain", None, T0, None), (3, "r", 1, 2, "divider", None, None, None, T0, None), (4, "r", 1, 3, "p", 1, "non­break", None, T0, None), (5, "r", 1, 4, "p", 1, "", None, T0, None)]
    text = lambda a, b: f"Title\n{a} {EN[0]}\n{b} {EN[1]}"
    corpus = [(k, text(f"The unit head reviews the {('tax return', 'relay team')[k % 2]}.", f"Questions about the {('tax return', 'relay team')[k % 2]} go to the desk."), "en", ("a", "b", "c", None)[k % 4], 1, "i") for k in range(80)]
    corpus += [(100, None, None, "a", None, None), (101, "", "en", "a", 0, None), (102, "  ", None, None, 2, None), (103, "<|endoftext|> " + "long " * 5000, "en", "b", None, None)]
    return {
        "extracted_documents": docs, "cleaned_documents": cleaned + cleaned[:1], "section_slots": slots, "slot_assignments": assigned, "chunks": chunks, "rich_paragraphs": rich, "documents": corpus,
        "subject_areas": [(1, "finance", None), (2, "sport", None)], "subject_labels": [(k, k % 2 + 1, None) for k in range(60)] + [(0, 1, "again"), (999, 1, None), (3, None, None)],
        "mix_targets": [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("nowhere", 0.1, 1)], "chunk_limits": [("pdf", 100, 20), ("txt", 300, 0), (None, 5, 1)],
    }


def write(spark, path, data):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(data.get(name, []), schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), rows())


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), {})


def got(spark, name, path):
    df = QUERIES[name](spark, path)
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, name):
    assert QUERIES[name](spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_small_tables(spark, small, name):
    df = QUERIES[name](spark, small)
    out = [str(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(out) == len(set(out))


def test_p1(spark, small):
    found = got(spark, "p1_found", small)
    assert {x for x in found if x[1] and x[1] != "None"} >= {("section_slots", f"d{k}", 1, 1) for k in range(30)}
    assert not any(x[3] == 0 and x[0] == "section_slots" for x in found)


def test_p2(spark, small):
    found = got(spark, "p2_found", small)
    assert ("wrong", -1, "en") in found and ("wrong", 3, "de") in found
    assert not any(x[0] in ("d0", "d1", "none", "empty", "bad") for x in found)


def test_p3_and_p4(spark, small):
    assert {x for x in got(spark, "p3_found", small)} == {("extracted_documents", "bad", 3), ("cleaned_documents", "bad", 3)}
    assert got(spark, "p4_found", small) == {("rich_paragraphs", "1", 0), ("rich_paragraphs", "4", 0), ("extracted_documents", "bad", 4)}
    repaired = {r.repaired for r in QUERIES["p3_repaired"](spark, small).collect()}
    assert repaired == {DE[1]}


def test_p4_forms_are_of_every_text(spark, small):
    form = {(r.tab, r.row_key, r.para_idx): r.form for r in QUERIES["p4_forms"](spark, small).collect()}
    want = {("extracted_documents", d[0], k) for d in rows()["extracted_documents"] for k, t in enumerate(d[6] or ()) if t is not None}
    assert set(form) == want | {("rich_paragraphs", str(r[0]), 0) for r in rows()["rich_paragraphs"] if r[6] is not None}
    assert form["extracted_documents", "bad", 4] == "ein Wort" and form["rich_paragraphs", "1", 0] == "the plan"
    changed = {(r.tab, r.row_key, r.para_idx): r.form for r in QUERIES["p4_changed"](spark, small).collect()}
    assert changed.items() <= form.items()


def test_p5(spark, small):
    assert got(spark, "p5_found", small) == {("d0", 0), ("d3", None)}
    assert "p5_found" in ORACLE


def test_p6(spark, small):
    ids = {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, small).collect()}
    assert len(ids) == 84 and ids[100] == ids[101] == [] and 50256 not in ids[103]


def test_p7(spark, small):
    mixed = QUERIES["p7_mix"](spark, small).collect()
    caps = {"a": 1, "b": 2, "c": 3}
    assert mixed and all(1 <= r.copies <= caps[r.source] for r in mixed) and not {r.doc_id for r in mixed} & {100, 101, 102}
    share = {r.source: r.share for r in QUERIES["p7_shares"](spark, small).collect()}
    reached = {r.source: r.reached for r in QUERIES["p7_shares"](spark, small).collect()}
    assert reached == {"a": True, "b": True, "c": True, "nowhere": False}
    assert share["nowhere"] == 0 and abs(share["a"] - 0.5 / 0.9) < 0.06 and abs(share["c"] - 0.1 / 0.9) < 0.06


def test_p8(spark, small):
    found = got(spark, "p8_found", small)
    right = {(k, ("finance", "sport")[k % 2]) for k in range(80)}
    assert len(found & right) >= 76 and len(found - right) <= 4
