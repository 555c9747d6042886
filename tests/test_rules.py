"""Rules of headings, values, tables and folds on literal rows."""

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import folds, headings, pipeline, tables, values


def column(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.x for r in df.select("k", f(F.col("text")).alias("x")).orderBy("k").collect()]


def lines(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, k, t) for k, t in enumerate(texts)], "doc_id string, line_idx int, text string")


def test_headings(spark):
    texts = ["1. Purpose: To help.", "Purpose", "purpose of it all is that everyone does " + "x" * 200, "Aim. " + "y" * 130, "Introduction ........ 5", "Policy:", "II. Scope", None, "", "Section 3: Exclusions - none", "Definitions Main ones"]
    assert column(spark, texts, headings.slots_of) == [[7], [7], [], [], [], [6], [8], [], [], [9], [12]]
    assert column(spark, ["3.", "INTRODUCTION", "1. Title here", "Scope", "Scope: a", "2.1. Health Care:", "The plan is here and is good.", "Title\nA body that is far longer than its title is", None], headings.is_section_start) == [True, True, True, True, False, True, False, True, False]
    assert column(spark, ["Benefits are payable by the company which employs the employee, and so on.", "Benefits: x", "plain words", "", None], headings.is_boundary) == [False, True, False, False, False]
    assert column(spark, ["1. Purpose: To help.", "Purpose", "Purpose - To help"], lambda c: headings.without_heading(c, 7)) == ["To help.", "Purpose", "To help"]
    assert column(spark, ["Purpose: To help.", "Purpose", "Purpose. Short.", "Purpose - not a heading", "Purpose - Heading"], lambda c: headings.inline_body(c, 7)) == ["To help.", "", "Short.", "not a heading", ""]
    found = headings.heading_bodies(lines(spark, "Purpose: To help.", "x")).collect()
    assert [(r.slot_id, r.body, r.inline) for r in found] == [(7, "To help.", "To help.")]
    assert [r.line_idx for r in headings.intro_paragraphs(lines(spark, "Short.", "This sentence is long enough to be prose here.", "Purpose", "Another sentence that is long enough for prose.")).collect()] == [1]


@pytest.mark.parametrize(
    ("label", "raw", "want"),
    [
        ("Type:", "Information Security Policy", "Policy"), ("Type:", "Employee Code of Conduct", "Code of Conduct"), ("Type:", "provides a policy", None), ("Functional Area(s):", "Human Resources and Finance", "Human Resources, Finance"),
        ("Functional Area(s):", "the staff", None), ("Policy Title:", "Leave: rules", None), ("Policy Title:", "Annual Leave", "Annual Leave"), ("Policy Title:", "Scope of leave", None), ("Last Reviewed:", "Q3 2025", "Q3 2025"),
        ("Last Reviewed:", "Annually.", "Annually."), ("Last Reviewed:", "soon", None), ("Supersedes:", '"HR-001"', "HR-001"), ("Supersedes:", "v1.0; the old one", "v1.0"), ("Responsible Function Officer(s):", "Chief Officer & is he", "Chief Officer"),
        ("Applicable Sector(s):", "Retail & Health", "Retail & Health"), ("Brief Description:", "1. Purpose:", None), ("Approved by:", "x" * 300, "x" * 200), ("Policy Number:", "  ", None), ("Policy Number:", None, None),
    ],
)
def test_values_of_labels(spark, label, raw, want):
    df = spark.createDataFrame([(label, raw)], "label string, raw string")
    assert df.select(values.checked_value(F.col("label"), F.col("raw")).alias("x")).first().x == want


def test_cross_field_rules_tails_and_lost_values(spark):
    v = spark.createDataFrame([("d", "Applies to:", "All staff, Finance"), ("d", "Functional Area(s):", "Finance"), ("d", "Policy Title:", "Group Policy – Leave Rules"), ("d", "Brief Description:", "group policy leave rules")], "doc_id string, label string, value string")
    assert {r.label: (r.value, r.changed) for r in values.refined(v).collect()} == {"Applies to:": ("All staff", True), "Functional Area(s):": ("Finance", False), "Policy Title:": ("Leave Rules", True), "Brief Description:": (None, True)}
    assert column(spark, ["Policy No.: CL_04/26) \ufffd", "Policy No.: CL_04/26", "no label)", None], values.clean_tail) == ["Policy No.: CL_04/26", "Policy No.: CL_04/26", "no label)", None]
    c = spark.createDataFrame([("d", [(0, "HR-7", "x"), (1, "Page 1 of 2", "x"), (2, "Type:", "x"), (3, "again", "x"), (4, "again", "x"), (5, "again", "x")])], "doc_id string, dropped array<struct<index:int,text:string,reason:string>>")
    assert [(r["index"], r.text) for r in values.lost_values(c).collect()] == [(0, "HR-7")]


def test_tables(spark):
    down = [["Field", "Value"], ["Type", "Policy"], ["Owner", "HR"]]
    across = [["Version", "Approved by", "Effective date"], ["V3", "Board", "2024"]]
    excluded = [["Exclusion", "Reason", "Notes"], ["Item A", "Not eligible", "Out of scope"], ["Item B", "Excluded", "Legacy"]]
    general = [["Task", "Frequency", "Priority"], ["Lift", "Monthly", "High"], ["Roof", "Weekly", "Low"]]
    rows = [("d", 9, 0, excluded), ("d", 10, 0, excluded), ("d", 14, 0, general), ("d", 10, 1, down), ("d", 10, 2, across), ("d", 10, 3, []), ("d", 10, 4, [[None, " "]]), ("d", 8, 0, None), ("d", 14, 1, [["Who", "What", "When"], ["a", "b", "c"]])]
    t = spark.createDataFrame(rows, "doc_id string, slot_id int, table_idx int, cells array<array<string>>")
    kinds = {(r.slot_id, r.table_idx): (r.shaped, r.label_table, r.general, r["class"]) for r in tables.described(t).collect()}
    assert kinds[9, 0] == (True, False, False, 9) and kinds[14, 0] == (True, False, True, -1) and kinds[10, 1][1] and kinds[10, 2][1] and not kinds[10, 3][0] and not kinds[10, 4][0] and not kinds[8, 0][0]
    to = {(r.slot_id, r.table_idx): r.to_slot for r in tables.routed(t).collect()}
    assert to[9, 0] == 9 and to[10, 0] is None and to[14, 0] is None and to[14, 1] == 14 and to[10, 1] is None
    assert {(r.table_idx, r.row_idx, r.text) for r in tables.label_lines(t).collect()} == {(1, 0, "Field: Value"), (1, 1, "Type: Policy"), (1, 2, "Owner: HR"), (2, 0, "Version: V3"), (2, 1, "Approved by: Board"), (2, 2, "Effective date: 2024")}
    assert {(r.slot_id, r.named_slot, r.hits) for r in tables.header_hits(spark, t).collect()} == {(9, 9, 1), (10, 9, 1)}


def test_folds(spark):
    text = lambda f, *ls: [r.text for r in f(lines(spark, *ls)).orderBy("para_idx").collect()]
    assert text(folds.continued, "Type: Policy.", "to all sectors under City Holdings") == ["Type: Policy. to all sectors under City Holdings"]
    assert text(folds.continued, "Type: Policy.", "Brief Description: x") == ["Type: Policy.", "Brief Description: x"]
    assert text(folds.stitched, "a line", "goes on", "But not this", None, "after a break") == ["a line goes on", "But not this", "after a break"]
    assert text(folds.blocks, "A line", "Goes on too.", "Ends here", "", "Type: x") == ["A line Goes on too.", "Ends here", "Type: x"]
    assert folds.blocks(lines(spark)).count() == 0


def test_fifteen_sections(spark):
    out = pipeline.document_sections(spark, lines(spark, "Type: Policy", "Policy Title: Annual Leave", "Purpose", "To help the staff.", "1", "Scope: all", None))
    got = {r.slot_id: (r.backend, r.text) for r in out.collect()}
    assert len(got) == 15 and got[1] == ("label_row", "Type: Policy\nPolicy Title: Annual Leave") and got[7] == ("heading", "Purpose\nTo help the staff.") and got[15] == ("logo", None) and got[9] == ("missing", pipeline.NOT_FOUND)
    assert {r.name for r in pipeline.checks(out).filter("ok").collect()} == {"fifteen_sections", "has_title", "some_heading", "nothing_garbled"}
