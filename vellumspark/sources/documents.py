"""Document files as tables: plain text, RTF and DOCX, and the JSON form of edited lines.

Files are read with Spark's binaryFile source, one row a file, and split to ordered paragraphs; formats that can't be read come out as rejects
with the reason, never as a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCUMENT = "path string, source_format string, source_sha256 string, paragraphs array<string>, tables array<array<array<string>>>, table_anchors array<int>, reject string"
#: Control words of RTF that stand for characters, and groups that hold no text.
RTF_CHARACTERS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer"}
RTF_TOKEN = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)


def rtf_text(data: bytes) -> str:
    """The text of an RTF file: groups that hold no text are skipped, escaped bytes are cp1252."""
    out: list[str] = []
    stack: list[bool] = []
    hidden = False
    skip = 0
    for word, number, byte, symbol, brace, char in RTF_TOKEN.findall(data.decode("latin-1")):
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif symbol == "*" or word in RTF_HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "u":
            out.append(chr(int(number or 0) % 65536))
            skip = 1
        elif word:
            out.append(RTF_CHARACTERS.get(word, ""))
        elif byte or symbol or char:
            if skip:
                skip -= 1
                continue
            out.append(bytes.fromhex(byte).decode("cp1252", "replace") if byte else symbol if symbol in ("{", "}", "\\") else " " if symbol == "~" else char)
    return "".join(out)


def docx_blocks(data: bytes) -> tuple[list[str], list[list[list[str]]], list[int]]:
    """Paragraphs, tables, and for each table the index of the paragraph before it (-1 at the start)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_XML}body")
    text = lambda p: "".join(t.text or "" if t.tag == f"{WORD_XML}t" else "\t" if t.tag == f"{WORD_XML}tab" else "\n" if t.tag == f"{WORD_XML}br" else "" for t in p.iter())
    paragraphs: list[str] = []
    tables: list[list[list[str]]] = []
    anchors: list[int] = []
    for block in body if body is not None else ():
        if block.tag == f"{WORD_XML}p":
            paragraphs.append(text(block))
        elif block.tag == f"{WORD_XML}tbl":
            cell = lambda c: "\n".join(x for x in map(text, c.iter(f"{WORD_XML}p")) if x.strip())
            tables.append([[cell(c) for c in row.findall(f"{WORD_XML}tc")] for row in block.findall(f"{WORD_XML}tr")])
            anchors.append(len(paragraphs) - 1)
    return paragraphs, tables, anchors


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path (or that match its pattern), by their extension; ``reject`` names why a file couldn't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("source_format"), F.sha2("content", 256).alias("source_sha256"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, kind, sha, content in zip(f.path, f.source_format, f.source_sha256, f.content):
                paragraphs, tables, anchors, reject = [], [], [], None
                try:
                    if kind == "txt":
                        paragraphs = bytes(content).decode("utf-8").splitlines()
                    elif kind == "rtf":
                        paragraphs = rtf_text(bytes(content)).split("\n")
                    elif kind == "docx":
                        paragraphs, tables, anchors = docx_blocks(bytes(content))
                    else:
                        reject = f"unsupported format: {kind}"
                except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    reject = f"{type(e).__name__}"
                rows.append((path, kind, sha, paragraphs, tables, anchors, reject))
            yield pd.DataFrame(rows, columns=["path", "source_format", "source_sha256", "paragraphs", "tables", "table_anchors", "reject"])

    return files.mapInPandas(run, DOCUMENT)


LINE = "kind string, slot int, text string, html string"


def lines_json(kind: Column, slot: Column, text: Column, html: Column) -> Column:
    """One edited line as JSON."""
    return F.to_json(F.struct(kind.alias("kind"), slot.alias("slot"), text.alias("text"), html.alias("html")))


def parse_line(c: Column) -> Column:
    """An edited line from JSON: an object, or the older form of an array of kind and text."""
    old = F.from_json(c, "array<string>")
    new = F.from_json(c, LINE)
    is_old = F.ltrim(c).startswith("[")
    return F.when(is_old, F.struct(F.get(old, 0).alias("kind"), F.lit(0).alias("slot"), F.get(old, 1).alias("text"), F.lit(None).cast("string").alias("html"))).otherwise(new)


def source_text(lines: DataFrame) -> DataFrame:
    """(run_id, version_no, text): the lines of a version as text, unrouted ones first and then section by section under its title."""
    from ..operators.workflow import section_titles, slot_texts

    titled = slot_texts(lines).withColumn("block", F.when(F.col("slot") == 0, F.col("text")).otherwise(F.concat(F.coalesce(F.try_element_at(section_titles(), F.col("slot")), F.lit("")), F.lit("\n"), F.col("text"))))
    blocks = F.array_sort(F.collect_list(F.struct("slot", "block")))
    return titled.groupBy("run_id", "version_no").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("text"))


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet by partition columns, one shuffle on them so that no directory gets a file from every task."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
