"""Document files as frames: plain text, Markdown, DOCX and PDF (whose pages are also a data source of their own, see pdf.py).

Files are read as binary rows through Spark, so any store that Spark reads will do, and parsed in Arrow batches on the executors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pdf import parse_pdf

SCHEMA = "path string, file_type string, text string, page_count int, page_map map<int,int>, tables array<struct<caption:string,cells:array<array<string>>>>, error string"
#: Extensions and MIME types of each kind of file.
TYPES = {
    "txt": ("txt", "text", "text/plain"),
    "md": ("md", "markdown", "text/markdown"),
    "docx": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "pdf": ("pdf", "application/pdf"),
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Characters that a page of a DOCX file is taken to have.
PAGE = 3000


def file_type(name: Column, mime: Column | None = None) -> Column:
    """The kind by extension, else by MIME type, else null."""
    known = {alias: kind for kind, aliases in TYPES.items() for alias in aliases}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    by_name = table[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))]
    return by_name if mime is None else F.coalesce(by_name, table[F.lower(mime)])


def parse_docx(data: bytes) -> tuple[str, int, list]:
    """Non-blank paragraphs outside tables, an estimate of the pages, and the tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    paragraphs = [t for node in body.findall(f"{_W}p") if (t := text_of(node)).strip()]
    tables = [{"caption": "", "cells": [[text_of(cell).strip() for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]} for table in body.findall(f"{_W}tbl")]
    text = "\n".join(paragraphs)
    return text, max(1, len(text) // PAGE), tables


def parse(kind: str | None, data: bytes) -> dict:
    out = {"text": None, "page_count": None, "page_map": {}, "tables": [], "error": None}
    try:
        if kind in ("txt", "md"):
            out |= {"text": data.decode("utf-8", "ignore"), "page_count": 1, "page_map": {1: 0}}
        elif kind == "docx":
            out |= dict(zip(("text", "page_count", "tables"), parse_docx(data), strict=True)) | {"page_map": {1: 0}}
        elif kind == "pdf":
            out |= dict(zip(("text", "page_count", "page_map", "tables"), parse_pdf(data), strict=True))
        else:
            out["error"] = "unsupported file type"
    except Exception as problem:  # a broken file is a row with its error, not a failed job
        out["error"] = f"{type(problem).__name__}: {problem}"[:500]
    return out


def read_files(spark: SparkSession, path: str, max_megabytes: int = 50) -> DataFrame:
    """One row per file of at most so many megabytes under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_megabytes << 20)
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    """Binary files (path, content) as documents; works on a stream too."""
    columns = [c.split(" ")[0] for c in ("path", "file_type", "text", "page_count", "page_map", "tables", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, "file_type": k} | parse(k, bytes(c)) for p, k, c in zip(batch["path"], batch["kind"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", file_type(F.col("path")).alias("kind"), "content").mapInPandas(run, SCHEMA)


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a labelled JSON dataset: id, claim_a, claim_b, label, category, difficulty."""
    schema = "version string, description string, labels array<string>, pairs array<struct<id:string,claim_a:string,claim_b:string,label:string,category:string,difficulty:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("pairs").alias("p")).select("p.*")
