"""Sources of pages: (document_id, page_number, text), one row for each page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import folds
from quire.functions.text import is_blank, lines, trimmed

PAGES = "document_id string, page_number int, text string"
QUESTIONS = "financebench_id string, company string, doc_name string, question_type string, question_reasoning string, question string, answer string, justification string, evidence array<struct<evidence_text: string, doc_name: string, evidence_page_num: int>>"


def from_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line of a text as a page."""
    return docs.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(lines(F.col(text_col))).alias("at", "text")).select("document_id", (F.col("at") + 1).alias("page_number"), "text")


def from_markdown(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", page: int = 1500) -> DataFrame:
    """Paragraphs packed into pages."""
    packed = folds.packed_paragraphs("text", page)
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"))
    return rows.select("document_id", F.posexplode(packed).alias("at", "text")).select("document_id", (F.col("at") + 1).alias("page_number"), trimmed(F.col("text")).alias("text"))


def from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Markdown of web pages: the heading and the paragraphs, one blank line apart."""
    plain = lambda c: F.regexp_replace(c, "<[^>]*>", "")
    html = F.col(html_col)
    title = F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), plain)
    return pages.select(F.col(id_col).cast("string").alias("document_id"), F.concat_ws("\n\n", F.concat(F.lit("# "), plain(title)), paragraphs).alias("text"))


def from_pdf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page of the PDF files under path; needs a PDF library (pypdf) on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"document_id": name, "page_number": range(1, len(texts) + 1), "text": texts})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, PAGES)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; blank lines and unknown fields are passed over."""
    raw = spark.read.text(path).filter(~is_blank(F.col("value")))
    return as_questions(raw.select(F.from_json("value", T.StructType.fromDDL(QUESTIONS)).alias("q")).select("q.*"))


def as_questions(rows: DataFrame) -> DataFrame:
    known = F.create_map(*(x for k in ("company", "question_type", "question_reasoning", "justification") for x in (F.lit(k), F.col(k))))
    return rows.select(
        F.col("financebench_id").alias("question_id"),
        F.col("doc_name").alias("document_id"),
        "question",
        F.col("answer").alias("expected_answer"),
        F.filter(F.transform(F.coalesce("evidence", F.array().cast("array<struct<evidence_text: string, doc_name: string, evidence_page_num: int>>")), lambda e: e["evidence_page_num"]), lambda x: x.isNotNull()).alias("evidence_pages"),
        F.map_filter(known, lambda k, v: v.isNotNull()).alias("metadata"),
    )


def question_documents(rows: DataFrame) -> DataFrame:
    return rows.select("document_id").distinct()
