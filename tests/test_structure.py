"""Detectors, trees and folds on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quire.config import IndexingConfig
from quire.functions import folds
from quire.operators import detect, tree

CONFIG = IndexingConfig(min_header_count=2)


def pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "document_id string, page_number int, text string")


def found(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows.orderBy("entry_pos").collect()]


def test_contents_with_leaders(spark):
    got = detect.by_contents(pages(spark, "Contents\nIntroduction . . . . 1\nMethods ...... 4\n2.6.1 Results\t9", *["text"] * 12), CONFIG)
    assert found(got, "title", "page_number", "physical_index", "level") == [("Introduction", 1, 2, 1), ("Methods", 4, 5, 1), ("2.6.1 Results", 9, 10, 3)]


def test_contents_at_the_end_and_negatives(spark):
    got = detect.by_contents(pages(spark, *["text"] * 9, "Table of Contents\nA ..... 1\nB ..... 5\nC ..... 8"), CONFIG)
    assert found(got, "physical_index", "last_content_page") == [(1, 9), (5, 9), (8, 9)]
    assert detect.by_contents(pages(spark, "Name   12\nAge 4", "x"), CONFIG).count() == 0


def test_wide_space_suffix_and_long_lines(spark):
    got = detect.by_contents(pages(spark, "TABLE OF CONTENTS\nSite   history   3\nSUMMARY .... 1-1\nWide title   7...\nSite map 9\n" + "word " * 20_000 + "  5", *["x"] * 9), CONFIG)
    assert ("SUMMARY", 1) in found(got, "title", "page_number") and ("Wide title", 7) in found(got, "title", "page_number") and ("Site map", 9) in found(got, "title", "page_number")


def test_headers(spark):
    text = "# One\n```\n# code\n```\nTitle\n===\npara\nSub\n---\n\nNot\n---\n1.2 Part\n**Bold**\n===\n===\n==="
    got = found(detect.by_headers(pages(spark, text), CONFIG), "title", "level")
    # an underline makes the line above a heading before its stars are looked at; the next "===" is one over the last
    assert got == [("One", 1), ("Title", 1), ("Sub", 2), ("Part", 2), ("**Bold**", 1), ("===", 1)]
    got = found(detect.by_headers(pages(spark, "**Bold**\nwith **some** words\n  **Last**  "), CONFIG), "title", "level")
    assert got == [("Bold", 1), ("Last", 1)]


def test_setext_runs_match_a_sequential_reader(spark):
    random.seed(3)
    texts = ["\n".join(random.choice(["a", "===", "", "---", "```", "# h", "2 b"]) for _ in range(12)) for _ in range(60)]

    def read(text):
        import re

        lines, out, i, code = text.split("\n"), [], 0, False
        while i < len(lines):
            line, nxt = lines[i], lines[i + 1] if i + 1 < len(lines) else ""
            if line.startswith("```"):
                code = not code
            elif not code and line.startswith("# "):
                out.append((line[2:], 1))
            elif not code and line.strip() and (nxt == "===" or (nxt == "---" and i and lines[i - 1].strip())):
                out.append((line, 1 if nxt == "===" else 2))
                i += 1
            elif not code and re.match(r"\d+ ", line):
                out.append((line[2:], 1))
            i += 1
        return out

    rows = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")
    got = {}
    for r in detect.header_lines(rows).orderBy("document_id", "line_pos").collect():
        got.setdefault(int(r.document_id), []).append((r.title, r.level))
    assert all(got.get(i, []) == read(t) for i, t in enumerate(texts))


def test_flat_and_groups(spark):
    rows = pages(spark, "x" * 10, "x" * 10, "x" * 10)
    assert found(detect.by_flat_pages(rows, IndexingConfig(max_node_text_length=20)), "title") == [("Pages 1-2",), ("Page 3",)]
    groups = detect.page_groups(pages(spark, *["x" * 40] * 4), IndexingConfig(page_group_max_tokens=20, page_group_overlap=1))
    assert [r.page_numbers for r in groups.orderBy("group_no").collect()] == [[1, 2], [2, 3], [3, 4]]


def test_patterns(spark):
    rows = pages(spark, "CHAPTER 1: Introduction\na\nb\nCHAPTER 2: Methods\nc\nd")
    assert detect.valid_patterns(rows, [(r"^CHAPTER\s+\d+:\s+(.+)$", 1), ("^(.)$", 1), ("(", 1), ("^x$", 1)]) == [(r"^CHAPTER\s+\d+:\s+(.+)$", 1)]
    assert found(detect.by_patterns(rows, [(r"^CHAPTER\s+\d+:\s+(.+)$", 1)], CONFIG), "title") == [("Introduction",), ("Methods",)]


def entries(spark, *rows):
    return spark.createDataFrame([("d", i, t, None, p, lv, None, "X", None) for i, (t, p, lv) in enumerate(rows, 1)], "document_id string, entry_pos int, title string, page_number int, physical_index int, level int, structure string, method string, last_content_page int")


def test_tree(spark):
    nodes = tree.build(entries(spark, ("A", 6, 1), ("B", 6, 2), ("C", 6, 2), ("D", 8, 1)), pages(spark, *[f"p{i}" for i in range(1, 10)]))
    got = [(r.node_id, r.parent_id, r.title, r.start_page, r.end_page, r.text) for r in nodes.orderBy("preorder").collect()]
    assert got == [("0001", None, "Front Matter", 1, 5, "p1\np2\np3\np4\np5"), ("0002", None, "A", 6, 7, None), ("0003", "0002", "B", 6, 6, "p6"), ("0004", "0002", "C", 6, 7, "p6\np7"), ("0005", None, "D", 8, 9, "p8\np9")]


def test_split_matches_a_sequential_reader(spark):
    random.seed(5)
    texts = ["".join(random.choice("ab\n\n ") for _ in range(random.randint(0, 200))) for _ in range(80)]

    def read(text, most):
        out, at = [], 0
        while at < len(text):
            end = min(at + most, len(text))
            if end < len(text):
                half = at + (end - at) // 2
                blank, line = text.rfind("\n\n", 0, end + 1), text.rfind("\n", 0, end)
                end = blank + 2 if blank >= half else line + 1 if line >= half else end
            out.append(text[at:end])
            at = end
        return out

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", folds.split_text("text", 23).alias("p")).collect()
    assert all(r.p == read(texts[r.i], 23) for r in got)


def test_offset_and_metadata(spark):
    rows = entries(spark, ("A", 5, 1), ("B", 8, 1), ("C", None, 1), ("D", 12, 1)).withColumn("page_number", F.expr("entry_pos * 2"))
    got = tree.apply_offset(rows, pages(spark, *["x"] * 10))
    # printed pages 2, 4, 6, 8: offsets 3, 4 and 4, so the open entry moves by 4
    assert [r.physical_index for r in got.orderBy("entry_pos").collect()] == [5, 8, 10, 12]
    tied = entries(spark, ("A", 5, 1), ("B", 8, 1), ("C", None, 1)).withColumn("page_number", F.expr("entry_pos * 2"))
    assert [r.physical_index for r in tree.apply_offset(tied, pages(spark, *["x"] * 10)).orderBy("entry_pos").collect()] == [5, 8, 9]
    assert [r.physical_index for r in tree.apply_offset(tied, pages(spark, *["x"] * 7)).orderBy("entry_pos").collect()] == [5, 8, 7]
    nodes = tree.build(entries(spark, ("A", 1, 1), ("B", 1, 2), ("C", 3, 2)), pages(spark, *["x"] * 5))
    assert tuple(tree.metadata(nodes, pages(spark, *["x"] * 5)).first())[1:] == (3, 2, 5)


def test_config():
    with pytest.raises(ValueError):
        IndexingConfig(verification_accuracy_threshold=1.5)
    with pytest.raises(ValueError):
        IndexingConfig(max_node_text_length=0)
    assert IndexingConfig(page_group_overlap=0).page_group_overlap == 0
