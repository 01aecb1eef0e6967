"""Section trees as adjacency rows.

nodes: document_id, node_id, parent_id, preorder, depth, level, title, summary, start_page, end_page, is_leaf,
text, path (titles from the root to the node), path_ids.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.functions import folds
from quire.functions.arrow import ARROW_BYTES, bounded_batches, paged, rows_of
from quire.functions.arrow import span_texts as _joined

NODE = ["document_id", "node_id", "parent_id", "preorder", "depth", "level", "title", "summary", "start_page", "end_page", "is_leaf", "text", "path", "path_ids"]
_LATE = 2147483647
#: Rows of nodes that a worker holds at once.
ROWS = 8192
#: Leaves of one document that get a page's text from one copy of it.
BLOCK = 4096


_BODY = "document_id string, node_id string, parent_id string, preorder int, depth int, level int, title string, summary string, start_page int, end_page int, is_leaf boolean, path array<string>, path_ids array<string>"


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each entry of each document; rows come in page order, ROWS of them at a time."""
    text, number = pa.string(), pa.int32()
    kinds = [text, text, text, number, number, number, text, text, number, number, pa.bool_(), pa.list_(text), pa.list_(text)]
    names = [c.split()[0] for c in _BODY.split(", ")]
    held: list[list] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)
    for batch in batches:
        entries = batch.column(3).flatten()
        titles, known = entries.field("title"), pc.is_valid(entries.field("at")).to_pylist()
        levels, starts = (entries.field(c).fill_null(1).to_pylist() for c in ("level", "at"))
        hi = 0
        for document, last, front, n in zip(*(batch.column(c).to_pylist() for c in range(3)), pc.list_value_length(batch.column(3)).to_pylist(), strict=True):
            at, hi = hi, hi + n
            title, level, start, known_ = titles[at:hi], levels[at:hi], starts[at:hi], known[at:hi]
            if front:
                held.append([document, "0001", None, 1, 1, 1, "Front Matter", None, 1, start[0] - 1, True, ["Front Matter"], ["0001"]])
            up, end, leaf = array("i", [-1]) * n, array("i", [last]) * n, bytearray(b"\x01") * n
            open_: list[int] = []  # the entry before and its ancestors
            for i in range(n):
                while open_ and level[open_[-1]] >= level[i]:
                    j = open_.pop()
                    end[j] = max((start[i] if known_[i] else start[j]) - 1, start[j])
                if open_:
                    up[i] = open_[-1]
                    leaf[up[i]] = 0
                open_.append(i)
            paths: dict[int, tuple[list, list]] = {-1: ([], [])}  # of those that hold others
            for lo in range(0, n, ROWS):
                for i, name in enumerate(title[lo : lo + ROWS].to_pylist(), lo):
                    ident = f"{i + 1 + front:04d}"
                    above, ids = paths[up[i]]
                    path, ids = [*above, name], [*ids, ident]
                    if not leaf[i]:
                        paths[i] = path, ids
                    held.append([document, ident, ids[-2] if len(ids) > 1 else None, i + 1 + front, len(path), level[i], name, None, start[i], end[i], bool(leaf[i]), path, ids])
                if len(held) >= ROWS:
                    yield made()
                    held.clear()
    if held:
        yield made()


def sections(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries in page order as nested page ranges, with front matter in front; no text yet.

    One shuffle brings a document's entries together; nesting and ends come from one pass with a stack: the parent
    is the nearest earlier entry of a lower level, and a section ends before the next entry of its level or lower.
    """
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("max_page"))
    place = F.coalesce("physical_index", "page_number")
    e = F.struct(F.coalesce(place, F.lit(_LATE)).alias("k"), "entry_pos", "title", "level", place.alias("at"))
    docs = entries.groupBy("document_id").agg(F.array_sort(F.collect_list(e)).alias("e"), F.max("last_content_page").alias("cap")).join(last, "document_id", "left")
    first = F.coalesce(F.expr("e[0].at"), F.lit(1))
    front = F.when(first > 1, 1).otherwise(0)
    docs = docs.withColumn("front", front).withColumn("last", F.coalesce("cap", "max_page", F.lit(0)))
    bounded_batches(pages.sparkSession)
    return docs.select("document_id", "last", "front", "e").mapInArrow(_nested, _BODY)


def span_texts(leaves: DataFrame, pages: DataFrame, carried: str = "block") -> DataFrame:
    """(document_id, start_page, end_page, carried, text): the text of each page range once for every value carried.

    The pages of a document come together by one shuffle, and one pass joins the texts of its ranges: however many
    leaves share a page, its text is handled once, and sent as often as carried has values.
    """
    bounded_batches(pages.sparkSession)
    if "page_pos" in pages.columns:
        pages = pages.groupBy("document_id", "page_number").agg(F.max_by("text", "page_pos").alias("text"))
    spans = leaves.groupBy("document_id", "start_page", "end_page").agg(F.collect_set(carried).alias("c"))
    spans = spans.groupBy("document_id").agg(F.collect_list(F.struct("start_page", "end_page", "c")).alias("s"))
    docs = spans.join(by_document(pages), "document_id")
    rows = docs.mapInArrow(_span_texts, f"document_id string, start_page int, end_page int, c array<{dict(leaves.dtypes)[carried]}>, text string")
    return rows.select("document_id", "start_page", "end_page", F.explode("c").alias(carried), "text")


def by_document(pages: DataFrame) -> DataFrame:
    """(document_id, p): the pages of each document."""
    return pages.filter("page_number is not null").groupBy("document_id").agg(F.collect_list(F.struct("page_number", "text")).alias("p"))


def _span_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        document, spans, pages = batch.columns
        (start, end, carried), (number, text) = spans.flatten().flatten(), pages.flatten().flatten()
        row = rows_of(spans)
        texts = _joined(paged(rows_of(pages), number), text, paged(row, start), paged(row, end))
        size, lo = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0
        while lo < len(texts):  # a few megabytes at a time
            hi = max(int(np.searchsorted(size, (size[lo - 1] if lo else 0) + ARROW_BYTES, "right")), lo + 1)
            columns = [document.take(pa.array(row[lo:hi])), start[lo:hi], end[lo:hi], carried[lo:hi], texts[lo:hi].cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["document_id", "start_page", "end_page", "c", "text"])
            lo = hi


def attach_text(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of nodes with the text of their pages, for leaves.

    A text goes once to each BLOCK of leaves of a document that show it, so leaves that share a long page are
    spread over tasks, and the text is repeated only in what comes out.
    """
    keys = ["document_id", "start_page", "end_page", "block"]
    rows = rows.drop("text").withColumn("block", F.when(F.col("is_leaf") & (F.col("end_page") >= F.col("start_page")), F.floor(F.col("preorder") / BLOCK)))
    texts = span_texts(rows.filter("block is not null").select(*keys), pages)
    return rows.join(texts, keys, "left").drop("block")


def with_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Leaves get the texts of their pages, one below the other; null if that is empty."""
    return attach_text(nodes, pages).select(*NODE)


def build(entries: DataFrame, pages: DataFrame) -> DataFrame:
    return with_text(sections(entries, pages), pages)


def split_oversized(nodes: DataFrame, most: int) -> DataFrame:
    """Leaves above most characters become parents of "(Part n)" leaves that share their pages out."""
    large = F.length("text") > most
    parts = nodes.filter(large).withColumn("parts", folds.split_text("text", most))
    per = F.greatest(F.lit(1.0), (F.col("end_page") - F.col("start_page") + 1) / F.size("parts"))
    rows = parts.select("*", per.alias("per"), F.posexplode("parts").alias("i", "part"))
    start = F.col("start_page") + F.floor(F.col("i") * F.col("per")).cast("int")
    end = F.when(F.col("i") == F.size("parts") - 1, F.col("end_page")).otherwise(F.least(F.col("start_page") + F.floor((F.col("i") + 1) * F.col("per")).cast("int") - 1, F.col("end_page")))
    name, ident = F.concat(F.col("title"), F.lit(" (Part "), F.col("i") + 1, F.lit(")")), F.concat(F.col("node_id"), F.lit("_part_"), F.col("i"))
    split = rows.select(
        "document_id", ident.alias("node_id"), F.col("node_id").alias("parent_id"), F.col("preorder").alias("old"), (F.col("i") + 1).alias("sub"), (F.col("depth") + 1).alias("depth"), (F.col("level") + 1).alias("level"), name.alias("title"), "summary",
        start.alias("start_page"), end.alias("end_page"), F.lit(True).alias("is_leaf"), F.col("part").alias("text"), F.array_append("path", name).alias("path"), F.array_append("path_ids", ident).alias("path_ids"),
    )
    whole = nodes.withColumn("is_leaf", F.col("is_leaf") & ~F.coalesce(large, F.lit(False))).withColumn("text", F.when(~F.coalesce(large, F.lit(False)), F.col("text"))).withColumn("old", F.col("preorder")).withColumn("sub", F.lit(0)).drop("preorder")
    place = F.row_number().over(W.partitionBy("document_id").orderBy("old", "sub"))
    return whole.unionByName(split).withColumn("preorder", place).select(*NODE)


def metadata(nodes: DataFrame, pages: DataFrame, method: DataFrame | None = None) -> DataFrame:
    about = nodes.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_nodes"), F.max("depth").alias("max_depth"))
    total = pages.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages"))
    out = about.join(total, "document_id")
    return out if method is None else out.join(method.select("document_id", F.col("method").alias("indexing_method")).distinct(), "document_id")


def leaves(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(chosen columns, leaf_id) for the leaves under, or equal to, each chosen (document_id, node_id)."""
    below = nodes.filter("is_leaf").select("document_id", F.col("node_id").alias("leaf_id"), F.explode("path_ids").alias("node_id"))
    return chosen.join(below, ["document_id", "node_id"])


def compact_json(nodes: DataFrame) -> DataFrame:
    """(document_id, tree): the nested tree without texts, nulls kept; one task's memory holds one tree.

    Rows are written out in preorder, each closing what ends before it; a node whose parent is not there is left out.
    """
    keys = ["node_id", "title", "summary", "level", "start_page", "end_page"]
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("tree", T.StringType())])
    names = ["nodeId", "title", "summary", "level", "startPage", "endPage"]

    def one(frame):
        import json

        import pandas as pd

        frame, out, open_, empty = frame.sort_values("preorder"), [], [], True
        told = {c: json.dumps(n) for c, n in zip(keys, names, strict=True)}
        there: set[str] = set()
        for parent, *values in frame[["parent_id", *keys]].itertuples(index=False, name=None):
            parent = parent if isinstance(parent, str) else None
            if parent is not None and parent not in there:
                continue
            while open_ and open_[-1] != parent:
                there.discard(open_.pop())
                out.append('], "text": null}')
                empty = False
            clean = [None if v is None or v != v else v if isinstance(v, str) else int(v) for v in values]
            out.append(("" if empty else ", ") + "{" + ", ".join(f"{told[k]}: {json.dumps(v, ensure_ascii=False)}" for k, v in zip(keys, clean, strict=True)) + ', "children": [')
            open_.append(values[0])
            there.add(values[0])
            empty = True
        out.append('], "text": null}' * len(open_))
        return pd.DataFrame({"document_id": [frame["document_id"].iloc[0]], "tree": ["[" + "".join(out) + "]"]})

    return nodes.select("document_id", "parent_id", "preorder", *keys).groupBy("document_id").applyInPandas(one, schema)


def apply_offset(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with a printed but no physical page are moved by the most frequent offset of the others.

    Of offsets that are equally frequent the one that comes first wins; without any nothing changes.
    """
    known = entries.filter("page_number is not null and physical_index is not null").withColumn("offset", F.col("physical_index") - F.col("page_number"))
    counted = known.groupBy("document_id", "offset").agg(F.count(F.lit(1)).alias("n"), F.min("entry_pos").alias("first"))
    best = counted.groupBy("document_id").agg(F.max_by("offset", F.struct("n", -F.col("first"))).alias("offset"))
    total = pages.groupBy("document_id").agg(F.max("page_number").alias("total"))
    moved = F.least(F.greatest(F.col("page_number") + F.col("offset"), F.lit(1)), F.col("total"))
    rows = entries.join(best, "document_id", "left").join(total, "document_id", "left")
    return rows.withColumn("physical_index", F.when(F.col("physical_index").isNull() & F.col("page_number").isNotNull() & F.col("offset").isNotNull(), moved).otherwise(F.col("physical_index"))).drop("offset", "total")
