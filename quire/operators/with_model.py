"""Operators that call a chat or embedding model: detectors, summaries, vectors, checks and repairs.

Models are picklable objects; each is called on the executors, batch by batch, and a failed call never fails the
job: it leaves its document to the next step, or its row without a result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.config import EMBED_BATCH, IndexingConfig
from quire.functions import text as X
from quire.functions.arrow import bounded_batches
from quire.functions.json_clean import parse
from quire.functions.vectors import mean_pool
from quire.models.chat import ChatModel, structured
from quire.models.prompts import render
from quire.operators.detect import ENTRY, by_patterns, valid_patterns
from quire.operators.tree import BLOCK, span_texts

#: Characters of the texts that go to an embedder at once.
EMBED_CHARS = 16 << 20

_KINDS = (T.StringType(), T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.StringType(), T.IntegerType())
FOUND = T.StructType([T.StructField(name, kind) for name, kind in zip(ENTRY, _KINDS, strict=True)])


def _ask(model: ChatModel, tag: str, prompt: str, more: Sequence[tuple[str, str]] = ()) -> str:
    return model.chat([("user", prompt), *more], [tag])


def _tag_number(value) -> int | None:
    import re

    found = re.search(r"<physical_index_(\d+)>", str(value or ""))
    return int(found[1]) if found and int(found[1]) < 2**31 else None


def _level(structure) -> int:
    return 1 if structure is None else str(structure).count(".") + 1


def _entry_rows(document: str, items: Iterable[dict], method: str, index: Callable[[dict], int | None]) -> pd.DataFrame:
    rows = [(document, i, str(x.get("title") or ""), None, index(x), _level(x.get("structure")), None if x.get("structure") is None else str(x["structure"]), method, None) for i, x in enumerate(items, 1)]
    return pd.DataFrame(rows, columns=ENTRY).astype({"page_number": "Int32", "physical_index": "Int32", "last_content_page": "Int32"})


def groups_of(pages: list[tuple[int, str]], config: IndexingConfig) -> list[list[tuple[int, str]]]:
    """Tagged pages by estimated tokens with overlap, for one document on a worker."""
    out, at = [], 0
    while at < len(pages):
        end, size = at, 0
        while end < len(pages) and (end == at or size + len(pages[end][1]) // 4 <= config.page_group_max_tokens):
            size += len(pages[end][1]) // 4
            end += 1
        out.append(pages[at:end])
        if end >= len(pages):
            break
        at = max(end - config.page_group_overlap, at + 1)
    return out


def _tagged(pages: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [(n, f"<physical_index_{n}>{t}</physical_index_{n}>") for n, t in pages]


def _per_document(pages: DataFrame, one: Callable[[str, list[tuple[int, str]]], pd.DataFrame | None], schema: T.StructType = FOUND) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_number")
        try:
            found = one(frame["document_id"].iloc[0], list(zip(frame["page_number"].tolist(), frame["text"].fillna("").tolist(), strict=True)))
        except Exception:  # a provider's failure leaves the document to the next detector
            found = None
        return pd.DataFrame() if found is None else found

    return pages.select("document_id", "page_number", "text").groupBy("document_id").applyInPandas(run, schema)


def by_unnumbered_contents(model: ChatModel) -> Callable[[DataFrame, IndexingConfig], DataFrame]:
    """Detector for contents pages without page numbers: found, copied, read and matched to pages by the model."""

    def detector(pages: DataFrame, config: IndexingConfig) -> DataFrame:
        def one(document: str, texts: list[tuple[int, str]]) -> pd.DataFrame | None:
            run: list[str] = []
            for _, text in texts[: config.toc_scan_pages]:
                yes = str((parse(_ask(model, "toc-detection", render("toc-detection", page_text=text)), dict) or {}).get("toc_detected", "no")).lower() == "yes"
                if yes:
                    run.append(text)
                elif run:
                    break
            if not run:
                return None
            raw = "\n".join(run)
            import re

            prompt = render("toc-extraction", toc_text=re.sub(r"\.{5,}", ": ", raw))
            got = _ask(model, "toc-extraction", prompt)
            if not got.strip():
                return None
            for _ in range(config.max_extraction_retries):
                done = parse(_ask(model, "toc-completeness", render("toc-completeness-check", raw_toc_text=raw, extracted_toc_text=got)), dict) or {}
                if str(done.get("completed", "yes")).lower() == "yes":
                    break
                got += "\n" + _ask(model, "toc-extraction-continue", prompt, [("assistant", got), ("user", "Please continue the extraction.")])
            items = (parse(_ask(model, "toc-transform", render("toc-transform", toc_text=got)), dict) or {}).get("table_of_contents")
            if not isinstance(items, list):
                return None
            numbered = parse(_ask(model, "page-index-detection", render("page-index-detection", toc_content=got)), dict) or {}
            if str(numbered.get("page_index_given_in_toc", "no")).lower() == "yes":
                return None
            items = [x for x in items if isinstance(x, dict)]
            for group in groups_of(_tagged(texts), config):
                new = parse(_ask(model, "toc-page-matching", render("toc-page-matching", structure_json=json.dumps(items), pages_text="\n".join(t for _, t in group))), list)
                items = [x for x in new if isinstance(x, dict)] if new is not None else items
            return _entry_rows(document, items, "TOC_WITHOUT_PAGES", lambda x: _tag_number(x.get("physical_index"))) if items else None

        return _per_document(pages, one)

    return detector


def by_outline(model: ChatModel) -> Callable[[DataFrame, IndexingConfig], DataFrame]:
    """Detector by an outline of each group of pages, merged two by two by rule: every (title, page) once, by page."""

    def merged(a: list[dict], b: list[dict]) -> list[dict]:
        seen, out = set(), []
        for x in [*a, *b]:
            key = (x.get("title"), x.get("physical_index"))
            if key not in seen:
                seen.add(key)
                out.append(x)
        return sorted(out, key=lambda x: n if (n := _tag_number(x.get("physical_index"))) is not None else 2**31)

    def detector(pages: DataFrame, config: IndexingConfig) -> DataFrame:
        clean = pages.withColumn("text", X.without_header_marks(F.col("text")))

        def one(document: str, texts: list[tuple[int, str]]) -> pd.DataFrame | None:
            found = [parse(_ask(model, "structure-detection-init", render("structure-detection-init", tagged_pages_text="\n".join(t for _, t in g))), list) for g in groups_of(_tagged(texts), config)]
            parts = [[x for x in f if isinstance(x, dict)] for f in found if f]
            while len(parts) > 1:
                parts = [merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            return _entry_rows(document, parts[0], "LLM_DETECTED", lambda x: _tag_number(x.get("physical_index"))) if parts and parts[0] else None

        return _per_document(clean, one)

    return detector


def by_discovered_patterns(model: ChatModel, cache=None, sample: int = 5) -> Callable[[DataFrame, IndexingConfig], DataFrame]:
    """Detector by heading patterns that the model finds in a document's first pages.

    Documents with the same sample share one call; patterns are kept in the cache, an empty list too.  The
    driver holds one group of patterns at a time, never the documents.
    """

    def detector(pages: DataFrame, config: IndexingConfig) -> DataFrame:
        first = pages.filter(F.col("page_number") <= sample).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
        named = first.select("document_id", "p", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("fingerprint"))
        shown = F.array_join(F.transform("p", lambda x: F.concat(F.lit("--- Page "), x["page_number"], F.lit(" ---\n"), x["text"])), "\n\n")
        out = pages.sparkSession.createDataFrame([], FOUND)
        for row in named.groupBy("fingerprint").agg(F.first(shown).alias("shown")).toLocalIterator():
            found = cache.get(row.fingerprint) if cache is not None else None
            own = pages.join(named.filter(F.col("fingerprint") == row.fingerprint).select("document_id"), "document_id", "left_semi")
            if found is None:
                try:
                    reply = _ask(model, "regex-discovery", render("regex-discovery", sample_pages_text=row.shown))
                except Exception:  # not kept: the next run may ask again
                    continue
                listed = [(str(x.get("regex")), int(x.get("level") or 1)) for x in parse(reply, list) or [] if isinstance(x, dict) and x.get("regex")]
                found = valid_patterns(own, listed) if listed else []
                if cache is not None:
                    cache.put(row.fingerprint, found)
            if found:
                out = out.unionByName(by_patterns(own, found, config))
        return out

    return detector


def summarize(nodes: DataFrame, model: ChatModel, config: IndexingConfig, pages: DataFrame | None = None) -> DataFrame:
    """Nodes with summaries: leaves in batches, then all parents once from their direct children.

    A child without a summary is told as such, a batch that fails leaves its nodes as they were.  With pages the
    nodes have no texts yet; prompts show those of the pages.
    """
    leaf = nodes.filter("is_leaf")
    if pages is None:
        leaf = leaf.filter("text is not null").select("document_id", "node_id", "preorder", "title", F.col("node_id").alias("key"), "text")
        told = _summaries(leaf.drop("text"), leaf.select("document_id", "key", "text"), model, "summary", config)
    else:
        leaf = leaf.withColumn("all", F.lit(0))
        texts = span_texts(leaf, pages, "all").filter("text is not null").withColumn("key", F.concat_ws("-", "start_page", "end_page"))
        leaf = leaf.join(texts.select("document_id", "start_page", "end_page", "key"), ["document_id", "start_page", "end_page"])
        told = _summaries(leaf.select("document_id", "node_id", "preorder", "title", "key"), texts.select("document_id", "key", "text"), model, "summary", config)
    now = _with_summaries(nodes, told).persist()
    children = now.filter("parent_id is not null").groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("preorder", F.concat(F.lit("- "), "title", F.lit(": "), F.coalesce("summary", F.lit("(no summary)"))).alias("line")))).alias("c"))
    parents = now.filter("not is_leaf").select("document_id", "node_id", "preorder", "title").join(children, ["document_id", "node_id"])
    parents = parents.select("document_id", "node_id", "preorder", "title", F.col("node_id").alias("key"), F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("text"))
    return _with_summaries(now, _summaries(parents.drop("text"), parents.select("document_id", "key", "text"), model, "rollup-summary", config))


#: Batches of a document's sections that go to one task, with each text that they show once.
RUN = 256


def _summaries(rows: DataFrame, texts: DataFrame, model: ChatModel, prompt: str, config: IndexingConfig) -> DataFrame:
    """rows: document_id, node_id, preorder, title, key; texts: document_id, key, text, which many rows may share.

    Prompts are put together on the workers, one at a time, so a text that many sections show is sent once to a run
    of RUN batches, not once for each of them.
    """
    bounded_batches(rows.sparkSession)
    place = F.row_number().over(W.partitionBy("document_id").orderBy("preorder"))
    rows = rows.withColumn("batch", X.batch_number(place, config.batch_summary_size)).withColumn("run", F.floor(F.col("batch") / RUN))
    runs = rows.groupBy("document_id", "run").agg(F.collect_list(F.struct("preorder", "batch", "node_id", "title", "key")).alias("rows"))
    shown = rows.groupBy("document_id", "key").agg(F.collect_set("run").alias("run")).join(texts, ["document_id", "key"]).withColumn("run", F.explode("run"))
    shown = shown.groupBy("document_id", "run").agg(F.collect_list(F.struct("key", "text")).alias("texts"))

    def prompts(document: str, listed: list[dict], texts: dict[str, str]) -> list[tuple[str, str, str]]:
        out, batches = [], {}
        for x in sorted(listed, key=lambda x: x["preorder"]):
            batches.setdefault(x["batch"], []).append(x)
        for batch in batches.values():
            try:
                sections = "\n\n".join(f"[{x['node_id']}] {x['title']}\n{texts[x['key']]}" for x in batch if x["title"] is not None)
                items = structured(model, [("user", render(prompt, sections=sections))], '{"node_id": "string", "summary": "string"}', True, ["summary"])
            except Exception:  # a failed batch has no summaries
                items = []
            out += [(document, str(x["node_id"]), str(x.get("summary") or "")) for x in items if isinstance(x, dict) and x.get("node_id")]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                document, listed, texts = (c[i].as_py() for c in batch.columns)
                out = prompts(document, listed, {x["key"]: x["text"] for x in texts})
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["document_id", "node_id", "told"])

    return runs.join(shown, ["document_id", "run"]).select("document_id", "rows", "texts").mapInArrow(run, "document_id string, node_id string, told string").dropDuplicates(["document_id", "node_id"])


def _with_summaries(nodes: DataFrame, told: DataFrame) -> DataFrame:
    return nodes.join(told, ["document_id", "node_id"], "left").withColumn("summary", F.coalesce("told", "summary")).drop("told").select(*nodes.columns)


def embed(nodes: DataFrame, embedder: Callable[[list[str]], list[Sequence[float]]], pages: DataFrame | None = None) -> DataFrame:
    """(document_id, node_id, embedding): leaves by the model in batches, parents as the mean of their children.

    Levels go from the deepest up; each is a join on the parent, and there are as many as the tree is deep.  A batch
    that fails leaves its leaves without a vector, and parents pool the children that have one.  With pages the nodes
    have no texts yet: a text that many leaves show comes once for all in a block of them, and a worker holds it with
    the titles of one batch at a time.  A batch is cut short where its texts exceed EMBED_CHARS.
    """
    bounded_batches(nodes.sparkSession)
    leaf = nodes.filter("is_leaf")
    if pages is None:
        rows = leaf.filter("text is not null").select("document_id", "text", F.array(F.struct("node_id", "title")).alias("n"))
    else:
        keys = ["document_id", "start_page", "end_page", "block"]
        leaf = leaf.withColumn("block", F.floor(F.col("preorder") / BLOCK))
        listed = leaf.groupBy(*keys).agg(F.collect_list(F.struct("node_id", "title")).alias("n"))
        rows = listed.join(span_texts(leaf.select(*keys), pages), keys).filter("text is not null").select("document_id", "text", "n")

    def vectors(part: list[tuple[str, str, str]]) -> pa.RecordBatch:
        try:
            made = [[float(v) for v in x] for _, x in zip(part, embedder([t for _, _, t in part]), strict=True)]
        except Exception:  # these leaves have no vector
            part, made = [], []
        columns = [pa.array([d for d, _, _ in part], pa.string()), pa.array([n for _, n, _ in part], pa.string()), pa.array(made, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["document_id", "node_id", "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                document, text, listed = (c[i].as_py() for c in batch.columns)
                for x in listed:
                    if x["title"] is None:
                        continue
                    if part and (len(part) == EMBED_BATCH or size + len(text) > EMBED_CHARS):
                        yield vectors(part)
                        part, size = [], 0
                    part.append((document, x["node_id"], f"{x['title']}: {text}"))
                    size += len(text)
        if part:
            yield vectors(part)

    out = rows.mapInArrow(run, "document_id string, node_id string, embedding array<double>").persist()
    deepest = nodes.agg(F.max("depth")).first()[0] or 1
    for depth in range(deepest, 1, -1):
        level = nodes.filter(F.col("depth") == depth).filter("parent_id is not null").select("document_id", "node_id", "parent_id").join(out, ["document_id", "node_id"])
        pooled = mean_pool(level.select("document_id", F.col("parent_id").alias("node_id"), "embedding"), ["document_id", "node_id"])
        out = out.unionByName(pooled).persist()
    return out


def verify(entries: DataFrame, pages: DataFrame, model: ChatModel, sample: int = 0, seed: int = 7) -> DataFrame:
    """Entries with a physical page, checked: document_id, entry_pos, title, physical_index, checked, correct.

    sample entries of each document by a seeded order (0: all).  Without its page an entry isn't asked about
    and counts as correct; a reply that says no, or can't be read, makes it incorrect; after a failed call correct is null.
    """
    bounded_batches(pages.sparkSession)
    rows = entries.filter("physical_index is not null")
    if sample > 0:
        rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("document_id").orderBy(F.xxhash64("entry_pos", F.lit(seed)), "entry_pos"))).filter(F.col("_k") <= sample)
    text = X.tagged(F.col("page_number"), F.col("text"))
    tagged = pages.select("document_id", F.col("page_number").alias("physical_index"), text.alias("page_text"))

    @F.pandas_udf(T.BooleanType())
    def right(title: pd.Series, page: pd.Series) -> pd.Series:
        def one(t, p):
            if p is None:
                return True
            try:
                found = parse(_ask(model, "verification", render("verification", title=t, page_text=p)), dict)
            except Exception:  # not checked: no result
                return None
            return found is not None and str(found.get("answer", "no")).strip().lower() != "no"

        return pd.Series([one(t, p) for t, p in zip(title, page, strict=True)])

    out = rows.select("document_id", "entry_pos", "title", "physical_index").join(tagged, ["document_id", "physical_index"], "left")
    return out.select("document_id", "entry_pos", "title", "physical_index", F.col("page_text").isNotNull().alias("checked"), right("title", "page_text").alias("correct"))


def accuracy(verified: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(document_id, accuracy); of the documents given, those with nothing to verify have 1."""
    found = verified.groupBy("document_id").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return found if documents is None else documents.select("document_id").distinct().join(found, "document_id", "left").withColumn("accuracy", F.coalesce("accuracy", F.lit(1.0)))


def fix(entries: DataFrame, verified: DataFrame, pages: DataFrame, model: ChatModel, config: IndexingConfig) -> DataFrame:
    """Entries with the wrong ones moved: the first max_fix_attempts of each document are asked about, against the
    pages at most fix_search_radius away; without such a page, or a tag in the reply, an entry stays."""
    wrong = verified.filter("not correct").withColumn("_k", F.row_number().over(W.partitionBy("document_id").orderBy("entry_pos"))).filter(F.col("_k") <= config.max_fix_attempts)
    r = config.fix_search_radius
    near = wrong.select("document_id", "entry_pos", "title", F.explode(F.sequence(F.col("physical_index") - r, F.col("physical_index") + r)).alias("page_number")).join(pages, ["document_id", "page_number"])
    asked = near.groupBy("document_id", "entry_pos", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", X.tagged(F.col("page_number"), F.col("text")).alias("t")))), lambda x: x["t"]), "\n").alias("shown"))

    @F.pandas_udf(T.IntegerType())
    def place(title: pd.Series, shown: pd.Series) -> pd.Series:
        def one(t, s):
            try:
                return _tag_number((parse(_ask(model, "fix", render("fix", title=t, pages_text=s)), dict) or {}).get("physical_index"))
            except Exception:  # the entry stays
                return None

        return pd.Series([one(t, s) for t, s in zip(title, shown, strict=True)], dtype="Int32")

    moved = asked.select("document_id", "entry_pos", place("title", "shown").alias("_new"))
    return entries.join(moved, ["document_id", "entry_pos"], "left").withColumn("physical_index", F.coalesce("_new", "physical_index")).drop("_new").select(*entries.columns)
