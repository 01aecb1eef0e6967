"""Structure detectors without a model: contents pages, headings, given patterns, flat chunks, and the chain.

A detector takes pages (document_id, page_number, text) and gives entries (document_id, entry_pos, title,
page_number, physical_index, level, structure, method, last_content_page); documents in which it finds no
structure have no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.config import DISCOVERY_MAX_RATIO, DISCOVERY_PAGES, IndexingConfig
from quire.functions import folds
from quire.functions import text as X
from quire.functions.arrow import bounded_batches

ENTRY = ["document_id", "entry_pos", "title", "page_number", "physical_index", "level", "structure", "method", "last_content_page"]


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page_number", F.posexplode(X.lines(F.col("text"))).alias("line_pos", "line"))


def fenced(rows: DataFrame, by_page: bool) -> DataFrame:
    """Lines with is_fence and in_fence; the state starts anew on each page, or runs through the document."""
    keys = ["document_id", "page_number"] if by_page else ["document_id"]
    fence = F.startswith(F.regexp_replace("line", r"^[\s\h]+", ""), F.lit(X.FENCE))
    before = W.partitionBy(*keys).orderBy("page_number", "line_pos").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("is_fence", fence).withColumn("in_fence", F.sum(F.col("is_fence").cast("int")).over(before) % 2 == 1)


def contents_pages(pages: DataFrame, config: IndexingConfig) -> DataFrame:
    """The pages, normalised, with has_header and is_toc; counts come from the page's own lines, no shuffle."""
    bounded_batches(pages.sparkSession)  # normalising works on pages of any length
    text = pages.select("document_id", "page_number", X.normalized(F.col("text")).alias("text"))
    clean = F.transform(F.filter(X.lines(F.col("text")), X.ends_in_number), X.without_header_mark)
    kind = lambda x: [hit for hit, _, _ in X.leader_parts(x)]
    structured, spaced = F.size(F.filter(clean, lambda x: kind(x)[0] | kind(x)[1] | kind(x)[2])), F.size(F.filter(clean, lambda x: kind(x)[3]))
    rows = text.withColumn("has_header", X.has_contents_header(F.col("text"))).withColumn("structured", structured).withColumn("spaced", spaced)
    least = config.min_toc_line_count
    return rows.withColumn("is_toc", F.col("has_header") | (F.col("structured") >= least) | ((F.col("structured") >= 1) & (F.col("spaced") >= least)))


def contents_lines(toc: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Entries parsed from the lines of contents pages, with the columns of keep; a line by label and page only where
    a page has the header."""
    allowed = F.max(F.col("has_header").cast("int")).over(W.partitionBy("document_id")) == 1
    rows = toc.filter("is_toc").withColumn("allowed", allowed).select("document_id", "page_number", "allowed", *keep, F.posexplode(X.lines(F.col("text"))).alias("line_pos", "line")).filter(X.ends_in_number(F.col("line")))
    line = X.without_header_mark(F.col("line"))
    title, page = F.lit(None).cast("string"), F.lit(None).cast("string")
    for hit, t, p in reversed(X.leader_parts(line)):
        title, page = F.when(hit, t).otherwise(title), F.when(hit, p).otherwise(page)
    loose = line.rlike(X.PERMISSIVE) & F.col("allowed") & F.regexp_extract(line, X.PERMISSIVE, 1).rlike("[A-Za-z]")
    title, page = F.coalesce(title, F.when(loose, F.regexp_extract(line, X.PERMISSIVE, 1))), F.coalesce(page, F.when(loose, F.regexp_extract(line, X.PERMISSIVE, 2)))
    rows = rows.select("document_id", F.col("page_number").alias("toc_page"), "line_pos", X.trimmed(title).alias("title"), page.try_cast("int").alias("page_number"), *keep)
    rows = rows.filter((F.col("page_number") >= 1) & (F.col("title") != "") & ~F.col("title").rlike(X.PURE_NUMERIC))
    return rows.withColumn("level", X.numbering_level(F.col("title")))


def by_contents(pages: DataFrame, config: IndexingConfig) -> DataFrame:
    """Entries of contents pages, moved to physical pages behind (or, if the contents stand last, before) them.

    Pages are looked at once: a document's counts and its contents pages come from the same pass.
    """
    about = ["total", "last_toc", "last_content_page"]
    toc = contents_pages(pages, config).groupBy("document_id").agg(
        F.max("page_number").alias("total"), F.max(F.when(F.col("is_toc"), F.col("page_number"))).alias("last_toc"), F.max(F.when(~F.col("is_toc"), F.col("page_number"))).alias("last_content_page"),
        F.collect_list(F.when(F.col("is_toc"), F.struct("page_number", "text", "has_header", "is_toc"))).alias("t"),
    )
    entries = contents_lines(toc.filter("last_toc is not null").select("document_id", *about, F.inline("t")), about)
    whole = W.partitionBy("document_id")
    spread = F.max("page_number").over(whole) - F.min("page_number").over(whole)
    n, distinct = F.count(F.lit(1)).over(whole), F.size(F.collect_set("page_number").over(whole))
    entries = entries.withColumn("least", F.min("page_number").over(whole)).withColumn("_ok", (spread >= 3) | ((n >= 6) & (distinct >= 3))).filter("_ok")
    rows = entries
    offset = F.when(F.col("last_toc") * 2 > F.col("total"), 1 - F.col("least")).otherwise(F.col("last_toc") + 1 - F.col("least"))
    physical = F.least(F.greatest(F.col("page_number") + offset, F.lit(1)), F.col("total").cast("int"))
    return _entries(rows.withColumn("physical_index", physical), "TOC_WITH_PAGES", ["toc_page", "line_pos"], F.col("last_content_page"))


def header_lines(pages: DataFrame) -> DataFrame:
    """Heading lines outside fences: title, level and kind, by ATX, setext, numbered and bold in that order."""
    page = W.partitionBy("document_id", "page_number").orderBy("line_pos")
    rows = fenced(page_lines(pages.filter(F.col("text").rlike(X.MAY_HEAD))), by_page=True)  # pages don't depend on each other
    line = F.col("line")
    rows = rows.withColumn("next", F.lead("line").over(page)).withColumn("before", F.lag("line").over(page))
    outside = ~F.col("is_fence") & ~F.col("in_fence")
    atx = outside & line.rlike(X.ATX)
    under = F.when(F.col("next").rlike(X.SETEXT_1), 1).when(F.col("next").rlike(X.SETEXT_2) & F.col("before").isNotNull() & ~X.is_blank(F.col("before")), 2)
    setext = outside & ~atx & ~X.is_blank(line) & under.isNotNull()
    # a line that is taken as an underline can't be a heading: in a run of candidates every other one counts
    rows = rows.withColumn("atx", atx).withColumn("setext", F.coalesce(setext, F.lit(False))).withColumn("under", under)
    starts = F.col("setext") & ~F.coalesce(F.lag("setext").over(page), F.lit(False))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(page.rowsBetween(W.unboundedPreceding, 0)))
    place = F.sum(F.col("setext").cast("int")).over(W.partitionBy("document_id", "page_number", "run").orderBy("line_pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("setext", F.col("setext") & (place % 2 == 1))
    rows = rows.withColumn("used", F.coalesce(F.lag("setext").over(page), F.lit(False)))
    free = outside & ~F.col("used")
    numbered_title = X.trimmed(F.regexp_extract("line", X.NUMBERED, 2))
    numbered = line.rlike(X.NUMBERED) & (numbered_title != "") & ~numbered_title.rlike(X.PURE_NUMERIC)
    bold_title = X.trimmed(F.regexp_extract("line", X.BOLD, 1))
    kind = F.when(~free, None).when(F.col("atx"), "atx").when(F.col("setext"), "setext").when(numbered, "numbered").when(line.rlike(X.BOLD), "bold")
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    title = F.when(F.col("kind") == "atx", X.trimmed(F.regexp_extract("line", X.ATX, 2))).when(F.col("kind") == "setext", X.trimmed(line)).when(F.col("kind") == "numbered", numbered_title).otherwise(bold_title)
    level = F.when(F.col("kind") == "atx", F.length(F.regexp_extract("line", X.ATX, 1))).when(F.col("kind") == "setext", F.col("under")).when(F.col("kind") == "numbered", X.outline_level(F.regexp_extract("line", X.NUMBERED, 1))).otherwise(1)
    return rows.select("document_id", "page_number", "line_pos", title.alias("title"), level.cast("int").alias("level"), "kind").filter("title <> ''")


def by_headers(pages: DataFrame, config: IndexingConfig) -> DataFrame:
    rows = header_lines(pages).withColumn("physical_index", F.col("page_number")).withColumn("page_number", F.lit(None).cast("int"))
    return _enough(_entries(rows, "HEADER_BASED", ["physical_index", "line_pos"]), config)


def valid_patterns(pages: DataFrame, patterns: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """The patterns that compile, have one group, and match some but at most half of the sample's non-blank lines.

    One pass counts all patterns; only their counts come back.
    """
    jvm = pages.sparkSession._jvm
    usable = []
    for regex, level in patterns:
        try:
            if jvm.java.util.regex.Pattern.compile(regex).matcher("").groupCount() == 1:
                usable.append((regex, level))
        except Exception:  # a pattern that doesn't compile is no pattern
            continue
    sample = page_lines(pages.filter(F.col("page_number") <= DISCOVERY_PAGES)).filter(~X.is_blank(F.col("line")))
    counts = sample.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("line").rlike(r)).alias(f"c{i}") for i, (r, _) in enumerate(usable))).first()
    return [p for i, p in enumerate(usable) if counts[f"c{i}"] and counts[f"c{i}"] <= DISCOVERY_MAX_RATIO * counts["n"]]


def by_patterns(pages: DataFrame, patterns: Iterable[tuple[str, int]], config: IndexingConfig) -> DataFrame:
    """Lines by the first pattern that matches, lower levels first; fences run through the document."""
    ordered = sorted(patterns, key=lambda p: p[1])
    rows = fenced(page_lines(pages), by_page=False).filter("not is_fence and not in_fence")
    title, level = F.lit(None).cast("string"), F.lit(None).cast("int")
    for regex, n in reversed(ordered):
        hit = F.col("line").rlike(regex)
        title, level = F.when(hit, X.trimmed(F.regexp_extract("line", regex, 1))).otherwise(title), F.when(hit, n).otherwise(level)
    rows = rows.select("document_id", F.lit(None).cast("int").alias("page_number"), F.col("page_number").alias("physical_index"), "line_pos", title.alias("title"), level.alias("level")).filter("title <> ''")
    return _enough(_entries(rows, "REGEX_DISCOVERED", ["physical_index", "line_pos"]), config)


def flat_chunks(pages: DataFrame, config: IndexingConfig) -> DataFrame:
    """Runs of pages up to max_node_text_length characters; never without rows for a document that has pages."""
    rows = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(F.length("text"), F.lit(0)).alias("len")))).alias("p"))
    rows = rows.select("document_id", "p", F.transform("p", lambda x: x["len"]).alias("lens"))
    rows = rows.select("document_id", F.inline(F.arrays_zip(F.transform("p", lambda x: x["page_number"]).alias("page_number"), folds.chunk_ids("lens", config.max_node_text_length).alias("chunk"))))
    return rows.groupBy("document_id", "chunk").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))


def by_flat_pages(pages: DataFrame, config: IndexingConfig) -> DataFrame:
    first, last = F.col("first_page"), F.col("last_page")
    title = F.when(first == last, F.concat(F.lit("Page "), first)).otherwise(F.concat(F.lit("Pages "), first, F.lit("-"), last))
    rows = flat_chunks(pages, config).select("document_id", title.alias("title"), first.alias("page_number"), first.alias("physical_index"), F.lit(1).alias("level"))
    return _entries(rows, "FLAT_PAGES", ["physical_index"])


def page_groups(pages: DataFrame, config: IndexingConfig) -> DataFrame:
    """(document_id, group_no, page_numbers): pages by estimated tokens, each group going back over the last."""
    rows = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(X.tokens_estimate(F.col("text")), F.lit(0)).alias("n")))).alias("p"))
    rows = rows.select("document_id", "p", F.transform("p", lambda x: x["n"]).alias("sizes"))
    runs = folds.overlapping_groups("sizes", config.page_group_max_tokens, config.page_group_overlap)
    rows = rows.select("document_id", "p", F.posexplode(runs).alias("group_no", "run"))
    return rows.select("document_id", "group_no", F.expr("transform(slice(p, run.lo + 1, run.hi - run.lo), x -> x.page_number)").alias("page_numbers"))


def detect(pages: DataFrame, config: IndexingConfig, more=()) -> DataFrame:
    """The entries of the first detector that finds any, document by document.

    Each detector, those in more (pages, config to entries) before the flat chunks, gets only the documents
    that are still open.  What is found is persisted (memory and disk), since every later step asks for it.
    """
    found = by_contents(pages, config).persist()
    for step in (by_headers, *more):
        rest = step(pages.join(found.select("document_id").distinct(), "document_id", "left_anti"), config)
        found = found.unionByName(rest).persist()
    return found.unionByName(by_flat_pages(pages.join(found.select("document_id").distinct(), "document_id", "left_anti"), config))


def _entries(rows: DataFrame, method: str, order: list[str], last_content: Column | None = None) -> DataFrame:
    place = F.row_number().over(W.partitionBy("document_id").orderBy(*order)).alias("entry_pos")
    return rows.select("document_id", place, "title", "page_number", "physical_index", "level", F.lit(None).cast("string").alias("structure"), F.lit(method).alias("method"), (F.lit(None).cast("int") if last_content is None else last_content).alias("last_content_page"))


def _enough(entries: DataFrame, config: IndexingConfig) -> DataFrame:
    return entries.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("document_id"))).filter(F.col("_n") >= config.min_header_count).drop("_n")
