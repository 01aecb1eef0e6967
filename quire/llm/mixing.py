"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them), so the flow network has a node
for each pattern and each source, however many documents there are.  A pattern's words can be used up to
``max_copies`` times, and each further copy costs more than the one before (convex costs), so the cheapest flow
that fills the source quotas repeats as little as possible.  What a pattern sends is then taken from its
documents in the order of a seeded hash, and each copy counts for the source into whose part of the flow it falls.
Every place in that order where something changes becomes a hash: it is found by sums over hash prefixes, as long
as the number of rows asks for, and an exact look into the one prefix that holds it.  So no source, however large,
is ever sorted or gathered, and the documents themselves are drawn by comparing hashes, without a shuffle.  Equal
rows are counted, not ranked, so a frequent row is cut in the middle like any other run of documents.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm import common
from quire.llm.common import checkpointed

#: More membership patterns than this are refused: the network is solved on the driver.
MAX_PATTERNS = 50_000
#: Distinct rows of a hash prefix that are aimed at; a prefix has 3 to 8 hex digits.
PREFIX_ROWS = 20_000


def weight_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Share of the summed sizes by weight; none above most times its size, the excess reshared by weight.

    Sorted by most * size / weight, the capped ones come first, so the common level is found in one sweep.
    """
    most = float(most)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        if weights[i] * (left / weight) <= most * sizes[i]:
            for j in order[k:]:
                out[j] = weights[j] * (left / weight)
            break
        out[i] = most * sizes[i]
        left, weight = left - most * sizes[i], weight - weights[i]
    return out


class _Network:
    """Arcs with what is left of their capacity; arc a ^ 1 is the way back of arc a."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def fill(self, start: int, end: int) -> None:
        """A largest flow by blocking flows on shortest ways."""
        to, room, arcs = self.to, self.room, self.arcs
        while True:
            level = [-1] * len(arcs)
            level[start], queue = 0, deque([start])
            while queue:
                x = queue.popleft()
                for a in arcs[x]:
                    if room[a] and level[to[a]] < 0:
                        level[to[a]] = level[x] + 1
                        queue.append(to[a])
            if level[end] < 0:
                return
            at, way, x = [0] * len(arcs), [], start
            while True:
                if x == end:
                    least = min(room[a] for a in way)
                    for a in way:
                        room[a] -= least
                        room[a ^ 1] += least
                    cut = next(i for i, a in enumerate(way) if not room[a])
                    x = to[way[cut] ^ 1]
                    del way[cut:]
                    continue
                while at[x] < len(arcs[x]) and not (room[arcs[x][at[x]]] and level[to[arcs[x][at[x]]]] == level[x] + 1):
                    at[x] += 1
                if at[x] < len(arcs[x]):
                    way.append(arcs[x][at[x]])
                    x = to[way[-1]]
                elif way:
                    x = to[way.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def min_cost_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], max_copies: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each source: as much of the quotas as can be filled, at least cost.

    patterns: (source indexes, words).  Copy r of a pattern's words costs r - 1 a word, and nothing else costs, so
    the cheapest ways to add flow are always those over the lowest copy that still has one: the copies are opened
    one after the other, and each time the network is filled.  All quantities are integers; the result is exact.
    """
    n_p, n_s = len(patterns), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    net = _Network(n_p + n_s + 2)
    inlet = [net.arc(start, p, 0) for p in range(n_p)]
    used = [{s: net.arc(p, n_p + s, words * max_copies) for s in members} for p, (members, words) in enumerate(patterns)]
    for s, quota in enumerate(quotas):
        net.arc(n_p + s, end, quota)
    for _ in range(max_copies):
        for p, (_, words) in enumerate(patterns):
            net.room[inlet[p]] += words
        net.fill(start, end)
    return [{s: net.room[a ^ 1] for s, a in sent.items()} for sent in used]


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


#: Behind every hash.
_END = "g"
_PLAN = "_pattern array<string>, _full long, _cut string, _cut_extra long, _cut_all long, _routes array<struct<copy: int, lo: string, hi: string, source: string>>, source_sizes array<long>, targets array<double>"


def _places(sized: DataFrame, edges: list[tuple[list[str], int, bool]], digits: int) -> dict[tuple[tuple[str, ...], int, bool], tuple]:
    """For places (pattern, words before it, whether it is the cut): (first key behind it, rows of that key that are before it, rows of it)."""
    spark = sized.sparkSession
    wanted = spark.createDataFrame(edges, "_pattern array<string>, _edge long, _is_cut boolean")
    prefix, words = F.substring("_key", 1, digits), F.col("_size") * F.col("_rows")
    sums = sized.groupBy("_pattern", prefix.alias("_prefix")).agg(F.sum(words).alias("_sum"))
    starts = sums.withColumn("_base", F.sum("_sum").over(W.partitionBy("_pattern").orderBy("_prefix")) - F.col("_sum"))
    held = starts.join(F.broadcast(wanted), "_pattern").filter("_base <= _edge and _edge < _base + _sum").select("_pattern", "_prefix", "_base", "_edge", "_is_cut")
    rows = sized.withColumn("_prefix", prefix).join(F.broadcast(held), ["_pattern", "_prefix"])
    before = F.sum(words).over(W.partitionBy("_pattern", "_edge", "_is_cut").orderBy("_key").rowsBetween(W.unboundedPreceding, -1))
    left = F.col("_edge") - F.col("_base") - F.coalesce(before, F.lit(0))  # words from the run's begin to the place
    # a row belongs before the place if its middle does: of a run, those with size * (2 * i + 1) <= 2 * left
    n = F.least(F.greatest(F.floor((F.floor(2 * left / F.col("_size")) + 1) / 2), F.lit(0)), F.col("_rows")).cast("long")
    rows = rows.filter("_size > 0").withColumn("_n", n)
    split = F.when(F.col("_is_cut"), F.col("_n") < F.col("_rows")).otherwise(2 * F.col("_n") < F.col("_rows"))
    first = F.min(F.when(split, F.struct("_key", "_n", "_rows", "_size")))
    got = rows.groupBy("_pattern", "_edge", "_is_cut").agg(first.alias("f"), F.first("_prefix").alias("p")).collect()
    return {(tuple(r["_pattern"]), r["_edge"], r["_is_cut"]): (r.f["_key"], r.f["_n"], r.f["_rows"]) if r.f else (r.p + _END, 0, 0) for r in got}


def mix_plan(sized: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """One row for each pattern: which keys get how many copies, and for which source each counts.

    sized: _pattern, _key (unique), _size, and _rows (how many equal rows the row stands for), checkpointed.  A row
    gets _full copies, and one more if its key is before _cut; of the rows whose key is _cut, _cut_extra get one
    more, and all of them together _cut_all.
    """
    totals = sized.groupBy("_pattern").agg(F.sum(F.col("_size") * F.col("_rows")).alias("z"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    totals.sort(key=lambda r: r[0])
    digits = 3
    while digits < 8 and 16**digits * PREFIX_ROWS < max((r.n for r in totals), default=0):
        digits += 1
    names = sorted({s for r in totals for s in r[0]}, key=lambda s: (s == "\0", s.encode()))
    index = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in totals:
        for s in r[0]:
            sizes[index[s]] += r.z
    targets = weight_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, max_copies) if names else []
    flow = min_cost_flow([([index[s] for s in r[0]], r.z) for r in totals], [int(t) for t in targets], max_copies)
    parts: list[list[tuple[int, int, int, int]]] = []  # of each pattern: (copy, words before, words behind, source)
    edges = []
    for r, sent in zip(totals, flow, strict=True):
        spans, at = [], 0
        for s in sorted(sent):
            lo, at = at, at + sent[s]
            for copy in range(lo // r.z if r.z else 0, -(-at // r.z) if r.z else 0):
                a, b = max(lo - copy * r.z, 0), min(at - copy * r.z, r.z)
                if a < b:
                    spans.append((copy + 1, a, b, s))
        parts.append(spans)
        edges += [(r[0], e, False) for e in sorted({e for _, a, b, _ in spans for e in (a, b)} - {0, r.z, at % r.z if r.z else 0})]
        if r.z and at % r.z:
            edges.append((r[0], at % r.z, True))
    found = _places(sized, edges, digits) if edges else {}
    plan = []
    for r, sent, spans in zip(totals, flow, parts, strict=True):
        full, rest = divmod(sum(sent.values()), r.z) if r.z else (0, 0)
        cut, extra, n = found[tuple(r[0]), rest, True] if rest else ("", 0, 0)
        # the run at the cut counts for the part that ends there
        spot = lambda e, cut=cut, extra=extra, rest=rest, r=r: "" if e == 0 else _END if e == r.z else (cut + _END if extra else cut) if e == rest else found[tuple(r[0]), e, False][0]
        routes = [(copy, spot(a), spot(b), names[s]) for copy, a, b, s in spans]
        plan.append((r[0], full, cut, extra, extra * (full + 1) + (n - extra) * full, routes, [sizes[index[s]] for s in r[0]], [targets[index[s]] for s in r[0]]))
    return sized.sparkSession.createDataFrame(plan, _PLAN)


def _pattern(sources: Column) -> Column:
    """Sorted names of a document's sources; the null source is a zero character."""
    listed = F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))
    return F.array_sort(F.array_distinct(F.transform(listed, lambda s: F.coalesce(s.cast("string"), F.lit("\0")))))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 23, id_col: str = "doc_id", sources_col: str = "sources", size_col: str = "size", carry: tuple[str, ...] = ()) -> DataFrame:
    """Copies of each document that bring every source near its target.

    docs: an id, an array of the sources that hold the document, its size in words, and columns to carry, which
    tell rows of one id apart.  The sources, by code point with null last, get the weights in turn.  Returns id,
    carried columns, sources, size, rows (how many equal rows the row stands for), copies (int, of each), routes
    (the source that each copy counts for), and source_sizes and targets in the order of sources; equal rows come
    as at most two rows, those with more copies and those with fewer.  A document without sources is a member of
    the null source.  An empty document gets 0 to max_copies copies, which changes no sum; an empty table gives
    an empty result.
    """
    kept = [f"_c{i}" for i in range(len(carry))]
    sized = docs.select(F.col(id_col).alias("_id"), _pattern(F.col(sources_col)).alias("_pattern"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"), *(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)))
    sized = sized.groupBy("_id", "_pattern", "_size", *kept).agg(F.count(F.lit(1)).alias("_rows"))
    sized = checkpointed(sized.withColumn("_key", _key(seed, F.col("_id"), F.col("_size"), *map(F.col, kept))))
    out = sized.join(F.broadcast(mix_plan(sized, weights, share, max_copies)), "_pattern")
    more = F.when(F.col("_key") == F.col("_cut"), F.col("_cut_extra")).when(F.col("_key") < F.col("_cut"), F.col("_rows")).otherwise(0)
    out = out.withColumn("_more", more).withColumn("_runs", F.array(F.struct(F.col("_more").alias("rows"), (F.col("_full") + 1).alias("copies")), F.struct((F.col("_rows") - F.col("_more")).alias("rows"), F.col("_full").alias("copies"))))
    out = out.select("*", F.inline(F.filter("_runs", lambda x: x["rows"] > 0)))
    route = F.expr("transform(sequence(1, copies), r -> coalesce(get(filter(_routes, x -> x.copy = r and _key >= x.lo and _key < x.hi), 0).source, _pattern[0]))")
    out = out.withColumn("routes", F.when(F.col("copies") > 0, route).otherwise(F.array().cast("array<string>")))
    named_back = lambda c: F.transform(c, lambda s: F.when(s != "\0", s))
    return out.select(F.col("_id").alias(id_col), *(F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)), named_back(F.col("_pattern")).alias("sources"), F.col("_size").alias("size"), "rows", F.col("copies").cast("int").alias("copies"), named_back(F.col("routes")).alias("routes"), "source_sizes", "targets")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of every row of documents, a document being in its one source."""
    sized = docs.select("doc_id", F.array("source").alias("sources"), common.n_words(F.col("text")).alias("size"))
    mixed = mix_sources(sized).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return mixed.select("doc_id", "size", F.element_at("source_sizes", 1).alias("source_size"), F.element_at("targets", 1).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, seed: int = 23, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it: up to max_copies times, or not at all; its columns stay.

    A row is told from others by all its columns, so rows of one id, or without one, are drawn one by one.  Only
    hashes and sizes are shuffled; of equal rows that are not all taken alike (at most one run for each source)
    all copies come from one of them.
    """
    clear = common.by_place(docs)
    place = [F.col(c) for c in clear.columns]
    text, source = (F.col(clear.columns[docs.columns.index(c)]) for c in (text_col, source_col))
    own = (F.xxhash64(*place, *(c.isNull() for c in place)), F.hash(*place, F.lit(7)))
    wide = clear.withColumn("_key", _key(seed, *own)).withColumn("_pattern", _pattern(F.array(source)))
    sized = wide.select("_key", "_pattern", common.n_words(text).alias("_size")).groupBy("_key", "_pattern", "_size").agg(F.count(F.lit(1)).alias("_rows"))
    drawn = wide.join(F.broadcast(mix_plan(checkpointed(sized), weights, share, max_copies)), "_pattern")
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    copies = F.col("_full") + (F.col("_key") < F.col("_cut")).cast("long")
    whole = drawn.filter("_key <> _cut").withColumn("_copies", copies).filter("_copies > 0").withColumn("_n", times(F.col("_copies")))
    run = drawn.filter("_key = _cut and _cut_all > 0").dropDuplicates(["_key"]).withColumn("_n", times(F.col("_cut_all")))
    return whole.unionByName(run.withColumn("_copies", F.lit(0).cast("long"))).select(*clear.columns).toDF(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_documents(common.table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5('23:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS z, CASE (row_number() OVER (ORDER BY source = chr(0), encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * z / w, source = chr(0), encode(source)) AS k FROM s),
level AS (SELECT *, (1.5 * (SELECT sum(z) FROM o) - coalesce(sum(2 * z) OVER before, 0))::DOUBLE / ((SELECT sum(w) FROM o) - coalesce(sum(w) OVER before, 0))::DOUBLE AS l FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(k) AS k FROM level WHERE w * l <= 2.0 * z),
t AS (SELECT source, z, CASE WHEN level.k < cut.k THEN 2.0::DOUBLE * z ELSE w * (SELECT l FROM level x, cut WHERE x.k = cut.k) END AS target FROM level, cut),
p AS (SELECT *, floor(target)::BIGINT // greatest(z, 1) AS f, CASE WHEN z = 0 THEN 0 ELSE floor(target)::BIGINT % z END AS rest FROM t),
c AS (SELECT k.*, p.*, sum(size) OVER (PARTITION BY k.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k JOIN p USING (source))
SELECT doc_id, size, z AS source_size, target, (size * (f + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
