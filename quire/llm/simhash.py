"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints that differ in at most r bits agree on p - r of p pieces of the 64 bits, so each distinct
fingerprint goes to one bucket for every choice of p - r pieces, and only bucket mates are compared: an exact
search, with p picked so that a bucket of evenly spread fingerprints stays small.  A bucket above ``CELL``
members is dealt into a grid of cells, each pair of its parts meeting in one, so a task's memory is bounded and
no pair is lost.  Inside a cell the members lie as bit planes, 64 members to a word; a query is compared with a
whole word at a time, plane by plane, in carry-save counters, and leaves once every member exceeds the radius.
Of the links found, only a spanning forest of each cell goes on, so a group of copies never becomes all its
pairs.  Components are found by contraction rounds on the links, checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import checkpointed, spread_join

RADIUS = 4
#: Members of a cell's side; a cell holds at most two sides.
CELL = 4096
#: Members that a bucket of evenly spread fingerprints may have before more pieces are used.
EVEN = 512
#: Pairs of a query and a word that are compared at once.
BATCH = 1 << 16
#: Shingles that are hashed and unpacked to bits at once; longer spans are hashed one by one.
UNPACK, SPAN = 1 << 16, 512

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of data, all spans at once; data has eight bytes more than any span reaches."""
    out = np.empty(len(starts), np.uint64)
    large = lengths > SPAN
    for i in np.flatnonzero(large):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes(), seed)
    some = np.flatnonzero(~large)
    if not len(some):
        return out
    at, left, start = starts[some].copy(), lengths[some].copy(), np.uint64(seed)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.full(len(some), start + _P5)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            lanes = [np.full(len(wide), x) for x in (start + _P1 + _P2, start + _P2, start, start - _P1)]
            for _ in range(int(left[wide].max()) // 32):
                go = np.flatnonzero(left[wide] >= 32)
                for k in range(4):
                    lanes[k][go] = _round(lanes[k][go], eight[at[wide[go]] + 8 * k])
                at[wide[go]] += 32
                left[wide[go]] -= 32
            made = sum(_turn(x, b) for x, b in zip(lanes[1:], (7, 12, 18), strict=True)) + _turn(lanes[0], 1)
            for x in lanes:
                made = (made ^ _round(np.uint64(0), x)) * _P1 + _P4
            h[wide] = made
        h += lengths[some].astype(np.uint64)
        for _ in range(3):
            go = np.flatnonzero(left >= 8)
            h[go] = _turn(h[go] ^ _round(np.uint64(0), eight[at[go]]), 27) * _P1 + _P4
            at[go] += 8
            left[go] -= 8
        go = np.flatnonzero(left >= 4)
        h[go] = _turn(h[go] ^ ((eight[at[go]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[go] += 4
        left[go] -= 4
        for k in range(3):
            go = np.flatnonzero(left > k)
            h[go] = _turn(h[go] ^ (data[at[go] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    out[some] = h ^ (h >> np.uint64(32))
    return out


def majority(hashes, own: np.ndarray, texts: int) -> np.ndarray:
    """For each text the bits that over half of its hashes have; hashes(part) gives those of a slice, own their text, rising."""
    ones = np.zeros((texts, 64), np.int64)
    for lo in range(0, len(own), UNPACK):
        part = slice(lo, lo + UNPACK)
        bits = np.unpackbits(hashes(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.r_[True, own[part][1:] != own[part][:-1]])
        ones[own[part][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.bincount(own, minlength=texts)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def prints(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """SimHash of each text: the XXH64 (seed 42) of its word shingles, A-Z lower-cased, repeats included; no word: 0."""
    texts = len(offsets) - 1
    norm, starts, ends, text = common.normalised(np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8), offsets)
    if not len(starts):
        return np.zeros(texts, np.uint64)
    norm = np.r_[norm, np.zeros(8, np.uint8)]
    n = np.bincount(text, minlength=texts)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    # a text of fewer words is one shingle
    own = np.repeat(np.flatnonzero(n), np.maximum(n[n > 0] - shingle + 1, 1))
    begin = np.repeat(first, np.maximum(n[n > 0] - shingle + 1, 1))
    begin += np.arange(len(own)) - np.searchsorted(own, own)
    last = begin + np.minimum(n[own], shingle) - 1
    return majority(lambda part: xxh64(norm, starts[begin[part]], ends[last[part]] - starts[begin[part]]), own, texts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id and fp (signed 64-bit fingerprint) of each row; a null text is empty."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(prints(data, offsets, shingle).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pieces(n: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Bit masks, one for each bucket that a fingerprint goes to.

    The fewest pieces are used for which n evenly spread fingerprints have at most EVEN mates on average.
    """
    p = radius + 1
    while p < 16 and n >> (64 * (p - radius) // p) > EVEN:
        p += 1
    edges = [64 * i // p for i in range(p + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(p)]
    return [sum(chosen) for chosen in combinations(parts, p - radius)]


def planes(words: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints as 64 bit planes: bit i of plane j of a block is bit j of its i-th fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, 64, 8).copy().view(np.uint64)[..., 0]


def close_words(fps: np.ndarray, plane: np.ndarray, query: np.ndarray, block: np.ndarray, over: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query and a block of planes: (the pairs that are left, their words of members within radius).

    over: members to leave out, as bits.  Counters of 1, 2 and 4 are held as words, one bit for each member; a
    carry out of 4 or a count above the radius sets the member's bit in over.  Pairs leave when over is full.
    """
    left = np.arange(len(query))
    ones, twos, fours = (np.zeros(len(query), np.uint64) for _ in range(3))
    for j in range(64):
        x = plane[block, j] ^ (np.uint64(0) - ((fps[query] >> np.uint64(j)) & np.uint64(1)))
        carry = ones & x
        ones ^= x
        x = twos & carry
        twos ^= carry
        over = over | (fours & x)
        fours ^= x
        if j % 4 == 3:
            above = over | _above(ones, twos, fours, radius)
            stay = np.flatnonzero(above != _ALL)
            if len(stay) < 0.9 * len(left):
                left, query, block, over, ones, twos, fours = (v[stay] for v in (left, query, block, above, ones, twos, fours))
                if not len(left):
                    break
            else:
                over = above
    hit = ~(over | _above(ones, twos, fours, radius))
    some = np.flatnonzero(hit)
    return left[some], hit[some]


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Members whose 3-bit count is above the radius (0 to 7)."""
    out = np.zeros_like(ones)
    for count in range(radius + 1, 8):
        out |= (fours if count & 4 else ~fours) & (twos if count & 2 else ~twos) & (ones if count & 1 else ~ones)
    return out


def roots_of(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while (more := parent[up] != up).any():
        up = np.where(more, parent[up], up)
    return up


def cell_links(cell: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The root of each member in a spanning forest of the close pairs of its cell.

    Rows are sorted by cell.  side: 0 and 1 are compared only with each other, 2 with all of its cell.
    """
    n = len(fps)
    parent = np.arange(n)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, n])
    # every cell in blocks of 64 members
    n_blocks = (size + 63) // 64
    block_of_cell = np.cumsum(n_blocks) - n_blocks
    own = np.repeat(np.arange(len(first)), size)
    rank = np.arange(n) - first[own]
    slot = (block_of_cell[own] + rank // 64) * 64 + rank % 64
    total = int(n_blocks.sum())
    padded = np.zeros(total * 64, np.uint64)
    padded[slot] = fps
    member = np.full(total * 64, -1, np.int64)
    member[slot] = np.arange(n)
    plane = planes(padded)
    bit = np.uint64(1) << (slot % 64).astype(np.uint64)
    lanes = np.zeros((3, total), np.uint64)
    for k in range(3):
        np.bitwise_or.at(lanes[k], slot[side == k] // 64, bit[side == k])
    ways = n_blocks[own] - rank // 64  # the query's own block and those behind
    done = np.cumsum(ways)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + BATCH, side="right")))
        query = np.repeat(np.arange(lo, hi), ways[lo:hi])
        block = slot[query] // 64 + np.arange(len(query)) - np.repeat(np.cumsum(ways[lo:hi]) - ways[lo:hi], ways[lo:hi])
        wanted = np.where(side[query] == 2, lanes[2][block], np.where(side[query] == 0, lanes[1][block], lanes[0][block]))
        same = block == slot[query] // 64
        here = bit[query]
        wanted = np.where(same, wanted & ~(here | (here - np.uint64(1))), wanted)
        some = np.flatnonzero(wanted)
        query, block = query[some], block[some]
        left, hit = close_words(fps, plane, query, block, ~wanted[some], radius)
        for a in range(0, len(left), 1 << 14):
            part = slice(a, a + (1 << 14))
            row, lane = np.nonzero(np.unpackbits(hit[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            x, y = query[left[part]][row], member[block[left[part]][row] * 64 + lane]
            while len(x):  # the larger root of each pair hooks to the smaller
                x, y = roots_of(parent, x), roots_of(parent, y)
                apart = x != y
                x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
                np.minimum.at(parent, y, x)
        lo = hi
    return roots_of(parent, np.arange(n))


def whole_runs(batches: Iterator[pa.RecordBatch], columns: int, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Integer columns of the batches in pieces of about so many rows; rows with an equal first column stay together."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)))
        n += len(batch)
        if n >= rows and len(batch):  # all but the last run is whole
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            if cut := int(np.searchsorted(whole[0], whole[0][-1])):
                yield tuple(x[:cut] for x in whole)
            held, n = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def celled(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Rows with the cell in which they are compared, and the side that they take there.

    Rows of one key (more than CELL: dealt by item into a grid of cells, each pair of parts meeting in one) share
    a cell.  Side: 0 and 1 are compared only with each other, 2 with all of its cell.
    """
    sizes = rows.groupBy(*keys).count().filter(F.col("count") > CELL).select(*keys, F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    sizes = checkpointed(sizes)
    n_large = sizes.count()
    if not n_large:
        return rows.withColumn("cell", F.xxhash64(*keys)).withColumn("side", F.lit(2))
    rows = rows.join(F.broadcast(sizes) if n_large <= 50_000 else sizes, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(item, F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("side", F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int")))
    return rows.withColumn("cell", F.xxhash64(*keys, F.least("part", "other"), F.greatest("part", "other"))).drop("parts", "part", "other")


def links(points: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join the same fingerprints as all pairs within the radius do; points: fp, n distinct ones."""
    masks = pieces(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = points.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("way", "key"))
    dealt = celled(rows, ["way", "key"], "fp").select("cell", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, side, fp in whole_runs(batches, 3, 8 * CELL):
            root = cell_links(cell, side, fp.view(np.uint64), radius)
            far = np.flatnonzero(root != np.arange(len(root)))
            a, b = fp[root[far]], fp[far]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) reaches.

    Each round, every node hooks to its least neighbour or itself, hooks are followed, and the links are drawn
    again between where their ends have gone; links inside a tree vanish.  A component's least node never moves,
    so it is the last one left.  The joins are plain ones on one row for each node, so where many links share an
    end, Spark's skew join splits them.
    """
    links = checkpointed(links.filter("a <> b").distinct())
    roots = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        hooks = checkpointed(hooks.alias("x").join(hooks.alias("y"), F.col("x.p") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.p").alias("p")))
        if roots is None:
            roots = hooks.toDF("node", "root")
        else:
            roots = checkpointed(roots.join(hooks, F.col("root") == F.col("v"), "left").select("node", F.coalesce("p", "root").alias("root")))
        ends = links.join(hooks.toDF("a", "x"), "a").join(hooks.toDF("b", "y"), "b").filter("x <> y")
        links = checkpointed(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Id, fp (signed 64-bit) and component_id, the least id that links reach, of every row.

    The graph has fingerprints for nodes, so ids may be of any type that has an order.  A null or empty text has
    fingerprint 0 and is linked like any other.  Rows of one id and text share a component; a row with a null id
    counts by its fingerprint alone, and its component is null only if no id is reachable.  An empty table gives
    an empty result.
    """
    printed = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    points = checkpointed(printed.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    total, n = points.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    roots = components(links(points.select("fp"), n, radius))
    linked = checkpointed(points.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root"))
    named = checkpointed(linked.groupBy("root").agg(F.min("least").alias("found")))
    joined = spread_join(linked, named, "root", linked.count()).select("fp", F.struct("found").alias("by"))
    found = points.join(joined, "fp", "left").select("fp", F.when(F.col("by").isNull(), F.col("least")).otherwise(F.col("by.found")).alias("component_id"))
    return spread_join(printed, checkpointed(found), "fp", total).select(F.col("id").alias(id_col), "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
