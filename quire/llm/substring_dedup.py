"""Removal of repeated word windows by super-k-mer partitioning.

A window is k consecutive words.  Its minimiser is the least hash among the runs of m words inside it, and
consecutive windows mostly share theirs, so they travel together: one string of words, packed with its place,
in a compressed block for its minimiser's bucket.  Equal windows have equal minimisers and meet in one bucket,
where sorting finds every window that starts earlier elsewhere; bytes decide, not hashes.  The number of buckets
follows the size of the texts, so a bucket holds about ``BUCKET_TEXT`` bytes of them at any scale.

Before anything travels, a task drops the windows that it has itself seen at an earlier place; of a passage
that a third of all documents share, one copy a block is sent.  Minimisers that are still common (found on a
bounded sample; this changes routes only, never results) have their windows dealt by the whole window's hash,
and first over ``SALTS`` buckets of their own: each lets only its earliest copy of a window go on to the bucket
that decides, so no bucket gets a copy from every block of the corpus.
What comes back is the runs of later windows, by document; only texts that have some are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import checkpointed

WINDOW = 20
MINIMISER = 4
#: Bytes of text a task packs at once; also the scope of the first, local comparison.
PACK = 3 << 20
#: Bytes of text for each bucket, and buckets for each partition, about.
BUCKET_TEXT, BUCKETS = 1 << 20, 16
#: Buckets over which the copies of a common window are spread before they meet.
SALTS = 64
#: About so many texts are looked at for common minimisers, and one in so many of them makes a minimiser common.
SAMPLE_TEXTS, COMMON_IN = 2_000, 100
#: Ranks rows without an id behind all others.
_NO_ID = (1 << 63) - 1
#: Names of rows that are sent to all tasks rather than shuffled.
SENT = 1_000_000
_CODEC = pa.Codec("zstd", compression_level=4)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    made, length = values, 1
    while length * 2 <= width:
        made = np.minimum(made[:-length], made[length:])
        length *= 2
    rest = width - length
    return np.minimum(made[: len(made) - rest], made[rest:]) if rest else made


def _runs(*columns: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) index of runs of consecutive positions at with equal columns."""
    n = len(at)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = at[1:] != at[:-1] + 1
    for c in columns:
        cut = cut | (c[1:] != c[:-1])
    first = np.flatnonzero(np.r_[True, cut])
    return first, np.r_[first[1:], n]


def later_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, window: np.ndarray, doc: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which windows (indexes of first words) equal one at an earlier (doc, place)."""
    later = np.zeros(len(window), bool)
    some = np.flatnonzero(common.repeated(hashes))
    if not len(some):
        return later
    order = some[np.lexsort((place[some], doc[some], hashes[some]))]
    head = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    after = (doc[order] != doc[lead]) | (place[order] != place[lead])
    order, lead = order[after], lead[after]
    a, b = starts[window[order]], starts[window[lead]]
    length = ends[window[order] + k - 1] - a
    same = length == ends[window[lead] + k - 1] - b
    # bytes decide: compared in runs, since neighbouring windows mostly repeat together
    first, last = _runs(a - b, window[lead] - window[order], same, at=window[order])
    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if same[lo]:
            x, y, n = a[lo], b[lo], a[hi - 1] + length[hi - 1] - a[lo]
            if not np.array_equal(data[x : x + n], data[y : y + n]):
                same[lo:hi] = [np.array_equal(data[a[i] : a[i] + length[i]], data[b[i] : b[i] + length[i]]) for i in range(lo, hi)]
    later[order[same]] = True
    if not same.all():  # two texts under one hash: the rest of those groups is settled by the bytes themselves
        for value in np.unique(hashes[order[~same]]):
            least: dict[bytes, tuple[int, int]] = {}
            group = np.flatnonzero(hashes == value)
            words = [data[starts[window[i]] : ends[window[i] + k - 1]].tobytes() for i in group]
            for i, w in zip(group, words, strict=True):
                least[w] = min(least.get(w, (doc[i], place[i])), (doc[i], place[i]))
            later[group] = [least[w] < (doc[i], place[i]) for i, w in zip(group, words, strict=True)]
    return later


def _pack(doc: np.ndarray, key: np.ndarray, place: np.ndarray, length: np.ndarray, text: np.ndarray) -> bytes:
    head = np.array([len(doc)], "<i8").tobytes()
    raw = head + doc.astype("<i8").tobytes() + key.astype("<i8").tobytes() + place.astype("<i8").tobytes() + length.astype("<i8").tobytes() + text.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _CODEC.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    doc, key, place, length = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n)
    return doc, key, place, length, np.frombuffer(raw, np.uint8, offset=8 + 32 * n)


def _minimisers(hashes: np.ndarray, text: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimiser) of every window that stays in its text."""
    if len(hashes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding_min(common.gram_hashes(hashes, m), k - m + 1)
    window = np.flatnonzero(text[: len(least)] == text[k - 1 :])
    return window, least[window]


def common_minimisers(docs: DataFrame, id_col: str, text_col: str, k: int, m: int) -> np.ndarray:
    """Minimisers that one in COMMON_IN of about SAMPLE_TEXTS texts has; at most a few thousand."""
    total = docs.select(F.count(F.lit(1))).first()[0]
    every = max(1, total // SAMPLE_TEXTS)
    sample = docs.filter(F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(every)) == 0).select(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(0)):
                norm, starts, ends, text = common.normalised(data, offsets)
                window, least = _minimisers(common.span_hashes(norm, starts, ends) if len(starts) else np.empty(0, np.uint64), text, k, m)
                pairs = np.unique(np.stack([least, text[window].astype(np.uint64)]), axis=1)[0]
                value, count = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["v", "n"])

    limit = max(20, min(total, SAMPLE_TEXTS) // COMMON_IN)
    found = sample.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit)
    return np.sort(np.array([r.v for r in found.select("v").limit(100_000).collect()], np.int64).view(np.uint64))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, place, key and text of every row.

    place orders the ids as a long (null for a null id): an integer id is its own, others are numbered along a
    range partitioning.  key is a hash of the text where the id is null or has different texts, else 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        rows = rows.select("id", F.col("id").cast("long").alias("place"), "text")
    else:
        spots = rows.select("id").filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
        spots = checkpointed(spots.withColumn("place", F.monotonically_increasing_id()))
        rows = rows.join(spots, "id", "left").select("id", "place", "text")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    clash = rows.filter("place is not null").groupBy("place").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo <> hi")
    clash = checkpointed(clash.select(F.col("place").alias("clash")))
    few = F.broadcast(clash) if clash.count() <= SENT else clash
    key = F.when(F.col("place").isNull() | F.col("clash").isNotNull(), own).otherwise(F.lit(0).cast("long"))
    return rows.join(few, F.col("place") == F.col("clash"), "left").select("id", "place", key.alias("key"), "text")


def _blocks(data: np.ndarray, route: np.ndarray, text: np.ndarray, window: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray, n_buckets: int, k: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, 0, block) of runs of neighbouring windows with one route."""
    first, last = _runs(route, text, at=window)
    if not len(first):
        return
    a, z = starts[window[first]], ends[window[last - 1] + k - 1]
    to = (common.mix(route[first]) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True])
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        some = order[x:y]
        yield int(to[some[0]]), 0, _pack(doc[first[some]], key[first[some]], place[first[some]], z[some] - a[some], common.take_spans(data, a[some], z[some]))


def packed(docs: DataFrame, n_buckets: int, often: np.ndarray, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(bucket, kind, block): packed super-k-mers (kind 0), and runs of windows already known to be later (kind 1); docs as keyed.

    Windows of common minimisers go to buckets from n_buckets on, which do not decide alone.
    """
    names = ["bucket", "kind", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = common.mix(np.array([TaskContext.get().partitionId() % SALTS + 1], np.uint64))[0]
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in common.chunks(batch.column(2), PACK):
                data, starts, ends, text = common.normalised(data, offsets)
                if not len(starts):
                    continue
                hashes = common.span_hashes(data, starts, ends)
                window, least = _minimisers(hashes, text, k, m)
                if not len(window):
                    continue
                whole = common.gram_hashes(hashes, k)[window]
                doc, key = ids[lo:hi][text[window]], keys[lo:hi][text[window]]
                place = window - np.searchsorted(text, text[window])  # first words of texts are where text changes
                later = later_windows(data, starts, ends, whole, window, doc, place, k)
                made: list[tuple[int, int, bytes]] = []
                gone = np.flatnonzero(later)
                first, last = _runs(text[window[gone]], at=window[gone])
                if len(first):
                    d, x, p, n = doc[gone[first]], key[gone[first]], place[gone[first]], last - first
                    to = (common.mix(d.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                    for b in np.unique(to):
                        some = to == b
                        made.append((int(b), 1, _pack(d[some], x[some], p[some], n[some], np.empty(0, np.uint8))))
                hot = np.zeros(len(window), bool)
                if len(often):
                    hot = often[np.minimum(np.searchsorted(often, least), len(often) - 1)] == least
                for part, shift in ((np.flatnonzero(~later & ~hot), 0), (np.flatnonzero(~later & hot), n_buckets)):
                    route = whole[part] ^ salt if shift else least[part]
                    found = _blocks(data, route, text[window[part]], window[part], starts, ends, doc[part], key[part], place[part], n_buckets, k)
                    made += [(b + shift, kind, block) for b, kind, block in found]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=names)

    return docs.select("place", "key", "text").mapInArrow(run, "bucket int, kind int, block binary")


def _settle(blocks: list[tuple[int, bytes]], k: int, n_buckets: int | None = None) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, bytes]]]:
    """Runs (doc, key, first window, windows) of later windows among the blocks of a bucket.

    With n_buckets also the blocks, by the whole window's hash, of the windows that are earliest here.
    """
    out = [tuple(np.asarray(x) for x in _unpack(b)[:4]) for kind, b in blocks if kind == 1]
    parts = [_unpack(b) for kind, b in blocks if kind == 0]
    onward: list[tuple[int, int, bytes]] = []
    if parts:
        doc, key, place, length, data = (np.concatenate([p[i] for p in parts]) for i in range(5))
        offsets = np.r_[0, np.cumsum(length)]
        starts, ends, piece = common.find_words(data, offsets)
        hashes = common.span_hashes(data, starts, ends)
        whole = common.gram_hashes(hashes, k)
        window = np.flatnonzero(piece[: len(whole)] == piece[k - 1 :])
        own = piece[window]
        at = place[own] + window - np.searchsorted(piece, own)
        gone = later_windows(data, starts, ends, whole[window], window, doc[own], at, k)
        later = np.flatnonzero(gone)
        first, last = _runs(own[later], at=window[later])
        out.append((doc[own[later[first]]], key[own[later[first]]], at[later[first]], last - first))
        if n_buckets is not None:
            stay = np.flatnonzero(~gone)
            onward = list(_blocks(data, whole[window[stay]], own[stay], window[stay], starts, ends, doc[own[stay]], key[own[stay]], at[stay], n_buckets, k))
    return (tuple(np.concatenate([o[i] for o in out]) for i in range(4)) if out else (np.empty(0, np.int64),) * 4), onward


_SETTLED = "doc long, key long, first long, windows long, bucket int, kind int, block binary"


def _settled(dealt: DataFrame, partitions: int, n_buckets: int, k: int) -> DataFrame:
    """Runs of later windows, and the blocks that buckets from n_buckets on let go on; a bucket is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        bucket = None
        schema = pa.schema([*((x, pa.int64()) for x in ("doc", "key", "first", "windows")), ("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])

        def done() -> Iterator[pa.RecordBatch]:
            runs, onward = _settle(held, k, n_buckets if bucket >= n_buckets else None)
            if n := len(runs[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in runs), *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], schema=schema)
            if n := len(onward):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), *(pa.array([x[i] for x in onward], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], schema=schema)

        for batch in batches:
            for b, kind, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket and held:
                    yield from done()
                    held = []
                bucket = b
                held.append((kind, block))
        if held:
            yield from done()

    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _SETTLED)


def later_runs(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(doc, key, first, windows): runs of windows whose words start earlier elsewhere; docs as keyed, doc is a place, null for rows without an id."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (BUCKET_TEXT * BUCKETS)))
    n_buckets = max(1, partitions * BUCKETS)
    often = common_minimisers(docs, "place", "text", k, m)
    runs = _settled(packed(docs, n_buckets, often, k, m), partitions, n_buckets, k)
    if len(often):
        runs = checkpointed(runs)
        more = runs.filter("block is not null").select("bucket", "kind", "block")
        runs = runs.filter("block is null").unionByName(_settled(more, partitions, n_buckets, k))
    return runs.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc"), "key", "first", "windows")


def drop_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    A word goes if a window of k words covers it whose words also start earlier: in a row with a smaller id, or
    before in the same row.  Rows of one id are the same document, so copies of a row with its id don't remove
    each other; rows without an id come last.  Texts of fewer than k words stay whole, a null text has no words,
    and an empty table gives an empty result.
    """
    common.bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    runs = later_runs(rows, k, m).groupBy("doc", F.col("key").alias("own")).agg(F.collect_set(F.struct("first", "windows")).alias("runs"))
    runs = checkpointed(runs)
    same = F.col("place").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("own"))
    if runs.count() <= SENT:  # texts without a repeat need no shuffle
        name = lambda doc, key: F.xxhash64(F.coalesce(doc, F.lit(_NO_ID)), key)
        names = F.broadcast(runs.select(name(F.col("doc"), F.col("own")).alias("name")).distinct())
        named = rows.withColumn("name", name(F.col("place"), F.col("key")))
        joined = named.join(names, "name", "left_semi").join(runs, same, "left").select("id", "text", "runs")
        joined = joined.unionByName(named.join(names, "name", "left_anti").select("id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs")))
    else:
        joined = rows.join(runs, same, "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for lo, hi, data, offsets in common.chunks(batch.column(1)):
                data, starts, ends, text = common.normalised(data, offsets)
                n = np.bincount(text, minlength=hi - lo) if len(text) else np.zeros(hi - lo, np.int64)
                base = np.r_[0, np.cumsum(n)]
                raw, kept, removed = data.tobytes(), [], []
                for i in range(hi - lo):
                    a, z = int(base[i]), int(base[i + 1])
                    found = lists[lo + i].as_py() if lists[lo + i].is_valid else None
                    if not found:
                        kept.append(raw[starts[a] : ends[z - 1]] if z > a else b"")
                        removed.append(0)
                        continue
                    step = np.zeros(z - a + 1, np.int64)
                    np.add.at(step, [x["first"] for x in found], 1)
                    np.add.at(step, [x["first"] + x["windows"] + k - 1 for x in found], -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
                    kept.append(b" ".join(raw[starts[a + x] : ends[a + y - 1]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
                    removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, as a hash."""
    return drop_repeats(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
grams AS (SELECT doc_id, pos, w, {" || ' ' || ".join(["w", *(f"lead(w, {i}) OVER t" for i in range(1, WINDOW))])} AS g FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY pos)),
late AS (SELECT doc_id, pos, w, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS late FROM grams),
gone AS (SELECT doc_id, pos, w, max(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM late),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
"""
