"""Sharding by a keyed permutation of global row numbers.

A row's number is its rank by md5 of its id and carried values, so rows of one id spread like any others.  Equal
rows are counted first, which reads the table once; the rank needs one more shuffle of the narrow rows left, over
buckets of the md5's leading digits, whose offsets come from the counted rows.  A Feistel network permutes the numbers; a number that
leaves the table is sent through again until it is inside (cycle walking), so the result is a permutation of
exactly 0 .. n-1.  Place p goes to shard p mod k, slot p div k.  ``place_of`` and ``number_of`` compute either
way without reading any data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm import common
from quire.llm.common import checkpointed

ROUNDS = 4
#: Rows of a rank bucket that are aimed at.
BUCKET_ROWS = 2_000
#: Equal rows that are numbered at once; a longer run is cut, and its parts go to several tasks.
RUN = 10_000
_LOW = (1 << 32) - 1


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even domain that holds n numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [(seed * 2654435761 + i * 40503 + 97) & _LOW for i in range(1, ROUNDS + 1)]


def _mixed(x, key, mask):
    """The round function, on integers below 2**32; every product stays below 2**63."""
    t = (x * 40503 + key) & _LOW
    t = t ^ (t >> 15)
    t = (t * 1103515245 + 12345) & _LOW
    return (t ^ (t >> 13)) & mask


def _forth(x, bits, keys):
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return (left << bits) | right


def _back(x, bits, keys):
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, mask), left
    return (left << bits) | right


def _walk(x: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    bits, keys = half_bits(n), round_keys(seed)
    x = step(np.asarray(x, np.int64), bits, keys)
    while len(out := np.flatnonzero(x >= n)):
        x[out] = step(x[out], bits, keys)
    return x


def place_of(number: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the rows of these numbers stand after the shuffle."""
    return _walk(number, n, seed, _forth)


def number_of(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of place_of."""
    return _walk(place, n, seed, _back)


def rank_digits(n: int) -> int:
    """Leading hex digits of the md5 that make a rank bucket: 1 to 4, so at most 65,536 offsets."""
    digits = 1
    while digits < 4 and 16**digits * BUCKET_ROWS < n:
        digits += 1
    return digits


def _ident(keys: list[str]) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys)).cast("binary"))


def shuffle_shards(rows: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Number, permute and place every row: id, the carried columns, row_number, place, shard and slot.

    Shards differ by one row at most, and slots have no gap.  Equal rows are counted before the shuffle and
    expanded behind it, RUN at a time, so copies of one row don't meet in a task; they take neighbouring numbers.
    Null ids and values rank as the empty text.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    keys = [id_col, *carry]
    grouped = rows.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    grouped = checkpointed(grouped.withColumn("_md5", _ident(keys)))
    total, longest = grouped.agg(F.coalesce(F.sum("_copies"), F.lit(0)), F.coalesce(F.max("_copies"), F.lit(0))).first()
    bucket = F.substring("_md5", 1, rank_digits(total))
    # at most 65,536 sums come back
    counts = dict(grouped.groupBy(bucket.alias("b")).agg(F.sum("_copies")).collect())
    starts, at = [], 0
    for b in sorted(counts):
        starts.append((b, at))
        at += counts[b]
    offsets = spark.createDataFrame(starts, "_bucket string, _offset long")
    order = ["_md5", *(F.col(c).asc_nulls_first() for c in keys)]
    before = F.sum("_copies").over(W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    first = F.col("_offset") + F.col("_before")
    runs = (
        grouped.withColumn("_bucket", bucket)
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .join(F.broadcast(offsets), "_bucket")
        .select(*keys, (first + F.col("_copies") - 1).alias("_last"), F.explode(F.sequence(first, first + F.col("_copies") - 1, F.lit(RUN).cast("long"))).alias("_first"))
    )
    if longest > RUN:
        runs = runs.repartition("_first")
    numbered = runs.select(*keys, F.explode(F.sequence("_first", F.least(F.col("_first") + (RUN - 1), F.col("_last")))).alias("row_number"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema), "place long, shard int, slot long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = place_of(batch.column("row_number").to_numpy(zero_copy_only=False), total, seed) if len(batch) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array((place % n_shards).astype(np.int32)), pa.array(place // n_shards)], names=[*batch.schema.names, "place", "shard", "slot"])

    return numbered.mapInArrow(run, schema)


def op6_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """Shard and slot of every document, by the law that counts are at most one apart."""
    return shard_documents(common.table(spark, sf_dir, "documents"), n_shards, seed)


def shard_documents(docs: DataFrame, n_shards: int, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_shards(rows, n_shards, seed, carry=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _feistel_sql(seed: int) -> str:
    """One pass of the network over x in the table walk(…, x, bits, mask)."""
    out, left, right = [], "l0", "r0"
    for i, key in enumerate(round_keys(seed), 1):
        out.append(f"z{i} AS (SELECT * EXCLUDE (l{i - 1}, r{i - 1}), r{i - 1} AS l{i}, xor(l{i - 1}, f) AS r{i} FROM (SELECT *, xor(t2, t2 >> 13) & mask AS f FROM (SELECT *, (xor(t1, t1 >> 15) * 1103515245 + 12345) & {_LOW} AS t2 FROM (SELECT *, (r{i - 1} * 40503 + {key}) & {_LOW} AS t1 FROM {'halves' if i == 1 else f'q{i - 1}'}))))")
        out.append(f"q{i} AS (SELECT * EXCLUDE (t1, t2, f) FROM z{i})")
    return ", ".join(out)


def oracle(n_shards: int = 24, seed: int = 17) -> str:
    """The same rows by a global rank and a recursive walk; crc32 byte by byte from its polynomial."""
    step = f"""SELECT n, total, bits, mask, (l{ROUNDS} << bits) | r{ROUNDS} AS x FROM (
      WITH halves AS (SELECT n, total, bits, mask, x >> bits AS l0, x & mask AS r0 FROM {{src}}), {_feistel_sql(seed)} SELECT * FROM q{ROUNDS})"""
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT doc_id, octet_length(encode(text)) AS len, hex(encode(text)) AS h FROM d),
sized AS (SELECT doc_id, (len + 8)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes, crc_table),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS n FROM sized),
size AS (SELECT total, bits, (1::BIGINT << bits) - 1 AS mask FROM (SELECT count(*) AS total, greatest(1, (length(ltrim(bin(greatest(count(*) - 1, 1)), '0')) + 1) // 2)::BIGINT AS bits FROM documents)),
start AS (SELECT n, total, bits, mask, n AS x FROM ranked, size),
walk AS (({step.format(src="start")}) UNION ALL ({step.format(src="(SELECT * FROM walk WHERE x >= total)")})),
placed AS (SELECT n, x FROM walk WHERE x < total)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {n_shards})::INT AS shard, (x // {n_shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM ranked JOIN placed USING (n)
"""


ORACLE = oracle()
