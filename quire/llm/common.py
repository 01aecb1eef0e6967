"""Byte-level text primitives shared by the Arrow operators of this subpackage.

Texts arrive as Arrow string columns.  Their UTF-8 bytes are worked on in place, in runs of about ``CHUNK``
bytes, so a worker's memory does not depend on the number of rows in a batch.  A text is never cut.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
#: The bytes that separate words: space and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a class of Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: Bytes of an Arrow batch that goes to or from a Python worker.
ARROW_BYTES = 4 << 20
#: A value that more than one in so many rows have is joined by broadcast.
HEAVY = 500

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_place(rows: DataFrame) -> DataFrame:
    """The rows with their columns called _0, _1, ..., so that no name of theirs can clash with an operator's."""
    return rows.toDF(*(f"_{i}" for i in range(len(rows.columns))))


def checkpointed(frame: DataFrame) -> DataFrame:
    """Written to the folder of spark.checkpoint.dir and read again; only a local session may go without that setting."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local($|\[)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return frame.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES from now on, whatever the length of the texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def spread_join(left: DataFrame, right: DataFrame, on: str, n: int, how: str = "inner") -> DataFrame:
    """left (n rows) joined, inner or left, with right, which has one row for each value of on.

    Values that hold more than one in HEAVY of left's rows, of which there are fewer than HEAVY, are joined by
    broadcast, so no task gets all rows of one.  Both sides are read twice and should be checkpointed.
    """
    heavy = F.broadcast(left.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HEAVY > n).select(on))
    often = left.join(heavy, on, "left_semi").join(F.broadcast(right.join(heavy, on, "left_semi")), on, how)
    return often.unionByName(left.join(heavy, on, "left_anti").join(right, on, how))


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none.  Runs inside code generation."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc32(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each run of n words; the result is shorter by n - 1 (empty if there are too few words)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    made, length = words, 1  # made[i] covers words i .. i + length - 1
    for bit in bin(n)[3:]:
        made = made[: len(made) - length] * np.uint64(pow(int(_BASE), length, 1 << 64)) + made[length:]
        length *= 2
        if bit == "1":
            made = made[: len(made) - 1] * _BASE + words[length:]
            length += 1
    return mix(made)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets into them) of runs of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word; a word ends with its text."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which the words of a text are one space apart, and (start, end, text) of the words in them."""
    starts, ends, text = find_words(data, offsets)
    keep = ~IS_SPACE[data]
    gap = ends[:-1][text[1:] == text[:-1]]
    keep[gap] = True
    out = data[keep]
    place = np.cumsum(keep) - keep
    starts, length = place[starts], ends - starts
    out[place[gap]] = 0x20
    return out, starts, starts + length, text


def char_totals(data: np.ndarray) -> np.ndarray:
    """Code points before each byte (one entry more than bytes)."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values by text."""
    return np.bincount(text, values, n).astype(np.int64) if len(text) else np.zeros(n, np.int64)


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    length = ends - starts
    at = np.repeat(starts - (np.cumsum(length) - length), length)
    return data[at + np.arange(len(at))]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs earlier in the array."""
    out = np.zeros(len(keys), bool)
    at = np.flatnonzero(repeated(keys))
    if len(at):
        order = at[np.argsort(keys[at], kind="stable")]
        out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out
