"""Work on Arrow batches of Python workers: bounded batches, rounding as Spark rounds, rankings, page texts."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker, and rows or elements of one that comes from there.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 1 << 16


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES from now on, or of one row that is longer; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half up on the shortest decimal form, which is what Spark's round() does."""
    scale = 10.0**digits
    size = np.abs(x) * scale
    whole = np.floor(size)
    k = np.where(size - whole >= 0.5, whole + 1, whole)
    for i in zip(*np.nonzero(np.abs(size - whole - 0.5) < 1e-5), strict=True):
        k[i] = float(Decimal(repr(float(abs(x[i])))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits))
    return np.where(size < 1e15, np.copysign(k / scale, x) + 0.0, x)


def best_first(scores: np.ndarray, preorder: np.ndarray) -> np.ndarray:
    """Places by score from the highest down (NaN is the highest), equal scores by preorder."""
    return np.lexsort((preorder, np.where(np.isnan(scores), -np.inf, -scores)))


def cosines(have: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosines of each asked vector with each one that is there; 0 with a zero vector.

    Products are added up from the first element to the last, so no figure depends on how the work is cut.
    """
    dot = np.zeros((len(asked), len(have)))
    for a, h in zip(asked.T, have.T, strict=True):
        dot += a[:, None] * h[None, :]
    length = lambda m: np.sqrt(sum((c * c for c in m.T), np.zeros(len(m))))
    norm = length(asked)[:, None] * length(have)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm == 0, 0.0, dot / norm)


def span_texts(numbers: np.ndarray, texts: pa.Array, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts of pages in each range, one below the other; null if there is nothing.

    Pages may come in any order; those without a text are passed over.  Many documents go at once with numbers
    that paged() has set apart.
    """
    there = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    numbers, texts = numbers[there], texts.filter(pa.array(there))
    order = np.argsort(numbers, kind="stable")
    if (np.diff(numbers[order]) == 0).any():  # a page that came twice: by its texts
        listed = texts.to_pylist()
        order = np.array(sorted(range(len(listed)), key=lambda i: (numbers[i], listed[i])))
    numbers = numbers[order]
    lo, hi = np.searchsorted(numbers, start, "left"), np.searchsorted(numbers, end, "right")
    n = np.maximum(hi - lo, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(lo - offsets[:-1], n) + np.arange(offsets[-1])
    parts = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), texts.cast(pa.large_string()).take(pa.array(order[at])))
    joined = pc.binary_join(parts, pa.scalar("\n", pa.large_string()))
    return pc.if_else(pc.equal(joined, pa.scalar("", pa.large_string())), pa.scalar(None, pa.large_string()), joined)


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row that each element of the flattened lists is in."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def paged(row: np.ndarray, number: pa.Array) -> np.ndarray:
    """Page numbers of many documents as one, those of each document apart from the others'."""
    return (row.astype(np.int64) << 32) + number.to_numpy(zero_copy_only=False).astype(np.int64)
