"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Features of a text are log counts of hashed byte trigrams, and pseudo-terms for its shape (how much of it is
symbols, capitals, digits, repeated words or lines), all weighted by inverse document frequency.  A truncated
SVD of a bounded sample of labelled rows gives the latent space; the sample's vectors and labels are broadcast.
Every document is compared with all of them by exact cosine, a block of documents times the whole table at a
time, and the labels of its nearest neighbours vote with their similarity.  Scoring is one pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common

#: Labelled rows to learn from at most; of more, those with the least hashes.
FIT_ROWS = 4_096
TRIGRAMS = 2_048
#: Shape measures, each told in steps.
SHAPES, STEPS = 8, 8
TERMS = TRIGRAMS + SHAPES * STEPS
DIMENSIONS = 64
NEIGHBOURS = 25
#: A neighbour votes with its similarity to this power.
POWER = 8
#: Weight of the shape terms among the others.
SHAPE_WEIGHT = 3.0

_CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 capital, 3 digit
_CLASS[list(b"#*$%&|<>!{}[]=_~^\\/@+")] = 1
_CLASS[list(range(ord("A"), ord("Z") + 1))] = 2
_CLASS[list(range(ord("0"), ord("9") + 1))] = 3


@dataclass(frozen=True)
class VoteModel:
    weight: np.ndarray  # (TERMS,) inverse document frequency
    basis: np.ndarray  # (TERMS, DIMENSIONS)
    vectors: np.ndarray  # (rows, DIMENSIONS), of length 1
    labels: np.ndarray  # (rows,) 0 or 1
    prior: float


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log counts of hashed trigrams and shape terms of each text of a chunk: (texts, TERMS) float32."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    if len(data) > 2:
        x = data.astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        inside = text[:-2] == text[2:]
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
        for lo in range(0, n, 256):  # counts of 256 texts at a time
            a, z = np.searchsorted(text[:-2], (lo, lo + 256))
            hi = min(n, lo + 256)
            got = np.bincount(((text[a:z] - lo) * TRIGRAMS + bucket[a:z])[inside[a:z]], minlength=(hi - lo) * TRIGRAMS)
            out[lo:hi, :TRIGRAMS] = np.log1p(got).reshape(hi - lo, TRIGRAMS)
    kind = _CLASS[data]
    whole = np.maximum(size, 1)
    starts, ends, owner = common.find_words(data, offsets)
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    salt = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    hashes = common.span_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    grams = common.gram_hashes(hashes, 3)
    first = np.flatnonzero(owner[: len(grams)] == owner[2:]) if len(grams) else np.empty(0, np.int64)
    old_words = common.seen_before(hashes ^ salt[owner]) if len(starts) else np.zeros(0, bool)
    old_grams = common.seen_before(grams[first] ^ salt[owner[first]]) if len(first) else np.zeros(0, bool)
    measures = [
        *(np.bincount(text[kind == k], minlength=n) / whole for k in (1, 2, 3)),
        np.bincount(owner[old_words], minlength=n) / words * 0.5,
        np.bincount(owner[first[old_grams]], minlength=n) / words,
        np.minimum((np.bincount(owner, ends - starts, n) if len(starts) else np.zeros(n)) / words / 16, 1),
        np.minimum(np.bincount(text[data == 10], minlength=n) / words, 1),
        np.minimum(np.log1p(words) / 12, 1),
    ]
    for i, m in enumerate(measures):
        step = np.minimum(np.sqrt(m) * STEPS, STEPS - 1e-6)
        # neighbouring steps share a value between them, so nearby shapes stay close
        lower = step.astype(np.int64)
        part = (step - lower).astype(np.float32)
        column = TRIGRAMS + i * STEPS
        out[np.arange(n), column + lower] += 1 - part
        out[np.arange(n), column + np.minimum(lower + 1, STEPS - 1)] += part
    return out


def project(found: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1 (0 for a text without features)."""
    found = found * weight
    trigrams = np.linalg.norm(found[:, :TRIGRAMS], axis=1, keepdims=True)
    found[:, :TRIGRAMS] /= np.maximum(trigrams, 1e-9)
    found[:, TRIGRAMS:] *= SHAPE_WEIGHT / np.sqrt(SHAPES) / 2
    made = found @ basis
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> VoteModel:
    """Learn from at most `most` labelled texts: the usable labels (0 or 1) whose document is there.

    Rows of one id, text and label count once, however often they stand in either table; of more than `most`, a
    hash of id and text chooses.  What comes to the driver is bounded by `most` rows at any skew.
    """
    common.bounded_batches(docs.sparkSession)
    known = labels.filter(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own"))
    rows = texts.join(known, "id").distinct().withColumn("order", F.xxhash64(F.col("id").cast("string"), "own", F.lit(3)))
    chosen = rows.orderBy("order", "label", "own", "id").limit(most).select("id", "own", "label").collect()
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen, f"id {docs.schema[id_col].dataType.simpleString()}, own long, label int")
    full = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = full.join(F.broadcast(sample), ["id", "own"]).select("id", "text", "label", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = []
            for i, x in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            for lo, hi, data, offsets in common.chunks(batch.column(1)):
                found = features(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (0, 2, 3)), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "label", "own", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, label int, own long, found binary").dropDuplicates(["id", "label", "own"])
    got = sorted(made.collect(), key=lambda r: (r.id, r.label, r.own))
    if not got:
        return VoteModel(np.ones(TERMS, np.float32), np.zeros((TERMS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32), 0.5)
    x = np.stack([np.frombuffer(bytes(r.found), np.float16) for r in got]).astype(np.float32)
    y = np.array([r.label for r in got], np.float32)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    weight[TRIGRAMS:] = 1
    same = project(x, weight, np.eye(TERMS, dtype=np.float32))
    # truncated SVD by subspace iteration from a fixed start
    q = np.random.default_rng(11).standard_normal((TERMS, min(DIMENSIONS + 16, len(x)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(same.T @ (same @ q))
    _, _, vt = np.linalg.svd(same @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :DIMENSIONS])
    return VoteModel(weight, basis, project(x, weight, basis), y, float(y.mean()))


def vote(model: VoteModel, vectors: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest neighbours; all that tie with the last one vote."""
    if not len(model.labels):
        return np.full(len(vectors), model.prior)
    out = np.empty(len(vectors))
    k = min(NEIGHBOURS, len(model.labels))
    for lo in range(0, len(vectors), 512):
        near = vectors[lo : lo + 512] @ model.vectors.T
        last = np.partition(near, -k, axis=1)[:, -k][:, None]
        power = np.where(near >= last, np.maximum(near, 0), 0).astype(np.float64) ** POWER
        total = power.sum(axis=1)
        out[lo : lo + 512] = np.where(total > 0, (power @ model.labels) / np.maximum(total, 1e-300), model.prior)
    return np.clip(out, 0.0, 1.0)


def score_quality(docs: DataFrame, model: VoteModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score (0 to 1, higher: label 1 likelier) of every row.

    A null or empty text is scored by its shape terms like any other; without any label every score is 0.5.
    Repeated rows agree, other columns are ignored, and an empty table gives an empty result.
    """
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(1)):
                got = [vote(model, project(part, model.weight, model.basis)) for part in [features(data, offsets)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.concatenate(got))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def held_out() -> Column:
    return F.pmod(common.id_crc32(F.col("doc_id")), F.lit(3)) == 1


def op1_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
