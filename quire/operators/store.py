"""Stores: section trees by document, discovered patterns by fingerprint, results as JSON."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import CACHE_SIZE

BUCKETS = 64


class TreeStore:
    """Rows keyed by document_id as Parquet under a path, by a hash of the id and a version.

    Writes only append: a save is a new version of its documents, a delete a line that ends them, so no file that a
    plan may still read is ever replaced, and a write costs as much as its own rows.  The latest version of a
    document counts.  A lookup reads one hash bucket; compact() writes what counts to a new place.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{part}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _append(self, rows: DataFrame, part: str) -> None:
        last = max((x.agg(F.max("version")).first()[0] or 0 for x in (self._read("rows"), self._read("gone")) if x is not None), default=0)
        made = rows.withColumn("bucket", self._bucket()).withColumn("version", F.lit(last + 1))
        made.write.mode("append").partitionBy("bucket", "version").parquet(f"{self.path}/{part}")

    def _current(self, keep=None) -> DataFrame | None:
        rows, gone = self._read("rows"), self._read("gone")
        if rows is None:
            return None
        rows, gone = (x if x is None or keep is None else x.filter(keep) for x in (rows, gone))
        marks = rows.select("document_id", "version", F.lit(True).alias("there"))
        if gone is not None:
            marks = marks.unionByName(gone.select("document_id", "version", F.lit(False).alias("there")))
        latest = marks.groupBy("document_id").agg(F.max(F.struct("version", "there")).alias("m")).filter("m.there").select("document_id", F.col("m.version").alias("version"))
        return rows.join(latest, ["document_id", "version"], "left_semi").drop("bucket", "version")

    def all(self) -> DataFrame | None:
        return self._current()

    def save(self, rows: DataFrame) -> None:
        self._append(rows, "rows")

    def find(self, document_id: str) -> DataFrame | None:
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(document_id)), F.lit(self.buckets)).cast("int")).first()[0]
        return self._current((F.col("bucket") == bucket) & (F.col("document_id") == document_id))

    def delete(self, document_id: str) -> None:
        if self._read("rows") is not None:
            self._append(self.spark.createDataFrame([(document_id,)], "document_id string"), "gone")

    def missing(self, pages: DataFrame) -> DataFrame:
        """Pages of documents that are not stored; others are left as they are."""
        rows = self.all()
        return pages if rows is None else pages.join(rows.select("document_id").distinct(), "document_id", "left_anti")

    def compact(self, path: str) -> TreeStore:
        """A store at another path with the latest version of every document."""
        other, rows = TreeStore(self.spark, path, self.buckets), self.all()
        if rows is not None:
            other.save(rows)
        return other


def upsert(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Old rows whose key has no new row, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


class PatternCache:
    """Least recently used out first; an empty list is an entry too."""

    def __init__(self, most: int = CACHE_SIZE):
        if most < 1:
            raise ValueError(f"size must be positive, was {most}")
        self.most, self.held = most, OrderedDict()

    def get(self, key):
        if key not in self.held:
            return None
        self.held.move_to_end(key)
        return self.held[key]

    def put(self, key, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)


def most_recent(uses: DataFrame, most: int, key: str = "key", at: str = "at") -> DataFrame:
    """Keys that a cache of this size holds after the uses: those last used most recently."""
    last = uses.groupBy(key).agg(F.max(at).alias(at))
    return last.orderBy(F.desc(at), key).limit(most)


def write_results(rows: DataFrame, path: str) -> None:
    """Few summary rows as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
