"""URL rules by a sort-merge range join.

A host is written with its labels reversed and closed ("net.example.blog."), so a host and all its subdomains
are one interval of keys: those that begin with its own.  Such intervals nest or are apart.  Keys and rules are
sorted, merged and swept once, with a stack of the rules whose interval is open; what is on the stack at a key is
exactly what holds it.

Up to ``BLOCK_RULES`` rules go to every task, which sweeps the distinct hosts of each batch; URLs are not shuffled.
More rules are never gathered: distinct hosts and rules are dealt into ranges of keys, a rule into each range that
its interval reaches, and every range is swept by a task.  The paths of a host's rules nest by prefix in the same
way, so a second sweep over host and path finds the longest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import checkpointed

#: Rules that may go to every task.
BLOCK_RULES = 200_000
#: Keys of the sample that draws the ranges.
SAMPLE = 10_000
#: Stands between the labels of a key; _BEHIND is the next character.
_END, _BEHIND = "\x01", "\x02"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_key(host: str) -> str:
    return _END.join(reversed(host.split("."))) + _END


def _better(rule: Rule) -> tuple:
    """Sorts the winning rule first: the longest as written, then the longer host, then block before allow."""
    return -len(rule.name), -len(rule.host), rule.verdict != "block", rule.name


class RuleTable:
    """Rules by host, in key order, with the interval of each host."""

    def __init__(self, rules: Iterable[Rule]):
        by_host: dict[str, list[Rule]] = {}
        for rule in set(rules):
            by_host.setdefault(rule.host, []).append(rule)
        self.nodes = sorted((host_key(host), sorted(group, key=_better)) for host, group in by_host.items())
        self.rules = [rule for _, group in self.nodes for rule in group]
        self.number = {rule: i for i, rule in enumerate(self.rules)}

    def sweep(self, hosts: list[str]) -> list[tuple[Rule, ...]]:
        """For each host the rules that fit it by host, best first."""
        order = sorted(range(len(hosts)), key=lambda i: (host_key(hosts[i])))
        out: list[tuple[Rule, ...]] = [()] * len(hosts)
        stack: list[tuple[str, list[Rule]]] = []  # (end of the interval, rules)
        at = 0
        made: dict[tuple[int, ...], tuple[Rule, ...]] = {}
        for i in order:
            key = host_key(hosts[i])
            while at < len(self.nodes) and self.nodes[at][0] <= key:
                start, rules = self.nodes[at]
                while stack and stack[-1][0] <= start:
                    stack.pop()
                stack.append((start[:-1] + _BEHIND, rules))
                at += 1
            while stack and stack[-1][0] <= key:
                stack.pop()
            if stack:
                open_ = tuple(id(rules) for _, rules in stack)
                if open_ not in made:
                    made[open_] = tuple(sorted((r for _, rules in stack for r in rules), key=_better))
                # labels with control characters could share a key
                out[i] = tuple(r for r in made[open_] if hosts[i] == r.host or hosts[i].endswith("." + r.host)) if _END in hosts[i] or _BEHIND in hosts[i] else made[open_]
        return out


def judge(table: RuleTable, host: pa.Array, path: pa.Array) -> np.ndarray:
    """Number in table.rules of the best rule that fits each URL, or -1."""
    coded = host.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    best = np.full(len(code), -1)
    swept = table.sweep(coded.dictionary.to_pylist())
    kinds = {rules: k for k, rules in enumerate(dict.fromkeys(swept))}
    kind = np.array([kinds[rules] for rules in swept], np.int64)[code] if len(code) else code
    for rules, k in kinds.items():
        rows = np.flatnonzero(kind == k)
        for rule in rules:
            if not len(rows):
                break
            fits = pc.starts_with(path.take(pa.array(rows)), rule.path).to_numpy(zero_copy_only=False)
            best[rows[fits]] = table.number[rule]
            rows = rows[~fits]
    return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://" or for null."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), whole, 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), whole, 2)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _swept(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(key, rule): for every point key all interval keys that it begins with; both distinct, in a column key."""
    spark = points.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = points.select("key", F.lit(1).alias("kind")).union(intervals.select("key", F.lit(0).alias("kind")))
    sample = sorted(r.key for r in both.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row = [], []
            for i, (key, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                lo = hi = bisect_right(bounds, key)
                while not kind and hi < len(bounds) and bounds[hi].startswith(key):
                    hi += 1
                part += range(lo, hi + 1)
                row += [i] * (hi + 1 - lo)
            some = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *some.columns], names=["part", "key", "kind"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[str] = []
        now = None
        for batch in batches:
            keys, rules = [], []
            for part, key, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    now, stack = part, []
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                if kind:
                    keys += [key] * len(stack)
                    rules += stack
                else:
                    stack.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rules, pa.string())], names=["key", "rule"])

    dealt = both.mapInArrow(deal, "part int, key string, kind int")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, "key string, rule string")


def _by_ranges(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct hosts and paths that a rule fits; rules: host, path, verdict."""
    key = lambda host: F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _END), F.lit(_END))
    block = F.max(F.struct((F.col("verdict") == "block").alias("first"), "verdict"))["verdict"]  # block goes before allow
    rules = checkpointed(rules.groupBy("host", "path").agg(block.alias("verdict")).withColumn("rule", key(F.col("host"))))
    asked = checkpointed(urls.select("host", "path").filter("host <> ''").distinct().withColumn("key", key(F.col("host"))))
    open_ = _swept(asked.select("key").distinct(), rules.select(F.col("rule").alias("key")).distinct())
    # each path under every rule host that its host is under, then the longest rule path that it begins with
    spot = lambda rule: F.concat(rule, F.lit("\0"), F.col("path"))
    held = checkpointed(asked.join(open_, "key").withColumn("key", spot(F.col("rule"))).drop("rule"))
    fits = _swept(held.select("key").distinct(), rules.select(spot(F.col("rule")).alias("key")).distinct())
    longest = fits.groupBy("key").agg(F.max(F.struct(F.length("rule").alias("n"), "rule"))["rule"].alias("spot"))
    named = rules.select(spot(F.col("rule")).alias("spot"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    found = held.join(longest, "key").join(named, "spot").filter((F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host")))
    name = F.concat("rule_host", "rule_path")
    return found.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), F.length("rule_host").alias("m"), name.alias("rule"), "verdict")).alias("b")).select("host", "path", "b.rule", "b.verdict")


def filter_urls(urls: DataFrame, rules: DataFrame | Iterable[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Id, host, path, the winning rule (null if none fits) and the verdict (default if none fits) of every row.

    rules: rows of host, path and verdict.  A null URL, or one without "://", has an empty host and path, which
    no rule fits.  Repeated rows are judged alike, other columns are ignored, and an empty table gives an empty
    result.
    """
    spark = urls.sparkSession
    common.bounded_batches(spark)
    host, path = url_parts(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(sorted(set(rules)), "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict").na.drop().distinct()
    few = rules.limit(BLOCK_RULES + 1).collect()
    if len(few) > BLOCK_RULES:
        out = rows.join(_by_ranges(rows, rules), ["host", "path"], "left")
    else:
        table = RuleTable(Rule(*r) for r in few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, verdicts = (pa.array([getattr(r, x) for r in table.rules], pa.string()) for x in ("name", "verdict"))
            for batch in batches:
                best = judge(table, batch.column(1), batch.column(2))
                at = pa.array(best, mask=best < 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, names.take(at), verdicts.take(at)], names=[*batch.schema.names, "rule", "verdict"])

        schema = T.StructType([*rows.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
        out = rows.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return filter_urls(common.table(spark, sf_dir, "pages"), RULES)


ORACLE = f"""
WITH parts AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(rhost, rpath, v) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
hits AS (SELECT p.*, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM parts p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE k = 1
"""
