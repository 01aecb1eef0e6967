"""Quality rules by repetition coverage.

Each text is measured alone: its words and lines get rolling 64-bit hashes in numpy, and for several n-gram
lengths the characters that stand inside n-grams seen earlier in the text are counted, as are the characters
of lines seen earlier.  There is no shuffle; a task holds ``common.CHUNK`` bytes of text, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common


@dataclass(frozen=True)
class RepetitionRules:
    """Percentages above which a text is turned down.

    gram_percent: n-gram length to the most percent of a text's word characters that may stand in n-grams
    equal to an earlier n-gram.  line_percent: the same for the characters of lines equal to an earlier line.
    base_window, base_percent, least_words: the base rule.
    """

    gram_percent: dict[int, int] = field(default_factory=lambda: {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20})
    line_percent: int = 30
    base_window: int = 8
    base_percent: int = 30
    least_words: int = 20


SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _coverage(start: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether each of size words is covered by one of the windows of n words that begin at start."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The measures of each text of a chunk, by column."""
    n = len(offsets) - 1
    starts, ends, text = common.find_words(data, offsets)
    chars = common.char_totals(data)
    word_chars = chars[ends] - chars[starts]
    out = {"n_words": np.bincount(text, minlength=n).astype(np.int64), "word_chars": common.per_text(word_chars, text, n)}
    symbols = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = np.bincount(np.searchsorted(offsets, symbols, side="right") - 1, minlength=n).astype(np.int64)

    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(data == 10)
    line_from = np.concatenate([offsets[:-1], breaks + 1])
    line_to = np.concatenate([offsets[1:], breaks])
    line_text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((line_from, line_text))
    line_from, line_text = line_from[order], line_text[order]
    line_to = line_to[np.lexsort((line_to, np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])))]
    has_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to, line_text = line_from[has_word], line_to[has_word], line_text[has_word]
    salt = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    old = common.seen_before(common.span_hashes(data, line_from, line_to) ^ salt[line_text]) if len(line_from) else np.zeros(0, bool)
    line_chars = chars[line_to] - chars[line_from]
    out["n_dup_lines"] = common.per_text(old, line_text, n)
    out["line_chars"] = common.per_text(line_chars, line_text, n)
    out["dup_line_chars"] = common.per_text(line_chars * old, line_text, n)

    hashes = common.span_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    zero = np.zeros(n, np.int64)
    for length in sorted({rules.base_window, *rules.gram_percent}):
        grams = common.gram_hashes(hashes, length)
        first = np.flatnonzero(text[: len(grams)] == text[length - 1 :]) if len(grams) else np.empty(0, np.int64)
        keys = grams[first] ^ salt[text[first]]
        if length == rules.base_window:
            covered = _coverage(first[common.repeated(keys)], length, len(starts))
            out["n_repeat_words"] = common.per_text(covered, text, n) if len(starts) else zero
        if length in rules.gram_percent:
            covered = _coverage(first[common.seen_before(keys)], length, len(starts))
            out[f"dup_{length}gram_chars"] = common.per_text(word_chars * covered, text, n) if len(starts) else zero

    base = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.base_percent * out["n_words"])
    bad = 100 * out["dup_line_chars"] > rules.line_percent * out["line_chars"]
    for length, percent in rules.gram_percent.items():
        bad |= 100 * out[f"dup_{length}gram_chars"] > percent * out["word_chars"]
    return out | {"base_failed": base, "kept": ~base & ~bad}


def repetition_rules(docs: DataFrame, rules: RepetitionRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, its measures, base_failed and kept.

    A null or empty text has no words and fails the base rule.  Repeated rows and null ids are measured like
    any others, other columns are ignored, and an empty table gives an empty result.
    """
    rules = rules or RepetitionRules()
    common.bounded_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "dup_line_chars", *(f"dup_{n}gram_chars" for n in sorted(rules.gram_percent))]
    kind = lambda x: T.BooleanType() if x in ("base_failed", "kept") else T.LongType()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, kind(x)) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.chunks(batch.column(1)):
                found = measure(data, offsets, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(found[x]) for x in names)], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return repetition_rules(common.table(spark, sf_dir, "documents"))


_GRAMS = RepetitionRules().gram_percent
_BASE = RepetitionRules().base_window
_JOINED = {n: " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER t" for i in range(1, n))]) for n in sorted({*_GRAMS, _BASE})}


def _gram_sql(n: int) -> str:
    """Per document and word: whether an n-gram that covers the word is repeated, and whether one is seen earlier."""
    return f"""g{n} AS (SELECT doc_id, pos, w, {_JOINED[n]} AS g FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY pos)),
f{n} AS (SELECT doc_id, pos, w, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS many,
  CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) > 1 THEN 1 ELSE 0 END AS late FROM g{n}),
c{n} AS (SELECT doc_id, length(w) AS chars, max(many) OVER t AS many, max(late) OVER t AS late FROM f{n}
  WINDOW t AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
s{n} AS (SELECT doc_id, sum(many) AS many, sum(CASE WHEN late = 1 THEN chars ELSE 0 END) AS late FROM c{n} GROUP BY doc_id)"""


ORACLE = f"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
{", ".join(_gram_sql(n) for n in _JOINED)},
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM split),
lines AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM cut),
nth AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) AS k FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
by_line AS (SELECT doc_id, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_dup_lines, sum(length(l)) AS line_chars, sum(CASE WHEN k > 1 THEN length(l) ELSE 0 END) AS dup_line_chars FROM nth GROUP BY doc_id),
m AS (SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(d.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(s{_BASE}.many, 0)::BIGINT AS n_repeat_words, coalesce(l.line_chars, 0)::BIGINT AS line_chars, coalesce(l.dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(s{n}.late, 0)::BIGINT AS dup_{n}gram_chars" for n in sorted(_GRAMS))}
  FROM split d LEFT JOIN by_line l USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in _JOINED)})
SELECT *, (n_words < {RepetitionRules().least_words} OR 100 * n_repeat_words > {RepetitionRules().base_percent} * n_words) AS base_failed,
  NOT (n_words < {RepetitionRules().least_words} OR 100 * n_repeat_words > {RepetitionRules().base_percent} * n_words OR 100 * dup_line_chars > {RepetitionRules().line_percent} * line_chars
  {" ".join(f"OR 100 * dup_{n}gram_chars > {p} * word_chars" for n, p in _GRAMS.items())}) AS kept FROM m
"""
