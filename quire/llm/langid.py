"""Language identification by multilingual mixture inference.

Training counts letter n-grams by language on a bounded, stratified sample.  A document's words then have a
likelihood under each language, and expectation-maximisation estimates the shares of the languages in the
document.  Which languages are really there is a search by penalised likelihood: from the best single language
on, the language along which the likelihood rises fastest is added and the shares are estimated anew, until the
information criterion no longer improves; there is no limit on the size of the set but the learned languages.
Equal words of a text are scored once.  Scoring is one pass without a shuffle; the model is L x 65,536 numbers
for L languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common

BUCKETS = 1 << 16
#: Training rows of each language, about; beyond it a hash of the id chooses.
FIT_ROWS = 4_000
#: Languages that can be learned.
MAX_LANGUAGES = 512
ROUNDS = 8
#: Added to each count; weight of the information criterion; least likelihood of a word against its best language.
SMOOTH, PENALTY, FLOOR = 0.5, 2.0, 1e-30
#: Numbers (n-grams times languages) that are looked up at once.
LOOKUP = 1 << 22
#: A text of so many n-grams is of no learned language if one is less likely than in training by this log factor.
ENOUGH, STRANGE = 60, 3.0

_LETTER = np.zeros(256, bool)
_LETTER[list(range(ord("a"), ord("z") + 1))] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # (BUCKETS, languages)
    level: np.ndarray  # (languages,) mean log-likelihood of an n-gram in training


def letter_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, first byte of each word): the byte trigrams centred on letters of lower-cased text, with their word."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    letter = _LETTER[data]
    x = np.where(letter, data, 0x20).astype(np.uint32)
    before, after = np.r_[np.uint32(0x20), x[:-1]], np.r_[x[1:], np.uint32(0x20)]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = 0x20, 0x20
    start = letter & (before == 0x20)
    at = np.flatnonzero(letter)
    code = (before[at] << np.uint32(16)) | (x[at] << np.uint32(8)) | after[at]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return bucket, np.cumsum(start)[at] - 1, np.flatnonzero(start)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def fit(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Learn from the usable rows with a text and a language; about FIT_ROWS of each language at most."""
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_own"))
    counts = rows.groupBy("_own").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(str(r[0]) for r in counts))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    index = {lang: i for i, lang in enumerate(languages)}
    spark = docs.sparkSession
    share = spark.createDataFrame([(r[0], index[str(r[0])], min(1.0, FIT_ROWS / r[1])) for r in counts], f"_lang {docs.schema[lang_col].dataType.simpleString()}, _index int, _share double")
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(F.broadcast(share), F.col("_own") == F.col("_lang")).filter(chance < F.col("_share")).select("_text", "_index")
    common.bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, data, offsets in common.chunks(lowered(batch.column(0))):
                bucket, word, begin = letter_grams(data, offsets)
                if len(bucket):
                    text = np.searchsorted(offsets, begin, side="right") - 1
                    total += np.bincount(own[lo + text[word]] * BUCKETS + bucket, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    # the sample is bounded, so a few tasks count it and only a few tables come back
    tables = sample.repartition(8).mapInArrow(run, "counts binary").toLocalIterator()
    total = np.zeros((len(languages), BUCKETS))
    for row in tables:
        total += np.frombuffer(row.counts, "<i8").reshape(len(languages), BUCKETS)
    seen = max(1, int((total.sum(axis=0) > 0).sum()))
    log_p = np.log((total + SMOOTH) / (total.sum(axis=1, keepdims=True) + SMOOTH * seen))
    level = (total * log_p).sum(axis=1) / np.maximum(total.sum(axis=1), 1)
    return LanguageModel(languages, np.ascontiguousarray(log_p.T.astype(np.float32)), level)


def _firsts(own: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, own[1:] != own[:-1]])


def _log_likelihoods(model: LanguageModel, bucket: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(words, languages): summed over each word's n-grams bucket[first : first + n], a block of words at a time."""
    out = np.empty((len(first), len(model.languages)))
    upto = np.cumsum(n) * max(1, len(model.languages))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LOOKUP, side="right")))
        grams = common.take_spans(bucket, first[lo:hi], first[lo:hi] + n[lo:hi])
        out[lo:hi] = np.add.reduceat(model.log_p[grams], np.cumsum(n[lo:hi]) - n[lo:hi], axis=0, dtype=np.float64)
        lo = hi
    return out


def _shares(likely: np.ndarray, count: np.ndarray, own: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """EM over counted words: likely is (words, languages), own the text (0, 1, ...) of each, share (texts, languages)."""
    first = _firsts(own)
    n = np.add.reduceat(count, first)[:, None]
    for _ in range(rounds):
        part = likely * share[own]
        part *= (count / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / n
    return share


def search(likely: np.ndarray, count: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Shares (texts, languages) of the set of languages that the information criterion chooses for each text."""
    first = _firsts(own)
    texts, n_lang = len(first), likely.shape[1]
    n = np.add.reduceat(count, first)
    fit = np.add.reduceat(np.log(likely) * count[:, None], first, axis=0)
    lead = np.argmax(fit, axis=1)
    best = np.zeros((texts, n_lang))
    best[np.arange(texts), lead] = 1.0
    least = -2 * fit[np.arange(texts), lead]
    open_ = np.arange(texts)  # texts whose set may still grow
    for k in range(2, n_lang + 1):
        rows = np.flatnonzero(np.isin(own, open_))
        if not len(rows):
            break
        at, now, words = np.searchsorted(open_, own[rows]), likely[rows], count[rows]
        share, total = best[open_], n[open_]
        rise = np.add.reduceat(now * (words / (now * share[at]).sum(axis=1))[:, None], _firsts(at), axis=0) / total[:, None]
        rise[share > 0] = 0
        more = np.argmax(rise, axis=1)
        some = rise[np.arange(len(open_)), more] > 1  # else no share of any other language makes the text likelier
        share = share * (1 - 1 / k)
        share[np.arange(len(open_)), more] += 1 / k
        keep = some[at]
        if not keep.any():
            break
        open_, share, total = open_[some], share[some], total[some]
        at, now, words = np.searchsorted(open_, own[rows[keep]]), now[keep], words[keep]
        share = _shares(now, words, at, share, ROUNDS)
        cost = -2 * np.add.reduceat(np.log((now * share[at]).sum(axis=1)) * words, _firsts(at)) + PENALTY * (k - 1) * np.log(np.maximum(total, 2))
        better = cost < least[open_] - 1e-9
        open_ = open_[better]
        best[open_], least[open_] = share[better], cost[better]
    return best


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language index or -1, its share, languages in the chosen set, strangeness) of each lower-cased text.

    Strangeness is how much less likely an n-gram of the text is than one of its language in training, as a
    logarithm; 0 for texts of fewer than ENOUGH n-grams.
    """
    texts, n_lang = len(offsets) - 1, len(model.languages)
    best, score, size, strange = np.full(texts, -1), np.zeros(texts), np.zeros(texts, np.int64), np.zeros(texts)
    bucket, word, begin = letter_grams(data, offsets)
    if not len(bucket) or not n_lang:
        return best, score, size, strange
    word_first = _firsts(word)
    n_grams = np.diff(np.r_[word_first, len(word)])
    # each distinct word is looked up once, and counted once for each text
    _, name, same = np.unique(common.span_hashes(data, begin, begin + n_grams), return_index=True, return_inverse=True)
    log_l = _log_likelihoods(model, bucket, word_first[name], n_grams[name])
    top = log_l.max(axis=1)
    text = np.searchsorted(offsets, begin, side="right") - 1
    pairs, count = np.unique(text * len(name) + same, return_counts=True)
    text, kind = pairs // len(name), pairs % len(name)
    first = _firsts(text)
    owner, own = text[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(text)]))
    count = count.astype(np.float64)
    likely = np.maximum(np.exp(log_l - top[:, None]), FLOOR)[kind]
    share = search(likely, count, own)
    found = np.argmax(share, axis=1)
    spot = np.arange(len(first))
    # a text of one language supports it less surely than its share says if it is short
    whole = np.add.reduceat(log_l[kind] * count[:, None], first, axis=0)
    odds = np.exp(whole - whole.max(axis=1, keepdims=True))
    size[owner] = (share > 0).sum(axis=1)
    best[owner], score[owner] = found, np.clip(np.where(size[owner] == 1, odds[spot, found] / odds.sum(axis=1), share[spot, found]), 0.0, 1.0)
    grams = np.add.reduceat(n_grams[name][kind] * count, first)
    mean = np.add.reduceat((np.log((likely * share[own]).sum(axis=1)) + top[kind]) * count, first) / grams
    strange[owner] = np.where(grams >= ENOUGH, model.level[found] - mean, 0.0)
    return best, score, size, strange


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in keep (all by default) with lang_pred, score and n_langs, which replace columns so called.

    A null text, or one without a letter, gets "und", 0.0 and 0, as does any text if no language was learned.
    Rows are judged one by one, so repeated rows agree; an empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "n_langs")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_langs", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.bounded_batches(docs.sparkSession)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            texts = pc.fill_null(batch.column(n), "")
            letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in common.chunks(lowered(texts), common.CHUNK // (1 + len(model.languages) // 16)):
                best, score, size, _ = infer(model, data, offsets)
                none = ~letters[lo:hi]
                best[none], score[none], size[none] = -1, 0.0, 0
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:n]), pa.array(names[best], pa.string()), pa.array(score), pa.array(size.astype(np.int32))], names=schema.names)

    return docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def held_out() -> Column:
    return F.pmod(common.id_crc32(F.col("doc_id")), F.lit(4)) == 2


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return identify(docs, model, keep=("doc_id",)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_langs")


def known_language(docs: DataFrame, model: LanguageModel, least: float = 0.3, strangest: float = STRANGE, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, of which one learned language makes up at least the given share.

    Texts that are null or have no letter go, and so do longer ones whose n-grams are less likely, by a factor
    of exp(strangest), than those of their language in training: they are of a language that was not learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            keep = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False).copy()
            for lo, hi, data, offsets in common.chunks(lowered(texts), common.CHUNK // (1 + len(model.languages) // 16)):
                best, score, _, strange = infer(model, data, offsets)
                keep[lo:hi] &= (best >= 0) & (score >= least) & (strange <= strangest)
            yield batch.filter(pa.array(keep))

    clear = common.by_place(docs)
    return clear.mapInArrow(run, clear.schema).toDF(*docs.columns)
