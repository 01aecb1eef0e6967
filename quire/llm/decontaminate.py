"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

The index has, for each term, its postings (item and impact) in item order, the greatest impact in each block of
items that the term has postings in, and the greatest of all; its size is in proportion to the postings.  Every
training text is cut into overlapping passages, so wide that any item lies wholly in one, and every passage is a
query.  As in block-max WAND, the terms of a passage are ordered by their greatest impact, and those before the
pivot, which together cannot reach the least score that any item needs, never open a block: only postings of the
others do.  A block opened is dropped if the block maxima of all the passage's terms cannot reach what an item of
it needs; only in the blocks left are postings read and items scored.  All passages of a chunk take these steps
at once, in slices of bounded size.

What an item needs is the least score that a passage with ``OVERLAP`` of the item's words can have, so every item
that verification would accept is retrieved.  Every candidate is verified: the words of the item's question and
of its answer that lie in shingles shared with the passage.

Items beyond ``POSTINGS`` words go to further indexes.  Each is built, sent, searched and dropped before the next
one is built, so any number of items is searched in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import checkpointed

K1, B = 1.2, 0.75
#: Words of a shingle, and the shares of an item, its question and its answer that must be found in shingles.
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.6
#: Share of an item's words that is its question, where an item is one text.
QUESTION_SHARE = 2 / 3
#: Words of the items that are indexed at once, about; items of a block.
POSTINGS, BLOCK = 2_000_000, 8
#: Passages, and entries of lists, that are worked on at once.
PASSAGES, ENTRIES = 2_048, 1 << 19
#: Sums of impacts may differ by so much.
_EPS = 1e-3

_WORDY = np.zeros(256, bool)
_WORDY[list(range(ord("a"), ord("z") + 1)) + list(range(ord("0"), ord("9") + 1))] = True
_WORDY[128:] = True


@dataclass(frozen=True)
class Index:
    """Items of like length, those that need the least score first."""

    ids: list
    terms: np.ndarray  # sorted word hashes
    posting: np.ndarray  # term * items + item of every posting, sorted
    impact: np.ndarray  # BM25 part of every posting
    block: np.ndarray  # term * blocks + block of every block that a term has postings in, sorted
    bound: np.ndarray  # greatest impact of the term in that block
    first: np.ndarray  # (terms + 1,) where each term's blocks begin
    most: np.ndarray  # (terms,) greatest impact
    least: np.ndarray  # (items,) score from which an item is a candidate
    block_least: np.ndarray  # (blocks,)
    words: tuple[np.ndarray, ...]  # word hashes of each item
    question: np.ndarray  # words of each item that are its question
    width: int  # words of the longest item


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of lower-cased texts: runs of letters, digits and non-ASCII characters."""
    plain = np.where(_WORDY[data], data, 0x20).astype(np.uint8)
    starts, ends, text = common.find_words(plain, offsets)
    return (common.span_hashes(plain, starts, ends) if len(starts) else np.empty(0, np.uint64)), text


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def least_score(impact: np.ndarray, times: np.ndarray) -> float:
    """The least score that OVERLAP of an item's words can give; impact and times are of its terms.

    A term is lost with all its times; those with the greatest impact a time go first, the last one in part.
    """
    lost = times.sum() - math.ceil(OVERLAP * times.sum() - 1e-9)
    order = np.argsort(-impact / times, kind="stable")
    spent = np.minimum(times[order], np.maximum(lost - (np.cumsum(times[order]) - times[order]), 0))
    return float(impact.sum() - (impact[order] * spent / times[order]).sum())


def build(ids: list, questions: list[str], answers: list[str]) -> list[Index]:
    """Indexes of the items that have a word, by length in powers of four."""
    items = []
    for i, q, a in zip(ids, questions, answers, strict=True):
        parts = [next(((h, t) for _, _, d, o in common.chunks(_lowered(pa.array([x]))) for h, t in [words_of(d, o)]), (np.empty(0, np.uint64), 0))[0] for x in (q, a)]
        if len(parts[0]) + len(parts[1]):
            items.append((i, np.concatenate(parts), len(parts[0])))
    n = len(items)
    if not n:
        return []
    average = sum(len(w) for _, w, _ in items) / n
    everywhere, df = np.unique(np.concatenate([np.unique(w) for _, w, _ in items]), return_counts=True)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    classes: dict[int, list] = {}
    for i, w, q in items:
        t, tf = np.unique(w, return_counts=True)
        impact = idf[np.searchsorted(everywhere, t)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / average))
        classes.setdefault(max(3, (len(w).bit_length() + 1) // 2), []).append((least_score(impact, tf), i, w, q, t, impact))
    out = []
    for _, group in sorted(classes.items()):
        group.sort(key=lambda x: x[:2])
        terms, at = np.unique(np.concatenate([x[4] for x in group]), return_inverse=True)
        item = np.repeat(np.arange(len(group)), [len(x[4]) for x in group])
        posting = at * len(group) + item
        order = np.argsort(posting)
        posting, impact = posting[order], np.concatenate([x[5] for x in group])[order].astype(np.float32)
        blocks = -(-len(group) // BLOCK)
        owner = posting // len(group) * blocks + posting % len(group) // BLOCK
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        bound, least = np.maximum.reduceat(impact, start), np.array([x[0] for x in group])
        first = np.searchsorted(owner[start], np.arange(len(terms) + 1) * blocks)
        out.append(Index([x[1] for x in group], terms, posting, impact, owner[start], bound, first, np.maximum.reduceat(bound, first[:-1]), least, least[::BLOCK], tuple(x[2] for x in group), np.array([x[3] for x in group]), max(len(x[2]) for x in group)))
    return out


def passages(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, behind the last) of passages of 2 * width words, width apart, that cover every text."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])
    n = np.maximum(1, -(-(size - width) // width))
    own = np.repeat(np.arange(len(first)), n)
    lo = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * width
    return lo, np.minimum(lo + 2 * width, first[own] + size[own])


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, index) of the entries first .. first + n of several lists."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(which))


def _slices(n: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of lists that have about limit entries together."""
    upto, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, side="right")))
        yield slice(lo, hi)
        lo = hi


def _query(index: Index, own: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of every item that reaches what it needs; own: the passage (rising) of each term."""
    items, blocks = len(index.ids), len(index.block_least)
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    most = index.most[term].astype(np.float64)
    # the pivot of each passage: terms before it can't reach any item's need together
    order = np.lexsort((most, own))
    own, term, most = own[order], term[order], most[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size = np.diff(np.r_[start, len(own)])
    upto = np.cumsum(most)
    upto -= np.repeat(upto[start] - most[start], size)
    opens = upto >= index.block_least[0] - _EPS
    before = np.add.reduceat(np.where(opens, 0.0, most), start)
    spot = np.repeat(np.arange(len(start)), size)
    lists = np.flatnonzero(opens)
    if not len(lists):
        return none
    n = index.first[term[lists] + 1] - index.first[term[lists]]
    out = []
    for part in _slices(n, ENTRIES):
        which, entry = _expanded(index.first[term[lists[part]]], n[part])
        key = spot[lists[part]][which] * blocks + index.block[entry] % blocks
        opened, at = np.unique(key, return_inverse=True)
        out.append(np.stack([opened, np.bincount(at, index.bound[entry]).view(np.int64)]))
    key, at = np.unique(np.concatenate([o[0] for o in out]), return_inverse=True)
    total = np.bincount(at, np.concatenate([o[1] for o in out]).view(np.float64))
    # a bound by the block maxima of the terms that opened the block and all of the others, then by those alone
    keep = total + before[key // blocks] >= index.block_least[key % blocks] - _EPS
    passage, block = key[keep] // blocks, key[keep] % blocks
    found = []
    for part in _slices(size[passage], ENTRIES):
        p, b = passage[part], block[part]
        which, row = _expanded(start[p], size[p])
        wanted = term[row] * blocks + b[which]
        at = np.minimum(np.searchsorted(index.block, wanted), len(index.block) - 1)
        held = index.block[at] == wanted
        bound = np.bincount(which, np.where(held, index.bound[at], 0), len(p))
        good = bound >= index.block_least[b] - _EPS
        some = np.flatnonzero(held & good[which])
        lo = np.searchsorted(index.posting, term[row[some]] * items + b[which[some]] * BLOCK)
        hi = np.searchsorted(index.posting, term[row[some]] * items + np.minimum((b[which[some]] + 1) * BLOCK, items))
        from_, posting = _expanded(lo, hi - lo)
        key, at = np.unique(p[which[some[from_]]] * items + index.posting[posting] % items, return_inverse=True)
        if len(key):
            score = np.bincount(at, index.impact[posting])
            good = score >= index.least[key % items] - _EPS
            found.append((own[start[key[good] // items]], key[good] % items, score[good]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else none


def candidates(index: Index, words: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, behind the last, item, score) of each passage and item whose score reaches what the item needs."""
    lo, hi = passages(text, index.width)
    if not len(lo):
        return
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    # the terms of each passage, once each: a word counts unless it stood in the passage before
    spot = np.flatnonzero(index.terms[at] == words)
    order = spot[np.argsort(at[spot], kind="stable")]
    last = np.full(len(words), -1, np.int64)
    same = at[order[1:]] == at[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    a, z = np.searchsorted(spot, lo), np.searchsorted(spot, hi)
    for p in range(0, len(lo), PASSAGES):
        own, word = _expanded(a[p : p + PASSAGES], (z - a)[p : p + PASSAGES])
        own, word = own + p, spot[word]
        fresh = last[word] < lo[own]
        if fresh.any():
            passage, item, score = _query(index, own[fresh], at[word[fresh]])
            yield lo[passage], hi[passage], item, score


def verify(item: np.ndarray, n_question: int, passage: np.ndarray) -> tuple[float, float, float]:
    """Shares of the item's words, of its question's and of its answer's that lie in shingles of the passage.

    An item shorter than a shingle is one shingle as a whole; an empty question or answer counts as found.
    """
    n = min(SHINGLE, len(item))
    if len(passage) < n:
        return 0.0, 0.0, 0.0
    found = np.flatnonzero(np.isin(common.gram_hashes(item, n), common.gram_hashes(passage, n)))
    step = np.zeros(len(item) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + n, -1)
    covered = np.cumsum(step[:-1]) > 0
    share = lambda x: float(x.mean()) if len(x) else 1.0
    return share(covered), share(covered[:n_question]), share(covered[n_question:])


def leaks(indexes: list[Index], data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(text, item id, best score, question and answer overlap) of every item found in a text of a chunk."""
    words, text = words_of(data, offsets)
    best: dict[tuple[int, int, int], tuple] = {}
    for k, index in enumerate(indexes):
        for lo, hi, item, score in candidates(index, words, text):
            for a, z, j, s in zip(lo.tolist(), hi.tolist(), item.tolist(), score.tolist(), strict=True):
                total, question, answer = verify(index.words[j], int(index.question[j]), words[a:z])
                if total >= OVERLAP and question >= PART_OVERLAP and answer >= PART_OVERLAP:
                    key, got = (int(text[a]), k, j), (total, round(s, 4), question, answer)
                    best[key] = max(best.get(key, got), got)
    return [(t, indexes[k].ids[j], s, q, a) for (t, k, j), (_, s, q, a) in sorted(best.items())]


@dataclass(frozen=True)
class Items:
    """Test items, and as many groups of them as are indexed one after the other; iterating builds the indexes."""

    rows: DataFrame  # i, q, a
    groups: int

    def __iter__(self) -> Iterator[list[Index]]:
        for part in range(self.groups):
            rows = self.rows.filter(F.pmod(F.xxhash64("i", "q", "a"), F.lit(self.groups)) == part) if self.groups > 1 else self.rows
            got = sorted(rows.collect())
            yield build([r.i for r in got], [r.q for r in got], [r.a for r in got])


def index_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, limit: int = POSTINGS) -> Items:
    """The test items in groups of about limit words; items without an id, and those without a word, are not looked for.

    With question_col and answer_col those are the parts; else the first QUESTION_SHARE of a text's words is
    its question and the rest its answer.
    """
    if question_col is None:
        words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        cut = F.ceil(F.size(words) * QUESTION_SHARE).cast("int")
        question, answer = F.array_join(F.slice(words, 1, F.greatest(cut, F.lit(1))), " "), F.array_join(F.filter(words, lambda w, i: i >= cut), " ")
    else:
        question, answer = F.coalesce(F.col(question_col), F.lit("")), F.coalesce(F.col(answer_col), F.lit(""))
    rows = checkpointed(items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), question.alias("q"), answer.alias("a")).distinct())
    size = rows.agg(F.coalesce(F.sum(common.n_words(F.concat_ws(" ", "q", "a"))), F.lit(0))).first()[0]
    return Items(rows, max(1, -(-size // limit)))


def find_leaks(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, bm25, question_overlap and answer_overlap of every test item found in a row.

    A null or empty text holds no item; repeated rows each give their rows; an empty table on either side gives
    an empty result.
    """
    common.bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("item_id", items.rows.schema["i"].dataType), *(T.StructField(x, T.DoubleType()) for x in ("bm25", "question_overlap", "answer_overlap"))])
    out = None
    for indexes in items:
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, data, offsets in common.chunks(_lowered(batch.column(1))):
                    if found := leaks(shared.value, data, offsets):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + f[0] for f in found])), *(pa.array([f[i] for f in found]) for i in (1, 2, 3, 4))], names=schema.names)

        part = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
        if items.groups > 1:
            part = checkpointed(part)
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, items: Items, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, in whose text no test item is found; nothing is shuffled."""
    common.bounded_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns
    docs = common.by_place(docs)
    for indexes in items:
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for lo, _, data, offsets in common.chunks(_lowered(batch.column(at))):
                    clean[[lo + f[0] for f in leaks(shared.value, data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if items.groups > 1:
            docs = checkpointed(docs)
            shared.destroy()
    return docs.toDF(*names)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return find_leaks(common.table(spark, sf_dir, "documents"), index_items(common.table(spark, sf_dir, "benchmark")))
