"""The pipeline's near copies against brute-force Jaccard of five-word shingles."""

import random
import re
from fractions import Fraction

import corpus_pipeline
import numpy as np
from quire.llm import near_copies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and Fraction(len(x & sets[j]), len(x | sets[j])) >= Fraction(4, 5):
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label


def near_texts(seed):
    """Near copies on both sides of 0.8, in groups small and large, with a common line and short texts."""
    r = random.Random(seed)
    line = [f"line{i}" for i in range(12)]
    out = []
    for k in range(12):
        base = [f"v{r.randint(0, 300)}" for _ in range(r.choice([8, 20, 60, 200]))] + (line if k % 3 else [])
        for _ in range(r.choice([1, 4, 25])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"n{r.randint(0, 99)}"
            out.append(r.choice([" ", "\n", "  "]).join(w[: r.randint(len(w) * 4 // 5, len(w))]).replace("v1", r.choice("vV") + "1"))
    out += ["a b", "A  b", "a b c", "", " \n", None, " ".join(line)]
    r.shuffle(out)
    return out


def test_jaccard_against_brute_force(spark):
    for seed in (1,):
        texts = near_texts(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        assert got == sorted(set(brute_groups(texts)))


def test_cells_of_large_families_and_tokens(spark, monkeypatch):
    """The same with grids of small cells, for shingles of many texts and for families of many."""
    monkeypatch.setattr(simhash, "CELL", 3)
    monkeypatch.setattr(near_copies, "CELL_SHINGLES", 150)
    monkeypatch.setattr(near_copies, "PAIRS", 40)
    texts = near_texts(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(x.doc_id for x in near_copies.one_of_each(docs).collect()) == sorted(set(brute_groups(texts)))
    assert near_copies.one_of_each(docs.filter("false")).count() == 0


def test_rows_without_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda words, k: " ".join([*words[:-k], *(f"x{k}{i}" for i in range(k))])
    named, lone = base, [f"u{i}" for i in range(60)]
    docs = [(4, " ".join(named)), (None, near(named, 1)), (None, near(named, 2))]
    docs += [(None, " ".join(lone)), (None, near(lone, 1)), (None, near(lone, 2)), (None, " ".join(lone)), (None, "on its own")]
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "").collect()]
    assert [x for x in got if x[0] is not None] == [docs[0]]
    assert sorted(t.split()[0] for i, t in got if i is None) == ["on", "u0"]


def test_unrelated_texts_that_share_lines_are_told_apart_early(spark, monkeypatch):
    """What unrelated texts share by chance grows with the square of a table, so hardly any of them may become a family."""
    monkeypatch.setattr(near_copies, "COMMON", 1 << 30)
    r = random.Random(3)
    lines = [[f"l{i}x{j}" for j in range(5)] for i in range(5)]
    texts = [" ".join([*sum(r.sample(lines, 2), []), *(f"w{r.randrange(10**6)}" for _ in range(120))]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = docs.select(near_copies.node(docs.text).alias("node"), "text").repartition(3)
    found = near_copies.candidates(named).select("a", "b").collect()
    assert len({x for row in found for x in row}) <= 100
    assert near_copies.one_of_each(docs).count() == 400


def test_blocks_of_wide_and_narrow_rows():
    """A block gives back its rows, with places and texts of 16 bits or more."""
    for k, m, top in ((5, 3, 9), (70_001, 70_001, 9), (5, 3, 1 << 20)):
        own = np.arange(k) % m
        token, at = np.arange(k).astype(np.uint64) + np.uint64((1 << 32) - k), np.arange(k) % top + (top - k if top > k else 0)
        node, n, fp = np.arange(m) - 2, np.arange(m) + (1 << 20), np.stack([-np.arange(m), np.arange(m) << 40])
        got = near_copies._unpack(7, near_copies._pack(token, at, own, node, n, fp))
        assert (got == np.stack([(7 << 32) + token.astype(np.int64), node[own], n[own], at, fp[0][own], fp[1][own]])).all()


def test_fingerprints_decide_only_as_a_filter(spark, monkeypatch):
    """Links of close SimHashes joined texts that prefixes had joined already; what fingerprints do is to keep pairs out."""
    texts = near_texts(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)

    def unasked(*_):
        raise AssertionError("no links of SimHashes are needed")

    monkeypatch.setattr(simhash, "links", unasked)
    assert sorted(x.doc_id for x in near_copies.one_of_each(docs).collect()) == sorted(set(brute_groups(texts)))
    fp = np.array([[0, 0, 3, -1], [0, 0, 5, 1]], np.int64).view(np.uint64)
    n, at = np.full(4, 100), np.zeros(4, np.int64)
    assert near_copies._fits(n, at, fp, np.array([0, 0, 0]), np.array([1, 2, 3])).tolist() == [0, 1]
