"""The operators on awkward rows, and against brute force."""

import dataclasses
import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, langid, license_scan, mixing, quality_vote, repetition, sharding, simhash, substring_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, "One two.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", "b"), (5, " \n\t", "fr", "b"), (6, "One two.", "en", "a"), (6, "One two.", "en", "a"), (None, "null id here", "en", None), (8, "été\u00a0😀 x", "fr", "c")]


def rows(spark, listed=ODD):
    """documents with further columns whose names operators use themselves."""
    made = spark.createDataFrame(listed, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return made.withColumns({c: F.lit("x") for c in ("score", "copies", "shard", "fp", "size", "found", "rule", "_id", "_text")})


def empty(spark):
    return rows(spark).filter("false")


def test_repetition(spark):
    block = "a b c d e f g h i j "
    got = {r.doc_id: r for r in repetition.repetition_rules(rows(spark, [(1, block * 9, "", ""), (2, "x y\nx y\n\nz", "", ""), (3, None, "", ""), (4, LONG, "", "")])).collect()}
    assert got[1].n_repeat_words == 90 and got[1].base_failed and not got[1].kept
    assert (got[2].n_words, got[2].n_dup_lines, got[2].word_chars) == (5, 1, 5)
    assert got[3].n_words == 0 and got[3].base_failed
    assert repetition.repetition_rules(rows(spark)).count() == len(ODD) and repetition.repetition_rules(empty(spark)).count() == 0


def test_repetition_by_brute_force(spark):
    random.seed(1)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(40)]
    got = {r.doc_id: r.n_repeat_words for r in repetition.repetition_rules(rows(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(grams)
        assert got[i] == len({j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 8)})


def test_license(spark):
    texts = ["x\n\nLicensed under CC BY-NC 4.0.", "Released under the MIT License.", "His driving license was lost", "Licensed under the Foo Community License", "All rights reserved.", None, "", "This is\nlicensed under the GNU General\n  Public License, version 3.\nAll rights reserved.", "Code: Apache 2.0", "Released under Mozilla Public terms v. 2.0", "x.\n\n\nTerms: MPL 2.0"]
    got = {}
    for r in license_scan.scan(rows(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert {i: sorted(x) for i, x in got.items()} == {0: [(3, "CC-BY-NC")], 1: [(1, "MIT")], 3: [(1, "unknown")], 4: [(1, "All-Rights-Reserved")], 7: [(1, "GPL"), (2, "All-Rights-Reserved")], 8: [(1, "Apache-2.0")], 9: [(1, "MPL-2.0")], 10: [(4, "MPL-2.0")]}
    assert license_scan.scan(empty(spark)).count() == 0 and license_scan.scan(rows(spark)).count() == 0


HELD_OUT = [
    ("Apache-2.0", "Covered by the Apache License, version 2.0, which you will find next to this text"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License'),
    ("MIT", "Everything in this folder is MIT licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
    ("GPL", "It may be copied only under the GNU General Public License, version 2"),
    ("GPL", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License"),
    ("LGPL", "Linked libraries are under the GNU Lesser General Public License, version 3"),
    ("AGPL", "The server is under the GNU Affero General Public License"),
    ("BSD", "You may choose the BSD 2-Clause License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "Our plug-ins fall under the Mozilla Public License 2.0"),
    ("CC-BY", "Figures: CC BY 4.0, the authors"),
    ("CC-BY-SA", "Text shared under CC BY-SA 3.0"),
    ("CC-BY-NC", "Photographs are CC BY-NC-SA 2.0"),
    ("CC0", "We place the tables under CC0 1.0 Universal"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
    ("All-Rights-Reserved", "Copyright 2014 by Mary Major. All rights reserved."),
    ("unknown", "Python Software Foundation License Version 2"),
    ("unknown", "Boost Software License"),
    ("unknown", "The Unlicense"),
    ("unknown", "WTFPL license"),
    ("unknown", "zlib License"),
    ("unknown", "Licensed under the Harbour Data Licence"),
    ("unknown", "Released under the Solderpad Hardware License v2.1"),
    (None, "He said all rights reserved by citizens are holy"),
    (None, "The bar owner waited a year for his liquor license"),
    (None, "A licensed plumber has to look at the pipes"),
    (None, "Students of MIT met people of the Apache tribe"),
    (None, "The general public may visit the free library"),
    (None, "Version 3 of the form was published in May"),
    (None, "Copyright is a subject that lawyers study"),
    (None, "The warranty covers wheels and brakes"),
    (None, "The river has its source in the hills"),
    (None, "She had permission to use the room for any purpose"),
]


def test_license_on_notices_it_has_not_seen(spark):
    seen = {t for _, t in license_scan.examples()}
    assert not seen & {t for _, t in HELD_OUT}
    got = {r.doc_id: r.family for r in license_scan.scan(rows(spark, [(i, t, "", "") for i, (_, t) in enumerate(HELD_OUT)])).collect()}
    wrong = [(got.get(i), want, t) for i, (want, t) in enumerate(HELD_OUT) if got.get(i) != want]
    assert len(wrong) <= 1, wrong


def test_license_gate_changes_nothing(spark, monkeypatch):
    """Random paragraphs of the model's own words, scored with and without the gate."""
    m, r = license_scan.model(), random.Random(4)
    plain = sorted({w for g in m.weights for w in g.split()} - set(m.gate))
    every = sorted({w for g in m.weights for w in g.split()})
    texts = [" ".join(r.choices(plain, k=r.randint(1, 120))) for _ in range(150)] + [" ".join(r.choices(every, k=r.randint(1, 25))) for _ in range(150)] + [" ".join(plain)]
    found = lambda: sorted(map(tuple, license_scan.scan(rows(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()))
    gated = found()
    monkeypatch.setattr(license_scan, "model", lambda: dataclasses.replace(m, gate=tuple(every)))
    assert gated == found() and len(gated) >= 10


def test_targets_and_flow():
    assert mixing.weight_targets([10, 100, 100], [5, 2, 1]) == [20.0, 196.66666666666666, 98.33333333333333]
    sent = mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 5)], [20, 12], 2)
    assert sum(f.get(0, 0) for f in sent) == 20 and sum(f.get(1, 0) for f in sent) == 12
    assert sum(max(0, sum(f.values()) - z) for f, z in zip(sent, (10, 10, 5), strict=True)) == 7  # no flow repeats fewer words


def test_mixing(spark):
    random.seed(2)
    listed = [(i, " ".join(["w"] * random.randint(0, 30)), "", random.choice(["a", "b", "c", None])) for i in range(300)]
    got = mixing.mix_documents(rows(spark, listed)).collect()
    again = mixing.mix_documents(rows(spark, listed[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 300
    taken = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.target] += r.taken
    assert all(abs(t - n) <= 31 for t, n in taken.items())
    assert mixing.mix_documents(empty(spark)).count() == 0 and mixing.mix_documents(rows(spark)).count() == len(ODD)


def test_mixing_overlap(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(100)], "doc_id long, sources array<string>, size long")
    got = mixing.mix_sources(docs, weights=(1, 1), share=1.0).collect()
    routed = Counter(s for r in got for s in r.routes)
    assert all(len(r.routes) == r.copies for r in got) and routed["a"] > 0 and routed["b"] > 0


def brute_routes(docs, sent, seed=23):
    """Words that go to each source if documents in order of their keys are cut where the flow says."""
    key = lambda i, size: hashlib.md5(f"{seed}:{i}:{size}".encode()).hexdigest()
    out, copies = Counter(), Counter()
    for pattern, flow in sent.items():
        rows = sorted((key(i, n), i, n) for i, p, n in docs if p == pattern)
        words, total = sum(n for _, _, n in rows), sum(flow.values())
        bounds, at = [], 0
        for s in sorted(flow):
            bounds.append((at, at + flow[s], s))
            at += flow[s]
        for copy in range(2):
            upto = copy * words
            for _, i, n in rows:
                if 2 * upto + n <= 2 * total:
                    copies[i] += 1
                    out[next((s for a, b, s in bounds if a <= upto + n / 2 < b), bounds[-1][2])] += n
                upto += n
    return out, copies


def test_mixing_of_overlapping_sources_by_brute_force(spark):
    r = random.Random(7)
    kinds = [("a",), ("a", "b"), ("b", "c"), ("c",), ("a", "b", "c")]
    docs = [(i, r.choice(kinds), r.randint(1, 30)) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame([(i, list(p), n) for i, p, n in docs], "doc_id long, sources array<string>, size long")).collect()
    names = ["a", "b", "c"]
    sizes = [sum(n for _, p, n in docs if s in p) for s in names]
    quotas = [int(t) for t in mixing.weight_targets(sizes, [5, 2, 1])]
    listed = sorted(set(kinds))
    words = {p: sum(n for _, q, n in docs if q == p) for p in listed}
    flow = mixing.min_cost_flow([([names.index(s) for s in p], words[p]) for p in listed], quotas, 2)
    want, copies = brute_routes(docs, {p: {names[s]: w for s, w in f.items()} for p, f in zip(listed, flow, strict=True)})
    routed = Counter()
    for x in got:
        assert len(x.routes) == x.copies == copies[x.doc_id] and set(x.routes) <= set(x.sources)
        for s in x.routes:
            routed[s] += x.size
    filled = [sum(f.get(k, 0) for f in flow) for k in range(3)]  # the sources overlap, so not every quota can be
    assert all(abs(routed[s] - want[s]) <= 60 and abs(routed[s] - n) <= 60 for s, n in zip(names, filled, strict=True)), (routed, want, filled, quotas)


def test_flow_against_every_way():
    r = random.Random(5)
    for _ in range(60):
        patterns = [(sorted(r.sample(range(3), r.randint(1, 3))), r.randint(0, 4)) for _ in range(3)]
        quotas = [r.randint(0, 6) for _ in range(3)]
        sent = mixing.min_cost_flow(patterns, quotas, 2)
        assert all(sum(f.get(s, 0) for f in sent) <= q for s, q in enumerate(quotas)) and all(sum(f.values()) <= 2 * z for f, (_, z) in zip(sent, patterns, strict=True))
        # the least cost of a largest flow, by words of each pattern
        feasible = lambda used: all(sum(u for u, (m, _) in zip(used, patterns, strict=True) if set(m) <= set(c)) <= sum(quotas[s] for s in c) for k in (1, 2, 3) for c in combinations(range(3), k))
        ways = [used for used in product(*(range(2 * z + 1) for _, z in patterns)) if feasible(used)]
        cost = lambda used: sum(max(0, u - z) for u, (_, z) in zip(used, patterns, strict=True))
        most = max(map(sum, ways))
        mine = [sum(f.values()) for f in sent]
        assert sum(mine) == most and cost(mine) == min(cost(u) for u in ways if sum(u) == most)


def test_mixed_rows_of_null_and_repeated_ids(spark):
    listed = [(None, f"{'w ' * (i % 9 + 1)}{i}", "", "a" if i < 20 else "b") for i in range(420)] + [(7, "same text here", "", "b")] * 300 + [(7, "other", "", "a")]
    docs = rows(spark, listed)
    got = mixing.mixed_rows(docs).collect()
    assert len(got[0]) == len(docs.columns) and mixing.mixed_rows(docs).columns == docs.columns
    have, took = Counter((d[0], d[1], d[3]) for d in listed), Counter((x.doc_id, x.text, x.source) for x in got)
    assert all(took[k] <= 2 * n for k, n in have.items()) and set(took) <= set(have)
    sizes = {s: sum(len(d[1].split()) for d in listed if d[3] == s) for s in "ab"}
    for s, target in zip("ab", mixing.weight_targets([sizes["a"], sizes["b"]], [5, 2]), strict=True):
        assert abs(sum(len(x.text.split()) for x in got if x.source == s) - target) <= 10
    again = mixing.mixed_rows(docs.repartition(5)).collect()
    assert Counter((x.doc_id, x.text, x.source) for x in again) == took
    assert mixing.mixed_rows(empty(spark)).count() == 0
    for k, r in ((0, mixing.mix_documents(docs).collect()),):
        assert len(r) == len(listed) and all(abs(sum(x.taken for x in r if x.target == t) - t) <= 10 for t in {x.target for x in r})


def test_language(spark):
    en, fr = "the house of that man is on the hill with the others", "les maisons de cet homme sont sur la colline avec les autres"
    listed = [(i, " ".join(random.Random(i).sample((en if i % 2 else fr).split(), 8)), "en" if i % 2 else "fr", "a") for i in range(200)]
    docs = rows(spark, listed)
    model = langid.fit(docs, ~langid.held_out())
    got = langid.identify(docs, model, keep=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(rows(spark), model, keep=("doc_id",)).collect()}
    assert odd[2].lang_pred == odd[3].lang_pred == odd[5].lang_pred == "und" and odd[8].lang_pred != "und"
    both = langid.identify(rows(spark, [(1, " ".join([en] * 6 + [fr] * 4), "", "")]), model).first()
    assert both.n_langs == 2 and 0.4 < both.score < 0.8
    kept = langid.known_language(rows(spark), model)
    assert kept.columns == rows(spark).columns and {r.doc_id for r in kept.collect()} == {None, 1, 6, 8}  # 4 has words of no learned language
    none = langid.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(rows(spark), none).collect()} == {"und"}


def brute_language(model, text):
    """The chosen shares of one text, word by word, with every set of languages that greedy search visits."""
    words = [w for w in re.split(r"[^a-z\x80-\xff]+", text.lower().encode().decode("latin-1")) if w]
    likely = []
    for w in words:
        padded = " " + w + " "
        codes = [(ord(padded[i]) << 16 | ord(padded[i + 1]) << 8 | ord(padded[i + 2])) * 2654435761 % 2**32 >> 16 for i in range(len(w))]
        log = [sum(float(model.log_p[c, k]) for c in codes) for k in range(len(model.languages))]
        likely.append([max(math.exp(x - max(log)), langid.FLOOR) for x in log])
    n = range(len(model.languages))
    fit = lambda share: sum(math.log(sum(p * s for p, s in zip(x, share, strict=True))) for x in likely)
    share = [0.0] * len(n)
    share[max(n, key=lambda k: sum(math.log(x[k]) for x in likely))] = 1.0
    least = -2 * fit(share)
    for size in range(2, len(n) + 1):
        rise = [0 if share[k] > 0 else sum(x[k] / sum(p * s for p, s in zip(x, share, strict=True)) for x in likely) / len(likely) for k in n]
        more = max(n, key=lambda k: rise[k])
        if rise[more] <= 1:
            break
        tried = [s * (1 - 1 / size) + (k == more) / size for k, s in enumerate(share)]
        for _ in range(langid.ROUNDS):
            parts = [[p * s / sum(a * b for a, b in zip(x, tried, strict=True)) for p, s in zip(x, tried, strict=True)] for x in likely]
            tried = [sum(p[k] for p in parts) / len(parts) for k in n]
        cost = -2 * fit(tried) + langid.PENALTY * (size - 1) * math.log(max(len(likely), 2))
        if cost >= least - 1e-9:
            break
        share, least = tried, cost
    return share


def test_language_sets_by_brute_force():
    r = random.Random(11)
    vocabulary = [["".join(r.choice(letters) for _ in range(5)) for _ in range(30)] for letters in ("abcde", "defgh", "ghijk", "klmno", "opqrs", "rstuv", "uvwxy")]
    total = np.full((7, langid.BUCKETS), 0.01)
    for k, words in enumerate(vocabulary):
        for text in words * 20:
            bucket, _, _ = langid.letter_grams(np.frombuffer(text.encode(), np.uint8), np.array([0, 5]))
            np.add.at(total[k], bucket, 1)
    model = langid.LanguageModel(tuple("abcdefg"), np.log(total / total.sum(axis=1, keepdims=True)).T.astype(np.float32), np.zeros(7))
    texts = [" ".join(r.choice(vocabulary[k]) for k in r.choices(r.sample(range(7), size), k=60)) for size in (1, 2, 3, 5, 6, 7, 1, 4)]
    data = "".join(texts).encode()
    best, score, size, _ = langid.infer(model, np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
    for i, text in enumerate(texts):
        share = brute_language(model, text)
        assert size[i] == sum(s > 0 for s in share) and best[i] == int(np.argmax(share))
        assert size[i] == 1 or abs(score[i] - max(share)) < 1e-6
    assert size.max() >= 6


def test_strange_languages_go(spark):
    en = "the house of that man is on the hill with the others and some people in the old town drew the plan of a river"
    docs = rows(spark, [(i, " ".join(random.Random(i).sample(en.split(), 14)), "en", "a") for i in range(100)] + [(200, "zxq wvk qqj zzk xkcd pqzr wvx qjz vvk zzx qxk wvz kqj zxq wvk qqj zzk xkcd pqzr wvx qjz", None, "a")])
    assert {x.doc_id for x in langid.known_language(docs, langid.fit(docs, F.lit(True))).collect()} == set(range(100))


def test_votes_by_brute_force():
    rng = np.random.default_rng(2)
    length = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, labels = length(rng.standard_normal((300, 8))).astype(np.float32), rng.integers(0, 2, 300).astype(np.float32)
    vectors[100:110] = vectors[100]  # ties
    model = quality_vote.VoteModel(np.ones(1), np.ones((1, 1)), vectors, labels, 0.5)
    asked = np.concatenate([length(rng.standard_normal((40, 8))).astype(np.float32), vectors[95:105]])
    for q, got in zip(asked, quality_vote.vote(model, asked), strict=True):
        near = [float(np.dot(q, v)) for v in vectors]
        last = sorted(near)[-quality_vote.NEIGHBOURS]
        power = [max(x, 0) ** quality_vote.POWER if x >= last - 1e-7 else 0 for x in near]
        assert abs(got - sum(p * y for p, y in zip(power, labels, strict=True)) / sum(power)) < 1e-4


def test_quality_sample_is_bounded(spark):
    docs = rows(spark, [(1, f"text number {i} of one id", "", "") for i in range(600)] + [(2, "equal rows", "", "")] * 600)
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1), (3, 1)], "doc_id long, quality int")
    assert len(quality_vote.fit(docs, labels, F.lit(True), most=50).labels) == 50
    model = quality_vote.fit(docs.filter("doc_id = 2"), labels, F.lit(True), most=50)
    assert model.labels.tolist() == [0.0]


def test_quality(spark):
    good = lambda i: " ".join(random.Random(i).sample("the plan of a house was drawn by some people in the old town near the river".split(), 12))
    listed = [(i, good(i) if i % 2 else good(i).upper().replace(" ", "!! ") + " %%%", "", "") for i in range(200)]
    docs, labels = rows(spark, listed), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality_vote.fit(docs, labels, ~quality_vote.held_out())
    got = quality_vote.score_quality(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in got]) > 0.98
    odd = quality_vote.score_quality(rows(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality_vote.score_quality(empty(spark), model).count() == 0
    blank = quality_vote.fit(docs, labels.filter("false"), F.lit(True))
    assert {r.score for r in quality_vote.score_quality(rows(spark), blank).collect()} == {0.5}


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        place = sharding.place_of(np.arange(n), n, 5)
        assert sorted(place) == list(range(n)) and (sharding.number_of(place, n, 5) == np.arange(n)).all()


def test_sharding(spark):
    got = sharding.shard_documents(rows(spark), 4, 17).collect()
    assert len(got) == len(ODD)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard_documents(rows(spark).repartition(7), 4, 17).collect()), key=str)
    assert sharding.shard_documents(empty(spark), 4, 17).count() == 0


def test_sharding_of_hot_ids_and_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = [(None, f"t{i}") for i in range(300)] + [(5, "same")] * 200 + [(i, "x") for i in range(100)]
    got = sharding.shuffle_shards(spark.createDataFrame(docs, "doc_id long, text string"), 6, carry=("text",)).collect()
    assert sorted(r.row_number for r in got) == list(range(600)) == sorted(r.place for r in got)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(docs, key=str)
    run = sorted(r.row_number for r in got if r.text == "same")
    assert run == list(range(run[0], run[0] + 200))
    spread = sorted(r.row_number for r in got if r.doc_id is None)
    assert spread[-1] - spread[0] > 400  # rows of one id aren't one block of ranks


def test_urls(spark, monkeypatch):
    urls = ["http://a.example.NET/en/x?q", "https://example.net/de/", "ftp://net", "http://xnet/", "http://b.example.com/de/1#a", "no url", None, "", "http://É.org/fr/", "x://y://org/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    want = {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("example.com/de/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("org/fr/", "allow"), 9: (None, "allow")}
    judged = lambda rules: {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert judged(url_filter.RULES) == want
    assert judged(spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")) == want
    assert url_filter.filter_urls(pages.filter("false"), url_filter.RULES).count() == 0
    monkeypatch.setattr(url_filter, "BLOCK_RULES", 1)
    assert judged(url_filter.RULES) == want
    assert url_filter.filter_urls(pages.filter("false"), url_filter.RULES).count() == 0
    assert judged([]) == {i: (None, "allow") for i in range(len(urls))}


@pytest.mark.parametrize("most", [1000, 5])
def test_urls_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BLOCK_RULES", most)
    r = random.Random(3)
    host = lambda n: ".".join(r.choice(["a", "b", "ab", "c"]) for _ in range(r.randint(1, n)))
    path = lambda n: "".join("/" + r.choice(["x", "y", "xy", ""]) for _ in range(r.randint(0, n)))
    rules = list({url_filter.Rule(host(3), path(3), r.choice(["block", "allow"])) for _ in range(60)})
    urls = [f"http://{host(5)}{path(4)}{r.choice(['', '?q', '#f'])}" for _ in range(500)] + [None, "x", "http://a.\x01b/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    for x in url_filter.filter_urls(pages, rules).collect():
        fit = [u for u in rules if (x.host == u.host or x.host.endswith("." + u.host)) and x.path.startswith(u.path)]
        best = min(fit, key=lambda u: (-len(u.name), -len(u.host), u.verdict != "block"), default=None)
        assert (x.rule, x.verdict) == ((best.name, best.verdict) if best else (None, "allow")), x


def brute_repeats(docs, k=20):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    key = lambda i: (1 << 63) if i is None else i
    for i, w in words:
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, (key(i), p)), (key(i), p))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - k + 1) if (key(i), p) > first[tuple(w[p : p + k])] for q in range(p, p + k)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, r.choice([" ", "  ", "\n"]).join((w := [r.choice("ab") + str(r.randint(0, 3)) for _ in range(r.randint(0, 60))])[:10] + passage[r.randint(0, 10) : r.randint(25, 40)] + w[10:])) for i in range(60)]
    docs += [(60, "ab " * 100), (61, LONG), (62, LONG), (63, None), (64, ""), (None, LONG), (65, LONG), (65, LONG)]
    r.shuffle(docs)
    got = substring_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("kept", F.lit(1)))
    got = [(x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in got.collect()]
    assert sorted(got, key=str) == brute_repeats(docs)


def test_substrings_of_unequal_rows_under_one_id(spark):
    passage, far = [f"p{i}" for i in range(30)], [f"f{i}" for i in range(80)]
    made = lambda own, n: " ".join([f"{own}{i}" for i in range(n)])
    docs = [(1, " ".join(passage)), (None, " ".join([made("a", 60), *passage])), (None, made("b", 100)), (None, "short"), (None, None)]
    docs += [(None, made("c", 25)), (7, " ".join([*far[:40], *passage])), (7, made("d", 90)), (7, "x y"), (7, None)]
    got = substring_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = [(x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in got.collect()]
    assert sorted(got, key=str) == brute_repeats(docs)


def test_substrings_of_text_ids_and_common_windows(spark, monkeypatch):
    passage = [f"p{i}" for i in range(45)]
    docs = [(f"k{i:02d}", " ".join([f"a{i}", *passage[i % 3 :], f"b{i}"])) for i in range(60)] + [(None, " ".join(passage)), ("k99", None)]
    monkeypatch.setattr(substring_dedup, "PACK", 300)  # copies in many blocks
    for often in (True, False):
        if not often:
            monkeypatch.setattr(substring_dedup, "common_minimisers", lambda *_: np.empty(0, np.uint64))
        got = substring_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id string, text string").repartition(7))
        got = {x.doc_id: (x.n_words, x.n_removed) for x in got.collect()}
        want = {i: (n, gone) for i, n, gone, _ in brute_repeats([("~" if i is None else i, t) for i, t in docs])}
        assert {("~" if i is None else i): v for i, v in got.items()} == want


def test_substrings_empty(spark):
    assert substring_dedup.drop_repeats(empty(spark)).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    data, offsets = np.frombuffer(b"a b c d a b e f", np.uint8), np.array([0, 15])
    norm, starts, ends, _ = common.normalised(data, offsets)
    later = substring_dedup.later_windows(norm, starts, ends, np.zeros(7, np.uint64), np.arange(7), np.zeros(7, np.int64), np.arange(7), 2)
    assert later.tolist() == [False] * 4 + [True, False, False]


def test_leaks(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice([6, 20, 60, 300])))) for i in range(40)]
    docs, want = [], set()
    for d in range(80):
        w = [word() for _ in range(r.randint(0, 400))]
        if d % 3 == 0:
            i, text = r.choice(items)
            want.add((d, i))
            w[len(w) // 2 : len(w) // 2] = text.upper().replace(" ", " - ").split()
        if d % 7 == 1:
            w += r.choice(items)[1].split()[:3]
        docs.append((d, " ".join(w)))
    table = spark.createDataFrame([(d, t, "", "") for d, t in docs], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "")], "item_id long, text string")
    groups = decontaminate.index_items(bench)
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(table, groups).collect()} == want
    clean = decontaminate.without_leaks(table, groups)
    assert clean.columns == table.columns and {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(rows(spark), groups).count() == 0 and decontaminate.find_leaks(table, decontaminate.index_items(bench.filter("false"))).count() == 0
    assert decontaminate.without_leaks(rows(spark), groups).count() == len(ODD)


def test_leaks_in_several_indexes(spark):
    r = random.Random(8)
    items = [(f"i{k}", " ".join(f"w{r.randint(0, 60)}" for _ in range(r.choice([4, 12, 40, 90])))) for k in range(60)]
    table = spark.createDataFrame([(f"d{k}", " ".join(["x y z"] * r.randint(0, 9) + [t, "q"])) for k, (_, t) in enumerate(items)], "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = decontaminate.index_items(bench), decontaminate.index_items(bench, limit=300)
    assert one.groups == 1 and many.groups > 4
    found = lambda x: {(f.doc_id, f.item_id) for f in decontaminate.find_leaks(table, x).collect()}
    assert found(one) == found(many) >= {(f"d{k}", f"i{k}") for k in range(60)}
    assert decontaminate.without_leaks(table, many).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_retrieval_loses_no_verified_item(seed, monkeypatch):
    """Every pair of a passage and an item verified, against the items that the index retrieves."""
    if seed == 2:
        monkeypatch.setattr(decontaminate, "ENTRIES", 50)
        monkeypatch.setattr(decontaminate, "PASSAGES", 7)
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + [f"rare{k}" for k in range(400)]
    drawn = lambda n: r.choices(vocabulary, [20] * 40 + [1] * 400, k=n)
    items = [drawn(r.choice([1, 3, 5, 8, 20, 60])) for _ in range(70)]
    indexes = decontaminate.build(list(range(70)), [" ".join(w[: len(w) * 2 // 3]) for w in items], [" ".join(w[len(w) * 2 // 3 :]) for w in items])
    texts = []
    for _ in range(60):
        w = drawn(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):  # whole, cut and changed items
            x = list(r.choice(items))
            x = x[r.randint(0, len(x) // 4) : len(x) - r.randint(0, len(x) // 4)]
            if x and r.random() < 0.5:
                x[r.randrange(len(x))] = "other"
            at = r.randint(0, len(w))
            w[at:at] = x
        texts.append(" ".join(w))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = {(t, i) for t, i, *_ in decontaminate.leaks(indexes, data, offsets)}
    words, text = decontaminate.words_of(data, offsets)
    want = set()
    for index in indexes:
        for a, z in zip(*decontaminate.passages(text, index.width), strict=True):
            for j, w in enumerate(index.words):
                total, question, answer = decontaminate.verify(w, int(index.question[j]), words[a:z])
                if total >= decontaminate.OVERLAP and min(question, answer) >= decontaminate.PART_OVERLAP:
                    want.add((int(text[a]), index.ids[j]))
    assert got == want and len(want) > 30


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    near = [[j for j, y in enumerate(prints) if (x ^ y).bit_count() <= 4] for x in prints]
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(near):
            least = min(label[j] for j in n)
            changed |= least < label[i]
            label[i] = min(least, label[i])
    return label


def test_simhash(spark, monkeypatch):
    r = random.Random(6)
    base = [[f"w{r.randint(0, 500)}" for _ in range(300)] for _ in range(12)]
    docs = [(None if i == 50 else i, " ".join(x if r.random() > 0.004 else "zz" for x in r.choice(base))) for i in range(90)]
    docs += [(90, None), (91, ""), (92, "Ab c"), (93, "aB  C"), (94, LONG), (94, LONG)]
    prints = [brute_print(t) for _, t in docs]
    ids = [1 << 62 if i is None else i for i, _ in docs]
    order = sorted(range(len(docs)), key=lambda k: ids[k])
    label = brute_components([prints[k] for k in order])
    known = lambda i: None if i == 1 << 62 else i
    want = sorted((str(docs[k][0]), prints[k], known(ids[order[label[n]]])) for n, k in enumerate(order))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2)})
    found = lambda: sorted((str(x.doc_id), x.fp % 2**64, x.component_id) for x in simhash.near_duplicates(table).collect())
    assert found() == want
    monkeypatch.setattr(simhash, "CELL", 4)  # large buckets in a grid of cells
    assert found() == want
    assert simhash.near_duplicates(table.filter("false")).count() == 0


def test_simhash_of_other_ids(spark):
    near = " ".join(f"w{i}" for i in range(400))
    docs = [("b", near), ("a", near + " z"), (None, near), ("c", "x y z"), (None, "alone here")]
    got = {(x.doc_id, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c"), (None, None)}
    top = (1 << 63) - 1
    got = simhash.near_duplicates(spark.createDataFrame([(top, "one"), (top - 1, "one")], "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {top - 1}


def test_hashes_match_the_library():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.getrandbits(8) for _ in range(3000)) + b"\0" * 8, np.uint8)
    starts, lengths = np.array([r.randint(0, 1000) for _ in range(600)]), np.array([r.choice([n % 45, r.randint(0, 1999)]) for n in range(600)])
    assert [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, lengths, strict=True)] == simhash.xxh64(data, starts, lengths).tolist()


def test_cells():
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for x in fps[:30]:
        for _ in range(5):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps = sorted(set(fps))
    root = simhash.cell_links(np.zeros(len(fps), np.int64), np.full(len(fps), 2), np.array(fps, np.uint64))
    label = brute_components(fps)
    assert len(set(zip(root.tolist(), label, strict=True))) == len(set(label)) == len(set(root.tolist()))


@pytest.mark.parametrize("p", [5, 6, 7])
def test_pieces_lose_no_link(p, monkeypatch):
    n = next(n for n in (1, 10**8, 10**10) if len(simhash.pieces(n)) == [None, 5, 15, 35][p - 4])
    masks, r = simhash.pieces(n), random.Random(p)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_components(spark):
    r = random.Random(8)
    nodes = r.sample(range(10_000), 300)
    links = [(a, b) for a, b in zip(nodes[:200], nodes[1:200], strict=False)] + [(r.choice(nodes[200:]), r.choice(nodes[200:])) for _ in range(60)]
    parent = {}

    def up(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = up(a), up(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == up(x) for x in parent)
