"""License scan: a trained classifier of paragraphs, as plain column expressions.

A paragraph is a line together with the lines that it is wrapped into: a line that doesn't end a sentence goes on
in the next one, unless that is blank.  A logistic regression over the presence of word 1-grams and 2-grams is
trained on the driver, when first asked for, from the notices and names below, with a class for paragraphs that
are no licence and one for licences of no known family.  Its logits are calibrated by temperature on folds that
were left out, and a family needs the calibrated probability LEAST.  A predicted family is then confirmed by
comparing the paragraph's word sequence with the family's templates; a prediction that no template confirms, or
that is not sure, is told as "unknown".

On the executors there are only built-in functions and no shuffle.  A paragraph without a gate word is passed over;
the gate words are chosen from the weights so that all n-grams without one of them, taken together, cannot
make any licence class win, so the gate never changes a result (the SQL has none).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

NONE, UNKNOWN = "none", "unknown"
#: Calibrated probability that a family needs; share of a template's word pairs that a paragraph needs.
LEAST, TEMPLATE_SHARE = 0.5, 0.75
FOLDS, STEPS = 4, 250

# Names of licence families, as public texts have them.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache 2.0", "Apache Software License"],
    "MIT": ["MIT License", "MIT license (MIT)", "MIT", "MIT/Expat license", "MIT-style license"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2.0 or later", "GNU GPL v2", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL license", "GNU GPL", "GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License version 2.1", "LGPL-2.1-only", "LGPL", "GNU LGPL", "LGPLv3", "GNU Library General Public License"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License version 3", "AGPL-3.0", "AGPLv3", "GNU AGPL", "AGPL license"],
    "BSD": ["BSD 3-Clause License", "BSD license", "BSD-2-Clause", "New BSD License", "Simplified BSD license", "Modified BSD License", "two-clause BSD license", "3-clause BSD license"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0", "Mozilla Public License", "MPL 2.0 license"],
    "CC-BY": ["CC BY 4.0", "CC-BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution License", "CC BY 3.0 license"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0 license"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC 3.0 license"],
    "CC0": ["CC0 1.0 Universal", "CC0", "CC0 1.0 Universal Public Domain Dedication", "CC0 license", "Creative Commons Zero license", "CC0-1.0"],
    "ISC": ["ISC License", "ISC", "ISC license (ISCL)", "Internet Systems Consortium license"],
    UNKNOWN: ["Eclipse Public License 2.0", "Artistic License 2.0", "European Union Public Licence", "Common Development and Distribution License", "SIL Open Font License, Version 1.1", "Microsoft Public License", "Academic Free License", "PostgreSQL License", "Example Community License, version 1.0", "Open Software License 3.0", "OpenSSL license", "Unlicense", "Unlicense (public domain)", "Unlicense license", "WTFPL", "Beerware license", "proprietary license", "commercial license", "end user license agreement", "license in the accompanying file", "same license as the original", "Vendor Source License", "Research License", "Data Sharing Licence", "Open Government Licence", "Foundation License Version 2", "Software License"],
}
# Sentences around a name.
CARRIERS = ["{}", "Licensed under the {}.", "Released under the {}", "This project is licensed under the terms of the {}.", "Distributed under the {}; see the LICENSE file for details", "This work is licensed under a {}.", "The code is made available under {}", "Use of this source code is governed by the {}", "SPDX-License-Identifier: {}", "License: {}", "Available under the terms of {}, subject to its conditions"]
# Notices that have no name put into a sentence, as public texts have them.
NOTICES = {
    "Apache-2.0": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", "Apache License Version 2.0, January 2004"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "You should have received a copy of the GNU General Public License along with this program", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Dedicated to the public domain under the Creative Commons Zero dedication"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee"],
    "All-Rights-Reserved": ["All rights reserved", "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Copyright (c) 2019 Example Corp, all rights reserved", "(c) 2021 The Company. All Rights Reserved", "All rights reserved, no part of this publication may be reproduced or transmitted in any form", "All rights reserved worldwide", "Copyright Example Inc. All rights reserved. Unauthorized copying is prohibited"],
    UNKNOWN: ["Licensed under the terms in the accompanying file", "This software is distributed under a proprietary license agreement", "See the license file for details", "See LICENSE for license information", "Released under the terms of an open license", "Use is subject to license terms", "The license is available from the copyright holder", "This is free and unencumbered software released into the public domain", "Do what you want to public license", "By installing this software you accept the license agreement", "The software is provided as is, without warranty of any kind, express or implied", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    NONE: [
        "He lost his driving license on the way to the city", "The bar was granted a liquor license last year", "A licensed electrician must check the wires", "Copyright law is taught in the second year", "The public domain of a function is the set of its inputs",
        "The warranty of the car runs for two years", "She asked for permission to use the free room", "Redistribution of wealth was the theme of the general election", "The general public was allowed to see the work", "MIT is a university with many students", "Researchers at MIT found a new method",
        "Version 2.0 of the plan was published in June", "The poetic license of the author made the work famous", "The license plate of the car was hidden", "He said all rights reserved by citizens must be respected by the state", "The rights reserved to the people are all listed in the charter", "They reserved all rooms and kept the rights of way",
        "The Apache people lived in the south west", "An Apache helicopter landed near the town", "Mozilla published a browser for the general public", "The creative commons of the village was open to everyone", "The foundation gave software to schools free of charge", "The software was provided with a manual and a warranty card", "The permission notice hung on the door of the library",
        "The source of the river and the binary star", "A free person may obtain a copy of the map", "Distribution of this form is the task of the office", "The public library was open under the terms of the agreement", "Her fishing licence had run out in June", "The teacher was licensed by the state board", "No part of this house may be sold", "The conditions are met in all cases", "The following conditions were discussed",
        "Use of this road is governed by the city", "The project was released in June and is available from the office", "The file was distributed to all members of the foundation", "See the file for details", "Details are in the accompanying file", "In the year 2004 the version was published", "The company reserved a table", "Copyright holders met in the city",
    ],
}
# Word sequences that confirm a family.
TEMPLATES = {
    "Apache-2.0": ["apache license", "apache 2 0", "apache software license", "apache software foundation", "apache org licenses license 2 0"],
    "MIT": ["mit license", "license identifier mit", "under the mit", "license mit", "under mit", "mit expat license", "mit style license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "this permission notice shall be included in all copies or substantial portions of the software"],
    "GPL": ["gnu general public license", "gnu gpl", "gpl license", "gplv3", "gplv2", "gpl v2", "gpl v3", "gpl 2 0", "gpl 3 0", "gpl version 2", "gpl version 3"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "lgpl", "lgplv3", "lgplv2"],
    "AGPL": ["gnu affero general public license", "gnu affero general public", "agpl", "agplv3"],
    "BSD": ["bsd license", "bsd 3 clause", "bsd 2 clause", "3 clause bsd", "2 clause bsd", "clause bsd license", "bsd style license", "redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"],
    "MPL-2.0": ["mozilla public license", "mozilla public", "mpl 2 0", "mozilla org mpl"],
    "CC-BY": ["cc by", "creative commons attribution"],
    "CC-BY-SA": ["cc by sa", "creative commons attribution sharealike"],
    "CC-BY-NC": ["cc by nc", "creative commons attribution noncommercial"],
    "CC0": ["cc0", "cc0 1 0 universal", "creative commons zero", "to the extent possible under law the author has waived all copyright and related or neighboring rights"],
    "ISC": ["isc license", "license identifier isc", "under the isc", "internet systems consortium license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "All-Rights-Reserved": ["all rights reserved"],
}
STOP = frozenset("a an and are as at be by for from has he her his in is it its no of on or that the their this to was were will with you your may any who".split())
#: Words that no pair has.
BARRIER = STOP - frozenset("by for to with no".split())
# Subjects that share words with licences, and what ordinary sentences say about them.
SUBJECTS = ["license", "driving license", "fishing licence", "liquor license", "software", "source code of the program", "open source community", "file", "version 2.0 of the plan", "general public", "public library", "common source", "research data", "free copy", "permission", "foundation", "community", "copyright law", "terms of trade", "conditions", "warranty", "rights of citizens", "documentation", "binary star", "notice", "library", "MIT campus", "MIT", "Apache village", "Apache people", "Mozilla browser", "BSD system", "GNU project", "eclipse of the sun", "artistic work", "commercial end", "European union", "academic year", "government office", "license plate", "licensed electrician", "creative commons garden", "user agreement", "all rights reserved by citizens", "all rights reserved to the states", "all rights reserved for members", "public domain of the function", "redistribution of wealth", "form", "software release", "vendor", "standard", "use of the road", "example", "identifier", "portion", "zero", "attribution of the painting", "style", "clause 3", "Internet systems", "affero"]
FRAMES = ["The {} was discussed at the meeting.", "She has seen the {} in June", "They opened the {} without any trouble", "It is about the {}, see below", "The terms under which the {} was sold are clear", "He said {} must be respected", "The project is subject to the {}", "Use the {} with care; details are available", "His {} was lost on the way"]


def words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams(text: str) -> set[str]:
    w = words(text)
    return {x for x in w if x not in STOP} | {f"{x} {y}" for x, y in zip(w, w[1:], strict=False) if not {x, y} & BARRIER}


def examples() -> list[tuple[str, str]]:
    """(class, text) of the training texts."""
    out = [(c, f.format(n)) for c, names in NAMES.items() for n in names for f in CARRIERS]
    out = [(c, t) for c, t in out if len(words(t)) > 1 or c not in ("MIT", "ISC")]  # such a word alone may be anything
    out += [(c, t) for c, texts in NOTICES.items() for t in texts for _ in range(3)]
    return out + [(NONE, f.format(x)) for x in SUBJECTS for f in FRAMES]


@dataclass(frozen=True)
class LicenseModel:
    classes: tuple[str, ...]
    weights: dict[str, tuple[int, ...]]  # in thousandths, by n-gram and class
    bias: tuple[int, ...]
    temperature: float
    gate: tuple[str, ...]


def _train(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient descent, from zero."""
    w, b = np.zeros((x.shape[1], n)), np.zeros(n)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    want = np.eye(n)[y]
    balance = (1.0 / np.sqrt(np.bincount(y, minlength=n).clip(1)))[y][:, None]
    balance /= balance.mean()
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - want) * balance / len(x)
        vw, vb = 0.9 * vw - (x.T @ g + 5e-4 * w), 0.9 * vb - g.sum(axis=0)
        w, b = w + 0.8 * vw, b + 0.8 * vb
    return w, b


def gate_words(weights: dict[str, tuple[int, ...]], bias: tuple[int, ...], none: int) -> tuple[str, ...]:
    """Words one of which any paragraph must hold for a class other than none to win.

    For each class, the n-grams without a gate word that speak for it against none must stay below the lead that
    none has by its bias; the word that speaks most for the class furthest from that is taken, again and again.
    """
    gate: set[str] = set()
    others = [c for c in range(len(bias)) if c != none]
    while True:
        free = [(g, v) for g, v in weights.items() if not gate & set(g.split())]
        reach = {c: bias[c] - bias[none] + sum(max(0, v[c] - v[none]) for _, v in free) for c in others}
        worst = max(others, key=lambda c: reach[c])
        if reach[worst] < 0:
            return tuple(sorted(gate))
        speaks: dict[str, int] = {}
        for g, v in free:
            for x in set(g.split()):
                speaks[x] = speaks.get(x, 0) + max(0, v[worst] - v[none])
        if max(speaks.values(), default=0) == 0:
            raise ValueError(f"{worst} wins without any word")
        gate.add(max(sorted(speaks), key=lambda x: speaks[x]))


@lru_cache(1)
def model() -> LicenseModel:
    """Trained from the notices; the same on every call and machine up to thousandths."""
    listed = examples()
    classes = tuple(dict.fromkeys([*NAMES, "All-Rights-Reserved", NONE]))
    texts = [(grams(t), classes.index(c)) for c, t in listed] + [(set(), classes.index(NONE))] * 60  # ordinary paragraphs have no known n-gram
    vocabulary = sorted({g for f, _ in texts for g in f})
    at = {g: j for j, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for row, (f, _) in enumerate(texts):
        x[row, [at[g] for g in f]] = 1
    y = np.array([i for _, i in texts])
    fold = np.array([sum(map(ord, t)) % FOLDS for _, t in listed] + [k % FOLDS for k in range(60)])
    logits = np.zeros((len(texts), len(classes)))
    for f in range(FOLDS):
        w, b = _train(x[fold != f], y[fold != f], len(classes))
        logits[fold == f] = x[fold == f] @ w + b

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(axis=1)
        return float(np.mean(np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y]))

    temperature = min((round(0.3 + 0.1 * i, 1) for i in range(30)), key=lambda t: (round(loss(t), 6), t))
    w, b = _train(x, y, len(classes))
    w, b = np.rint(w * 1000).astype(int), np.rint(b * 1000).astype(int)
    weights = {g: tuple(int(v) for v in w[j]) for g, j in at.items() if np.abs(w[j]).max() >= 20}
    bias = tuple(int(v) for v in b)
    return LicenseModel(classes, weights, bias, temperature, gate_words(weights, bias, classes.index(NONE)))


# A line that goes on: its last character ends no sentence, and the next line is not blank.
_OPEN, _GOES_ON = r"([^.!?\x20\x09-\x0D])[\x20\x09\x0D]*\n[\x20\x09]*", r"([^\x20\x09-\x0D])"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a lower-cased text, wrapped lines joined; a line of one character may need the second pass."""
    for _ in range(2):
        text = F.regexp_replace(text, _OPEN + _GOES_ON, "$1 $2")
    return F.split(text, "\n", -1)


def _sql_strings(values) -> str:
    """An array of plain words; none of them holds a quote."""
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _held(rows: DataFrame, column: Column) -> DataFrame:
    """The rows with a column that is computed once, behind a generator, however often it is used."""
    return rows.select("*", F.inline(F.array(F.struct(column))))


def template_grams(template: str) -> list[str]:
    """The word pairs of a template, or its one word."""
    w = template.split()
    return [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)] or w


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence paragraph: id, paragraph (its number, from 1), family, probability, template_share.

    family is a known family, or "unknown" for a licence that is none of them or that no template confirms.
    Null and empty texts have no paragraph; repeated rows each give theirs; other columns are ignored.
    """
    m = model()
    rows = docs.select(F.col(id_col).alias("_id"), F.posexplode(paragraphs(F.lower(F.col(text_col)))).alias("_at", "_line"))
    rows = _held(rows.select("_id", (F.col("_at") + 1).alias("paragraph"), "_line"), F.regexp_extract_all("_line", F.lit("[a-z0-9]+"), F.lit(0)).alias("_w")).drop("_line")
    rows = rows.filter(F.exists("_w", lambda w: w.isin(*m.gate)))
    pairs = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat(F.element_at("_w", i), F.lit(" "), F.element_at("_w", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = _held(rows, F.array_distinct(F.concat(F.col("_w"), pairs)).alias("_g")).drop("_w")
    table = F.expr("map(" + ", ".join(f"'{g}', array({', '.join(map(str, m.weights[g]))})" for g in sorted(m.weights)) + ")")
    rows = _held(rows, F.transform(F.filter("_g", lambda g: g.isin(*sorted(m.weights))), lambda g: F.element_at(table, g)).alias("_f"))
    summed = lambda c: F.aggregate("_f", F.lit(m.bias[c]), lambda a, f: a + F.element_at(f, c + 1))
    rows = _held(rows, F.array(*(summed(c) for c in range(len(m.classes)))).alias("_z")).drop("_f")
    rows = _held(rows, F.array_max("_z").alias("_top"))
    rows = _held(rows, F.element_at(F.expr(_sql_strings(m.classes)), F.array_position("_z", F.col("_top")).cast("int")).alias("_name")).filter(F.col("_name") != NONE)
    total = F.aggregate("_z", F.lit(0.0), lambda a, z: a + F.exp((z - F.col("_top")) / (1000.0 * m.temperature)))
    rows = rows.withColumn("probability", F.round(1.0 / total, 6))
    by_family = F.expr("map(" + ", ".join(f"'{f}', array({', '.join(_sql_strings(template_grams(t)) for t in ts)})" for f, ts in TEMPLATES.items()) + ")")
    share = F.coalesce(F.array_max(F.transform(F.element_at(by_family, F.col("_name")), lambda t: F.size(F.array_intersect(t, F.col("_g"))) / F.size(F.array_distinct(t)))), F.lit(0.0))
    rows = rows.withColumn("template_share", F.round(share, 6))
    sure = (F.col("probability") >= LEAST) & (F.col("template_share") >= TEMPLATE_SHARE)
    return rows.select(F.col("_id").alias(id_col), "paragraph", F.when(sure, F.col("_name")).otherwise(UNKNOWN).alias("family"), "probability", "template_share")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    return scan(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same without a gate: every paragraph is scored."""
    m = model()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({quoted(g)}, [{', '.join(map(str, v))}])" for g, v in sorted(m.weights.items()))
    templates = ", ".join(f"({quoted(f)}, [{', '.join(quoted(x) for x in template_grams(t))}])" for f, ts in TEMPLATES.items() for t in ts)
    n = len(m.classes)
    joined = lambda s: f"regexp_replace({s}, '{_OPEN}{_GOES_ON}', '\\1 \\2', 'g')"
    return f"""
WITH weights(g, w) AS (VALUES {weights}), templates(family, t) AS (VALUES {templates}),
cut AS (SELECT doc_id, string_split({joined(joined("lower(text)"))}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS paragraph FROM cut),
worded AS (SELECT doc_id, paragraph, regexp_extract_all(line, '[a-z0-9]+') AS ws FROM lines),
gs AS (SELECT doc_id, paragraph, list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gs FROM worded),
feats AS (SELECT doc_id, paragraph, unnest(gs) AS g FROM gs),
sums AS (SELECT doc_id, paragraph, {", ".join(f"coalesce(sum(w[{c + 1}]), 0) AS s{c}" for c in range(n))} FROM feats JOIN weights USING (g) GROUP BY doc_id, paragraph),
logits AS (SELECT gs.doc_id, gs.paragraph, gs, [{", ".join(f"{m.bias[c]} + coalesce(s{c}, 0)" for c in range(n))}] AS z FROM gs LEFT JOIN sums USING (doc_id, paragraph)),
best AS (SELECT *, list_max(z) AS top, [{", ".join(map(quoted, m.classes))}][list_position(z, list_max(z))] AS name FROM logits),
prob AS (SELECT *, round(1.0::DOUBLE / list_sum(list_transform(z, lambda v: exp((v - top)::DOUBLE / {1000.0 * m.temperature!r}::DOUBLE))), 6) AS probability FROM best WHERE name <> '{NONE}'),
shares AS (SELECT doc_id, paragraph, name, probability, coalesce(max(round(len(list_intersect(t, gs))::DOUBLE / len(list_distinct(t)), 6)), 0.0::DOUBLE) AS template_share FROM prob LEFT JOIN templates ON family = name GROUP BY ALL)
SELECT doc_id, paragraph, CASE WHEN probability >= {LEAST} AND template_share >= {TEMPLATE_SHARE} THEN name ELSE '{UNKNOWN}' END AS family, probability, template_share FROM shares
"""
