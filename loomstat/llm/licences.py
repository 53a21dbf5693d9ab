"""Licence scans: a trained paragraph classifier, with DataFrame functions only.

Paragraphs are parted by blank lines. Each line is scanned on its own, for notices of
one line; a paragraph of several lines is scanned as a whole besides, for wrapped
texts, and reported if it is confirmed. Words are runs of a-z and 0-9 after
lower-casing, without stop words; features are the presence of words and of pairs of neighbours. A sparse
multinomial logistic regression (L1, trained here on statements made from the
families' names and on characteristic sentences, with unrelated sentences as the
class `unknown`) scores the families. Its temperature and the least probability of a
family are calibrated on made statements that it has not seen. A prediction is
confirmed if enough of the words of one of the family's templates stand in the
paragraph. Only words with a weight can move a score from the bias, which says
`unknown`; so pieces without any of them leave before scoring, which changes no result.

Null and empty texts have no paragraphs. A text without line breaks is one line,
however long. Repeated rows are each reported; other
columns are ignored. Nothing moves between tasks; the weights are literals of fixed
size.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import table

UNKNOWN = "unknown"
#: Share of a template's words that confirms a prediction.
CONFIRM = 0.6
#: What parts paragraphs: one blank line or more.
BLANK = r"\n(?:[ \t\r]*\n)+"
L1, RATE, STEPS = 0.0004, 4.0, 200
#: A feature stands in that many examples at least.
LEAST_EXAMPLES = 3

# Words without weight, words that weigh only beside another, names by which licences go, and sentences out of their texts.
STOP = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "can", "for", "from", "has", "have", "in", "is", "it", "its", "not", "of", "on", "or", "our", "that", "the", "their", "these", "they", "this", "to", "under", "was", "we", "were", "which", "will", "with", "you", "your")
IN_PAIRS = ("nc", "sa", "bsd", "isc", "lesser", "commons", "0", "1", "2", "3", "4", "following", "conditions", "source", "without", "version", "public", "general", "free", "work", "mit", "by")
NAMES = {
    "Apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache License"),
    "MIT": ("MIT License", "MIT licence", "MIT", "The MIT License (MIT)", "Expat License"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License", "GPL v3", "GPLv2", "GNU GPL version 2", "GPL-3.0-or-later"),
    "LGPL": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL v3", "LGPL-2.1", "GNU LGPL"),
    "AGPL": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0", "GNU AGPL"),
    "BSD": ("BSD License", "3-Clause BSD License", "BSD 2-Clause License", "BSD-3-Clause", "New BSD License"),
    "MPL": ("Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"),
    "ISC": ("ISC License", "ISC licence", "ISC"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY-4.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "CC-BY-SA-4.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0", "CC-BY-NC-4.0"),
    "CC0": ("CC0 1.0 Universal", "CC0", "Creative Commons Zero", "CC0 1.0 Public Domain Dedication"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
SENTENCES = {
    "Apache": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL": ("You should have received a copy of the GNU Affero General Public License along with this program.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
FRAMES = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "This project is made available under the {}.", "See LICENSE for details ({}).", "Published under {}", "License: {}", "The code is covered by the {}.")
OTHERS = (
    "The driver had to show a license at the border.", "A fishing license costs ten pounds a year.", "Version 2.0 of the report will be released in May.", "The general public was invited to the opening.", "Permission to land was granted at noon.", "The software update fixes a crash.", "Released after three years, the record sold well.", "Public transport is free of charge on Sundays.", "All rights and duties of tenants are listed below.",
    "The foundation published its annual statement.", "Attribution of the painting remains uncertain.", "The license plate was found by the river.", "A new version of the song, released under another name.", "General terms apply to every order.", "The work is done, the version is final.", "Students learn to copy, modify and merge drawings.", "Source and target are of binary form.", "Our creative team likes common tools.", "Zero tolerance and universal rules.", "She studied at MIT and works in Boston.", "The Apache helicopter landed.", "Clause 3 of the contract is void.", "mozilla developers met in public.", "the lesser evil", "He was licensed to sell food in 2004.", "The commons are open to the public.", "Er kam mit dem Zug, mit ihr und mit uns.", "Mit Geduld und von Anfang an mit dabei.", "Ce texte est libre de droits selon lui.", "El autor dio permiso para copiar la obra.",
)


def words(text: str) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in STOP]


def _features(text: str) -> list[str]:
    w = words(text)
    return sorted({*(x for x in w if x not in IN_PAIRS), *(f"{a} {b}" for a, b in zip(w, w[1:]))})


def _examples() -> list[tuple[str, str]]:
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(n))
    out = []
    for family, names in NAMES.items():
        for name in names:
            out += [(frame.format(name), family) for frame in FRAMES]
            out += [(f"{noise(rng.randint(3, 12))}. {rng.choice(FRAMES).format(name)} {noise(rng.randint(0, 12))}", family) for _ in range(4)]
        for sentence in SENTENCES.get(family, ()):
            parts = sentence.split()
            for _ in range(12):
                out.append((" ".join(p for p in parts if rng.random() < 0.85), family))
    for sentence in OTHERS:
        out += [(sentence, UNKNOWN)] * 6
    out += [(noise(rng.randint(1, 40)), UNKNOWN) for _ in range(150)]
    out += [(frame.format(noise(rng.randint(1, 4))), UNKNOWN) for frame in FRAMES for _ in range(4)]
    rng.shuffle(out)
    return out


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.lru_cache(1)
def train() -> dict:
    """classes, bias, weights (feature -> one value a class), temperature and least probability of a family."""
    classes = (*NAMES, UNKNOWN)
    data = [(_features(t), classes.index(y)) for t, y in _examples()]
    often = Counter(f for features, _ in data for f in features)
    names = sorted(f for f, n in often.items() if n >= LEAST_EXAMPLES)
    data = [([f for f in features if often[f] >= LEAST_EXAMPLES], y) for features, y in data]
    number = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(data), len(names))), np.array([y for _, y in data])
    for row, (features, _) in zip(x, data):
        row[[number[f] for f in features]] = 1 / math.sqrt(len(features) or 1)
    held = np.arange(len(data)) % 5 == 0
    own, truth = x[~held], np.eye(len(classes))[y[~held]]
    w, bias = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    ahead, before, t = w, w, 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        off = _softmax(own @ ahead + bias) - truth
        x_new = ahead - RATE * (own.T @ off) / len(own)
        x_new = np.sign(x_new) * np.maximum(0, np.abs(x_new) - RATE * L1)
        bias = bias - 0.5 * off.mean(0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, before, t = x_new + (t - 1) / t_new * (x_new - before), x_new, t_new
    w = np.where(np.abs(before) >= 0.05, before.round(4), 0.0)
    margins, truth = x[held] @ w + bias, y[held]
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(margins / t)[np.arange(len(truth)), truth])).mean()
    temperature = float(min((k / 10 for k in range(2, 31)), key=loss))
    p = _softmax(margins / temperature)
    best, sure = p.argmax(1), p.max(1)

    def wrong(least: float) -> float:
        return float((np.where(sure >= least, best, len(classes) - 1) != truth).mean())

    least = min((k / 20 for k in range(6, 16)), key=lambda k: (wrong(k), abs(k - 0.5)))
    weights = {f: w[i].tolist() for f, i in number.items() if w[i].any()}
    return {"classes": classes, "bias": bias.tolist(), "weights": weights, "temperature": temperature, "least": least, "held_out_accuracy": 1 - wrong(least)}


def _templates() -> list[dict]:
    out = [{"family": f, "words": sorted({*words(name)})} for f, names in NAMES.items() for name in names]
    return out + [{"family": f, "words": sorted({*words(s)})} for f, sentences in SENTENCES.items() for s in sentences]


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph and its line (both from 0; no line: the whole paragraph), family, probability, template_similarity, confirmed of what names a licence."""
    model = train()
    classes, n = model["classes"], len(model["classes"])
    # of a pair one word is enough to look for: the one that comes first in IN_PAIRS, or is not there at all
    vocabulary = sorted({min(f.split(" "), key=lambda w: (IN_PAIRS.index(w) if w in IN_PAIRS else -1, -len(w), w)) for f in model["weights"]})
    blocks = docs.select("doc_id", F.posexplode(F.split("text", BLANK)).alias("paragraph", "block")).withColumn("parts", F.split("block", "\n"))
    whole = F.when(F.size("parts") > 1, F.array("block")).otherwise(F.array().cast("array<string>"))
    pieces = blocks.select("doc_id", "paragraph", F.posexplode(F.concat("parts", whole)).alias("line", "said")).withColumn("line", F.when(F.instr("said", "\n") == 0, F.col("line").cast("long")))
    stop = F.array(*map(F.lit, ("", *STOP)))
    known = weights = _literal(model["weights"], "map<string,array<double>>")
    said = pieces.withColumn("words", F.split(F.lower("said"), "[^a-z0-9]+")).where(F.arrays_overlap("words", F.array(*map(F.lit, vocabulary)))).select(
        "doc_id", "paragraph", "line", F.filter("words", lambda w: ~F.array_contains(stop, w)).alias("words"))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    alone = F.filter("words", lambda w: ~w.isin(*IN_PAIRS))
    listed = said.select("doc_id", "paragraph", "line", "words", F.explode(F.array(F.filter(F.array_distinct(F.concat(alone, pairs)), lambda f: known[f].isNotNull()))).alias("features"))
    zero = F.array(*[F.lit(0.0)] * n)
    total = F.aggregate(F.transform("features", lambda f: weights[f]), zero, lambda s, w: F.zip_with(s, w, lambda a, b: a + b))
    bias = F.array(*map(F.lit, model["bias"]))
    margins = F.zip_with(total, bias, lambda s, b: (s / F.sqrt(F.greatest(F.size("features"), F.lit(1))) + b) / model["temperature"])
    # each explode of one element keeps what it makes from being worked out again where it is used
    scored = listed.where(F.size("features") > 0).select("doc_id", "paragraph", "line", "words", F.explode(F.array(margins)).alias("margins")).withColumn("top", F.array_max("margins"))
    scored = scored.withColumn("probability", 1 / F.aggregate("margins", F.lit(0.0), lambda s, m: s + F.exp(m - F.col("top"))))
    best = F.get(F.array(*map(F.lit, classes)), F.array_position("margins", F.col("top")).cast("int") - 1)
    found = scored.withColumn("family", best).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model["least"]))
    own = F.filter(_literal(_templates(), "array<struct<family:string,words:array<string>>>"), lambda t: t.family == F.col("family"))
    similar = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(t.words, F.col("words"))) / F.size(t.words)))
    return found.withColumn("template_similarity", similar).where(F.col("line").isNotNull() | (F.col("template_similarity") >= CONFIRM)).select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "line", "family", "probability", "template_similarity", (F.col("template_similarity") >= CONFIRM).alias("confirmed"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
