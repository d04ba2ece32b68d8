"""License scan: a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line that names a licensing word, or one without that the
model knows as some family's, or a hard-wrapped notice: lines up to one that
ends a sentence (a piece) or up to a blank one (a block; lines of marks alone,
as in comments, are blank). A piece that is confirmed, while none of its lines
is by itself, is one paragraph in place of its lines; a piece or block that
confirms a family that nothing within it does counts beside them. Nothing is
cut before the model but texts without a word of ``GATE``, which cannot hold
half of any template. The distinct word 1- to 3-grams of a line, piece or block, each weighing one over the root of their number, feed a multinomial
logistic regression over licence families and an unknown class, fitted on the
driver from the notices below and generated negatives, with a temperature
calibrated on generated lines of another style (``measure`` gives accuracy and
calibration error on a third). A prediction is confirmed if the
paragraph holds enough of a template of that family (its 3-grams).

The model is a small table (a row for each n-gram of the training lines, some
thousands, whatever the corpus) joined by broadcast; sums per paragraph and
then per document are aggregates with partial sums.

Defined results: null and empty texts, and texts without a word of ``GATE``,
have no paragraphs and zero counts; each repeated row gets its row; all lines
of long texts are read; an empty table gives an empty result; ties between
families go to the first in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Common notices of each family.
NOTICES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL v3 or later.",
        "Available under AGPLv3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Distributed under Apache 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "You may redistribute this package under the terms of the Artistic License 2.0 or, at your option, the terms of Perl itself."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at www.eclipse.org/legal/epl-2.0."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or later.", "Licensed under the European Union Public Licence, version 1.2."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL v2 or later.",
        "Available under GPLv3.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "Released under the ISC license."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU LGPL version 2.1."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Licensed under the MIT license.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Proprietary": ["Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. No license is granted."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License.", "Licensed under the zlib/libpng license."],
}
# Lines that name licensing words and grant nothing.
NEGATIVES = [
    "He lost his driving license last week.", "The license plate was found near the road.", "The city grants a license to every street vendor.", "Poetic license is no excuse.", "She is licensed to practice medicine.", "A warranty card came with the phone.",
    "The copyright office opened a new branch.", "They argued about copyright in the court for years.", "The public domain of a function is its set of inputs.", "Permission to land was granted late.", "His fishing licence had expired.", "Licensed premises must close at midnight.",
]
FAMILIES = [*sorted(NOTICES), UNKNOWN]
#: A line in which this is found is a paragraph whatever the model says.
NAMED = r"(?i)licen[cs]|copyright|warrant|redistribut|public domain|creative commons|\bcc0\b|\bcc by|all rights reserved|permission is hereby"
#: Least share of a template's 3-grams in a paragraph that confirms its family.
CONFIRM = 0.5
#: Least calibrated probability of a family; below it a paragraph is unknown.
LEAST = 0.5
#: Line breaks before a line without a letter or digit, and after a sentence.
BLANK, ENDED = r"\n[^\p{L}\p{N}\n]*+(?=\n)", r"(?<=[.!?:])[^\p{L}\p{N}.!?:\n]*+\n"


def _words(line: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9.]+|\.(?![0-9])", " ", line.lower()).split(" ") if w]


def grams(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})


def _templates() -> list[tuple[str, set[str]]]:
    return [(f, {g for g in grams(_words(t)) if g.count(" ") == 2} or set(grams(_words(t)))) for f in FAMILIES[:-1] for t in NOTICES[f]]


def gate_words() -> list[str]:
    """Words such that a text without any of them holds less than ``CONFIRM`` of each template: long ones first, then those that settle most."""
    chosen: set[str] = set()
    for _, own in sorted(_templates(), key=lambda x: len(x[1])):
        while len(left := [g for g in own if not chosen & set(g.split(" "))]) >= CONFIRM * len(own):
            seen = Counter(w for g in left for w in set(g.split(" ")))
            chosen.add(max(seen, key=lambda w: (len(w) >= 5, seen[w], w)))
    return sorted(chosen)


#: What a text holds that has a paragraph: a licensing word or a word of the gate.
GATE = rf"{NAMED}|(?<![a-z0-9])(?:{'|'.join(map(re.escape, gate_words()))})(?![a-z0-9])"


class Model:
    """Weights of each n-gram for each family, biases, temperature and templates."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float], temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.templates = _templates()

    def table(self) -> list[tuple]:
        return [(g, [float(x) for x in w], [int(g in t) for _, t in self.templates]) for g, w in sorted(self.weights.items())]


#: What stands before and after a notice in generated lines, for the fit, for the temperature and for the measured error; no style sees another's.
STYLES = {
    "fit": (["This project is ", "Code: ", "Note. ", "Copyright (c) 2019 Ada Moor. "], ["", "", " See the file for details.", " Thank you."], 0.08, 1.0),
    "calibrate": (["The library below is ", "Source files: ", "(c) 2021 The Authors. ", "NOTICE: "], ["", " Contributions are welcome.", " The full text follows."], 0.12, 0.8),
    "measure": (["All of this work was ", "License - ", "Copyright 2015-2020 by Kim Ray, Inc. ", "Unless stated otherwise: "], ["", " For questions write to us.", " Read on below."], 0.15, 0.7),
}


def _examples(seed: int, n: int, style: str = "fit") -> list[tuple[list[str], int]]:
    """Generated lines: their n-grams and family. A style's last two numbers are the share of words left out and the least share of a notice that is kept."""
    rng = np.random.default_rng(seed)
    before, after, lost, least = STYLES[style]
    any_of = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(any_of(["th", "er", "on", "an", "re", "he", "in", "la", "de", "que", "ung", "sch", "ión", "le"]) for _ in range(int(rng.integers(1, 4))))
    out = []
    for k in range(n):
        if k % 3 == 0:
            line, label = any_of([any_of(NEGATIVES), " ".join(word() for _ in range(int(rng.integers(3, 60))))]), len(FAMILIES) - 1
            if rng.random() < 0.5:
                line = " ".join([*(word() for _ in range(8)), any_of(["license", "copyright", "warranty", "licensed", "public domain", "permission", "software", "version 2.0", "the terms of the"]), *(word() for _ in range(8))])
        else:
            family = any_of(FAMILIES[:-1])
            line, label = any_of(NOTICES[family]), FAMILIES.index(family)
            if len(own := line.split(" ")) > 15:
                line = " ".join(own[: int(len(own) * rng.uniform(least, 1)) + 1])
            if rng.random() < 0.5:
                line = any_of(before) + line + any_of(after)
        words = _words(line)
        out.append((grams([w for w in words if rng.random() > lost] or words), label))
    return out


def _scores(model: Model, rows: list[tuple[list[str], int]]) -> np.ndarray:
    """Logits of each family, at the model's temperature."""
    none = [0.0] * len(FAMILIES)
    return np.array([(np.array(model.bias) + sum((np.array(model.weights.get(g, none)) for g in x), np.zeros(len(FAMILIES))) / math.sqrt(max(1, len(x)))) / model.temperature for x, _ in rows])


def _loss(z: np.ndarray, label: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float(-(z[np.arange(len(z)), label] - np.log(np.exp(z).sum(axis=1))).mean())


def measure(model: Model, seed: int = 77, n: int = 1500, style: str = "measure") -> tuple[float, float]:
    """Share of generated lines that are classified rightly, and the calibration error: the mean gap of confidence and accuracy over ten bins of confidence."""
    rows = _examples(seed, n, style)
    z, label = _scores(model, rows), np.array([c for _, c in rows])
    p = np.exp(z - z.max(axis=1, keepdims=True))
    sure, right = (p / p.sum(axis=1, keepdims=True)).max(axis=1), z.argmax(axis=1) == label
    bins = np.minimum((sure * 10).astype(int), 9)
    return float(right.mean()), float(sum(abs(sure[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins)))


@lru_cache(maxsize=1)
def default_model(n: int = 2400, seed: int = 5, rounds: int = 150) -> Model:
    """Fits by full-batch Adam with an L2 penalty, then calibrates the temperature on lines of another style."""
    data = _examples(seed, n)
    seen = Counter(g for x, _ in data for g in x)
    names = sorted(g for g, c in seen.items() if c >= 3)
    index, k = {g: i for i, g in enumerate(names)}, len(FAMILIES)
    x = np.zeros((n, len(names)), np.float32)
    for i, (own, _) in enumerate(data):
        x[i, [index[g] for g in own if g in index]] = 1 / math.sqrt(len(own))
    y = np.eye(k)[[c for _, c in data]]
    w, b = np.zeros((len(index), k)), np.zeros(k)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        z = x @ w.astype(np.float32) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for j, (v, g) in enumerate(((w, x.T @ (p - y).astype(np.float32) / len(x) + 1e-5 * w), (b, (p - y).mean(axis=0)))):
            m1, m2 = state[2 * j], state[2 * j + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v -= 0.2 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    model = Model({g: np.round(w[i], 6).tolist() for g, i in index.items()}, np.round(b, 6).tolist(), 1.0)
    other = _examples(seed + 1, n // 2, "calibrate")
    z, label = _scores(model, other), np.array([c for _, c in other])
    grid = np.exp(np.linspace(math.log(0.2), math.log(5), 200))
    model.temperature = round(float(min(grid, key=lambda t: _loss(z / t, label))), 4)
    return model


def _grams_column(words):
    def of(n: int):
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<string>"))

    parts = [of(n) for n in (1, 2, 3)]
    return F.array_distinct(F.concat(*parts))


def paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row a paragraph, and rows of nulls for what is none (at least one row a document): rid, doc_id, block, piece (null for a whole block), line (null for several lines), family, probability, share, confirmed."""
    model, spark = model or default_model(), docs.sparkSession
    k, t = len(FAMILIES), len(model.templates)
    table = spark.createDataFrame(model.table(), "gram string, w array<double>, t array<int>").select("gram", *(F.col("w")[i].alias(f"w{i}") for i in range(k)), *(F.col("t")[i].alias(f"t{i}") for i in range(t)))
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("rid", "doc_id", F.posexplode_outer(F.when(text.rlike(GATE), F.split(text, BLANK))).alias("block", "text")).where(text.isNull() | text.rlike(GATE))
    unit = lambda piece, line, said: F.struct(F.lit(piece).cast("int").alias("piece") if piece is None else piece.alias("piece"), F.lit(line).cast("int").alias("line") if line is None else line.alias("line"), said.alias("said"))
    several = lambda parts, whole: F.when(F.size(parts) > 1, F.array(whole)).otherwise(F.array().cast("array<struct<piece:int,line:int,said:string>>"))
    of_piece = lambda p, i: F.concat(several(F.split(p, "\n"), unit(i, None, p)), F.transform(F.split(p, "\n"), lambda l, j: unit(i, j, l)))
    units = F.concat(several(F.col("pieces"), unit(None, None, text)), F.flatten(F.transform("pieces", of_piece)))
    rows = rows.withColumn("pieces", F.split(text, ENDED)).select("rid", "doc_id", "block", F.explode_outer(F.filter(units, lambda u: u["said"].rlike(GATE))).alias("unit")).select("rid", "doc_id", "block", "unit.*")
    rows = rows.withColumn("named", F.col("said").rlike(NAMED))
    words = F.filter(F.split(F.regexp_replace(F.lower("said"), r"[^a-z0-9.]+|\.(?![0-9])", " "), " "), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumn("grams", _grams_column(F.col("words"))).select("rid", "doc_id", "block", "piece", "line", "named", F.size("grams").alias("n"), F.explode_outer("grams").alias("gram"))
    sums = rows.join(F.broadcast(table), "gram", "left").groupBy("rid", "doc_id", "block", "piece", "line", "named", "n").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(k)), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(t)))
    logits = [(F.lit(model.bias[i]) + F.coalesce(f"w{i}", F.lit(0.0)) / F.sqrt(F.greatest("n", F.lit(1)))) / model.temperature for i in range(k)]
    sums = sums.select("rid", "doc_id", "block", "piece", "line", "named", *(x.alias(f"z{i}") for i, x in enumerate(logits)), *(f"t{i}" for i in range(t)))
    top = F.greatest(*(f"z{i}" for i in range(k)))
    total = sum((F.exp(F.col(f"z{i}") - F.col("top")) for i in range(1, k)), F.exp(F.col("z0") - F.col("top")))
    best = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(F.array(*(F.col(f"z{i}") for i in range(k))), F.col("top")).cast("int"))
    share = F.lit(0.0)
    for j, (f, own) in enumerate(model.templates):
        share = F.greatest(share, F.when(F.col("best") == f, F.coalesce(f"t{j}", F.lit(0)) / len(own)).otherwise(0.0))
    found = sums.withColumn("top", top).withColumn("best", best).withColumn("probability", 1 / total)
    found = found.withColumn("family", F.when(F.col("probability") >= LEAST, F.col("best")).otherwise(UNKNOWN)).withColumn("share", share)
    found = found.withColumn("sure", F.col("block").isNotNull() & (F.col("family") != UNKNOWN) & (F.col("share") >= CONFIRM))
    is_line, is_piece = F.col("line").isNotNull(), F.col("line").isNull() & F.col("piece").isNotNull()
    within = lambda which, *by: F.collect_set(F.when(which & F.col("sure"), F.col("family"))).over(Window.partitionBy("rid", *by))
    found = found.withColumn("in_piece", within(is_line, "block", "piece")).withColumn("in_block", within(F.col("piece").isNotNull(), "block"))
    taken = F.max(is_piece & F.col("sure") & (F.size("in_piece") == 0)).over(Window.partitionBy("rid", "block", "piece"))
    found = found.withColumn("taken", taken)
    counts = F.when(is_line, ~F.col("taken") & (F.col("named") | (F.col("family") != UNKNOWN))).otherwise(F.col("sure") & ~F.array_contains(F.when(is_piece, F.col("in_piece")).otherwise(F.col("in_block")), F.col("family")))
    found = found.withColumn("counts", F.col("block").isNotNull() & counts)
    return found.select("rid", "doc_id", *(F.when(F.col("counts"), F.col(c)).alias(c) for c in ("block", "piece", "line", "family", "probability", "share")), (F.col("counts") & F.col("sure")).alias("confirmed"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row a document: doc_id, n_paragraphs, n_confirmed, n_unconfirmed, n_unknown, families (confirmed, sorted, comma-joined)."""
    rows = paragraphs(docs, id_col=id_col, text_col=text_col, model=model)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sure, unknown = F.col("confirmed"), F.col("family") == UNKNOWN
    return rows.groupBy("rid", "doc_id").agg(
        F.count("block").alias("n_paragraphs"), count(sure).alias("n_confirmed"), count(~sure & ~unknown).alias("n_unconfirmed"), count(unknown).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"),
    ).drop("rid")
