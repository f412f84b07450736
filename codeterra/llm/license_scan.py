"""License scans: a trained paragraph classifier whose predictions are confirmed by comparison with templates.

Paragraphs are lines, and lines of a wrapped notice with the short ones around them. Their features are the words and word pairs that they hold; a multinomial logistic regression with
an L1 penalty, fitted on the driver to variants of the templates below and a bounded sample of other paragraphs, gives
each licence family and the class of unknown text a weight for few of them. A temperature, fitted on variants that
were not learned from, calibrates the probabilities; what no family reaches with LEAST is unknown. A prediction is
confirmed by the largest part of one of its family's templates that the paragraph holds.

Scoring is Spark expressions only. The fitted weights also give a set of words without any of which no family can reach
LEAST (proved by the sum of all other positive weights), so that most paragraphs are passed over by one pattern, exactly.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Paragraphs of the documents that stand for unknown text, about; so many of a text, and of each so many characters.
SAMPLE = 3000
PER_TEXT = 4
LONGEST = 2000
#: A line of no more characters may be one of a wrapped paragraph: it is judged once alone, and once with such lines around it.
WRAPPED = 120
BEFORE, AFTER = 2, 7
VARIANTS = 40
#: Calibrated probability that a family needs, and the part of a template that confirms it.
LEAST = 0.5
CONFIRMED = 0.6
PENALTY = 0.0004
STEPS = 300

# Notices by which each licence family is granted or named.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is released into the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Paragraphs that talk of licences and grant none.
OTHERS = (
    "You need a license to drive a car in this state.",
    "The license fee is due on the first day of each month.",
    "He was released under the terms of the agreement.",
    "The public was asked for permission to copy the version in the library.",
    "Work in the general area of software is free of charge for the public.",
    "The source of the river is under the mountain.",
    "Read the terms and conditions of use before you sign.",
    "The council granted permission for the work on the house.",
)


def grams_of(text: str) -> list[str]:
    """Distinct words (ASCII letters and digits, lower case) and pairs of neighbours of one paragraph."""
    words = [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def _lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def grams(paragraph: Column) -> Column:
    """The same as grams_of, as an expression; paragraph must be in lower case."""
    words = F.filter(F.split(paragraph, "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def _variants(rng: random.Random, text: str, n: int) -> list[str]:
    """The text itself, and copies with a few words dropped or doubled, cut short, or with a year or name added."""
    out = [text]
    words = text.split()
    for _ in range(n - 1):
        now = [w for w in words if rng.random() > 0.08] or words
        if rng.random() < 0.3:
            now = now[: max(len(now) * 2 // 3, min(4, len(now)))]
        if rng.random() < 0.3:
            now = [rng.choice(("copyright", "notice", "legal", "see", "file")), str(rng.randint(1990, 2030)), *now]
        out.append(" ".join(now))
    return out


@dataclass
class Model:
    classes: list[str]  # unknown is the last
    bias: np.ndarray
    weights: dict[str, np.ndarray]  # by gram, a weight for each class, divided by the temperature
    anchors: list[str]

    def probabilities(self, text: str) -> np.ndarray:
        margin = self.bias + sum((self.weights[g] for g in grams_of(text) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(margin - margin.max())
        return e / e.sum()


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _anchors(vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, common: dict[str, int]) -> list[str]:
    """A small set of words without any of which no family's margin over unknown reaches what LEAST needs."""
    gain = np.maximum(weights[:, :-1] - weights[:, -1:], 0)  # of each family over unknown
    need = math.log(LEAST / (1 - LEAST)) + bias[-1] - bias[:-1]
    held = {g: set(g.split(" ")) for g, x in zip(vocabulary, gain) if x.max() > 0}
    rows = {g: x for g, x in zip(vocabulary, gain)}
    anchors = {w for ws in held.values() for w in ws}

    def free(without: str) -> np.ndarray:
        left = anchors - {without}
        return sum((rows[g] for g, ws in held.items() if not ws & left), np.zeros(len(need)))

    for word in sorted(anchors, key=lambda w: (-common.get(w, 0), w)):
        if (free(word) < need - 1e-9).all():
            anchors.discard(word)
    return sorted(anchors)


def fit(others: list[str]) -> Model:
    """Families from the templates' variants, unknown from other paragraphs; every fourth variant is kept for the temperature."""
    rng = random.Random(7)
    classes = [*TEMPLATES, UNKNOWN]
    rows = [(k, v, i % 4 == 3) for k, name in enumerate(TEMPLATES) for t in TEMPLATES[name] for i, v in enumerate(_variants(rng, t, VARIANTS))]
    rows += [(len(TEMPLATES), t, i % 4 == 3) for i, t in enumerate([v for t in OTHERS for v in _variants(rng, t, 8)] + others)]
    sets = [grams_of(t) for _, t, _ in rows]
    seen: dict[str, int] = {}
    for g in (g for (k, _, kept), s in zip(rows, sets) if k < len(TEMPLATES) and not kept for g in s):
        seen[g] = seen.get(g, 0) + 1
    vocabulary = sorted(g for g, n in seen.items() if n >= VARIANTS // 4)
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i, [at[g] for g in s if g in at]] = 1
    y = np.eye(len(classes))[[k for k, _, _ in rows]]
    # unknown text is by far the most: its rows count ten times, which the bias learns
    much = np.where(np.array([k for k, _, _ in rows]) == len(TEMPLATES), 10.0, 1.0)
    kept = np.array([h for _, _, h in rows])
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    learn, mass = x[~kept], much[~kept][:, None] / much[~kept].sum()
    pace = 2 / max(float((mass[:, 0] * (learn.sum(axis=1) + 1)).max() * len(learn) / 50), 0.05)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        error = (_soft(learn @ ahead_w + ahead_b) - y[~kept]) * mass
        new = ahead_w - pace * (learn.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - pace * PENALTY, 0)
        new_b = ahead_b - pace * error.sum(axis=0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    margins, truth = x[kept] @ w + b, y[kept].argmax(axis=1)
    heats = np.geomspace(0.1, 3, 40)
    loss = [-(much[kept] * np.log(_soft(margins / h)[np.arange(len(truth)), truth] + 1e-12)).sum() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    w, b = w / heat, b / heat
    used = np.abs(w).max(axis=1) > 1e-6
    names = [g for g, u in zip(vocabulary, used) if u]
    common: dict[str, int] = {}
    for s in (s for (k, _, _), s in zip(rows, sets) if k == len(TEMPLATES)):
        for g in s:
            common[g] = common.get(g, 0) + 1
    return Model(classes, b, dict(zip(names, w[used])), _anchors(names, w[used], b, common))


def train(docs: DataFrame, sample: int = SAMPLE, per_text: int = PER_TEXT, longest: int = LONGEST) -> Model:
    """Unknown text: paragraphs without words of licences, about `sample`, of texts whose hash is below a threshold.

    Of each such text the first `per_text` paragraphs are taken, and of each paragraph the first `longest` characters.
    """
    n = docs.count()
    part = min(1.0, sample / per_text / max(n, 1))
    some = docs.select("text").where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(part * (1 << 30)))
    plain = F.slice(F.filter(F.split("text", "\n"), lambda p: (p != "") & ~p.rlike("(?i)licen[sc]|copyright|creative commons|public domain|rights reserved")), 1, per_text)
    # copies of one text pass together, so paragraphs are made distinct before they are sent
    lines = some.select(F.explode(plain).alias("p")).select(F.substring("p", 1, longest).alias("p")).distinct()
    return fit(sorted(r["p"] for r in lines.limit(2 * sample).collect()))  # about `sample` paragraphs


def _doubles(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def predict(paragraph: Column, model: Model) -> Column:
    """struct(at, probability) of one paragraph in lower case: the place of its best class, counted from 1 in TEMPLATES' order, unknown last."""
    names = list(model.weights)
    vocabulary = F.split(F.lit("\n".join(names)), "\n")
    table = F.from_json(F.lit("[" + ",".join("[" + ",".join(repr(float(v)) for v in model.weights[g]) + "]" for g in names) + "]"), "array<array<double>>")
    held = F.array_intersect(grams(paragraph), vocabulary)
    margins = F.aggregate(held, _doubles(model.bias), lambda acc, g: F.zip_with(acc, F.element_at(table, F.array_position(vocabulary, g).cast("int")), lambda a, w: a + w))
    top = F.array_max(F.zip_with(margins, F.sequence(F.lit(1), F.lit(len(model.classes))), lambda m, k: F.struct(m.alias("m"), (-k).alias("k"))))
    total = F.aggregate(margins, F.lit(0.0), lambda acc, m: acc + F.exp(m - F.array_max(margins)))
    return F.struct((-top["k"]).alias("at"), (1 / total).alias("probability"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_paragraphs, license, paragraph, probability, similarity, confirmed, licenses), a row for each row.

    license is the family of the paragraph with the highest probability among those that a family wins with LEAST or
    more, confirmed ones first, then the first; null where all paragraphs are unknown. paragraph counts lines from 0; a wrapped
    notice has the line that an anchor is in.
    licenses has the distinct families of confirmed paragraphs, sorted. A null text is one empty paragraph. Repeated
    rows come back repeated.
    """
    pattern = "(?<![a-z0-9])(?:" + "|".join(model.anchors) + ")(?![a-z0-9])"
    docs = docs.select("doc_id", F.split(_lower(F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    # (paragraph, text) of those that hold an anchor: all others are unknown
    some = F.filter(F.transform("lines", lambda p, k: F.struct(k.alias("paragraph"), p.alias("p"))), lambda x: x["p"].rlike(pattern))
    docs = docs.select("doc_id", "lines", F.size("lines").cast("long").alias("n_paragraphs"), some.alias("some"))

    def around(x: Column) -> Column:
        first = F.greatest(x["paragraph"] + 1 - BEFORE, F.lit(1))
        near = F.slice("lines", first, x["paragraph"] + 2 + AFTER - first)
        return F.struct(x["paragraph"].alias("paragraph"), F.array_join(F.filter(near, lambda p: F.length(p) <= WRAPPED), " ").alias("p"))

    joined = F.filter(F.transform(F.filter("some", lambda x: F.length(x["p"]) <= WRAPPED), around), lambda x: F.length(x["p"]) > 0)
    docs = docs.withColumn("some", F.array_distinct(F.concat("some", joined))).drop("lines")
    families = list(TEMPLATES)
    judged = F.transform("some", lambda x: F.struct(x["paragraph"].alias("paragraph"), predict(x["p"], model).alias("found"), grams(x["p"]).alias("grams")))
    judged = F.filter(judged, lambda x: (x["found"]["at"] <= len(families)) & (x["found"]["probability"] >= LEAST))
    docs = docs.withColumn("judged", judged)
    templates = F.from_json(F.lit("[" + ",".join("[" + ",".join("[" + ",".join(f'"{g}"' for g in grams_of(t)) + "]" for t in TEMPLATES[f]) + "]" for f in families) + "]"), "array<array<array<string>>>")
    part = lambda x, t: F.size(F.array_intersect(x["grams"], t)) / F.size(t)
    compared = F.transform("judged", lambda x: F.struct(F.element_at(F.split(F.lit("\n".join(families)), "\n"), x["found"]["at"]).alias("license"), x["paragraph"].alias("paragraph"), x["found"]["probability"].alias("probability"), F.array_max(F.transform(F.element_at(templates, x["found"]["at"]), lambda t: part(x, t))).alias("similarity")))
    docs = docs.withColumn("compared", compared)
    best = F.array_max(F.transform("compared", lambda x: F.struct((x["similarity"] >= CONFIRMED).alias("ok"), x["probability"].alias("probability"), (-x["paragraph"]).alias("k"), x.alias("x"))))
    docs = docs.withColumn("best", best["x"])
    sure = F.array_sort(F.array_distinct(F.transform(F.filter("compared", lambda x: x["similarity"] >= CONFIRMED), lambda x: x["license"])))
    return docs.select(
        "doc_id",
        "n_paragraphs",
        F.col("best.license").alias("license"),
        F.col("best.paragraph").cast("long").alias("paragraph"),
        F.col("best.probability").alias("probability"),
        F.col("best.similarity").alias("similarity"),
        F.coalesce(F.col("best.similarity") >= CONFIRMED, F.lit(False)).alias("confirmed"),
        sure.alias("licenses"),
    )


def licenses(docs: DataFrame) -> DataFrame:
    """The whole operator: the model's unknown class is fitted to a bounded sample of these documents, then all are classified."""
    return classify(docs, train(docs))
