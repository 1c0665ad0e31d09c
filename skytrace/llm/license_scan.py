"""License scan: a trained paragraph classifier over sparse word n-grams, scored in DataFrame functions only.

Training (a few thousand short paragraphs, on the driver): template statements of each family, whole, shortened, with words missing or inside
other text, against a bounded sample of the corpus' own paragraphs and against paragraphs with stray template words. A multinomial logistic
regression with an unknown class learns from presence of word 1- to 3-grams of the templates. Anchor words and features come from the templates
alone; the sample only sets weights. A temperature fitted on held-back paragraphs calibrates the probabilities. Scoring: paragraphs (single lines, and
overlapping runs of lines for notices that are wrapped; comment marks and blank lines hold no words) that hold an anchor word are cut into n-grams, joined with the weight table (bounded by the templates) and summed. A prediction counts if its probability is high
enough and a template statement of that family is covered by the paragraph's n-grams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrace.llm.common import doc_key, let, lookup, text_or_empty
from skytrace.session import store

# Short statements by which published works name their licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "published by the Free Software Foundation under the terms of the GNU Affero General Public License",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "No part of this publication may be reproduced in any form without prior written permission of the publisher.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
FAMILIES = tuple(TEMPLATES)
GRAMS = 3
# Words of the statements that any text has: anchors only where a statement has no others.
PLAIN = frozenset("a all and any are as at author be by can except extent file following for form free in is it may met no not of on or part person possible prior provided public source subject term terms that the this to under use version with without work you".split())


@dataclass(frozen=True)
class ScanParams:
    background_docs: int = 300  # documents of the background sample, chosen by a hash of the id
    background_paragraphs: int = 1500  # of their paragraphs, at most
    background_words: int = 120  # words kept of each of those, for training only
    background_coverage: float = 0.4  # a sampled paragraph with so much of a statement may be a notice and isn't trained on as background
    variants: int = 40  # training paragraphs per statement
    probability: float = 0.5
    run_lines: int = 8  # lines of a run; runs start at every half of it, so a notice of up to half of it and one line lies in one
    coverage: float = 0.7  # share of a statement's n-grams that the paragraph must hold
    seed: int = 11


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i:i + n]) for n in range(1, GRAMS + 1) for i in range(len(tokens) - n + 1)}


@dataclass(frozen=True)
class LicenseModel:
    features: tuple[str, ...]
    anchors: tuple[str, ...]
    weights: np.ndarray  # [feature, class]; the last class is unknown; already divided by the temperature
    bias: np.ndarray


def covered(found: set[str], family: str) -> float:
    return max(len(found & g) / len(g) for g in (grams(words(t)) for t in TEMPLATES[family]))


def anchor_words(statement: str, coverage: float) -> set[str]:
    """Words of a statement of which every text holds one that covers so much of it; longer and less plain words first."""
    tokens, chosen = words(statement), set()
    shape = grams(tokens)
    for word in sorted(set(tokens), key=lambda w: (w in PLAIN or w.isdigit(), w != "cc", -len(w), w)):
        if sum(not chosen & set(g.split()) for g in shape) < coverage * len(shape):
            break
        chosen.add(word)
    return chosen


def train(background: list[str], p: ScanParams = ScanParams()) -> LicenseModel:
    rng = np.random.default_rng(p.seed)
    plain = [w for w in (words(t)[:p.background_words] for t in background) if w]
    plain = [w for w in plain if max(covered(grams(w), f) for f in FAMILIES) < p.background_coverage] or [["text"]]
    own = {g for f in FAMILIES for t in TEMPLATES[f] for g in grams(words(t))}
    held = {w for f in FAMILIES for t in TEMPLATES[f] for w in anchor_words(t, p.coverage)}
    anchors, features = tuple(sorted(held)), tuple(sorted(g for g in own if held & set(g.split())))
    rows: list[tuple[list[str], int]] = []
    for k, f in enumerate(FAMILIES):
        for statement in TEMPLATES[f]:
            tokens = words(statement)
            for v in range(p.variants):
                kept = [t for t in tokens if rng.random() > 0.08] if v % 4 == 1 else tokens
                if v % 4 == 2 and len(tokens) > 8:
                    size = int(rng.integers(int(0.8 * len(tokens)), len(tokens)))
                    start = int(rng.integers(len(tokens) - size + 1))
                    kept = tokens[start:start + size]
                around = plain[int(rng.integers(len(plain)))]
                cut = int(rng.integers(len(around) + 1))
                rows.append((around[:cut] + kept + around[cut:] if v % 2 else kept, k))
    unknown = len(FAMILIES)
    single = [words(s) for f in FAMILIES for s in TEMPLATES[f]]
    for i, w in enumerate(plain):
        rows.append((w, unknown))
        stray = list(w[:40])
        for _ in range(int(rng.integers(1, 3))):
            source = single[int(rng.integers(len(single)))]
            stray.insert(int(rng.integers(len(stray) + 1)), source[int(rng.integers(len(source)))])
        rows.append((stray, unknown))
    index = {g: i for i, g in enumerate(features)}
    x = np.zeros((len(rows), len(features)), np.float32)
    for r, (tokens, _) in enumerate(rows):
        x[r, [index[g] for g in grams(tokens) if g in index]] = 1
    y = np.array([k for _, k in rows])
    test = rng.random(len(rows)) < 0.2
    weights, bias = np.zeros((len(features), unknown + 1), np.float32), np.zeros(unknown + 1, np.float32)
    share = np.bincount(y[~test], minlength=unknown + 1)
    each = (len(y[~test]) / (unknown + 1) / np.maximum(share, 1))[y[~test]]
    each[y[~test] == unknown] *= 3
    target = np.eye(unknown + 1, dtype=np.float32)[y[~test]]
    speed = [np.zeros_like(weights), np.zeros_like(bias)]
    for _ in range(200):
        error = (_softmax(x[~test] @ weights + bias) - target) * each[:, None].astype(np.float32) / each.sum()
        for value, grad, v in ((weights, x[~test].T @ error + 1e-5 * weights, speed[0]), (bias, error.sum(0), speed[1])):
            v *= 0.9
            v -= 2.0 * grad
            value += v
    logits = x[test] @ weights + bias
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(logits)), y[test]] + 1e-12).mean() for t in np.geomspace(0.25, 4, 17)} if test.any() else {1.0: 0.0}
    heat = min(losses, key=losses.get)
    return LicenseModel(features, anchors, weights / heat, bias / heat)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def background(docs: DataFrame, p: ScanParams) -> list[str]:
    """A bounded sample of the corpus' paragraphs, for training."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.background_docs).distinct()
    lines = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("at", "line"))
    words_only = F.substring_index(F.trim("line"), " ", p.background_words)
    rows = lines.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(p.background_paragraphs).select(words_only.alias("line")).collect()
    return [r["line"] for r in rows]


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))


def _grams(tokens: Column) -> Column:
    """Distinct 1- to 3-grams; each length extends the one before by the words that follow, in one pass over the array."""
    parts = [tokens]
    for n in range(2, GRAMS + 1):
        count = F.greatest(F.lit(0), F.size(tokens) - n + 1)
        parts.append(F.zip_with(F.slice(parts[-1], F.lit(1), count), F.slice(tokens, F.lit(n), count), lambda head, word: F.concat_ws(" ", head, word)))
    return F.array_distinct(F.concat(*parts))


def classified(docs: DataFrame, model: LicenseModel, p: ScanParams = ScanParams()) -> DataFrame:
    """(row, line_no, family, probability, share) of paragraphs with a confirmed licence; ``docs`` has row (a document's key) and text.

    Lines are judged one by one, then runs of lines. A run adds what no line in it has given; its line_no is the last line from which on the rest of the
    run still covers as much of the statement, and of overlapping runs with one family the best covered counts (ties: the first).
    """
    anchored = "(?i)(?<![a-z0-9])(?:" + "|".join(model.anchors) + ")(?![a-z0-9])"
    held = docs.where(F.col("text").rlike(anchored))
    lines = held.select("row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(anchored)).distinct()
    single = store(_confirmed(lines, model, p).drop("shape", "line"))
    step = max(1, p.run_lines // 2)
    runs = let(F.split("text", "\n"), lambda ls: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ls) - 2, F.lit(0)), F.lit(step)),
        lambda i: F.struct(i.alias("line_no"), F.array_join(F.slice(ls, i + 1, F.lit(p.run_lines)), "\n").alias("line"))))
    wrapped = held.where(F.contains("text", F.lit("\n"))).select("row", F.inline(runs)).where(F.col("line").rlike(anchored)).distinct()
    wrapped = store(_confirmed(wrapped, model, p))
    given = single.select("row", "family", F.col("line_no").alias("at"))
    inside = (given["row"] == wrapped["row"]) & (given["family"] == wrapped["family"]) & (given["at"] >= wrapped["line_no"]) & (given["at"] < wrapped["line_no"] + p.run_lines)
    added = wrapped.join(given, inside, "left_anti")
    by_start = Window.partitionBy("row", "family").orderBy("line_no")
    fresh = F.coalesce((F.col("line_no") - F.lag("line_no").over(by_start) >= p.run_lines).cast("int"), F.lit(0))
    added = added.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by_start))
    best = added.groupBy("row", "family", "island").agg(F.max_by(F.struct(*single.columns, "line", "shape"), F.struct("share", -F.col("line_no"))).alias("b")).select("b.*")
    rest = let(F.split("line", "\n"), lambda ls: F.transform(
        F.sequence(F.lit(1), F.size(ls)), lambda j: F.size(F.array_intersect(_grams(_tokens(F.array_join(F.slice(ls, j, F.lit(p.run_lines)), " "))), F.col("shape")))))
    last = let(rest, lambda r: F.array_max(F.transform(r, lambda n, i: F.when(n == F.array_max(r), i))))
    return single.unionByName(best.withColumn("line_no", F.col("line_no") + last).select(*single.columns))


def _confirmed(lines: DataFrame, model: LicenseModel, p: ScanParams) -> DataFrame:
    """(row, line_no, family, probability, share, shape, line) of those ``lines(row, line_no, line)`` whose licence the templates confirm."""
    spark = lines.sparkSession
    lines = store(lines.withColumn("grams", _grams(_tokens(F.col("line")))))
    classes = (*FAMILIES, "unknown")
    table = spark.createDataFrame([(g, [float(w) for w in model.weights[i]]) for i, g in enumerate(model.features)], "gram string, w array<double>")
    hits = lines.select("row", "line_no", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("row", "line_no").agg(*(F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(classes))))
    logits = [F.col(f"z{k}") + float(model.bias[k]) for k in range(len(classes))]
    top = F.greatest(*logits)
    total = sum((F.exp(z - top) for z in logits), F.lit(0.0))
    best = F.array_max(F.array(*(F.struct(z.alias("z"), F.lit(-k).alias("k")) for k, z in enumerate(logits))))
    named = sums.select("row", "line_no", F.get(F.array(*map(F.lit, classes)), -best["k"]).alias("family"), (1 / total).alias("probability"))
    named = named.where((F.col("family") != "unknown") & (F.col("probability") >= p.probability))
    shapes = spark.createDataFrame([(f, sorted(grams(words(t)))) for f in FAMILIES for t in TEMPLATES[f]], "family string, shape array<string>")
    compared = named.join(F.broadcast(shapes), "family").join(lines, ["row", "line_no"])
    share = F.size(F.array_intersect("grams", "shape")) / F.size("shape")
    best = compared.withColumn("share", share).groupBy("row", "line_no", "family", "probability").agg(
        F.max("share").alias("share"), F.max_by("shape", F.struct("share", F.size("shape"))).alias("shape"), F.first("line").alias("line"))
    return best.where(F.col("share") >= p.coverage)


def scan_licenses(docs: DataFrame, p: ScanParams = ScanParams(), model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, n_licenses, families, spans, confidence) for every row of ``docs(doc_id, text, ...)``.

    Paragraphs are lines and runs of lines (see :func:`classified`). families lists the distinct families by name; spans is line:family in line order; confidence is the largest probability
    (null without a licence). Null and empty texts have none. Repeated rows give repeated rows. An empty table trains on the templates alone.
    Other columns are not read. Without a ``model`` one is trained on the sample of ``docs`` that the parameters bound.
    """
    model = model or train(background(docs, p), p)
    named = docs.select("doc_id", doc_key().alias("row"), text_or_empty().alias("text"))
    found = store(classified(named, model, p))
    span = F.struct("line_no", "family")
    listed = found.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("s"), F.max("probability").alias("confidence"))
    out = lookup(named.select("doc_id", "row"), store(listed), "row", "left")
    spans = F.coalesce(F.col("s"), F.array().cast("array<struct<line_no:int,family:string>>"))
    return out.select(
        "doc_id", F.size(spans).cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["line_no"], x["family"])), ",").alias("spans"), F.round("confidence", 6).alias("confidence"))
