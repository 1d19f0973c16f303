"""Licence scan: a trained paragraph classifier in DataFrame and SQL operations only.

A paragraph is a line, or a run of lines over which a notice is wrapped. Paragraphs become sparse
word 1- and 2-grams. A multinomial logistic regression over licence families and an unknown class,
trained by full-batch gradient descent from the labelled notices below (one SQL expression, so one
small task), predicts a family; its temperature is calibrated on notices held out of training. A
prediction is confirmed by comparing the paragraph with the family's templates; without that it is
unknown.

Which texts are read closely follows from the templates, not from a list of words: a confirmed
paragraph holds at least half of some template's 2-grams, hence one of any half and one more of
them. So a text without any of these, chosen to be the rarest, has no notice, and is passed over.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, without, written

#: Public short notices of licence families. The last of each family is held out for calibration.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License Version 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "This software is licensed under the MIT License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the GNU Lesser General Public License, version 3.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the Mozilla Public License Version 2.0.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under CC BY 3.0.",
        "Content on this site is licensed under CC BY 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Released under CC BY-SA 3.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC 3.0 for non-commercial use only.",
        "Released under CC BY-NC 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "Licensed under CC0 1.0.",
        "Released into the public domain under CC0.",
    ],
    "proprietary": [
        "Copyright 2020 Example Inc. All rights reserved.",
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. No license is granted without written permission.",
        "Copyright (c) 2019 The Authors. All rights reserved.",
    ],
    "unknown": [
        "A driving licence is required for this job.",
        "The restaurant lost its liquor license last year.",
        "He asked for permission to leave the room early.",
        "Your warranty covers parts and labour for two years.",
        "The fishing license fee is due in spring.",
        "Teachers must renew the license every five years.",
        "The court heard a dispute about copyright in the song.",
        "Her poetic license with the facts amused the public.",
    ],
}
#: Words that say little: 2-grams with fewer of them come first when those are chosen that a text must hold.
COMMON = ("a", "an", "and", "any", "are", "at", "by", "can", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "you", "with")
EPOCHS, RATE, DECAY = 120, 0.6, 0.002
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0)
#: The calibrated probability and the share of a template's 2-grams that a prediction needs.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.5


def grams(text: Column) -> Column:
    """Distinct word 1- and 2-grams of a paragraph (letters, digits and dots; A-Z lower-cased)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"\.(?=\s|$)", " "), r"[^a-z0-9.]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, _pairs(w))))[0]  # a variable of a function is computed once


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _holds(text: Column, pairs: list[str]) -> Column:
    return F.arrays_overlap(F.filter(grams(text), lambda g: F.contains(g, F.lit(" "))), F.lit(pairs))


def _any_of(words: list[str]) -> str:
    """A regular expression for texts that hold one of the words, with common beginnings written once."""
    if "" in words:
        return ""
    first = sorted({w[0] for w in words})
    parts = [re.escape(c) + _any_of([w[1:] for w in words if w[0] == c]) for c in first]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def template_pairs(spark: SparkSession) -> tuple[list[str], list[str]]:
    """All 2-grams of templates, and those of which a text that holds a notice has at least one: of each template the rarest, as many as cannot all be missing."""
    rows = _labelled(spark).filter("family != 'unknown'").select(F.filter("grams", lambda g: g.contains(" ")).alias("pairs")).collect()  # NOTICES, bounded
    need = set()
    for r in rows:
        order = sorted(r["pairs"], key=lambda g: (sum(w in COMMON for w in g.split(" ")), -len(g), g))
        need.update(order[: len(order) - math.ceil(LEAST_SHARE * len(order)) + 1])
    return sorted({g for r in rows for g in r["pairs"]}), sorted(need)


def _labelled(spark: SparkSession) -> DataFrame:
    rows = [{"k": k, "family": f, "held": i == len(texts) - 1, "n": i, "text": t} for k, (f, texts) in enumerate(NOTICES.items()) for i, t in enumerate(texts)]
    kind = "array<struct<k:int,family:string,held:boolean,n:int,text:string>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))).withColumn("grams", grams(F.col("text")))


def train(spark: SparkSession, *, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> dict:
    """{"features": [gram], "weights": [[of each class]], "bias": [...], "temperature": t}: bounded by the notices' vocabulary."""
    labelled = _labelled(spark)
    classes = len(NOTICES)
    one = labelled.agg(F.sort_array(F.collect_list(F.struct("k", "n", "held", "grams"))).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("vocabulary"))
    one = one.withColumn("map", F.map_from_arrays("vocabulary", F.sequence(F.lit(0), F.size("vocabulary") - 1)))
    one = one.withColumn("x", F.expr("transform(rows, r -> transform(r.grams, g -> map[g]))")).withColumn("fit", F.expr("transform(rows, r -> NOT r.held)")).withColumn("y", F.expr("transform(rows, r -> r.k)"))
    one = one.withColumn("inverse", F.expr("transform(sequence(0, size(vocabulary) - 1), f -> filter(sequence(0, size(x) - 1), r -> fit[r] AND array_contains(x[r], f)))"))
    # Written, as the optimizer would else put these columns' expressions into the loop that reads them.
    one = written(one.select("vocabulary", "x", "fit", "y", "inverse"), "license-notices")
    # Softmax of row x under weights w (feature-major, the last feature-row is the bias); w is scaled by 1 / temperature.
    logits = f"transform(sequence(0, {classes - 1}), k -> aggregate(x[r], w[size(vocabulary) * {classes} + k], (s, f) -> s + w[f * {classes} + k]))"
    softmax = "transform(array({l}), l -> transform(array(aggregate(l, 0D, (s, v) -> s + exp({t} * v))), z -> transform(l, v -> exp({t} * v) / z))[0])[0]"
    error = f"transform(sequence(0, size(x) - 1), r -> transform({softmax.format(l=logits, t='1D')}, (p, k) -> p - IF(k = y[r], 1D, 0D)))"
    slope = f"IF(i < size(vocabulary) * {classes}, aggregate(inverse[i div {classes}], 0D, (s, r) -> s + e[r][i % {classes}]), aggregate(sequence(0, size(x) - 1), 0D, (s, r) -> s + IF(fit[r], e[r][i % {classes}], 0D)))"
    update = f"transform(array({error}), e -> transform(w, (v, i) -> v - {rate}D * ({slope} / size(x) * {classes} + {decay}D * v)))[0]"
    one = one.withColumn("w", F.expr(f"aggregate(sequence(1, {epochs}), array_repeat(0D, (size(vocabulary) + 1) * {classes}), (w, epoch) -> {update})"))
    losses = ", ".join(f"aggregate(sequence(0, size(x) - 1), 0D, (s, r) -> s - IF(fit[r], 0D, ln(1e-12 + {softmax.format(l=logits, t=f'{t}D')}[y[r]])))" for t in TEMPERATURES)
    row = one.select("vocabulary", "w", F.expr(f"array({losses})").alias("losses")).collect()[0]
    w, n = row["w"], len(row["vocabulary"])
    best = min(range(len(TEMPERATURES)), key=lambda i: row["losses"][i])
    return {"features": row["vocabulary"], "weights": [w[f * classes : (f + 1) * classes] for f in range(n)], "bias": w[n * classes :], "temperature": TEMPERATURES[best]}


def classify(paragraphs: DataFrame, model: dict) -> DataFrame:
    """family, probability and share of each distinct paragraph that is confirmed as a notice of a family.

    Grams are exploded only for the paragraphs given; weights and template grams are joined by
    broadcast, as they are bounded by NOTICES.
    """
    spark = paragraphs.sparkSession
    families = list(NOTICES)
    kind = "array<struct<gram:string,w:array<double>>>"
    weights = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps([{"gram": g, "w": w} for g, w in zip(model["features"], model["weights"], strict=True)])), kind)))
    each = paragraphs.select("paragraph", F.explode(grams(F.col("paragraph"))).alias("gram")).join(F.broadcast(weights), "gram")
    sums = each.groupBy("paragraph").agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(families))])
    exps = F.array(*[F.exp(model["temperature"] * (F.col(f"s{k}") + model["bias"][k])) for k in range(len(families))])
    total = F.aggregate("exps", F.lit(0.0), lambda a, x: a + x)
    guess = sums.withColumn("exps", exps).withColumn("probability", F.array_max("exps") / total)
    guess = guess.withColumn("family", F.element_at(F.array(*map(F.lit, families)), F.array_position("exps", F.array_max("exps")).cast("int")))
    guess = guess.filter((F.col("family") != "unknown") & (F.col("probability") >= LEAST_PROBABILITY)).select("paragraph", "family", "probability")
    templates = _labelled(spark).filter("family != 'unknown'").select("family", "n", F.filter("grams", lambda g: g.contains(" ")).alias("pairs"))
    pairs = templates.filter(F.size("pairs") > 0).select("family", "n", F.size("pairs").alias("size"), F.explode("pairs").alias("gram"))
    shared = guess.select("paragraph", "family", "probability", F.explode(grams(F.col("paragraph"))).alias("gram")).join(F.broadcast(pairs), ["family", "gram"])
    shares = shared.groupBy("paragraph", "family", "probability", "n").agg((F.count("*") / F.first("size")).alias("share"))
    confirmed = shares.groupBy("paragraph", "family", "probability").agg(F.max("share").alias("share"))
    return confirmed.filter(F.col("share") >= LEAST_SHARE)


def _paragraphs(docs: DataFrame, text_col: str) -> DataFrame:
    """text_key, line, run and paragraph: of each different text the lines with a template's 2-gram (run null), and runs of two such lines or more, joined."""
    every, need = template_pairs(docs.sparkSession)
    words = sorted({max(g.split(" "), key=lambda w: (w not in COMMON, len(w), w)) for g in need})  # one of each pair: a cheap look at every text before the pairs
    texts = docs.select(F.col(text_col).alias("text")).filter(F.lower("text").rlike(_any_of(words)) & _holds(F.col("text"), need)).select(F.md5("text").alias("text_key"), "text").dropDuplicates(["text_key"])
    lines = texts.select("text_key", F.split("text", "\n").alias("lines"))
    word = lambda i, pattern: F.regexp_extract(F.coalesce(F.get("lines", i), F.lit("")), pattern, 0)
    around = lambda x, i: F.concat_ws(" ", word(i - 1, r"\S+\s*$"), x, word(i + 1, r"^\s*\S+"))  # noqa: E731  a 2-gram may lie across lines
    each = lines.select("text_key", F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("paragraph"), around(x, i).alias("around")))).alias("line", "x"))
    each = written(each.filter(_holds(F.col("x.around"), every)).select("text_key", "line", F.col("x.paragraph").alias("paragraph")), "license-lines")
    run = F.col("line") - F.row_number().over(Window.partitionBy("text_key").orderBy("line"))
    runs = each.withColumn("run", run)
    joined = runs.groupBy("text_key", "run").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line", "paragraph"))).alias("rows"))
    joined = joined.filter("n > 1").select("text_key", "line", F.lit(True).alias("wrapped"), "run", F.array_join(F.transform("rows", lambda x: x["paragraph"]), " ").alias("paragraph"))
    return runs.select("text_key", "line", F.lit(False).alias("wrapped"), "run", "paragraph").unionByName(joined)


def scan_licenses(docs: DataFrame, *, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """docs with licenses: array of (line, family, probability, share), by line (from 0).

    Lines end at \\n. A notice wrapped over several lines stands at its first line, unless one of its
    lines is confirmed by itself. Null, empty and unlicensed texts get an empty array; rows are kept
    one for one (repeated rows and equal texts get equal arrays); texts of any length are read whole;
    an empty table gives an empty one. A column named licenses, text_key or found is replaced.
    Different texts, and different paragraphs, are classified once.
    """
    spark = docs.sparkSession
    docs = without(docs, "licenses", "text_key", "found")
    units = written(_paragraphs(docs, text_col), "license-units")
    kinds = written(classify(units.select("paragraph").distinct(), model or train(spark)), "license-kinds")
    known = units.join(kinds, "paragraph")
    alone = known.filter("NOT wrapped")
    wrapped = known.filter("wrapped").join(alone.select("text_key", "run").distinct(), ["text_key", "run"], "left_anti")
    per = alone.unionByName(wrapped.select(*alone.columns)).groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("line", "family", "probability", "share"))).alias("found"))
    out = docs.withColumn("text_key", F.md5(text_col)).join(per, "text_key", "left")
    return out.withColumn("licenses", F.coalesce("found", F.array().cast("array<struct<line:int,family:string,probability:double,share:double>>"))).drop("found", "text_key")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", families).alias("families"), F.concat_ws(",", F.transform("licenses", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"]))).alias("lines"))
