"""License scans by a trained paragraph classifier.

Paragraphs are lines. A multinomial logistic regression over sparse word pairs is
trained on variants of licence notices (words left out by rule) and on paragraphs of a
bounded sample of the corpus, as class "none". L1 keeps few weights; they are joined
to the exploded word pairs of every paragraph, and only sums per paragraph are grouped.

A paragraph is licence text when "none" has less than half of the probability and at
least ``HINT`` of the word pairs of a template are there. Its
family counts when its probability reaches the cutoff that held-out variants and
paragraphs select (the lowest with at most ``ERROR`` wrong families among those
accepted) and when it holds at least ``CONFIRM`` of the word pairs of one of the
family's templates; otherwise it is "unknown".

Null and empty texts have no paragraphs and family "none". Equal figures go to the
alphabetically first family. Rows of a repeated id are taken together: one row per id.
Without any documents the classifier is trained on the templates alone.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import staged

# The customary wording of licence notices.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "GNU Affero General Public License as published by the Free Software Foundation"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission of the copyright holder."],
}
#: Variants of each template, documents sampled for class "none", share of wrong families allowed,
#: template share that confirms, and that a licence of unknown family has at least.
VARIANTS, SAMPLE, ERROR, CONFIRM, HINT = 40, 1000, 0.01, 0.6, 0.3
NONE, UNKNOWN = "none", "unknown"
#: Only so many word pairs have weights.
MOST_PAIRS = 5000


def pairs(text: Column) -> Column:
    """Pairs of successive words, lower-cased; a word is a run of letters, digits and ``.``, not ending in ``.``."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])", " "))
    words = F.filter(F.split(clean, " +"), lambda w: w != "")
    return F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _line, _pairs)`` of the lines that have a pair of words."""
    lines = docs.select(F.col(id_col).alias("_id"), F.posexplode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_line", "_text"))
    clean = F.trim(F.regexp_replace(F.lower("_text"), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])", " "))
    split = lines.select("_id", "_line", F.split(clean, " +").alias("_w"))
    return split.where("size(_w) > 1").select("_id", "_line", "_w", F.expr("transform(slice(_w, 2, size(_w) - 1), (w, i) -> concat(get(_w, i), ' ', w))").alias("_pairs"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, number, text) for family, texts in sorted(TEMPLATES.items()) for number, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "family string, number int, text string")
    return df.select("family", "number", F.array_distinct(pairs(F.col("text"))).alias("template"), "text")


def _variants(spark: SparkSession) -> DataFrame:
    """Templates with words left out by rule: (family, fold, _pairs)."""
    rows = _templates(spark).select("family", "number", "text", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    words = F.filter(F.split("text", " "), lambda w, i: (F.col("v") < 4) | (F.pmod(F.xxhash64("family", "number", "v", i), F.lit(12)) != 0))
    rows = rows.select("family", (F.col("v") % 5 == 4).alias("held"), pairs(F.array_join(words, " ")).alias("_pairs"))
    return rows.where(F.size("_pairs") > 0)


def train(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str], list[str], list[float], float]:
    """Weights (pair, w, t), classes, the templates' families, intercepts and the cutoff of the unknown class."""
    spark = docs.sparkSession
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("licence")), F.lit(every)) == 0)
    templates = [(r["family"], set(r["template"])) for r in _templates(spark).orderBy("family", "number").collect()]  # fixed ones
    known = sorted(set().union(*(t for _, t in templates)))
    lines = paragraphs(sample, id_col, text_col).select("_pairs", F.xxhash64("_id", "_line").alias("h"))
    # paragraphs that hold a template's words are not examples of "none"
    likely = lines.where(F.size(F.array_intersect("_pairs", F.array(*[F.lit(p) for p in known]))) < 2)
    rows = _variants(spark).unionAll(likely.select(F.lit(NONE).alias("family"), (F.pmod("h", F.lit(5)) == 0).alias("held"), "_pairs"))
    rows = staged(rows, "licence-training")
    vector = CountVectorizer(inputCol="_pairs", outputCol="features", binary=True, vocabSize=MOST_PAIRS, minDF=2.0).fit(rows.where(f"family <> '{NONE}'"))
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    ready = index.transform(vector.transform(rows))
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=5e-4, maxIter=60, standardization=False).fit(ready.where("not held"))
    classes = index.labels
    weights = model.coefficientMatrix.toArray()
    # a pair's weights, and its share of each template
    table = [(word, [float(x) for x in weights[:, j]], [1.0 / len(t) if word in t else 0.0 for _, t in templates]) for j, word in enumerate(vector.vocabulary)]
    held = model.transform(ready.where(f"held AND family <> '{NONE}'")).select("label", "prediction", "probability").collect()  # of the variants
    cutoff = 0.5
    for c in (x / 20 for x in range(10, 20)):
        taken = [r for r in held if max(r["probability"]) >= c and classes[int(r["prediction"])] != NONE]
        cutoff = c
        if sum(r["label"] != r["prediction"] for r in taken) <= ERROR * len(taken):
            break
    pairs_ = spark.createDataFrame(table, "pair string, w array<double>, t array<double>")
    return pairs_, classes, [f for f, _ in templates], [float(x) for x in model.interceptVector], cutoff


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_paragraphs, n_licence, family, probability, confirmed)``: one row per id, the strongest licence paragraph deciding."""
    weights, classes, families, intercepts, cutoff = train(docs, id_col, text_col)
    lines = paragraphs(docs, id_col, text_col)
    # at most MOST_PAIRS weights
    sums = [F.sum(F.col("w")[i]).alias(f"m{i}") for i in range(len(classes))] + [F.sum(F.col("t")[j]).alias(f"t{j}") for j in range(len(families))]
    hits = (lines.select("_id", "_line", F.explode_outer(F.array_distinct("_pairs")).alias("pair")).join(F.broadcast(weights), "pair")
            .groupBy("_id", "_line").agg(*sums))
    margin = F.array(*[F.col(f"m{i}") + F.lit(intercepts[i]) for i in range(len(classes))])
    held = {c: [F.col(f"t{j}") for j, f in enumerate(families) if f == c] for c in classes}
    shares = F.array(*[F.array_max(F.array(*held[c])) if held[c] else F.lit(0.0) for c in classes])
    scored = hits.select("_id", "_line", shares.alias("s"), margin.alias("m"))
    scored = scored.select("_id", "_line", "s", F.expr("transform(m, x -> exp(x - array_max(m)))").alias("e"))
    scored = scored.select("_id", "_line", "s", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))").alias("p"))
    none = classes.index(NONE) if NONE in classes else -1
    licence = scored.where(F.lit(True) if none < 0 else F.col("p")[none] < 0.5)
    names = F.array(*[F.lit(c) for c in classes])
    licence = licence.withColumn("probability", F.array_max(F.expr(f"transform(p, (x, i) -> IF(i = {none}, 0D, x))")))
    licence = licence.withColumn("place", F.array_position("p", F.col("probability")).cast("int"))
    licence = licence.withColumn("guess", F.element_at(names, F.col("place")))
    share = F.element_at("s", F.col("place"))
    licence = licence.withColumn("share", F.coalesce(share, F.lit(0.0))).where(F.col("share") >= HINT)
    licence = licence.withColumn("confirmed", (F.col("probability") >= cutoff) & (F.col("share") >= CONFIRM))
    licence = licence.withColumn("family", F.when(F.col("confirmed"), F.col("guess")).otherwise(F.lit(UNKNOWN)))
    best = licence.groupBy("_id").agg(F.count(F.lit(1)).alias("n_licence"), F.max(F.struct(
        "confirmed", "probability", (-F.col("_line")).alias("l"), "family")).alias("b"))
    counts = docs.select(F.col(id_col).alias("_id"), F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("n"))
    counts = counts.groupBy("_id").agg(F.sum("n").cast("long").alias("n_paragraphs"))
    return counts.join(best.withColumnRenamed("_id", "_b"), F.col("_id").eqNullSafe(F.col("_b")), "left").select(
        F.col("_id").alias(id_col), "n_paragraphs", F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce("b.family", F.lit(NONE)).alias("family"), F.col("b.probability").alias("probability"),
        F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"))
