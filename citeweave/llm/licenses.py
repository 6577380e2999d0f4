"""Licence scans with a trained paragraph classifier.

A multinomial logistic regression over word one- and two-grams tells licence
families, other licence terms and ordinary text apart. It is trained when the
query runs: on variants of the templates below (parts and thinned copies) and on a
bounded, hash-chosen sample of the corpus's own paragraphs as ordinary text. Its
threshold for "unknown" is calibrated on variants that were not trained on, and a
family counts only if the paragraph also has the words of one of its templates.
Every paragraph is put to the classifier, as a whole and sentence by sentence.

Everything is DataFrame and JVM-side machine-learning operations.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.session import durable

NONE = "none"
UNKNOWN = "unknown"
#: Templates: wordings by which each family is stated. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0, public domain."),
    ("reserved", "All rights reserved."),
    ("reserved", "Copyright by the author. All rights reserved. No part of this publication may be reproduced without prior written permission."),
    (UNKNOWN, "Use of this software is subject to the licence terms agreed with the vendor."),
    (UNKNOWN, "This file is covered by a custom license; see the license file for the terms that apply."),
    (UNKNOWN, "You may not copy or distribute this material without the permission of the copyright holder."),
    (UNKNOWN, "The end user license agreement governs your use of the product and its warranty."),
    (NONE, "He renewed his driving licence last week and lost it again on the way home."),
    (NONE, "The shop offers a two year warranty on every watch that it sells."),
    (NONE, "She asked for permission to leave early because the last train goes at nine."),
    (NONE, "Some people take poetic license with the facts when they tell old stories."),
)
#: Words of licence terms: what the classifier is less sure of than the threshold is "unknown" only with one of them.
CUE = (r"(?i)licen[sc]e|copyright|rights reserved|permission|warrant(?:y|ies)|redistribut|public domain|spdx|\bgpl\b|"
       r"creative commons|\bcc[ -]by\b|\bcc0\b")
#: Between sentences.
STOP = r"(?<=[.!?])\s+"
#: Words: letters and digits with inner dots and hyphens, in lower case.
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FEATURES = 1 << 13
SAMPLE_DOCS = 300
#: Share of a template's words that a paragraph must have.
CONFIRM = 0.6


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def grams(w: str) -> Column:
    """Words and pairs of neighbouring words of an array column."""
    pairs = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(F.col(w), F.when(F.size(w) > 1, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text with their number; null text has none."""
    return F.transform(F.split(text, "\n", -1), lambda p, i: F.struct(i.alias("nth"), p.alias("text")))


def sentences(paragraph: Column) -> Column:
    """What is judged of a paragraph: all of it, and each of its sentences if there are more."""
    parts = F.split(paragraph, STOP, -1)
    return F.when(F.size(parts) > 1, F.concat(F.array(paragraph), parts)).otherwise(F.array(paragraph))


def variants(spark: SparkSession) -> DataFrame:
    """``label, w, part``: template wordings whole, halved, thinned and framed; ``part`` deals them to training and calibration."""
    base = spark.createDataFrame(list(TEMPLATES), "label string, text string").withColumn("w", words(F.col("text")))
    n = F.size("w")
    middle = F.floor(n / 2).cast("int")
    made = [(F.lit(1), F.col("w"), 0), (n >= 12, F.slice("w", F.lit(1), F.greatest(middle, F.lit(1))), 0), (n >= 12, F.slice("w", F.greatest(middle, F.lit(1)), n), 0)]
    made += [(n >= 6, thinned(k), k % 2) for k in range(7)]
    made += [(F.lit(1), F.concat(F.array(*map(F.lit, before)).cast("array<string>"), F.col("w"), F.array(*map(F.lit, after)).cast("array<string>")), k % 2)
             for k, (before, after) in enumerate(((["note"], []), ([], ["see", "below"]), (["the", "following", "applies"], []), ([], ["thank", "you"])))]
    each = F.explode(F.array(*[F.struct(test.cast("int").alias("on"), w.alias("w"), F.lit(part).alias("part")) for test, w, part in made]))
    return base.select("label", each.alias("x")).filter("x.on = 1").select("label", "x.w", "x.part")


def thinned(k: int) -> Column:
    """Without each seventh word, from the ``k``-th on."""
    return F.filter("w", lambda x, i: (i % 7) != k)


def wording(w: str) -> Column:
    """Whether the words are, to four in five, those of a template: no example of ordinary text, even without a cue."""
    lists = F.array(*[F.array(*map(F.lit, dict.fromkeys(re.findall(WORDS, t.lower())))) for label, t in TEMPLATES if label != NONE])
    return F.exists(lists, lambda own: F.size(F.array_intersect(w, own)) >= F.greatest(F.lit(8.0), 0.8 * F.size(F.array_distinct(w))))


def train(docs: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """The model, its labels by index, and the calibrated threshold, from documents (row, text).

    The threshold is the level that 99 of 100 rightly told calibration variants
    pass, but 0.5 at least: below it a paragraph with licence words is "unknown".
    """
    spark = docs.sparkSession
    n = docs.count()
    share = min(1 << 20, -(-SAMPLE_DOCS * (1 << 20) // max(1, n)))
    ordinary = (
        docs.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < share)
        .select(F.explode(F.split("text", "\n", -1)).alias("p")).filter(~F.col("p").rlike(CUE))
        .select(F.lit(NONE).alias("label"), words(F.col("p")).alias("w"), F.lit(0).alias("part")).filter((F.size("w") > 2) & ~wording("w")))
    labels = sorted({label for label, _ in TEMPLATES})
    number = reduce(lambda other, i: F.when(F.col("label") == labels[i], float(i)).otherwise(other), range(len(labels)), F.lit(None).cast("double"))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    rows = variants(spark).unionByName(ordinary).withColumn("grams", grams("w")).withColumn("y", number)
    ready = hashed.transform(rows)
    model = LogisticRegression(
        featuresCol="features", labelCol="y", maxIter=30, regParam=0.002, elasticNetParam=0.1, family="multinomial").fit(ready.filter("part = 0"))
    judged = model.transform(ready.filter("part = 1")).filter("prediction = y").select(F.array_max(vector_to_array("probability")).alias("p"))
    level = judged.agg(F.percentile_approx("p", 0.01, 10_000).alias("p")).first()["p"]
    return model, labels, max(0.5, min(0.9, level or 0.5))


def judge(units: DataFrame, model: LogisticRegressionModel, labels: list[str], level: float) -> DataFrame:
    """``units`` with (text) plus ``license`` and ``p``: a family, "unknown" or "none" for each paragraph."""
    spark = units.sparkSession
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    ready = hashed.transform(units.withColumn("w", words(F.col("text"))).withColumn("grams", grams("w")))
    probs = vector_to_array("probability")
    told = model.transform(ready).withColumn("p", F.array_max(probs)).withColumn(
        "told", F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int")))
    # The templates are a fixed short list, a row for each family.
    families = spark.createDataFrame([t for t in TEMPLATES if t[0] not in (NONE, UNKNOWN)], "told string, t string").select(
        "told", F.array_distinct(words(F.col("t"))).alias("t")).groupBy("told").agg(F.collect_list("t").alias("wordings"))
    mine = F.size(F.array_distinct("w"))

    def fits(own: Column) -> Column:
        both = F.size(F.array_intersect("w", own))
        return (both >= CONFIRM * F.size(own)) | ((both >= 0.8 * mine) & (both >= 8))

    told = told.join(F.broadcast(families), "told", "left")
    confirmed = F.coalesce(F.exists("wordings", fits), F.lit(False))
    sure = F.col("p") >= level
    return told.withColumn(
        "license", F.when((F.col("told") == NONE) | ~(sure | F.col("text").rlike(CUE)), NONE).when(sure & confirmed, F.col("told")).otherwise(UNKNOWN))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, licenses, n_licensed, n_unknown, confidence``.

    ``licenses`` lists the families found, sorted and comma-joined; ``n_licensed`` and
    ``n_unknown`` count paragraphs with a confirmed family and with other licence
    terms; ``confidence`` is the least probability among the confirmed (null without).
    Paragraphs end at a line feed; each is judged as a whole and sentence by sentence,
    and has the families and other terms that any of these judgements finds.

    A null or empty text has no paragraph. Repeated rows get equal results; a null id
    passes through; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    model, labels, level = train(rows.select("row", "text"))
    # Texts are judged where they are read; only what holds licence terms moves on.
    units = rows.select("row", F.explode(paragraphs(F.col("text"))).alias("x")).select(
        "row", "x.nth", F.explode(sentences(F.col("x.text"))).alias("text")).filter(F.lower("text").rlike(WORDS))
    told = durable(judge(units, model, labels, level).filter(F.col("license") != NONE).select("row", "nth", "license", "p"))
    good = F.col("license") != UNKNOWN
    per_paragraph = told.groupBy("row", "nth").agg(
        F.collect_set(F.when(good, F.col("license"))).alias("found"), F.max(F.when(good, F.col("p"))).alias("p"))
    known = F.size("found") > 0
    per_row = per_paragraph.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.count(F.when(known, 1)).alias("n_licensed"),
        F.count(F.when(~known, 1)).alias("n_unknown"), F.min("p").alias("confidence"))
    return rows.select("doc_id", "row").join(per_row, "row", "left").select(
        "doc_id", F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"), F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), "confidence")
