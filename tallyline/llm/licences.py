"""Licence scan by a trained paragraph classifier, in DataFrame functions and Spark's own logistic regression.

Paragraphs are lines, sentences of lines, and runs of up to WINDOW lines without an empty one between
them, as notices are wrapped; a long line gives EDGE of its characters to a run. A sparse logistic regression over word n-grams tells licence families and an
unknown class apart; it learns from the templates, from parts of them, from fixed sentences that only
sound alike, and from at most MAX_OTHERS first lines of the corpus, chosen by a hash. A family is predicted where its
probability is the highest and above a limit calibrated on examples that were not fitted. In a
paragraph whose families together reach the limit, each is confirmed of which it holds at least
CONFIRMED of the n-grams of a template, and OWN of those that no other family's templates have. A
family counts once for each place: its shortest paragraphs that do not overlap. Predicted lines
that no confirmed paragraph covers are counted as unknown; those below the limit are no licences.

Only paragraphs with one of the model's telling words are scored. They are chosen from the weights so
that the n-grams without any of them can't raise a family, nor all families together, to the limit, all
taken together. Null and empty texts have no paragraphs. Rows that repeat a doc_id get a row each.
"""

import math
import re
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from tallyline.llm.common import filled
from tallyline.session import written

WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
N_GRAMS = 3
CONFIRMED, OWN = 0.6, 0.5
WINDOW, EDGE = 6, 300
SENTENCE = r"(?<=[.!?;])\s+"
MAX_OTHERS = 400
MAX_FEATURES = 20_000
UNKNOWN = "unknown"
SPEAKING = "licen[cs]e|copyright|public domain|redistribut"

#: Words that say nothing by themselves; n-grams of them alone are no features.
COMMON = (
    "a all an and any are as at be by file following for from he his in is it its may more no not of on or our see "
    "she that the their them there these they this to under was we were will with without you your"
).split()

#: Names of licence families and sentences of their public notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Distributed under the BSD 3-Clause License."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC BY", "Licensed under CC BY 4.0."),
    ("CC BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has dedicated all rights to this work to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
ALIKE = [
    "He is a licensed driver and keeps his license in the car.", "The bar lost its license in the spring.",
    "A fishing license is required for the lake.", "The film was released under another title.",
    "The public was asked for permission.", "The new version of the software was released in May.",
    "All rights reserved.", "Copyright of the publisher.", "She has a general interest in public works.",
    "This program was shown on television, free of charge.", "The terms of the contract were subject to change.",
    "The work is done under difficult conditions.", "You may obtain a copy at the library.",
    "The foundation was published as a source of water.", "The redistribution of wealth is a binary matter for some.",
    "The Apache are a people of the Southwest.", "A student of MIT wrote this.", "The GNU is an antelope.",
    "They distributed the notes under the door.", "Attribution of the painting is unknown.", "Our license has expired.",
    "The commons lie outside the village.", "This is a use of force without restriction.", "Version 2.0 of the plan, version 3 and so on.",
]


def _grams(text):
    """All different runs of one to N_GRAMS words of a text that are not of common words alone."""
    said = "(?:" + "|".join(COMMON) + ")"

    def runs_of(words, n):
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        runs = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

    def runs(words):
        out = [words, *[runs_of(words, n) for n in range(2, N_GRAMS + 1)]]
        return F.filter(F.array_distinct(F.concat(*out)), lambda g: ~F.rlike(g, F.lit(f"^{said}(?: {said})*$")))

    # bound to a name, so that a text is cut into words once
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)
    return F.element_at(F.transform(F.array(words), runs), 1)


def _examples(spark, lines):
    """(text, family) of templates, of their parts, and of what is no licence."""
    rows = [(text, family) for family, text in TEMPLATES] + [(text, UNKNOWN) for text in ALIKE]
    for family, text in TEMPLATES:
        words = text.split()
        rows += [(" ".join(words[cut:]), family) for cut in (1, 2) if len(words) > cut + 3]
        rows += [("Notice: " + text + " See the file for more.", family), (text.upper(), family)]
    known = spark.createDataFrame(rows, "text string, family string")
    others = lines.where("text <> ''").orderBy(F.xxhash64("text"), "text").limit(MAX_OTHERS)
    return known.unionByName(others.select("text", F.lit(UNKNOWN).alias("family")))


def fit(spark, lines):
    """(families, intercepts, {n-gram: weights by family}, limit, telling words), learned from templates and other lines."""
    rows = written(_examples(spark, lines).select("family", _grams(F.col("text")).alias("grams"), F.xxhash64("text").alias("mark")), "licence-examples")
    families = sorted({family for family, _ in TEMPLATES}) + [UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = rows.withColumns({"label": label.cast("double"), "weight": F.when(F.col("family") == UNKNOWN, 0.3).otherwise(1.0)})
    held = F.pmod(F.xxhash64("mark"), F.lit(5)) == 0
    count = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=MAX_FEATURES)
    model = LogisticRegression(weightCol="weight", family="multinomial", regParam=0.003, elasticNetParam=0.5, maxIter=60, standardization=False)
    fitted = Pipeline(stages=[count, model]).fit(rows.where(~held).coalesce(1))  # a few hundred rows
    counted, regression = fitted.stages
    matrix = regression.coefficientMatrix.toArray()  # families by n-grams, the unknown class last
    weights = {gram: matrix[:, j].tolist() for j, gram in enumerate(counted.vocabulary) if matrix[:, j].any()}
    intercepts = regression.interceptVector.toArray().tolist()
    scored = _probabilities(spark, rows.where(held).select(F.col("mark").alias("key"), "family", "grams"), families, intercepts, weights)
    ends = scored.agg(
        F.max(F.when(F.col("family") == UNKNOWN, F.col("chance"))).alias("low"),
        F.percentile(F.when(F.col("family") == F.col("best"), F.col("chance")), 0.05).alias("high"),
    ).first()
    limit = min(0.9, max(0.3, ((ends["low"] or 0.0) + (ends["high"] or 1.0)) / 2))
    seen = {r["word"]: r["n"] for r in rows.where(F.col("family") == UNKNOWN).select(F.explode("grams").alias("word")).where(
        ~F.col("word").contains(" ")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return families, intercepts, weights, limit, telling_words(families, intercepts, weights, limit, seen)


def telling_words(families, intercepts, weights, limit, seen):
    """Words without which no paragraph's families reach the limit together; words that `seen` counts often are left out first.

    A family's odds against the unknown class are at most those of all n-grams that speak for it, so the
    families' greatest odds are added and held against the limit's.
    """
    gains = {
        gram: [max(0.0, w - by[-1]) for w in by[:-1]] for gram, by in weights.items() if max(by[:-1]) > by[-1]
    }
    needed = math.log(limit / (1 - limit))
    words = sorted({w for gram in gains for w in gram.split()}, key=lambda w: (w not in COMMON, -seen.get(w, 0), len(w), w))
    kept = set(words)
    for word in words:
        fewer = kept - {word}
        without = [by for gram, by in gains.items() if fewer.isdisjoint(gram.split())]
        reach = [sum(by[i] for by in without) + intercepts[i] - intercepts[-1] for i in range(len(families) - 1)]
        most = max(reach)
        if most + math.log(sum(math.exp(r - most) for r in reach)) < needed:
            kept = fewer
    return sorted(kept)


def _probabilities(spark, rows, families, intercepts, weights):
    """Rows (key, family, grams) with the likeliest family but unknown, as best, and its chance."""
    model = spark.createDataFrame([(g, w) for g, w in weights.items()], "gram string, weights array<double>")
    found = rows.select("key", F.explode("grams").alias("gram")).join(F.broadcast(model), "gram")
    sums = found.groupBy("key").agg(*[F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(families))])
    joined = rows.join(sums, "key", "left")
    scores = [F.exp(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + intercepts[i]) for i in range(len(families))]
    total = reduce(lambda a, b: a + b, scores)
    ranked = F.array_max(F.array(*[F.struct((s / total).alias("chance"), F.lit(f).alias("best")) for f, s in zip(families, scores) if f != UNKNOWN]))
    some = reduce(lambda a, b: a + b, [s for f, s in zip(families, scores) if f != UNKNOWN]) / total
    return joined.select("key", "family", "grams", ranked.alias("top"), some.alias("some")).select("key", "family", "grams", "top.best", "top.chance", "some")


def _contexts(text, anchor):
    """Of each line with a telling word: its place, and the lines around it, of which it is number `at`."""
    def of(lines):
        hot = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.rlike(F.lower(F.get(lines, i)), F.lit(anchor)))

        def around(i):
            first = F.greatest(i - (WINDOW - 1), F.lit(0))
            whole = F.transform(
                F.slice(lines, first + 1, i - first + WINDOW),
                lambda line, k: F.when((k + first == i) | (F.length(line) <= 2 * EDGE), line).otherwise(
                    F.concat(F.left(line, F.lit(EDGE)), F.lit("\n"), F.right(line, F.lit(EDGE)))),
            )
            return F.struct(i.alias("line"), (i - first).alias("at"), whole.alias("lines"))

        return F.transform(hot, around)

    # bound to a name, so that a text is cut into lines once
    return F.element_at(F.transform(F.array(F.split(text, "\n")), of), 1)


def _units(anchor):
    """Paragraphs of a context, each (first line, last line, text); of several contexts the first has a run of lines."""
    at, lines = F.col("c.at"), F.col("c.lines")
    speaks = lambda line: F.rlike(F.lower(line), F.lit(anchor))
    unit = lambda first, last, text: F.struct((F.col("c.line") + first).alias("first"), (F.col("c.line") + last).alias("last"), text.alias("text"))
    own = F.get(lines, at)
    sentences = F.split(own, SENTENCE)
    parts = F.transform(F.filter(sentences, speaks), lambda part: unit(0, 0, part))
    runs = [unit(0, 0, own)]
    for back in range(WINDOW):
        for on in range(WINDOW - back):
            if back + on == 0:
                continue
            held = F.slice(lines, F.greatest(at - back, F.lit(0)) + 1, back + on + 1)
            fits = (at >= back) & (F.size(lines) > at + on) & ~F.exists(held, lambda line: F.trim(line).rlike(r"^\s*$"))
            if back:
                fits &= ~F.exists(F.slice(lines, F.greatest(at - back, F.lit(0)) + 1, back), speaks)
            text = F.concat_ws(" ", F.transform(held, lambda line, k: F.when(F.length(line) <= EDGE, line).when(
                k == 0, F.right(line, F.lit(EDGE))).otherwise(F.left(line, F.lit(EDGE)))))
            runs.append(F.when(fits, unit(-back, on, text)))
    runs = F.filter(F.array(*runs), lambda u: u.isNotNull())
    return F.when(F.size(sentences) > 1, F.concat(runs, parts)).otherwise(runs)


def _shortest(spans):
    """The spans (last, first) of one family that count: of those that overlap the earliest to end."""
    start = F.array().cast("array<struct<last:int,first:int>>")
    return F.aggregate(F.array_sort(spans), start, lambda found, s: F.when(
        (F.size(found) == 0) | (s["first"] > F.element_at(found, -1)["last"]), F.concat(found, F.array(s))).otherwise(found))


def licences(docs, id_col="doc_id", text_col="text"):
    """A row for each row of `docs`: id_col, licences (families, sorted), n_confirmed, n_unknown."""
    spark = docs.sparkSession
    first_lines = docs.select(F.substring_index(filled(text_col), "\n", 1).alias("text"))
    others = first_lines.where((F.length("text") < 400) & ~F.lower("text").rlike(SPEAKING))
    families, intercepts, weights, limit, telling = fit(spark, others)
    anchor = "(?<![a-z0-9])(?:" + "|".join(map(re.escape, telling)) + ")(?![a-z0-9])"
    text = filled(text_col)
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias(id_col),
        F.when(F.rlike(F.lower(text), F.lit(anchor)), _contexts(text, anchor)).alias("contexts"),
    ), "licence-lines")
    units = rows.select("row_id", F.explode("contexts").alias("c")).select("row_id", F.posexplode(_units(anchor)).alias("pos", "u"))
    paragraphs = units.select(
        F.struct("row_id", F.col("u.first").alias("first"), F.col("u.last").alias("last"), "pos").alias("key"),
        F.lit("").alias("family"), _grams(F.col("u.text")).alias("grams"),
    )
    judged = written(_probabilities(spark, paragraphs, families, intercepts, weights).where(F.greatest("chance", "some") >= limit), "licence-lines-judged")
    grams = spark.createDataFrame(list(enumerate(TEMPLATES)), "template int, t struct<best:string,text:string>").select(
        "template", "t.best", F.explode(_grams(F.col("t.text"))).alias("gram"))
    own = grams.groupBy("gram").agg((F.count_distinct("best") == 1).cast("int").alias("own"))
    grams = grams.join(own, "gram")
    sizes = grams.groupBy("template").agg(F.count("*").alias("size"), F.sum("own").alias("own_size"))
    templates = grams.join(sizes, "template")
    held = judged.select("key", F.explode("grams").alias("gram")).join(F.broadcast(templates), "gram").groupBy("key", "template").agg(
        F.first("best").alias("found"), (F.count("*") / F.first("size")).alias("share"), (F.sum("own") / F.first("own_size")).alias("own_share")
    ).where((F.col("share") >= CONFIRMED) & (F.col("own_share") >= OWN))
    spans = held.groupBy(F.col("key.row_id").alias("row_id"), "found").agg(
        F.collect_set(F.struct(F.col("key.last").alias("last"), (F.col("key.first")).alias("first"))).alias("spans"))
    confirmed = spans.groupBy("row_id").agg(
        F.sort_array(F.collect_set("found")).alias("licences"), F.sum(F.size(_shortest("spans"))).alias("n_confirmed"),
        F.flatten(F.collect_list("spans")).alias("covered"))
    likely = judged.where((F.col("chance") >= limit) & (F.col("key.pos") == 0)).groupBy(F.col("key.row_id").alias("row_id")).agg(
        F.collect_set("key.first").alias("likely"))
    unknown = F.filter("likely", lambda line: ~F.exists(F.coalesce("covered", F.array().cast("array<struct<last:int,first:int>>")),
                                                        lambda s: line.between(s["first"], s["last"])))
    by_row = likely.join(confirmed, "row_id", "full").select("row_id", "licences", "n_confirmed", F.size(unknown).alias("n_unknown"))
    return rows.join(by_row, "row_id", "left").select(
        id_col, F.concat_ws(",", "licences").alias("licences"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.greatest(F.coalesce("n_unknown", F.lit(0)), F.lit(0)).cast("long").alias("n_unknown"),
    )
