"""Licence scans by a trained paragraph classifier, in DataFrame functions and Spark's own learning library alone.

A paragraph is a line of a text. Its features are those word n-grams (one to three words), hashed, that occur in the fixed
texts below; a multinomial logistic regression tells licence families from one another and from other text. It learns from
the templates (whole, and every run of their sentences) and, as the class *unknown*, from every paragraph of the corpus
that holds no such text, whatever its length, and from sentences that speak of licences without granting one. Paragraphs
with the same n-grams are one weighted row, so training works on what is different among them. The bound for calling a
paragraph known is set on the fifth of all corpus paragraphs that is left out of training: all but a small share of them
stay below it.

A prediction is confirmed by comparison with the family's templates and the runs of their sentences: at least
``least_shared`` of the paragraph's or the template's word pairs must be shared. Paragraphs that share less with the
templates of every family are left out before they are classified: whatever the model said of them, the same comparison
would reject it, so results are those of classifying all.

All paragraphs of whole texts are scanned. A null or empty text has no licence. Rows that repeat are reported each.
"""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumql.llm.common import tagged
from quorumql.session import freeze

UNKNOWN = "unknown"
BUCKETS = 1 << 14
#: A corpus paragraph's weight in training, and as how many such paragraphs all of them weigh together at most; share of
#: left-out unknowns above the bound for known.
WEIGHT, MASS, FALSE_SHARE = 0.25, 4000, 0.001
LEAST_SHARED = 0.6

# Names and opening phrases of public licences, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License v3.0.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License v2.0.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal, a public domain dedication license.",
        "This work is dedicated to the public domain under the CC0 license.",
    ),
    "Proprietary": (
        "Copyright. All rights reserved. No license is granted.",
        "This document is confidential and proprietary; no licence to copy it is granted.",
    ),
}
#: Paragraphs of licence texts that name no licence.
PARTS = {
    "MIT": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
}
SPEAKS_OF = (
    "The driving licence was renewed at the office last week.", "A fishing license costs ten dollars a year.", "The committee discussed the license fee of public television.",
    "They took poetic license with the story.", "The pub lost its licence to serve alcohol.", "He was a licensed electrician in the county.", "Her license plate was stolen.",
    "The licence of the station expires in June.", "License to drive is granted after the test.", "The court revoked the license of the doctor.", "You need a licence for this dog.",
    "A software license can be bought in the shop.", "The license agreement was signed by both parties.", "Ask the author for a license.", "What does a license cost?",
    "See the LICENSE file for details.",
)
#: Every template (not every sentence or part of one) holds one of these.
ANCHORS = "licens|licenc|permission is hereby granted"


def paragraphs(text: Column) -> Column:
    return F.split(text, "\\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def runs(found: Column, n: int) -> Column:
    """Runs of ``n`` words of a list of words."""
    starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))


def known_grams(text: Column, known: tuple[list[str], ...]) -> Column:
    """The different n-grams of ``text`` among ``known`` (one list for each n), sorted."""
    ones, twos, threes = known

    def rest(found: Column, first: int) -> Column:
        return F.slice(found, F.lit(first), F.greatest(F.size(found), F.lit(0)))

    def joined(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))  # null where either is

    def all_of(seen: Column, two: Column) -> Column:
        parts = F.filter(seen, lambda w: w.isNotNull()), F.filter(two, lambda p: p.isin(*twos)), F.filter(joined(two, rest(seen, 3)), lambda t: t.isin(*threes))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    # Lists of one give names to values, which would be worked out anew for each use otherwise.
    seen = F.transform(words(text), lambda w: F.when(w.isin(*ones), w))
    return F.transform(F.array(seen), lambda s: F.transform(F.array(joined(s, rest(s, 2))), lambda two: all_of(s, two))[0])[0]


def pairs(found: Column) -> Column:
    """The different pairs of neighbours in a list of words."""
    rest = F.greatest(F.size(found) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(found, 1, rest), F.slice(found, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b)))


def template_texts() -> list[tuple[str, str]]:
    """Family and text of every template and every run of its sentences but those that speak of licences alone."""
    found = {}
    for table in (TEMPLATES, PARTS):
        for family, texts in table.items():
            for text in texts:
                cut = re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)
                spans = [" ".join(cut[i:j]) for i in range(len(cut)) for j in range(i + 1, len(cut) + 1)]
                found.update({(family, span): None for span in spans if span not in SPEAKS_OF and " " in span})
    return list(found)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_texts(), "family string, paragraph string")


def template_pairs(spark: SparkSession) -> list[tuple[str, ...]]:
    """The word pairs of each text of the template table, a fixed list."""
    return sorted({tuple(sorted(r[0])) for r in template_table(spark).select(pairs(words(F.col("paragraph")))).collect()})


def shares(own: Column, shapes: list[tuple[str, ...]], least_shared: float, whole: bool = False) -> Column:
    """Whether the word pairs ``own`` share ``least_shared`` of them or of one shape's word pairs (``whole``: of the shape's)."""
    known, least = sorted({p for s in shapes for p in s}), min(map(len, shapes))

    def among(found: Column, some: tuple[str, ...] | list[str]) -> Column:
        return F.filter(found, lambda p: p.isin(*some))

    def reaches(hit: Column, size: int) -> Column:
        return F.size(hit) / F.greatest(F.lit(size) if whole else F.least(F.size(own), F.lit(size)), F.lit(1)) >= least_shared

    def met(hit: Column) -> Column:
        done = F.lit(False)
        for s in shapes:
            done = done | reaches(among(hit, s), len(s))
        return reaches(hit, least) & done

    # ``exists`` over lists of one gives names to values, which would be worked out anew for each use otherwise.
    return F.exists(F.array(among(own, known)), met)


def shares_pairs(text: Column, shapes: list[tuple[str, ...]], least_shared: float, whole: bool = False) -> Column:
    """Whether ``text`` shares ``least_shared`` of its own or one shape's word pairs (``whole``: of the shape's)."""
    return F.exists(F.array(words(text)), lambda found: F.exists(F.array(pairs(found)), lambda own: shares(own, shapes, least_shared, whole)))


class LicenceModel:
    """Families by class number, the n-grams it knows, the hashing and regression stages, and the bound for calling a paragraph known."""

    def __init__(self, families: list[str], known: tuple[list[str], ...], stages: PipelineModel, bound: float) -> None:
        self.families, self.known, self.stages, self.bound = families, known, stages, bound

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with n-grams) with family and probability of the likeliest class."""
        done = self.stages.transform(rows).withColumn("p", vector_to_array("probability"))
        names = F.array(*[F.lit(f) for f in self.families])
        return done.withColumn("confidence", F.array_max("p")).withColumn(
            "family", F.element_at(names, (F.array_position("p", F.col("confidence"))).cast("int"))).drop("p", "probability", "rawPrediction", "prediction", "features")


def fixed_rows(spark: SparkSession) -> DataFrame:
    """Family, paragraph and weight of the templates, in several contexts each, and of the sentences that only speak of licences."""
    # Several contexts of each template: alone, after and before a plain phrase.
    around = F.array(F.lit("%s"), F.lit("notice %s"), F.lit("%s see details"), F.lit("the text below %s"), F.lit("%s all files"), F.lit("code %s and data"))
    known = template_table(spark).select("family", F.explode(around).alias("shape"), "paragraph").select(
        "family", F.expr("replace(shape, '%s', paragraph)").alias("paragraph"), F.lit(1.0).alias("weight"))
    return known.union(spark.createDataFrame([(UNKNOWN, s, 4.0) for s in SPEAKS_OF], known.schema))


def fixed_grams(spark: SparkSession) -> tuple[list[str], ...]:
    """The n-grams of the fixed rows, a fixed list for each n."""
    found = fixed_rows(spark).select(*(runs(words(F.col("paragraph")), n) for n in (1, 2, 3))).collect()
    return tuple(sorted({gram for row in found for gram in row[n]}) for n in range(3))


def corpus_rows(docs: DataFrame, text: str, known: tuple[list[str], ...]) -> DataFrame:
    """(grams, left_out, count) of all paragraphs of the corpus that hold no template, a row for each different pair of the first two."""
    paragraph = F.col("paragraph")
    every = docs.select(F.explode(paragraphs(F.col(text))).alias("paragraph")).select(
        known_grams(paragraph, known).alias("grams"), (F.xxhash64(paragraph) % 5 == 0).alias("left_out"))
    # Whether a template is held shows in the pairs among the n-grams.
    return freeze(every.groupBy("grams", "left_out").count().filter(~shares(F.col("grams"), template_pairs(docs.sparkSession), LEAST_SHARED, whole=True)), "licence-corpus")


def train_licence_model(docs: DataFrame, text: str = "text") -> LicenceModel:
    """Fit on the templates, the sentences that only speak of licences, and all other paragraphs of the corpus."""
    spark = docs.sparkSession
    known = fixed_grams(spark)
    plain = corpus_rows(docs, text, known)
    total = plain.agg(F.sum("count")).first()[0] or 0
    one = WEIGHT * min(1.0, MASS / max(1, total))
    fixed = fixed_rows(spark).select("family", known_grams(F.col("paragraph"), known).alias("grams"), F.lit(False).alias("left_out"), F.lit(1).cast("long").alias("count"), "weight")
    corpus = plain.select(F.lit(UNKNOWN).alias("family"), "grams", "left_out", "count", (F.col("count") * F.lit(one)).alias("weight"))
    families = [UNKNOWN, *TEMPLATES]
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = fixed.union(corpus).withColumn("label", number.cast("double"))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    regression = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, weightCol="weight", standardization=False)
    fitted = regression.fit(hashing.transform(rows.filter(~F.col("left_out"))))
    model = LicenceModel(families, known, PipelineModel(stages=[hashing, fitted]), 0.5)
    chance = F.when(F.col("family") == UNKNOWN, 0.0).otherwise(F.col("confidence"))
    reached = model.scored(rows.filter("left_out")).select(chance.alias("c"), "count").agg(F.percentile("c", F.lit(1 - FALSE_SHARE), F.col("count"))).first()[0]
    model.bound = max(0.5, min(0.95, float(reached or 0.0)))
    return model


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", least_shared: float = LEAST_SHARED) -> DataFrame:
    """Row number, key, place and text of the paragraphs that can be confirmed, and one row without a place for each document.

    Written once by one reading, so the row numbers of documents and paragraphs agree.
    """
    numbered, row = tagged(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    # The first entry stands for the document itself.
    entries = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(paragraphs(F.col("text")), F.array().cast("array<string>")))
    every = numbered.select(F.col(row).alias("row"), "key", F.posexplode(entries).alias("place", "paragraph"))
    every = every.withColumn("place", F.nullif(F.col("place"), F.lit(0)) - 1)
    return freeze(every.filter(F.col("place").isNull() | shares_pairs(F.col("paragraph"), template_pairs(docs.sparkSession), least_shared)), "licence-candidates")


def scan(docs: DataFrame, model: LicenceModel, text: str = "text", key: str = "doc_id", least_shared: float = LEAST_SHARED) -> DataFrame:
    """Confirmed licence paragraphs: row number and key of the document, place of the paragraph, family and confidence."""
    return confirmed(candidates(docs, text, key, least_shared), model, least_shared)


def confirmed(found: DataFrame, model: LicenceModel, least_shared: float = LEAST_SHARED) -> DataFrame:
    """The paragraphs among ``candidates`` that the model calls known and its family's templates confirm."""
    met = found.filter(F.col("place").isNotNull())
    # Written once: a condition on the scores would otherwise be moved below them and work them out once for each use.
    featured = met.withColumn("words", words(F.col("paragraph"))).withColumn("grams", known_grams(F.col("paragraph"), model.known))
    scores = freeze(model.scored(featured).drop("paragraph", "grams"), "licence-scores")
    scored = scores.filter((F.col("family") != UNKNOWN) & (F.col("confidence") >= model.bound))
    shapes = template_table(found.sparkSession).select("family", pairs(words(F.col("paragraph"))).alias("shape"))
    shapes = shapes.groupBy("family").agg(F.collect_list("shape").alias("shapes"))  # a fixed list of a few templates
    found = scored.withColumn("own", pairs(F.col("words"))).join(F.broadcast(shapes), "family")
    share = F.array_max(F.transform("shapes", lambda s: F.size(F.array_intersect("own", s)) / F.least(F.size("own"), F.size(s))))
    return found.withColumn("shared", share).filter(F.col("shared") >= least_shared).select("row", "key", "place", "family", "confidence", "shared")


def scan_documents(docs: DataFrame, model: LicenceModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key, families found (in order of name, joined by commas; null if none), paragraphs found."""
    every = candidates(docs, text, key)
    found = confirmed(every, model).groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n_paragraphs"), F.min("confidence").alias("confidence"))
    return every.filter(F.col("place").isNull()).select("row", "key").join(found, "row", "left").select(
        "key", "families", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), "confidence")
