"""Licence scans: a paragraph classifier over word n-grams, a calibrated unknown class, and template comparison.

Paragraphs are the lines of a text; longer ones are read in overlapping pieces of ``PIECE_WORDS`` words, so a notice
inside a long line isn't diluted. Features are the word unigrams and bigrams of the fixed notices and near misses
(sparse, binary). A multinomial logistic regression with classes for eight licence families and ``unknown`` is trained
on windows of known notices against every distinct corpus paragraph that shares no word triple with any notice; one in
five of these, by hash, is held out of the fit. A family counts only above its threshold: the ``QUANTILE`` of its
probability among all held-out unknown paragraphs (never below one half). Each prediction is then compared with its
family's notices by shared word pairs; enough overlap confirms it.

Training and scoring run on Spark's DataFrame API in the JVM; the main path has no Python function. Training shuffles
each paragraph's hash and known terms and keeps one row per different set of terms; scoring shuffles nothing of the
corpus up to the last aggregation of the few recognised paragraphs.

Edge cases: null, empty and wordless texts have no paragraphs and no licence; ties go to the family that sorts first;
rows are told apart by (doc_id, hash of the text), so repeated rows get equal results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.store import keep

UNKNOWN = "unknown"
#: Wording of common licence notices, by family.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the terms of the Apache 2.0 license.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under the BSD 3-Clause License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "creative_commons": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons license.",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written "
        "permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Reproduction without written permission is prohibited.",
    ],
}
#: Sentences near to notices that name no licence.
NEAR_MISSES = [
    "You must carry a valid driving license and the papers of the vehicle.",
    "The license plate of the car was seen near the public library.",
    "All rights and duties of the members are set out below.",
    "The apache helicopter was released to the public under the general.",
    "She was granted permission to copy the work for her own source.",
    "The version of the story that was distributed is not the common one.",
    "The general public is invited; creative work is reserved for later.",
]
PIECE_WORDS, PIECE_STEP = 48, 24
#: Weight in training of all corpus paragraphs together; fewer of them weigh one each.
CORPUS_WEIGHT = 8000.0
QUANTILE, LEAST, OVERLAP = 0.999, 0.5, 0.6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def pairs(tokens: str) -> str:
    return f"zip_with(slice({tokens}, 1, greatest(size({tokens}) - 1, 0)), slice({tokens}, 2, greatest(size({tokens}) - 1, 0)), (a, b) -> concat(a, ' ', b))"


def runs(texts: Iterable[str], n: int) -> list[str]:
    """The distinct runs of ``n`` words of fixed ASCII texts, sorted."""
    split = [re.findall("[a-z0-9]+", text.lower()) for text in texts]
    return sorted({" ".join(w[i : i + n]) for w in split for i in range(len(w) - n + 1)})


#: The features: words, and pairs of words, of the notices and near misses. No other term can speak for a family.
WORDS, PAIRS = (runs([*chain(*NOTICES.values()), *NEAR_MISSES], n) for n in (1, 2))
TRIPLES = runs(chain(*NOTICES.values()), 3)


def known_words(tokens: str) -> Column:
    """The words at their places, null where no notice or near miss has the word."""
    return F.transform(tokens, lambda w: F.when(w.isin(WORDS), w))


def known_pairs(known: str) -> Column:
    """The word pairs at their places, null where no notice or near miss has the pair."""
    return F.transform(F.expr(pairs(known)), lambda p: F.when(p.isin(PAIRS), p))


def terms(known: Column, coupled: Column) -> Column:
    return F.array_compact(F.concat(known, coupled))


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, tokens, terms): paragraphs with words, long ones in overlapping pieces, and their known terms."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    tokens = lines.select("doc_id", "mark", words(F.col("line")).alias("w"))
    known = tokens.withColumn("k", known_words("w")).withColumn("c", known_pairs("k"))
    # No piece of a wordless line: a filter would be pushed below and split each line again.
    starts = F.expr(f"if(size(w) > 0, sequence(0, greatest(0, size(w) - {PIECE_WORDS - PIECE_STEP + 1}) div {PIECE_STEP}), array())")

    def piece(i: Column) -> Column:
        own = terms(F.slice("k", i * PIECE_STEP + 1, PIECE_WORDS), F.slice("c", i * PIECE_STEP + 1, PIECE_WORDS - 1))
        return F.struct(F.slice("w", i * PIECE_STEP + 1, PIECE_WORDS).alias("tokens"), own.alias("terms"))

    return known.select("doc_id", "mark", F.explode(F.transform(starts, piece)).alias("piece")).select("doc_id", "mark", "piece.tokens", "piece.terms")


def features(rows: DataFrame) -> DataFrame:
    return CountVectorizerModel.from_vocabulary([*WORDS, *PAIRS], inputCol="terms", outputCol="features", binary=True).transform(rows)


def notices(spark: SparkSession) -> DataFrame:
    """(family, tokens) of the known notices."""
    rows = [(family, text) for family, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", words(F.col("text")).alias("tokens"))


def quotes_notice() -> Column:
    """Whether ``tokens`` share a word triple with a notice; only a piece with two known pairs can."""
    triples = F.expr("transform(sequence(1, greatest(1, size(tokens) - 2)), i -> array_join(slice(tokens, i, 3), ' '))")
    return (F.size(F.filter("terms", lambda t: t.contains(" "))) >= 2) & F.exists(triples, lambda t: t.isin(TRIPLES))


def training_rows(docs: DataFrame) -> DataFrame:
    """(family, terms, held, n): windows of notices, near misses, and every distinct corpus piece that quotes no notice.

    Pieces with the same known terms are one row of n pieces, which is the same to the fit and to quantiles.
    """
    spark = docs.sparkSession
    windows = F.expr("transform(array(6, 9, 14, 24, 60), n -> transform(sequence(0, greatest(0, size(tokens) - n) div 3), i -> slice(tokens, i * 3 + 1, n)))")
    positive = notices(spark).select("family", F.explode(F.flatten(windows)).alias("tokens")).where("size(tokens) >= 3").distinct()
    misses = spark.createDataFrame([(t,) for t in NEAR_MISSES], "text string").select(F.lit(UNKNOWN).alias("family"), words(F.col("text")).alias("tokens"))
    fixed = positive.unionByName(misses).withColumn("k", known_words("tokens")).withColumn("terms", terms(F.col("k"), known_pairs("k")))
    corpus = pieces(docs).where(~quotes_notice()).select(F.lit(UNKNOWN).alias("family"), F.xxhash64("tokens").alias("id"), "terms")
    rows = fixed.select("family", F.xxhash64("tokens").alias("id"), "terms").unionByName(corpus)
    rows = rows.withColumn("terms", F.array_sort(F.array_distinct("terms"))).distinct()
    held = (F.col("family") == UNKNOWN) & (F.pmod("id", F.lit(5)) == 0)
    return rows.withColumn("held", held).groupBy("family", "terms", "held").agg(F.count("*").alias("n"))


class LicenceModel:
    """A fitted classifier and the calibrated threshold of each family."""

    def __init__(self, fitted: LogisticRegressionModel, families: list[str], thresholds: list[float]):
        self.fitted, self.families, self.thresholds = fitted, families, thresholds

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose likeliest class is a family, with family (``unknown`` below its threshold) and probability."""
        unknown = float(self.families.index(UNKNOWN))
        # The class alone is asked of every row, once; probabilities only of the few rows that stay.
        first = self.fitted.copy({self.fitted.probabilityCol: "", self.fitted.rawPredictionCol: ""})
        likely = first.transform(features(rows)).where(F.col("prediction") != unknown).drop("prediction")
        scored = self.fitted.transform(likely).withColumn("_p", vector_to_array("probability"))
        best = F.array_position("_p", F.array_max("_p")).cast("int")
        limit = F.element_at(F.array(*[F.lit(float(t)) for t in self.thresholds]), best)
        family = F.element_at(F.array(*[F.lit(f) for f in self.families]), best)
        out = scored.withColumn("probability", F.array_max("_p")).withColumn("family", F.when(F.col("probability") >= limit, family).otherwise(F.lit(UNKNOWN)))
        return out.drop("_p", "features", "rawPrediction", "prediction")


def fit(docs: DataFrame) -> LicenceModel:
    families = sorted([*NOTICES, UNKNOWN])
    rows = keep(training_rows(docs), "licence-training")
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    corpus = rows.where((F.col("family") == UNKNOWN) & ~F.col("held")).agg(F.sum("n")).first()[0]
    weight = F.when(F.col("family") == UNKNOWN, F.lit(min(1.0, CORPUS_WEIGHT / corpus))).otherwise(3.0) * F.col("n")
    ready = features(rows.withColumn("label", label).withColumn("weight", weight))
    fitted = LogisticRegression(maxIter=40, regParam=2e-4, weightCol="weight", family="multinomial", aggregationDepth=2).fit(ready.where("NOT held"))
    held = fitted.transform(ready.where("held")).select(vector_to_array("probability").alias("p"), "n")
    # Six digits from LEAST up: the quantile holds at most half a million values a family, over any number of pieces.
    values = [F.greatest(F.round(F.get("p", F.lit(k)), 6), F.lit(LEAST)) for k in range(len(families))]
    limits = held.agg(*[F.coalesce(F.percentile(value, F.lit(QUANTILE), F.col("n")), F.lit(LEAST)) for value in values]).first()
    return LicenceModel(fitted, families, [LEAST if f == UNKNOWN else float(x) for f, x in zip(families, limits, strict=True)])


def recognised(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, mark, family, probability, overlap, confirmed) of every paragraph piece with a licence family."""
    found = model.predict(pieces(docs)).where(F.col("family") != UNKNOWN)
    known = notices(docs.sparkSession).select(F.col("family").alias("f"), F.expr(f"array_distinct({pairs('tokens')})").alias("notice"))
    shared = F.expr(f"size(array_intersect({pairs('tokens')}, notice)) / greatest(1, least(size(array_distinct({pairs('tokens')})), size(notice)))")
    own = F.xxhash64("tokens").alias("piece")
    # The notices are a fixed table of a few dozen rows.
    compared = found.join(F.broadcast(known), F.col("family") == F.col("f")).select("doc_id", "mark", own, "family", "probability", shared.alias("overlap"))
    best = compared.groupBy("doc_id", "mark", "piece", "family", "probability").agg(F.max("overlap").alias("overlap"))
    return best.withColumn("confirmed", F.col("overlap") >= OVERLAP)


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, mark, families, confirmed, n_pieces, probability) per row; the arrays of families are sorted."""
    found = (
        recognised(docs, model).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(
            F.array_sort(F.collect_set("family")).alias("families"),
            F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("confirmed"),
            F.count("*").alias("n_pieces"), F.max("probability").alias("probability"),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark")).join(found, same, "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "mark", F.coalesce("families", none).alias("families"), F.coalesce("confirmed", none).alias("confirmed"),
        F.coalesce("n_pieces", F.lit(0)).cast("long").alias("n_pieces"), "probability",
    )
