"""Licence statements by a trained paragraph classifier, in DataFrame and ML functions only.

Two logistic regressions over sparse word uni- and bigrams share the work. The first, of two classes, scores every line
of every text as a sum of weights; a paragraph is a run of lines that it does not take for other prose, so a wrapped
notice is found inside prose too. The second names the family of each such line and paragraph. Its probabilities are
tempered on templates it was not fitted on, whose lowest tenth sets the bound below which a statement is ``unknown``. A
prediction stands only if the unit shares enough bigrams with a template of that family.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.llm.shared import stage

FEATURES, LINE_FEATURES = 1 << 13, 1 << 14
#: Variants made of each template; lines of the corpus fitted as other prose, and texts they are from, at most about;
#: words in a part of a template or line that the first model is fitted on; least share of a template's bigrams.
VARIANTS, OTHER_LINES, OTHER_TEXTS, PART_WORDS, LEAST_CONTAINED = 40, 4_000, 2_000, 8, 0.5
NONE, UNKNOWN = "none", "unknown"

#: Statements by which well-known licences are named or granted.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "Distributed under Apache 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl": [
        "Licensed under the GNU General Public License.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "BSD 3-Clause",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain under CC0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "This software is proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
#: A family whose statements name no version, and those that its neighbours may tell it is.
VERSIONLESS, VERSIONS = "gpl", ("gpl-2.0", "gpl-3.0")
#: Lines that speak of licences, copies or warranties without granting anything.
OTHER_PROSE = [
    "Her driving licence was renewed last spring.",
    "The plumber is licensed in three states.",
    "They lost the license plate on the motorway.",
    "Copyright law was debated in parliament for years.",
    "The warranty on the car expired in March.",
    "He asked for permission to leave the room.",
    "A search warrant was issued by the judge.",
    "The restaurant has no licence to sell spirits.",
    "The general public was invited to version 2 of the play.",
    "Redistribution of wealth was the subject of the lecture.",
    "The film fell into the public domain in 1998.",
    "The licensing office is closed on Mondays.",
]


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grams(text: Column) -> Column:
    """Lower-case words and word pairs of a text; marks part words, but a dot within a number stays."""
    words = F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}.]+|\.(?!\p{N})", " ")), " "), "")
    pairs = lambda ws: F.transform(F.slice(ws, 2, F.size(ws)), lambda w, i: F.concat_ws(" ", F.get(ws, i), w))
    return _once(words, lambda ws: F.concat(ws, pairs(ws)))


def grams(text: Column) -> Column:
    """The distinct n-grams of a text."""
    return F.array_distinct(_grams(text))


def _line_grams(line: Column) -> Column:
    """Numbers of a lower-case line's words and of each word with the next, below LINE_FEATURES; with repeats."""
    number = lambda *c: F.pmod(F.xxhash64(*c), F.lit(LINE_FEATURES)).cast("int")
    words = F.split(line, r"(?:[^\p{L}\p{N}.]|\.(?!\p{N}))+")
    pairs = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: number(a, b))
    return _once(words, lambda ws: F.concat(F.transform(ws, lambda w: number(w)), pairs(ws)))


def units(docs: DataFrame, gate: LineModel) -> DataFrame:
    """``docs`` with a row for each line that ``gate`` does not take for other prose, and one for each run of several.

    Added: block (the run's first line), paragraph (the unit's first line, both from 0), single, statement; ``text`` goes.
    """
    rest = [c for c in docs.columns if c != "text"]
    lines = docs.select(*rest, F.split("text", "\n").alias("_lines"), F.split(F.lower("text"), "\n").alias("_lower"))
    # lower-casing changes no line end, so both lists have the same lines
    lines = lines.select(*rest, "_lines", F.transform("_lower", gate.passes).alias("_full"))
    at = F.sequence(F.lit(0), F.size("_lines") - 1)
    full = lambda i: F.coalesce(F.get("_full", i), F.lit(False))
    lines = lines.select(*rest, "_lines", F.filter(at, lambda i: full(i) & ~full(i - 1)).alias("_first"), F.filter(at, lambda i: full(i) & ~full(i + 1)).alias("_last"))

    def unit(block: Column, at: Column, single: bool, text: Column) -> Column:
        return F.struct(block.alias("block"), at.alias("paragraph"), F.lit(single).alias("single"), text.alias("statement"))

    def of(first: Column, last: Column) -> Column:
        own = F.transform(F.sequence(first, last), lambda i: unit(first, i, True, F.get("_lines", i)))
        whole = F.array(unit(first, first, False, F.array_join(F.slice("_lines", first + 1, last - first + 1), "\n")))
        return F.when(last > first, F.concat(whole, own)).otherwise(own)

    # an outer explode, since Spark would score every line once more to tell which texts have none
    found = lines.select(*rest, F.explode_outer(F.flatten(F.zip_with("_first", "_last", of))).alias("_unit"))
    return found.where("_unit IS NOT NULL").select(*rest, "_unit.*")


def _weighed(numbers: Column, weights: list[float]) -> Column:
    # one string becomes one constant; an array of literals would be built anew for each word
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    return F.aggregate(numbers, F.lit(0.0), lambda a, g: a + F.get(table, g))


@dataclass
class LineModel:
    """Weights of LINE_FEATURES numbers, and the score from which on a line is not taken for other prose."""

    weights: list[float]
    least: float

    def score(self, line: Column) -> Column:
        return _weighed(_line_grams(line), self.weights)

    def passes(self, line: Column) -> Column:
        return line.rlike(r"[\p{L}\p{N}]") & (self.score(line) >= self.least)


@dataclass
class LicenceModel:
    gate: LineModel
    templates: dict[str, list[list[str]]]
    families: list[str]
    model: LogisticRegressionModel
    temperature: float
    least: float


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def _tempered(prob: Column, temperature: float) -> Column:
    powered = F.transform(prob, lambda p: F.pow(F.greatest(p, F.lit(1e-12)), F.lit(1.0 / temperature)))
    return F.transform(powered, lambda p: p / F.aggregate(powered, F.lit(0.0), lambda a, x: a + x))


def template_grams(spark: SparkSession) -> dict[str, list[list[str]]]:
    """The n-grams of each template."""
    rows = spark.createDataFrame([(k, n, t) for k, ts in TEMPLATES.items() for n, t in enumerate(ts)], "family string, n int, text string")
    out: dict[str, list[list[str]]] = {k: [] for k in TEMPLATES}
    for r in rows.select("family", "n", grams(F.col("text")).alias("grams")).orderBy("family", "n").collect():  # the templates above
        out[r["family"]].append(r["grams"])
    return out


def _contained(own: Column, templates: list[list[str]]) -> Column:
    """The largest share of a template's n-grams, of ``templates``, that ``own`` holds."""
    shares = [F.size(F.array_intersect(own, F.split(F.lit("\n".join(t)), "\n"))) / len(t) for t in templates]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def _other_prose(spark: SparkSession, prose: DataFrame | None, templates: dict[str, list[list[str]]]) -> DataFrame:
    """text: OTHER_PROSE and about OTHER_LINES lines of about OTHER_TEXTS texts, chosen by hashes, that hold no template."""
    own = spark.createDataFrame([(t,) for t in OTHER_PROSE], "text string")
    if prose is None:
        return own
    share = min(1.0, OTHER_TEXTS / max(prose.count(), 1))
    texts = prose.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("text")).where(F.col("text").rlike(r"\p{L}")).distinct()
    lines = lines.orderBy(F.xxhash64("text", F.lit(1)), "text").limit(OTHER_LINES)
    lines = stage(lines.withColumn("grams", grams(F.col("text"))), "other_prose")
    held = _contained(F.col("grams"), [t for ts in templates.values() for t in ts])
    return own.unionByName(lines.where(held < LEAST_CONTAINED).select("text"))


def _parts(text: Column) -> Column:
    """A text and its parts of PART_WORDS words."""
    words = F.split(text, r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - PART_WORDS, F.lit(0)), F.lit(PART_WORDS // 2))
    return F.array_distinct(F.concat(F.array(text), F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, PART_WORDS), " "))))


def fit_lines(statements: DataFrame, other: DataFrame) -> LineModel:
    """Fit the line scores on texts and parts of texts. The bound lets the lowest percentile of held-out statements through."""
    rows = statements.select("text", "held", F.lit(1).alias("label")).unionByName(other.select("text", F.pmod(F.xxhash64("text"), F.lit(5)) == 0, F.lit(0).alias("label")).toDF("text", "held", "label"))
    rows = rows.select("held", "label", F.explode(_parts(F.lower("text"))).alias("text")).distinct()
    rows = rows.select("held", "label", F.transform(_line_grams(F.col("text")), lambda g: g.cast("string")).alias("grams"))
    counted = CountVectorizerModel.from_vocabulary([str(k) for k in range(LINE_FEATURES)], inputCol="grams", outputCol="features").transform(rows).coalesce(2).cache()
    model = LogisticRegression(maxIter=60, regParam=1e-3).fit(counted.where("NOT held"))
    weights = [float(w) for w in model.coefficients.toArray()]
    score = _weighed(F.transform("grams", lambda g: g.cast("int")), weights)
    low = counted.where("held AND label = 1").select(F.percentile(score, 0.01)).first()[0]
    counted.unpersist()
    # the intercept is the classes' odds in the fit, which say nothing of the corpus
    return LineModel(weights, min(-model.intercept, low if low is not None else 0.0))


def _variants(rows: DataFrame) -> DataFrame:
    """label, held, v, grams: VARIANTS copies of each text; the first is whole, the others lose n-grams or gain plain ones."""
    base = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("grams", grams(F.col("text")))
    thinned = F.filter("grams", lambda g: (F.col("v") == 0) | (F.pmod(F.xxhash64(g, F.col("v")), F.lit(10)) > 0))
    around = F.slice(F.shuffle(F.split(F.lit("and the of in a for to this file is see note by with from it on at be as all text page"), " "), 11), 1, F.col("v") % 6)
    return base.select("label", "held", "v", F.concat(thinned, F.when(F.col("v") % 2 == 1, around).otherwise(F.array().cast("array<string>"))).alias("grams"))


def fit(spark: SparkSession, prose: DataFrame | None = None) -> LicenceModel:
    """Fit both models on variants and parts of the templates and, as other prose, a bounded sample of ``prose`` (text).

    Of each family with three or more templates the last is held out while temperature and bound are chosen; the model
    is then fitted on all.
    """
    families = [NONE, *sorted(TEMPLATES)]
    rows = [(t, families.index(k), len(ts) > 2 and n == len(ts) - 1) for k, ts in TEMPLATES.items() for n, t in enumerate(ts)]
    statements = spark.createDataFrame(rows, "text string, label int, held boolean")
    templates = template_grams(spark)
    other = _other_prose(spark, prose, templates)
    gate = fit_lines(statements, other)
    plain = other.select(F.lit(0).alias("label"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"), F.lit(0).alias("v"), grams(F.col("text")).alias("grams"))
    data = _features(_variants(statements).unionByName(plain)).coalesce(2).cache()
    fitted = lambda rows: LogisticRegression(maxIter=60, regParam=3e-4, family="multinomial").fit(rows)
    scored = fitted(data.where("NOT held")).transform(data.where("held")).select("label", vector_to_array("probability").alias("p")).cache()
    losses = []
    for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0):  # the temperature under which the held-out labels are likeliest
        loss = scored.select(F.avg(-F.log(F.greatest(F.get(_tempered(F.col("p"), t), F.col("label")), F.lit(1e-12)))).alias("l")).first()["l"]
        losses.append((loss, t))
    temperature = min(losses)[1]
    right = scored.where("label > 0").select(F.get(_tempered(F.col("p"), temperature), F.col("label")).alias("own"))
    least = right.select(F.percentile("own", 0.1)).first()[0]
    model = fitted(data)
    scored.unpersist()
    data.unpersist()
    # a family is named only where it is likelier than all else together
    return LicenceModel(gate, templates, families, model, temperature, float(min(max(least, 0.5), 0.9)))


def classify(docs: DataFrame, fitted: LicenceModel) -> DataFrame:
    """doc_id, paragraph (first line's number from 0), family, probability, contained, confirmed, statement.

    One row for each line of each whole text that states a licence and for each paragraph (run of several such lines)
    that does. A confirmed paragraph stands for its lines, except those that confirm another family; an unconfirmed one
    has a row only where none of its lines has.
    A statement that every version of a licence has word for word takes the version from the nearest statement before it
    in its text that names one, else from the nearest after it; without either its family is VERSIONLESS.
    ``family`` is ``unknown`` where the best family is not probable enough or no template of it confirms the unit. Null
    or empty texts have no rows; repeated rows repeat theirs; ties between families go to the first by name; columns
    other than doc_id and text are ignored. Every line is scored; only those that may state a licence are shuffled.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = units(source.withColumn("_text", F.xxhash64("text")), fitted.gate).withColumn("grams", _grams(F.col("statement")))
    # the filter stands on the model's own prediction, which tempering does not change
    scored = fitted.model.transform(_features(found)).where(F.col("prediction") != fitted.families.index(NONE))
    index = F.col("prediction").cast("int")
    scored = scored.select("doc_id", "_text", "block", "paragraph", "single", "statement", "grams", F.get(F.array(*[F.lit(f) for f in fitted.families]), index).alias("named"), F.get(_tempered(vector_to_array("probability"), fitted.temperature), index).alias("probability"))
    contained = F.lit(0.0)
    for family, texts in fitted.templates.items():
        contained = F.when(F.col("named") == family, _contained(F.col("grams"), texts)).otherwise(contained)
    scored = scored.withColumn("contained", contained).drop("grams")
    scored = scored.withColumn("confirmed", (F.col("probability") >= fitted.least) & (F.col("contained") >= LEAST_CONTAINED))
    run = Window.partitionBy("doc_id", "_text", "block")
    scored = scored.withColumn("_lines", F.max("single").over(run)).withColumn("_whole", F.max(F.when(~F.col("single") & F.col("confirmed"), F.col("named"))).over(run))
    # a confirmed paragraph stands for its lines, except those that confirm another family
    part = (F.col("named") == VERSIONLESS) & F.col("_whole").isin(*VERSIONS)
    line = F.col("_whole").isNull() | (F.col("confirmed") & (F.col("named") != F.col("_whole")) & ~part)
    scored = scored.where(F.when(F.col("single"), line).otherwise(F.col("confirmed") | ~F.col("_lines")))
    text = Window.partitionBy("doc_id", "_text").orderBy("paragraph", "single")
    version = F.when(F.col("confirmed") & F.col("named").isin(*VERSIONS), F.col("named"))
    before = F.last(version, ignorenulls=True).over(text.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(version, ignorenulls=True).over(text.rowsBetween(1, Window.unboundedFollowing))
    scored = scored.withColumn("named", F.when(F.col("named") == VERSIONLESS, F.coalesce(before, after, "named")).otherwise(F.col("named")))
    family = F.when(F.col("confirmed"), F.col("named")).otherwise(F.lit(UNKNOWN))
    return scored.select("doc_id", "paragraph", family.alias("family"), F.round("probability", 6).alias("probability"), F.round("contained", 6).alias("contained"), "confirmed", "statement")
