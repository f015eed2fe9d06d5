"""Licence scans: a trained paragraph classifier, confirmed against templates.

Candidates are paragraphs (blocks of lines between blank ones, their lines joined) and each
of their lines. Their features are word 1- to 3-grams out of those that occur
in the templates and aren't made of stop words alone; a multinomial logistic regression
over them tells the licence families and ``none`` apart. It is trained on the
templates, mutilated in fixed ways, and on a bounded sample of the corpus's paragraphs and lines, whose weight in all is
fixed, so the verdict doesn't hang on the corpus's size. Of the sample only what resembles a template is left out.

A candidate none of whose words is a template's has no feature at all, so it is left out
early, exactly; every other one goes to the classifier.

Probabilities are calibrated on notices and prose that the classifier wasn't fitted on: by a temperature, then by a cut for
each family and one for being a licence at all, the least that are right at a stated rate. A family needs its cut and
enough of a template: of its words in a line, of its word pairs in a paragraph of several lines. A line over the
licence cut that fails either is ``unknown``, unless its paragraph is of a family; under that cut it is none.
Of equal probabilities the first label in the order families by name, none, unknown counts.
"""

from __future__ import annotations

import re
from json import dumps

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import small_side, staged

#: How the families are named, and what their notices say.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "Available under the terms of the Apache License 2.0",
        "Apache-2.0 licensed", "Licensed under Apache 2.0", "License: Apache 2", "Apache License v2",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source or binary form is permitted, provided that this copyright notice is kept",
        "The 2-Clause BSD License", "BSD 3-Clause License", "BSD licensed", "New BSD license",
    ],
    "CC": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under the Creative Commons Attribution-ShareAlike License.",
        "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0.",
        "This work is dedicated to the public domain",
        "CC0 1.0 Universal",
        "Content is CC BY-SA 3.0", "License: CC BY 4.0", "Creative Commons license",
        *[f"Text available under CC {kind} 4.0" for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Lesser General Public License.",
        "Covered by the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GNU GPL v3", "Released under the GPL v2", "GPL v3 licensed", "Licensed under LGPL-2.1", "AGPL-3.0 licensed", "GPLv3", "License: GPLv2 or later", "GPL licensed",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
        "Permission to use, copy, modify and distribute this software is granted free of charge",
        "The MIT License (MIT)",
        "Available under the MIT license", "Distributed under the terms of the MIT license", "MIT licensed", "Dual MIT/Apache licensed",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.",
        "Released under the terms of the Mozilla Public License, version 2.0", "MPL 2.0 licensed",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: Licences of no family above: they teach the classifier what else is a licence.
OTHER = [
    "Dual licensed", "Dual licensed under two licenses", "Multi-licensed, see the license files",
    "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    "Licensed under the terms of the accompanying license agreement.",
    "This software is proprietary and confidential; unauthorised copying is prohibited under the license.",
    "Distributed under the Artistic License.", "Licensed under the Eclipse Public License.", "This file is licensed under the zlib license.",
    "Use, modification and distribution are subject to the Boost Software License.", "Made available under the Open Database License.",
    "Licensed under the EUPL, version 1.2", "License: ISC", "License: EUPL-1.1", "European Union Public License", "EUPL 1.1 or later",
]
#: Notices worded in other ways, which the classifier isn't fitted on: they tell what probability a family needs.
HELD_OUT = {
    "Apache": ["This project is licensed under Apache 2.0", "Code licensed under the Apache License v2.0", "You may use this file only in accordance with the Apache License, Version 2.0"],
    "BSD": ["This library is available under the 3-clause BSD license", "BSD licensed, see LICENSE", "Redistribution in source or binary form is permitted provided that the copyright notice is retained"],
    "CC": ["Photographs are CC BY-SA 3.0", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-NonCommercial license", "Dedicated to the public domain by its author (CC0)"],
    "GPL": ["This file is part of a program licensed under the GPL version 2 or later", "Released under the terms of the GNU General Public License (GPL)", "GNU GPL v3 or later"],
    "MIT": ["This project is open source under the MIT license", "Code is MIT licensed", "Permission is granted, free of charge, to use, copy and modify this software"],
    "MPL": ["Licensed under the MPL 2.0", "This file is covered by the Mozilla Public License 2.0"],
}
#: Sentences with licences' words that are none: of the first the classifier is told, the second say with the held-out notices what a probability is worth.
PROSE = [
    "a word of the day", "general terms and conditions may apply", "version 3 of the story", "the public was free to copy it", "software and source code", "no permission",
    "She renewed her driver's license last week.", "The restaurant lost its liquor license.", "A fishing license is required here.", "He studied physics at MIT in Boston.", "Apache helicopters flew over the valley.",
    "The company distributed software to hospitals under a contract.", "Their source code was written in an afternoon.", "The council granted permission to build the road.", "The general public was invited to the opening.",
    "A warranty covers the kitchen for two years.", "The copyright on the song ran out.", "The foundation is free of charge for visitors.", "Modification of the route was permitted in May.", "An agreement was reached without any conditions.",
    "The herd of gnu crossed the river.", "It is published by the museum without an index.", "The work of the commons committee is creative.", "He may not use the car without a license.", "Taxi licenses are issued by the city.",
    "The statue was dedicated to the public in spring.", "The domain of the king was public land.", "He dedicated the garden to his daughter.",
]
HELD_OUT_PROSE = [
    "He obtained a business license to distribute software to schools.", "My driver's license expired in March.", "The license plate was covered with mud.", "Students of MIT built a robot.", "The Apache people lived in the south west.",
    "The public domain of the park was dedicated to its founder.", "Permission was granted by the teacher to leave early.", "The software was distributed on disks at the time.", "Hunting without a license is forbidden.", "A mozilla sticker was on the notebook.",
    "The terms of the contract include a warranty of one year.", "Copies of the book were sold on the street.", "The author reserves a table for the reading.", "The gnu is an antelope.", "They provide a general service to the public.", "The clause on redistribution of land was disputed.",
]
#: Predictions over a cut are right at this rate among what is held out; a cut is over a uniform guess in any case.
PRECISION, LEAST_CUT = 0.95, 0.3
#: What the licences are called; each name is a notice in three short forms.
NAMES = {
    "Apache": ["Apache License 2.0", "Apache License, v2.0", "Apache-2.0"],
    "BSD": ["BSD License", "3-Clause BSD License", "BSD-2-Clause"],
    "CC": ["CC BY 4.0 license", "CC BY-SA 3.0", "CC BY-NC", "CC0 public domain dedication", "Creative Commons Attribution license"],
    "GPL": ["GPL", "GNU GPL v2", "GPL version 3 or later", "LGPL v2.1", "AGPL v3", "GNU General Public License"],
    "MIT": ["MIT License", "MIT"],
    "MPL": ["MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
}
FORMS = ["{}", "Available under the {}", "Distributed under {}"]
NONE, UNKNOWN = "none", "unknown"
STOP = frozenset("a an and any are as at be by can for from if in is it may no not of on one or other that the this to use was with you we".split())
#: Texts of the corpus of which the classifier is fitted on one paragraph each at most, about: the sample's bound.
TRAIN_TEXTS = 4000
#: Share of a template's words that a line must have, and of its word pairs that a paragraph must.
CONFIRM = 0.6
#: A row of the sample is a piece of a template, and no prose, if so much of it is.
FRAGMENT = 0.5
#: Blocks of lines end at blank lines.
BLANK = r"\n[ \t\x0B\f\r]*\n"
#: What each class of notices, and all that is none, weighs in the fit, whatever their numbers.
CLASS_WEIGHT, NONE_WEIGHT = 1000.0, 1000.0
#: Temperatures that are tried.
TEMPERATURES = [x / 8 for x in range(4, 41)]
SPLIT = r"[^\p{L}\p{N}.+]+|(?<!\.)\.++(?=[^\p{L}\p{N}]|$)"


def templates() -> dict[str, list[str]]:
    """All notices by family: ``TEMPLATES``, and the names in their forms (a bare word is no notice)."""
    return {f: [*TEMPLATES[f], *(form.format(n) for n in NAMES[f] for form in FORMS if " " in form.format(n) or "-" in n)] for f in TEMPLATES}


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, ``+`` and inner dots; hyphens part words, and a licence is a license."""
    return F.array_remove(F.split(F.regexp_replace(F.replace(F.lower(text), F.lit("licenc"), F.lit("licens")), SPLIT, " "), " +"), "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(" +", re.sub(r"[^\w.+]+|_|(?<!\.)\.++(?=[\W_]|$)", " ", text.lower().replace("licenc", "licens"))) if w]


def _grams(words: list[str]) -> set[str]:
    found = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return {g for g in found if not set(g.split()) <= STOP}


def vocabulary() -> list[str]:
    """The features: grams of all templates, in code-point order."""
    texts = [t for family in templates().values() for t in family] + OTHER
    return sorted(set().union(*(_grams(_words(t)) for t in texts)))


def grams(words: Column) -> Column:
    """Word 1- to 3-grams of an array of words."""
    joined = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, joined(2), joined(3))


def _mutilated(text: str) -> list[str]:
    """A template and fixed variants: without its ends, with words left out, inside other words."""
    words = text.split()
    out = [text, text.upper(), "// " + text, text + " See LICENSE for details."]
    for k in range(2, 6):
        out.append(" ".join(w for i, w in enumerate(words) if (i + k) % (k + 3)))
    if len(words) > 8:
        out += [" ".join(words[: len(words) * 2 // 3]), " ".join(words[len(words) // 3 :])]
    return out


def anchors() -> list[str]:
    """Words without which a line has no feature: those of the features, stop words left out."""
    return sorted({w for g in vocabulary() for w in g.split()} - STOP)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column more, computed once a row.

    A generator's output: later filters are not moved below it. Else the filter on the
    classifier's result would hold the whole chain spelled out, and cut a line into
    words again for each of its grams.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def anchored(words: Column, anchors: list[str]) -> Column:
    """The 1- to 3-grams with one of ``anchors`` in them, once for each; empty ones where the row ends. No other gram is a feature."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.get(words, i).isin(anchors))
    spans = [(d, n) for n in (1, 2, 3) for d in range(1 - n, 1)]
    joined = lambda i, d, n: F.coalesce(F.concat(*(x for k in range(n) for x in ([F.lit(" ")] if k else []) + [F.get(words, i + (d + k))])), F.lit(""))
    return F.flatten(F.transform(at, lambda i: F.array(*(joined(i, d, n) for d, n in spans))))


def candidates(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """``(id, para, part, wrapped, words)`` of each paragraph and line that has one of ``words`` among its own.

    ``part`` is 0 for a whole paragraph, ``wrapped`` if it has several lines; those have their number from 1.
    No word goes over a line's end, so lines are cut into words once and a paragraph has theirs.
    """
    blocks = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), BLANK)).alias("para", "text"))
    known = lambda l: F.exists(l, lambda w: w.isin(words))
    cut = once(blocks, "lines", F.transform(F.split("text", "\n"), tokens)).where(F.exists("lines", known))
    several = F.size("lines") > 1
    parts = F.when(several, F.concat(F.array(F.flatten("lines")), F.col("lines"))).otherwise(F.col("lines"))
    # both made before the rows: a row for each line must not hold all lines
    each = cut.select("id", "para", several.alias("several"), parts.alias("parts")).select("id", "para", "several", F.posexplode("parts").alias("part", "words"))
    return each.where(known(F.col("words"))).select("id", "para", "part", (F.col("several") & (F.col("part") == 0)).alias("wrapped"), "words")


def _pairs(text: str) -> set[str]:
    words = _words(text)
    return {" ".join(x) for x in zip(words, words[1:])}


def _literal(sets: list[set[str]]) -> Column:
    """Sets of strings as one literal, not one for each word."""
    return F.from_json(F.lit(dumps([sorted(x) for x in sets])), "array<array<string>>")


def shared(templates: list[str], grams_: Column) -> Column:
    """Those of the grams that any template has: all that :func:`resemblance` and :func:`held_share` look at, and few."""
    return F.array_intersect(grams_, F.element_at(_literal([set().union(*({*_words(t), *_pairs(t), *_grams(_words(t))} for t in templates))]), 1))


def resemblance(templates: list[str], grams_: Column, wrapped: Column) -> Column:
    """The largest share of a template that is there: of its words, or of its word pairs where ``wrapped``; templates of one word count by that."""
    share = lambda t: F.size(F.array_intersect(grams_, t)) / F.size(t)
    best = lambda sets: F.array_max(F.transform(_literal(sets), share))
    return F.when(wrapped, best([_pairs(t) or set(_words(t)) for t in templates])).otherwise(best([set(_words(t)) - STOP for t in templates]))


def held_share(templates: list[str], grams_: Column, own: Column) -> Column:
    """The largest share of a row's ``own`` different grams that one template holds: near 1 for a piece of it."""
    return F.array_max(F.transform(_literal([_grams(_words(t)) for t in templates]), lambda t: F.size(F.array_intersect(grams_, t)))) / own


class Scanner:
    """The trained and calibrated classifier: ``temperature``, ``cuts`` by family, and ``licence_cut``."""

    def __init__(self, spark: SparkSession, sample: DataFrame | None = None):
        """``sample``: ``(text, held)`` of the corpus, a bounded number of rows; those ``held`` aren't fitted on but calibrate."""
        self.families = sorted(TEMPLATES)
        self.labels = [*self.families, NONE, UNKNOWN]
        self.vocabulary = vocabulary()
        self.anchors = anchors()
        none = self.labels.index(NONE)
        notices = lambda texts, most: [(t, self.labels.index(f), True) for f in self.labels if f != NONE for x in texts.get(f, []) for t in _mutilated(x)[:most]]
        fit = notices({**templates(), UNKNOWN: OTHER}, None) + [(x, none, True) for x in ("", "the", *PROSE)]
        held = notices(HELD_OUT, 4) + [(x, none, True) for x in HELD_OUT_PROSE]
        rows = spark.createDataFrame([(*x, False) for x in fit] + [(*x, True) for x in held], "text string, label int, own boolean, held boolean")
        if sample is not None:
            known = [t for f in self.families for t in templates()[f]] + OTHER
            cut = once(once(sample, "words", tokens(F.col("text"))), "grams", grams(F.col("words")))
            cut = once(cut, "met", shared(known, F.col("grams")))
            fragment = (F.size("words") > 3) & (held_share(known, F.col("met"), F.size(F.array_distinct("grams"))) >= FRAGMENT)
            prose = cut.where((resemblance(known, F.col("met"), F.col("text").contains("\n")) < CONFIRM) & ~fragment)
            rows = rows.unionByName(prose.select("text", F.lit(none).alias("label"), F.lit(False).alias("own"), "held"))
        # a few thousand rows by the sample's bound: one partition, read in every iteration; what comes before it is spread
        data = self._vectors(rows.withColumn("words", tokens(F.col("text")))).select("features", "label", "own", "held").repartition(1).persist()
        sizes = {r["label"]: r["count"] for r in data.where("NOT held").groupBy("label").count().collect()}
        weight = F.element_at(F.array(*(F.lit((NONE_WEIGHT if k == none else CLASS_WEIGHT) / sizes.get(k, 1)) for k in range(len(self.labels)))), F.col("label") + 1)
        self.model = LogisticRegression(maxIter=60, regParam=0.0003, family="multinomial", featuresCol="features", labelCol="label", weightCol="weight").fit(data.where("NOT held").withColumn("weight", weight))
        seen = self.model.transform(data.where("held")).select("label", "own", vector_to_array("rawPrediction").alias("z")).collect()
        data.unpersist()
        self._calibrate(seen, none)

    def _calibrate(self, seen: list, none: int) -> None:
        """From the held-out rows: the temperature of least log-loss, notices and prose each with half of the weight, then the cuts."""
        z, label = np.array([r.z for r in seen]), np.array([r.label for r in seen])
        # the corpus's own rows and the hard sentences share the prose's half
        weight = np.where(label != none, 1.0, 0.0)
        for part in ([r.own and r.label == none for r in seen], [not r.own for r in seen]):
            weight[part] = max(1.0, (label != none).sum()) / 2 / max(1, sum(part))

        def softmax(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        loss = {t: -(weight * np.log(softmax(t)[np.arange(len(label)), label] + 1e-12)).sum() for t in TEMPERATURES}
        self.temperature = min(TEMPERATURES, key=lambda t: (loss[t], t))
        p = softmax(self.temperature)
        best = p.argmax(axis=1)
        self.cuts = {f: _least_cut(p[best == k, k], label[best == k] == k, weight[best == k]) for k, f in enumerate(self.families)}
        licence = 1 - p[:, none]
        self.licence_cut = _least_cut(licence[best != none], (label != none)[best != none], weight[best != none])

    def _vectors(self, rows: DataFrame) -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="features_of", outputCol="features")
        counter = counter.setBinary(True) if hasattr(counter, "setBinary") else counter
        return counter.transform(once(rows, "features_of", anchored(F.col("words"), self.anchors)))

    def scan(self, rows: DataFrame) -> DataFrame:
        """``(id, para, part, family, probability, overlap)`` for those of :func:`candidates` that are licences."""
        tempered = F.transform(vector_to_array("rawPrediction"), lambda z: z / self.temperature)
        top = lambda zs: let(F.array_max(zs), lambda m: F.transform(zs, lambda z: F.exp(z - m)))
        whole = lambda es: F.transform(es, lambda e: e / F.aggregate(es, F.lit(0.0), lambda a, x: a + x))
        # worked out once a row: the filter on it would have features and model anew for each mention
        scored = once(self.model.transform(self._vectors(rows)), "p", let(tempered, lambda zs: let(top(zs), whole)))
        best = F.element_at(F.array(*map(F.lit, self.labels)), F.array_position("p", F.array_max("p")).cast("int"))
        licence = 1 - F.element_at("p", self.labels.index(NONE) + 1)
        found = scored.where((best != NONE) & (licence >= self.licence_cut)).select("id", "para", "part", "wrapped", "words", best.alias("best"), F.array_max("p").alias("probability"))
        found = once(found, "grams", shared([t for ts in templates().values() for t in ts], grams(F.col("words"))))
        overlap, sure = F.lit(0.0), F.lit(False)
        for f in self.families:
            overlap = F.when(F.col("best") == f, resemblance(templates()[f], F.col("grams"), F.col("wrapped"))).otherwise(overlap)
            sure = F.when(F.col("best") == f, F.col("probability") >= self.cuts[f]).otherwise(sure)
        found = found.withColumn("overlap", overlap)
        named = found.select("id", "para", "part", "wrapped", F.when(sure & (F.col("overlap") >= CONFIRM), F.col("best")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "overlap")
        # of a paragraph of several lines only what is sure counts: its lines tell the rest
        return named.where(~F.col("wrapped") | (F.col("family") != UNKNOWN)).drop("wrapped")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _least_cut(p: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """The least cut over ``LEAST_CUT`` at and above which predictions are right at the rate ``PRECISION``; 0.9 where none is."""
    for cut in sorted({LEAST_CUT, *p[p > LEAST_CUT].tolist()}):
        over = p >= cut
        if over.any() and (weight * right)[over].sum() >= PRECISION * weight[over].sum():
            return float(cut)
    return 0.9


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_TEXTS) -> Scanner:
    """A scanner fitted on the templates and on a paragraph and a line, by hash, of each of about ``most`` texts; a quarter of these are held out."""
    count = docs.count()
    share = F.lit(min(1.0, most / max(count, 1)))
    place = lambda what: F.xxhash64(F.col(id_col), F.lit(what))
    kept = docs.where(F.col(text_col).isNotNull() & (F.pmod(place("licence"), F.lit(1 << 30)) < share * (1 << 30)))
    one = lambda parts, what: F.element_at(parts, (F.pmod(place(what), F.size(parts)) + 1).cast("int"))
    texts = F.array(one(F.split(F.col(text_col), BLANK), "paragraph"), one(F.split(F.col(text_col), r"\n"), "line"))
    sample = kept.select((F.pmod(place("held"), F.lit(4)) == 0).alias("held"), F.explode(texts).alias("text"))
    return Scanner(docs.sparkSession, staged(sample, "licence_sample"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """``(id, licences, n_paragraphs, best_probability)`` for every row of ``docs``.

    ``licences`` are the families of its licence paragraphs and lines, sorted, ``unknown`` among them;
    empty for texts without, also null and empty ones. Rows that repeat an id with
    one text come back repeated, each with the licences of all of that id. Null ids match null ids. Other
    columns don't matter. Empty in, empty out.
    """
    scanner = scanner or train(docs, id_col, text_col)
    hits = staged(scanner.scan(candidates(docs, id_col, text_col, scanner.anchors)), "licence_hits")
    by_para = hits.groupBy("id", "para").agg(F.collect_set("family").alias("f"), F.max("probability").alias("p"))
    sure = F.array_remove("f", UNKNOWN)
    by_para = by_para.select("id", "p", F.when(F.size(sure) > 0, sure).otherwise(F.col("f")).alias("f"))
    by_id = by_para.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("found"), F.count("*").alias("n"), F.max("p").alias("p"))
    by_id = staged(by_id.withColumnRenamed("id", "_id"), "licence_ids")
    joined = docs.select(F.col(id_col).alias("id")).join(small_side(by_id), F.col("id").eqNullSafe(F.col("_id")), "left")
    return joined.select("id", F.coalesce("found", F.array().cast("array<string>")).alias("licences"), F.coalesce("n", F.lit(0)).cast("int").alias("n_paragraphs"), F.col("p").alias("best_probability"))
