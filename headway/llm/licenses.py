"""License scans: a sparse word n-gram logistic regression over paragraphs, confirmed by templates.

Everything runs in the JVM: Spark's tokenizer, n-gram, count-vector and
logistic-regression transformers and SQL functions.  The vocabulary is the words
and bigrams of the notices, so it has a fixed size.  Training rows are the
templates and pieces of them with dropped words, sentences that name a licence
(names in frames), the same sentences with invented licences (class `unknown`),
plain sentences, and a bounded sample of the corpus's own paragraphs (class
`none`).  One temperature calibrates the probabilities on frames and paragraphs
that are held back whole from training.  A predicted family that is not likely
enough, or that neither a template nor a name of the family confirms, is `unknown`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drawn, materialize, read, text_of

#: Notices by family (fixed values).
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPLv3.",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GPLv2.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
}
#: Names by family (fixed values).  A paragraph that holds all bigrams of a name, or a name of one word, confirms the family.
LICENSE_NAMES = {
    "mit": ["MIT License", "MIT licence", "MIT licensed", "MIT-licensed", "Expat License", "under MIT", "SPDX-License-Identifier MIT", "License MIT", "MIT terms", "MIT style"],
    "apache-2.0": ["Apache License Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0", "Apache License v2.0", "Apache Software License", "ASL 2.0"],
    "gpl-3.0": ["GNU General Public License version 3", "General Public License v3", "GNU GPL v3", "GPL-3.0", "GPLv3", "GPL v3", "GPL version 3", "GPL-3.0-or-later", "GPL-3.0-only", "GPLv3+", "GPL 3.0"],
    "gpl-2.0": ["GNU General Public License version 2", "General Public License v2", "GNU GPL v2", "GPL-2.0", "GPLv2", "GPL v2", "GPL version 2", "GPL-2.0-or-later", "GPL-2.0-only", "GPLv2+", "GPL 2.0"],
    "lgpl": ["GNU Lesser General Public License", "Lesser General Public License", "GNU LGPL", "LGPL", "LGPL-2.1", "LGPL-3.0", "LGPLv2.1", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only"],
    "agpl-3.0": ["GNU Affero General Public License", "Affero General Public License", "Affero GPL", "GNU AGPL", "AGPL", "AGPL-3.0", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "BSD licence", "BSD licensed", "3-clause BSD", "2-clause BSD", "BSD style", "BSD terms"],
    "mpl-2.0": ["Mozilla Public License", "MPL-2.0", "MPL 2.0", "MPLv2", "MPL v2"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC-BY-3.0", "CC-BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution License", "Creative Commons Attribution licence"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "CC-BY-SA-3.0", "CC-BY-SA", "Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike", "Attribution ShareAlike"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "CC-BY-NC-3.0", "CC-BY-NC", "Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial", "Attribution NonCommercial"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal", "public domain dedication"],
    "isc": ["ISC License", "ISC licence", "ISC licensed", "ISC-licensed", "under ISC", "SPDX-License-Identifier ISC", "License ISC", "ISC terms"],
}
#: Sentences that name a licence, learned from, and others that only calibrate (fixed values).
FRAMES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "{}", "License: {}", "SPDX-License-Identifier: {}", "This project is licensed under the terms of the {}.", "Distributed under the {}; see the file LICENSE for the full text.", "The code is made available under {}."]
HELD_FRAMES = ["This work is published under the {}.", "It may be used and shared under {}, like the rest of the site.", "All files here are covered by the {} unless stated otherwise."]
#: Notices of licences without a template, and their invented names (fixed values).
UNKNOWN = [
    "Licensed under the {} License.",
    "Released under the {} License, version {}.",
    "This work is licensed under the {} Public License, version {}.",
    "Distributed under the terms of the {} license agreement.",
    "Use of this software is subject to the {} terms and conditions.",
    "Copyright {} authors. All rights reserved. See the license for details.",
]
NAMES = ["Northwind", "Zenith", "Acme", "Foobar", "Quill", "Harbor", "Meridian", "Solstice", "Lantern", "Orchard", "Copperfield", "Juniper"]
#: Sentences of no licence, so that the class exists over an empty corpus too (fixed values).
NONE = [
    "The meeting was moved to the next week because of the rain.",
    "She opened the window and looked at the old bridge.",
    "You can use this table to find the total for any version of the plan.",
    "The driver showed a license at the gate and went in.",
    "Sie ging mit dem Hund und mit ihrer Schwester nach Hause.",
    "Das Haus mit Garten liegt unter der Stadt, nicht weit vom Fluss.",
    "Researchers at MIT published a paper on the motion of rivers.",
    "An Apache helicopter landed in the field behind the school.",
    "They gave us permission to use the hall without any charge.",
    "The general public was invited, and a lesser crowd came to the house.",
    "A fishing license costs ten in that village, and a hunting licence costs more.",
    "The notice shall be included in all copies of the letter.",
    "Version 2.0 of the table replaces version 1.0 and was released in May.",
    "He made a copy of the book and sold it to a friend.",
    "The file was distributed to the members under the old rules.",
    "The software is slow, but the terms of the contract are clear.",
    "The zero on the scale was wrong, and the clause in the letter was too.",
    "Creative people met in the commons of the college on Sunday.",
    "",
]
#: Corpus paragraphs that train class `none` at most, from the documents of least hash.
TRAIN_DOCS = 500
TRAIN_PARAGRAPHS = 3000
#: Variants of each notice, and of each sentence that names a licence.
VARIANTS, NAMED_VARIANTS = 24, 3
#: Training rows without any word of the vocabulary.
STRANGE = 1000
LEAST_PROBABILITY = 0.5
#: Share of bigrams that a template, or the paragraph, has in common with the other.
CONFIRMS = 0.6
CLASSES = ["none", "unknown", *TEMPLATES]


def tokenizer() -> RegexTokenizer:
    """Lower-case runs of letters, digits, dots and hyphens inside words."""
    return RegexTokenizer(inputCol="paragraph", outputCol="words", pattern=r"[\p{L}0-9]+(?:[.-][\p{L}0-9]+)*", gaps=False, toLowercase=True)


def bounded(words: Column) -> Column:
    """Words between marks for the paragraph's edges, so that one word makes bigrams too."""
    return F.concat(F.array(F.lit("^")), words, F.array(F.lit("$")))


def bigrams(rows: DataFrame) -> DataFrame:
    """rows with `words` and `grams`, the words and bigrams of column `paragraph`."""
    words = tokenizer().transform(rows).withColumn("words", bounded(F.col("words")))
    pairs = NGram(n=2, inputCol="words", outputCol="grams").transform(words)
    return pairs.withColumn("grams", F.concat("grams", F.slice("words", F.lit(2), F.size("words") - 2)))


def notices(spark: SparkSession) -> DataFrame:
    """(label, paragraph, variants, held) of all templates, names in frames, invented notices and plain sentences: some thousand rows."""
    rows = [(CLASSES.index(f), t, VARIANTS, False) for f, texts in TEMPLATES.items() for t in texts]
    rows += [(1, t.format(n, 1 + i % 4), VARIANTS, False) for t in UNKNOWN for i, n in enumerate(NAMES)]
    named = [(CLASSES.index(f), n) for f, names in LICENSE_NAMES.items() for n in names] + [(1, f"{n} {w}") for n in NAMES for w in ("License", "Public License 1.0", "terms")]
    # Names among words that nothing else has, as what stands around a name is seldom known.
    rows += [(k, f"zz{i}a zz{i}b {n} zz{i}c" if i % 2 else f"{n} zz{i}a zz{i}b zz{i}c zz{i}d", NAMED_VARIANTS, False) for i, (k, n) in enumerate(named)]
    # A name that brings its own "under" or "License" stands in frames without one.
    fits = lambda frame, name: not (name.split()[0] in ("under", "License", "SPDX-License-Identifier") and frame != "{}")
    for frames, held in ((FRAMES, False), (HELD_FRAMES, True)):
        rows += [(k, t.format(n), NAMED_VARIANTS, held) for t in frames for k, n in named if fits(t, n)]
    return spark.createDataFrame(rows + [(0, t, VARIANTS, False) for t in NONE], "label int, paragraph string, variants int, held boolean")


def varied(rows: DataFrame) -> DataFrame:
    """`variants` forms of each notice: variant 0 whole, the others with words dropped, every second cut to a run of words as a wrapped line is."""
    words = F.split("paragraph", " ")
    out = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("variants") - 1))).withColumn("w", words)
    draw = lambda *x: F.pmod(F.xxhash64("paragraph", "v", *x), F.lit(1000))
    length = F.when((F.col("v") % 2 == 0) | (F.size("w") < 12), F.size("w")).otherwise(8 + draw(F.lit("n")) % 8)
    start = 1 + draw(F.lit("s")) % F.greatest(F.size("w") - length + 1, F.lit(1))
    out = out.withColumn("w", F.slice("w", start.cast("int"), length.cast("int")))
    kept = F.filter("w", lambda w, i: (F.col("v") == 0) | (draw(i, w) >= 80))
    return out.select("label", F.array_join(kept, " ").alias("paragraph"), "held")


@dataclass
class Model:
    """Transformers from `grams` to `rawPrediction`, the temperature, and the bigrams of templates and names."""

    stages: PipelineModel
    temperature: float
    templates: DataFrame


def probability(raw: Column, k: Column, temperature: Column) -> Column:
    """The softmax of an array of raw predictions at a temperature, for class k."""
    return 1 / F.aggregate(raw, F.lit(0.0), lambda a, x: a + F.exp(F.least((x - F.get(raw, k)) / temperature, F.lit(700.0))))


def fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    known = notices(spark)
    # Short notices say little beside the name in them, which confirms by itself.
    whole = spark.createDataFrame([(CLASSES.index(f), t) for f, texts in TEMPLATES.items() for t in texts if len(t.split()) > 12], "label int, paragraph string")
    name = spark.createDataFrame([(CLASSES.index(f), n) for f, names in LICENSE_NAMES.items() for n in names], "label int, paragraph string")
    # Of a name, the bigrams inside it, or its one word.
    inside = F.when(F.size("words") == 3, F.slice("words", 2, 1)).otherwise(F.slice("grams", F.lit(2), F.size("words") - 3))
    templates = bigrams(whole).select("label", F.array_distinct(F.filter("grams", lambda g: F.contains(g, F.lit(" ")))).alias("template"), F.lit(False).alias("name"))
    templates = materialize(templates.unionByName(bigrams(name).select("label", inside.alias("template"), F.lit(True).alias("name"))).coalesce(1), "templates")
    grams = bigrams(known).select(F.explode("grams").alias("g")).filter("g not rlike '(^| )zz[0-9]'").distinct()
    vocabulary = sorted(r["g"] for r in grams.collect())
    # Corpus paragraphs that look like a notice are left out of class `none`.
    texts = docs.select(text_of().alias("text")).withColumn("draw", F.xxhash64("text"))
    texts = texts.filter(drawn(F.col("draw"), docs.count(), TRAIN_DOCS)).dropDuplicates(["draw"])
    sample = texts.orderBy("draw").limit(TRAIN_DOCS)
    plain = sample.select("draw", F.explode(F.split("text", "\n")).alias("paragraph")).withColumn("draw", F.xxhash64("draw", "paragraph")).orderBy("draw").limit(TRAIN_PARAGRAPHS)
    plain = materialize(plain.dropDuplicates(["draw"]).coalesce(1), "paragraphs")
    pairs = bigrams(plain).select("draw", F.explode(F.array_distinct("grams")).alias("g")).join(F.broadcast(grams.filter("g like '% %'")), "g")
    plain = plain.join(pairs.groupBy("draw").count().filter("count > 2"), "draw", "left_anti")
    rows = varied(known).unionByName(plain.select(F.lit(0).alias("label"), "paragraph", (F.pmod("draw", F.lit(5)) == 4).alias("held")))
    # Paragraphs of none of the notices' words are no notices.
    rows = rows.unionByName(spark.range(STRANGE).select(F.lit(0).alias("label"), F.format_string("zz%d yy%d", "id", "id").alias("paragraph"), (F.col("id") % 5 == 4).alias("held")))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True)
    rows = materialize(bigrams(rows).select(F.col("label").cast("double").alias("label"), "held", "grams").coalesce(2), "license-rows")
    regression = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=30).fit(counter.transform(rows.filter("not held")))
    raw = regression.transform(counter.transform(rows.filter("held"))).select("label", vector_to_array("rawPrediction").alias("raw"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in np.exp(np.linspace(-1.5, 1.5, 25)).round(4)])).alias("t")
    held = raw.select("label", "raw", grid).withColumn("p", probability(F.col("raw"), F.col("label").cast("int"), F.col("t")))
    best = held.groupBy("t").agg(F.avg(-F.log(F.greatest("p", F.lit(1e-12)))).alias("loss")).orderBy("loss", "t").first()
    return Model(PipelineModel([counter, regression]), float(best["t"]), templates)


def classify(rows: DataFrame, model: Model, every: Column | None = None) -> DataFrame:
    """rows with `probability` and `family` for those whose `paragraph` is a licence notice; the others go, but where `every` is true stay with nulls.

    `confirmed` says that a template or a name of the family confirms it; without
    that, or under LEAST_PROBABILITY, the family is `unknown`.
    """
    keep = [c for c in rows.columns if c != "paragraph"]
    is_notice = F.col("prediction") > 0
    found = model.stages.transform(bigrams(rows).drop("paragraph")).filter(is_notice if every is None else is_notice | every)
    pairs = F.filter(F.array_distinct("grams"), lambda g: F.contains(g, F.lit(" ")))
    found = found.select(*keep, F.col("prediction").cast("int").alias("class"), F.array_distinct("grams").alias("grams"), pairs.alias("pairs"), vector_to_array("rawPrediction").alias("raw"))
    templates = model.templates.groupBy(F.col("label").alias("class")).agg(F.collect_list(F.struct("template", "name")).alias("templates"))
    found = found.join(F.broadcast(templates), "class", "left")
    shared = lambda t: F.size(F.array_intersect("grams", t))
    near = lambda t: F.when(t["name"], F.floor(shared(t["template"]) / F.size(t["template"]))).otherwise(F.greatest(shared(t["template"]) / F.size(t["template"]), shared(t["template"]) / F.size("pairs")))
    likely = probability(F.col("raw"), F.col("class"), F.lit(model.temperature))
    sure = (F.coalesce(F.array_max(F.transform("templates", near)), F.lit(0.0)) >= CONFIRMS) & (likely >= LEAST_PROBABILITY)
    name = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("class") + 1)
    notice = F.col("class") > 0
    return found.select(*keep, F.when(notice, likely).alias("probability"), F.when(notice, F.when(sure, name).otherwise("unknown")).alias("family"), F.when(notice, sure).alias("confirmed"))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: paragraphs, licence paragraphs, families (sorted, joined by commas), confirmed and unknown ones, greatest probability.

    A paragraph is a line.  Null text counts as empty, which is one empty
    paragraph; documents without a notice have no families and probability 0.
    Rows of one id and text are worked out together and come back as many times
    as they stand in docs, null ids too; extra columns are ignored.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of()).alias("h"), F.split(text_of(), "\n").alias("lines"))
    rows = lines.select("id", "h", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "paragraph"))
    found = classify(rows, model, F.col("pos") == 0)
    first = F.col("pos") == 0
    out = found.groupBy("id", "h").agg(
        F.count(F.when(first, 1)).alias("rows"),
        F.max("n").cast("long").alias("n_paragraphs"),
        F.count("family").alias("n_licenses"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"),
        F.count(F.when(~F.col("confirmed"), 1)).alias("n_unknown"),
        F.coalesce(F.max("probability"), F.lit(0.0)).alias("probability"),
    )
    each = [F.expr(f"{c} div rows").alias(c) for c in ("n_licenses", "n_confirmed", "n_unknown")]
    out = out.select(F.col("id").alias(id_col), "n_paragraphs", each[0], "families", *each[1:], "probability", F.explode(F.expr("sequence(1L, rows)")).alias("copy"))
    return out.drop("copy")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
