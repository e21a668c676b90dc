"""Licence families of paragraphs: a sparse word n-gram logistic regression, and templates that confirm it.

The model is fitted on the driver to notices of each family below, varied by rule, and to
units of the unknown class: a sample of the corpus that no template confirms, sentences that
mention licences without granting one, and notices whose words are shuffled or thinned. Its
unknown class is calibrated: the temperature and the least probability are those under which
held-out variants keep their family and held-out unknown units stay unknown.

A unit is a paragraph, which ends at a blank line, so a notice wrapped over several lines is one
text; each line of a longer paragraph is a unit too, as a notice often stands on a line of its
own. Every unit is scored. Scoring is DataFrame expressions only: n-grams made of words that
some feature has are joined with the weights and the templates' trigrams, whose number is
bounded by FEATURES and by the notices.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FEATURES, GRAMS = 8192, (1, 2, 3)
#: The bound of the unknown class's sample: units.
UNKNOWN_SAMPLE = 2000
#: The share of a template's trigrams that confirms a family.
CONFIRMS = 0.6

NOTICES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This software is distributed under the Apache 2.0 license."],
    "bsd": ["Licensed under the BSD license.", "Released under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Released under the GPL version 2 or later.", "Licensed under the GNU GPL v3."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License.", "Released under the LGPL version 3."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."],
    "all-rights-reserved": ["Copyright 2020 Example. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission.", "Copyright (c) 2019 the authors, all rights reserved."],
}
UNKNOWN = "unknown"
#: Names by which a family is called, and sentences that call a licence by name.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT", "MIT License"],
    "apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0"],
    "bsd": ["BSD", "BSD License", "3-Clause BSD", "2-Clause BSD", "BSD 3-Clause", "BSD 3-Clause License", "BSD 2-Clause License", "Simplified BSD License"],
    "gpl": ["GPL", "GPLv3", "GPL v2", "GPL-3.0", "GNU General Public License", "GNU GPL version 3"],
    "lgpl": ["LGPL", "LGPLv3", "LGPL v2.1", "LGPL-2.1", "GNU Lesser General Public License"],
    "mpl-2.0": ["MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0 License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 3.0 License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 3.0 License"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "CC0 public domain dedication"],
}
FORMS = ("{}", "{}.", "Licensed under {}.", "Licensed under the {}.", "Licensed under the terms of the {}.", "Released under {}.", "Released under the {} terms.", "Distributed under {}.", "Distributed under the {}.", "Distributed under the {} terms.", "Provided under the {} terms.", "Published under {}.", "License: {}", "SPDX-License-Identifier: {}", "This code is available under the {}.", "You may use this file under the terms of the {}.")
#: Further wording of the licences' own texts, as sentences that stand alone when a text is split.
CLAUSES: dict[str, list[str]] = {
    "mit": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "bsd": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."],
    "apache-2.0": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis."],
    "gpl": ["You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["You should have received a copy of the GNU Lesser General Public License along with this library."],
}
_SWAPS = (("Licensed", "Released"), ("This work", "This text"), ("This work", "This article"), ("is licensed", "is distributed"), ("Released", "Published"), ("License", "Licence"))
_OTHER = (
    "You need a driving license to rent a car.", "The warranty covers parts for two years.", "Copyright law is taught in the second term.", "The license plate was not readable.", "He has a licence to sell fish.", "The public domain was discussed at length.",
    "A general public meeting is held in May.", "Version 2.0 was released in spring.", "The GNU is an antelope of the plains.", "Apache helicopters were shown.", "She studied physics at MIT and moved west.", "The MIT campus lies by the river.",
    "A licence fee is due each year.", "The software was distributed on tape.", "The terms of the agreement are under review.", "Version 3 of the program is available.", "Permission to enter is granted at the gate.", "Conditions in the north were poor.",
    "The library is free to visit.", "All rights were discussed in the assembly.", "Creative work is common in schools.", "The commons were open to all.", "Work under the bridge has ended.", "He was released under bail.", "The article is about licensing hours in pubs.",
    "A copyright lawsuit was filed over the song.", "They published under a false name.", "The restaurant lost its liquor license.", "The source of the river was found.", "Use of this road is free of charge.", "The text is in the public library.", "Licence applications are dealt with by the council.",
    "Mozilla opened an office in town.", "The attribution of the painting is disputed.", "Binary stars were observed.", "Redistribution of land was promised.", "Without warranty the price is lower.", "The document is in the file.", "The original work was lost.",
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)}


def variants() -> list[tuple[str, str]]:
    """(family, notice) of every notice and its variants."""
    out = []
    for family, texts in NOTICES.items():
        for t in texts:
            all_of = {t, *(t.replace(a, b) for a, b in _SWAPS)}
            out += [(family, v) for v in sorted(all_of)] + [(family, f"{v} See the file for details.") for v in sorted(all_of)]
    out += [(family, f.format(n)) for family, names in NAMES.items() for n in names for f in FORMS]
    return out + [(family, t) for family, texts in CLAUSES.items() for t in texts]


def vocabulary() -> dict[str, int]:
    """The FEATURES n-grams that the most variants have."""
    count: dict = {}
    for _, t in variants():
        for g in grams_of(words_of(t)):
            count[g] = count.get(g, 0) + 1
    return {g: i for i, g in enumerate(sorted(sorted(count), key=lambda g: -count[g])[:FEATURES])}


def templates() -> list[tuple[str, frozenset[str]]]:
    """(family, trigrams) of every distinct variant of at least three words."""
    out: dict = {}
    for f, t in variants():
        w = words_of(t)
        if len(w) >= 3:
            out[f, frozenset(" ".join(w[i : i + 3]) for i in range(len(w) - 2))] = None
    return list(out)


def fit(unknown: list[list[str]], epochs: int = 30, seed: int = 5) -> dict:
    """Families, weights by n-gram, bias, temperature and least probability; ``unknown`` are the n-grams of sampled units."""
    rng = random.Random(seed)
    known = variants()
    names = [*NOTICES, UNKNOWN]
    rows = [(grams_of(w), f) for f, t in known if (w := words_of(t))]
    for _, t in known:
        w = words_of(t)
        s = w[:]
        rng.shuffle(s)
        if len(w) > 3:  # of a name alone any order is a name
            rows += [(grams_of(s), UNKNOWN), (grams_of([x for x in w if rng.random() < 0.35]), UNKNOWN)]
    # What no template tells from a text of its own: the sentences' words weigh as much as the families'.
    rows += [(grams_of(words_of(t)), UNKNOWN) for t in _OTHER] * 4 + [({*g}, UNKNOWN) for g in unknown]
    vocab = vocabulary()
    data = [(np.array(sorted(vocab[g] for g in grams if g in vocab), np.int64), names.index(f)) for grams, f in rows]
    rng.shuffle(data)
    hold, learn = data[::5], [d for i, d in enumerate(data) if i % 5]
    k = len(names)
    w, b = np.zeros((len(vocab), k)), np.zeros(k)
    share = np.bincount([y for _, y in learn], minlength=k)
    weight = np.sqrt(len(learn) / np.maximum(share, 1) / k).clip(0.2, 5)
    for epoch in range(epochs):
        lr = 0.3 * (1 - epoch / epochs)
        for at in rng.sample(range(len(learn)), len(learn)):
            x, y = learn[at]
            n = max(1.0, len(x)) ** 0.5
            z = w[x].sum(0) / n + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            w[x] -= lr * weight[y] * p / n
            b -= lr * 0.1 * weight[y] * p
    logits = np.array([w[x].sum(0) / max(1.0, len(x)) ** 0.5 + b for x, _ in hold])
    y = np.array([y for _, y in hold])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    z = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
    p = z / z.sum(1, keepdims=True)
    wrong = p[:, :-1].max(1)[(y == k - 1) | (p[:, :-1].argmax(1) != y)]
    least = float(min(0.9, max(0.5, np.quantile(wrong, 0.99) if len(wrong) else 0.5)))
    return {"names": names, "vocab": vocab, "w": w, "b": b, "temperature": temperature, "least": least}


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, line, words) of every paragraph (line null) and of every line of a longer one, by their numbers from 0.

    ``row`` tells rows of one doc_id apart within one run of a plan.
    """
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("t"), F.monotonically_increasing_id().alias("row"))
    d = d.select("doc_id", "row", F.posexplode(F.split("t", r"\n[^\S\n]*\n")).alias("paragraph", "p"))
    lines = F.split("p", "\n")
    each = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("u")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.col("p").alias("u")))
    d = d.select("doc_id", "row", "paragraph", F.inline(F.when(F.size(lines) > 1, F.concat(whole, each)).otherwise(whole)))
    return d.select("doc_id", "row", "paragraph", "line", _words(F.col("u")).alias("words"))


def _grams(words: Column, of: set[str]) -> Column:
    """Distinct n-grams all of whose words are in ``of``, a bounded set."""
    run = lambda w, n: F.transform(w, lambda x, i: F.concat(x, *[y for k in range(1, n) for y in (F.lit(" "), F.get(w, i + k))]))
    all_of = lambda w: F.array_distinct(F.filter(F.concat(*[run(w, n) for n in GRAMS]), lambda g: g.isNotNull()))
    known = F.transform(words, lambda x: F.when(x.isin(*sorted(of)), x))
    return F.get(F.transform(F.array(known), all_of), 0)  # a lambda's argument is computed once


def _features(unit: DataFrame, weights: dict) -> tuple[DataFrame, DataFrame]:
    """(rows of each unit's distinct n-grams with w, their weights, and t, the templates they are in; templates: t, family, size).

    ``weights``: list of numbers by n-gram. The joined side holds these and the templates' trigrams only.
    """
    spark = unit.sparkSession
    at: dict = {}
    listed = templates()
    for i, (_, tri) in enumerate(listed):
        for g in tri:
            at.setdefault(g, []).append(i)
    every = sorted({*weights, *at})
    side = spark.createDataFrame([(g, weights.get(g), at.get(g, [])) for g in every], "gram string, w array<double>, t array<int>")
    known = spark.createDataFrame([(i, f, len(tri)) for i, (f, tri) in enumerate(listed)], "t int, of string, size int")
    grams = unit.select("doc_id", "row", "paragraph", "line", F.explode(_grams(F.col("words"), {w for g in every for w in g.split(" ")})).alias("gram"))
    return grams.join(F.broadcast(side), "gram"), F.broadcast(known)


UNIT = ["doc_id", "row", "paragraph", "line"]


def unknown_sample(docs: DataFrame, most: int = UNKNOWN_SAMPLE) -> list[list[str]]:
    """The model's n-grams in each of at most ``most`` units, by a hash of their document and place, that no template confirms."""
    n = max(1, docs.count())
    near = docs.select("doc_id", "text").where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(min(1.0, most / n) * (1 << 20)) + 1)
    rows, known = _features(units(near), {g: [0.0] for g in vocabulary()})
    g = rows.groupBy(*UNIT).agg(F.collect_list(F.when(F.col("w").isNotNull(), F.col("gram"))).alias("grams"), F.flatten(F.collect_list("t")).alias("t"))
    chosen = g.orderBy(F.xxhash64("doc_id", "paragraph", "line"), *UNIT).limit(2 * most)
    share = chosen.select(*UNIT, "grams", F.explode_outer("t").alias("t")).groupBy(*UNIT, "t").agg(F.first("grams").alias("grams"), F.count("*").alias("n")).join(known, "t", "left")
    out = share.groupBy(*UNIT).agg(F.first("grams").alias("grams"), F.coalesce(F.max(F.col("n") / F.col("size")), F.lit(0.0)).alias("overlap"))
    out = out.where(F.col("overlap") < CONFIRMS).orderBy(F.xxhash64("doc_id", "paragraph", "line"), *UNIT).limit(most)
    return [sorted(r["grams"]) for r in out.collect()]


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, paragraph, line, family, probability, overlap, confirmed) of every paragraph, or line of one, of a known family.

    Paragraphs end at blank lines and are counted from 0; ``line`` is null where the paragraph
    as a whole is meant. A paragraph of several lines is given as a whole where a template
    agrees with it better than with any of its lines, and else by its lines. Units whose best
    family is below the calibrated probability, or below the unknown class, are unknown and not
    returned. ``overlap`` is the largest share of the word trigrams of a template of the family
    that the unit holds; ``confirmed`` where at least CONFIRMS. Null and empty texts have no unit
    of a family. Repeated rows give repeated results.
    """
    names, k = model["names"], len(model["names"])
    rows, known = _features(units(docs), {g: [float(x) for x in model["w"][i]] for g, i in model["vocab"].items()})
    sums = [F.coalesce(F.sum(F.get("w", i)), F.lit(0.0)).alias(f"w{i}") for i in range(k)]
    g = rows.groupBy(*UNIT).agg(F.count("w").alias("n"), F.flatten(F.collect_list("t")).alias("t"), *sums).where("n > 0")
    logits = F.array(*[(F.col(f"w{i}") / F.sqrt("n") + float(model["b"][i])) / model["temperature"] for i in range(k)])
    top = F.array_max("z")
    g = g.withColumn("z", logits).withColumn("e", F.transform("z", lambda x: F.exp(x - top))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    best = F.array_max(F.slice("e", 1, k - 1))
    g = g.withColumn("at", F.array_position(F.slice("e", 1, k - 1), best)).withColumn("probability", best / F.col("total"))
    g = g.where((F.col("probability") >= model["least"]) & (F.col("probability") >= F.get("e", k - 1) / F.col("total")))
    g = g.select(*UNIT, F.get(F.array(*[F.lit(n) for n in names]), F.col("at").cast("int") - 1).alias("family"), "probability", F.explode_outer("t").alias("t"))
    g = g.groupBy(*UNIT, "family", "probability", "t").agg(F.count("*").alias("n")).join(known, "t", "left")
    g = g.groupBy(*UNIT, "family", "probability").agg(F.coalesce(F.max(F.when(F.col("of") == F.col("family"), F.col("n") / F.col("size"))), F.lit(0.0)).alias("overlap"))
    # A paragraph of several lines against its lines.
    whole, line = F.max(F.when(F.col("line").isNull(), F.col("overlap"))), F.max(F.when(F.col("line").isNotNull(), F.col("overlap")))
    sides = g.groupBy("row", "paragraph").agg((F.coalesce(whole, F.lit(-1.0)) > F.coalesce(line, F.lit(-1.0))).alias("as_whole"))
    g = g.join(sides, ["row", "paragraph"]).where(F.col("line").isNull() == F.col("as_whole"))
    return g.select("doc_id", "paragraph", "line", "family", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"), (F.col("overlap") >= CONFIRMS).alias("confirmed"))
