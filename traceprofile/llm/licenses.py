"""Find licence texts and notices in documents.

Text is normalised (A-Z lowered, anything but a-z, 0-9 and line ends becomes one space)
and cut into units: every line, and every paragraph, as full licence texts are wrapped
over lines. A unit is compared with the licence templates by the Dice coefficient over
their sets of word bigrams, ``2 * common / (a + b)``. For the coefficient to reach ``t``
the sizes must satisfy ``a * t / (2 - t) <= b <= a * (2 - t) / t``; templates outside
these bounds are not compared. A notice that shares its line or paragraph with other text is
found by windows over the words of the whole text, as long as the template, that start at a
bigram of the template; of overlapping windows the most similar stays, and it counts unless
a matching line or paragraph holds it. Windows are not bounded by size, as they have that of
their template. Everything happens inside the row of a document, so no rows are shuffled and
no document is cut.

Most documents hold no licence, and two exact gates tell that early. Whatever matches a
template of ``a`` bigrams has at least ``a * t / (2 - t)`` of them, hence one of any choice of
``a - a * t / (2 - t) + 1``: the ones with the longest words are chosen, and a document without
these words (:func:`gate_words`) is done. In the others the bigrams of the whole text are
counted by template, and units and windows are looked at for templates with enough of them.

Defined results: a NULL or empty text, and a unit of fewer than two words, match nothing.
Ties go to the licence that comes first by name. Repeated rows each get their row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.llm import common as C

MIN_DICE = 0.75

# Wordings of licences and of notices that name them.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and "
        "other kinds of works, specifically designed to ensure cooperation with the community "
        "in the case of network server software.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution "
        "as defined by Sections 1 through 9 of this document.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the terms of the Apache License, Version 2.0.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the terms of the BSD license.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSL-1.0": (
        "SPDX-License-Identifier: BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 "
        "International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by "
        "the terms and conditions of this Creative Commons Attribution 4.0 International "
        "Public License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by "
        "the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International "
        "Public License",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by "
        "the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International "
        "Public License",
    ),
    "EPL-2.0": (
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds "
        "of works.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v2.",
        "Released under the GPL v3.",
        "Licensed under the terms of the GNU General Public License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        "This version of the GNU Lesser General Public License incorporates the terms and "
        "conditions of version 3 of the GNU General Public License, supplemented by the "
        "additional permissions listed below.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
        "SPDX-License-Identifier: MIT",
        "Licensed under the terms of the MIT license.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        "\"Contributor\" means each individual or legal entity that creates, contributes to the "
        "creation of, or owns Covered Software.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software.",
    ),
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(C.lower_ascii(text), "[^a-z0-9\\n]+", " ")


def _lines(clean: str) -> Column:
    return F.split(clean, "\n")


def _paragraphs(clean: str) -> Column:
    return F.split(clean, "\\n ?\\n")


def _pairs(unit: Column) -> Column:
    word = F.array_remove(F.split(unit, " "), "")
    pairs = F.zip_with(word, F.slice(word, 2, F.greatest(F.size(word), F.lit(1))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(pairs)


def _bigrams(unit: Column) -> Column:
    return F.array_distinct(_pairs(unit))


def bigram_set(text: str) -> list[str]:
    """The same set for a template, in Python: templates become literals of the plan."""
    clean = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    return sorted({f"{a} {b}" for a, b in zip(clean, clean[1:])})


def _template_array(templates: Mapping[str, tuple[str, ...]], min_dice: float) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"),
                 F.lit(len(grams)).alias("size"), F.lit(_n_pairs(text)).alias("width"),
                 F.lit(_least_common(len(grams), min_dice)).alias("least"))
        for name, texts in sorted(templates.items()) for text in texts for grams in [bigram_set(text)]
    ])


def _n_pairs(text: str) -> int:
    return max(1, len("".join(c if c.isascii() and c.isalnum() else " " for c in text).split()) - 1)


def _least_common(size: int, min_dice: float) -> int:
    """Bigrams of a template of ``size`` that whatever matches it must have."""
    return math.ceil(size * min_dice / (2 - min_dice) - 1e-9)


def gate_words(templates: Mapping[str, tuple[str, ...]] = TEMPLATES, min_dice: float = MIN_DICE) -> list[str]:
    """Words of which every text that matches a template holds one."""
    found = set()
    for grams in (bigram_set(text) for texts in templates.values() for text in texts):
        longest = sorted(max(g.split(), key=len) for g in grams)
        longest.sort(key=len, reverse=True)
        found |= set(longest[:len(grams) - _least_common(len(grams), min_dice) + 1])
    return sorted(found)


_WINDOW = "struct<start:int,end:int,dice:double,license:string,grams:array<string>>"


def _window_hits(pairs: Column, near: Column, min_dice: float) -> Column:
    """The windows over the bigrams ``pairs`` of a text that match a template of ``near``, none
    overlapping."""
    def of_template(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(pairs)),
                          lambda i: F.array_contains(t["grams"], F.element_at(pairs, i)))

        def window(i: Column) -> Column:
            # the set stands in a lambda of its own, so that it is made once
            return F.transform(
                F.array(F.array_distinct(F.slice(pairs, i, t["width"]))),
                lambda g: F.struct(
                    i.alias("start"), (i + t["width"]).alias("end"),
                    (F.size(F.array_intersect(g, t["grams"])) * 2.0 / (F.size(g) + t["size"])).alias("dice"),
                    t["name"].alias("license"), g.alias("grams"),
                ))[0]

        return F.filter(F.transform(starts, window), lambda w: w["dice"] >= min_dice)

    def keep(kept: Column, w: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (w["start"] > last["end"])
        return F.when(apart, F.concat(kept, F.array(w))).when(
            w["dice"] > last["dice"],
            F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(w)),
        ).otherwise(kept)

    found = F.array_sort(F.flatten(F.transform(near, of_template)))
    none = F.array().cast(f"array<{_WINDOW}>")
    return F.reduce(found, none, keep)


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, min_dice: float = MIN_DICE
) -> DataFrame:
    """``(doc_id, n_units, hits)`` of every document; ``hits`` lists, in order of the text,
    the units that match with ``license`` and ``dice``, the best template of each, then windows."""
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    sizes = [len(bigram_set(t)) for texts in templates.values() for t in texts]
    every = _template_array(templates, min_dice)

    def best(grams: Column) -> Column:
        size = F.size(grams)
        near = F.filter("near", lambda t: (t["size"] >= size * low) & (t["size"] <= size * high))
        rated = F.transform(near, lambda t: F.struct(
            (F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (size + t["size"])).alias("dice"),
            t["name"].alias("license"),
        ))
        good = F.filter(rated, lambda r: r["dice"] >= min_dice)
        return F.reduce(
            good, F.lit(None).cast("struct<dice:double,license:string>"),
            lambda a, r: F.when(a.isNull() | (r["dice"] > a["dice"]), r).otherwise(a),
        )

    # a unit outside the size bounds of all templates is not looked at again
    some_near = lambda g: F.size(g).between(
        int(min(sizes) / high), int(max(sizes) / low) + 1)
    known = F.array(*map(F.lit, sorted({g for ts in templates.values() for t in ts for g in bigram_set(t)})))
    gate = F.array(*map(F.lit, gate_words(templates, min_dice)))
    clean = docs.select("doc_id", normalised(C.whole_text()).alias("clean"))
    one_line = F.translate("clean", "\n", " ")
    passed = clean.select(
        "doc_id", (F.size(_lines("clean")) + F.size(_paragraphs("clean"))).cast("long").alias("n_units"),
        F.when(F.arrays_overlap(F.split(one_line, " "), gate), F.col("clean")).alias("clean"),
    )
    # a CASE computes what stands in it for the documents that come that far only
    pairs = passed.withColumn("pairs", F.when(F.col("clean").isNotNull(), _pairs(one_line)))
    some = F.when(F.col("pairs").isNotNull(), F.array_intersect("pairs", known))
    rows = pairs.withColumn("some", some).withColumn("near", F.when(
        F.size("some") > 0,
        F.filter(every, lambda t: F.size(F.array_intersect("some", t["grams"])) >= t["least"]),
    )).withColumn("go", F.coalesce(F.size("near") > 0, F.lit(False)))
    units = F.concat(_lines("clean"), F.transform(_paragraphs("clean"), lambda p: F.translate(p, "\n", " ")))
    grams = F.filter(F.array_distinct(F.transform(units, _bigrams)), some_near)
    rated = F.filter(
        F.transform(grams, lambda g: F.struct(best(g).alias("best"), g.alias("grams"))),
        lambda r: r["best"].isNotNull())
    found = rows.select(
        "doc_id", "n_units", F.when(F.col("go"), rated).alias("rated"),
        F.when(F.col("go"), _window_hits(F.col("pairs"), F.col("near"), min_dice)).alias("windows"),
    )
    more = F.filter("windows", lambda w: ~F.exists("rated", lambda r: (
        (r["best"]["license"] == w["license"])
        & (F.size(F.array_intersect(w["grams"], r["grams"])) * 4 >= F.size(w["grams"]) * 3))))
    hits = F.concat(F.transform("rated", lambda r: r["best"]),
                    F.transform(more, lambda w: F.struct(w["dice"].alias("dice"), w["license"].alias("license"))))
    none = F.array().cast("array<struct<dice:double,license:string>>")
    return found.select("doc_id", "n_units", F.coalesce(hits, none).alias("hits"))


def license_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_units, n_hits, licenses, best_license, best_dice)`` of every document."""
    best = F.reduce(
        "hits", F.lit(None).cast("struct<dice:double,license:string>"),
        lambda a, r: F.when(
            a.isNull() | (r["dice"] > a["dice"])
            | ((r["dice"] == a["dice"]) & (r["license"] < a["license"])), r).otherwise(a),
    )
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    return scan_licenses(docs).withColumn("best", best).select(
        "doc_id", "n_units", F.size("hits").cast("long").alias("n_hits"),
        F.array_join(names, ",").alias("licenses"),
        F.col("best.license").alias("best_license"), F.col("best.dice").alias("best_dice"),
    )
