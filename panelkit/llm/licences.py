"""Licence scans: Dice coefficient over word bigrams against licence templates.

A unit is a line of a document, or the whole document when it has several lines. Its normalised
text is lower case with everything but letters and digits turned into spaces. A template is
compared only if the two bigram counts allow the wanted coefficient: Dice >= t needs
2 * min(a, b) >= t * (a + b). DataFrame functions only.

Licences that no unit names are then looked for in spans of the normalised whole text, so notices
inside a longer line, wrapped notices and the full texts in licence_texts/ are found in long
documents; each adds one match. A span that a better one overlaps does not count, unless it
holds all of that and more. A span begins and ends with a bigram of the template. For templates of
up to SHORT bigrams all spans within the Dice size bound are compared; for longer ones the span of
the largest running gain (1 - t/2 for a new common bigram, -t/2 for any other new one).

Defined results: null and empty texts have no units and match nothing; units of one word have no
bigrams and are not compared; ties between templates go to the smaller name; repeated rows each
get their own result; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import let

# Least Dice coefficient of a match.
DICE = 0.8

# Most distinct bigrams of a template of which all spans are compared.
SHORT = 64

# Public licence notices, by licence and whether they allow commercial use and closed redistribution.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_bigrams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams) of each template."""
    out = []
    for name, text in templates:
        words = re.sub(r"[^\w]|_", " ", text.lower()).split()
        out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return out


def full_texts() -> list[tuple[str, str]]:
    """(licence, full text) of the files in licence_texts/, in order of name."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as file:
            out.append((name.removesuffix(".txt"), file.read()))
    return out


def _needed(n: int, dice: float) -> int:
    """Least common bigrams of a match with a template of n: 2c >= dice * (n + c)."""
    return next(c for c in range(n + 1) if 2 * c >= dice * (n + c) - 1e-9)


def _least_words(bigrams: list[str], dice: float) -> int:
    """Least number of a template's words in a span that matches it: the bigrams among some words are at most half their degrees."""
    degrees = sorted(Counter(w for b in bigrams for w in b.split()).values(), reverse=True)
    needed = 2 * _needed(len(bigrams), dice)
    return next(m for m, total in enumerate(itertools.accumulate(degrees, initial=0)) if total >= needed)


def _spans(templates: list[tuple[str, str]], dice: float) -> str:
    """SQL text: (d, name) of each licence's best span in bigrams g, without the licences in `named`; `hit` has the templates' words in the text."""
    rows = []
    for (name, b), (_, text) in zip(template_bigrams(templates), templates):
        if b:
            n = len(re.sub(r"[^\w]|_", " ", text.lower()).split()) - 1
            rows.append(f"struct({_quoted(name)} as name, array({', '.join(map(_quoted, b))}) as b, {_needed(len(b), dice)} as need, "
                        f"{_word_bound(b, dice)}, {int(n * (2 - dice) / dice) + 1} as most)")
    of_span = "2D * size(array_intersect(u, t.b)) / (size(array_distinct(u)) + size(t.b))"
    # Hits are positions in order, so at most t.most of them lie within as many places.
    short = let("filter(sequence(0, size(g) - 1), i -> array_contains(c, g[i]))", "h",
                "array_max(flatten(transform(sequence(0, size(h) - 1), k -> transform(filter(slice(h, k + 1, t.most), j -> j < h[k] + t.most), "
                f"j -> struct({let('slice(g, h[k] + 1, j - h[k] + 1)', 'u', of_span)} as d, h[k] as s, j as e)))))")
    start = ("named_struct('i', 0, 's', 0D, 'st', 0, 'seen', cast(array() as array<string>), 'best', 0D, 'bs', 0, 'bn', 0)")
    gain = f"a.s + if(array_contains(a.seen, x), 0D, if(array_contains(c, x), {1 - dice / 2}D, {-dice / 2}D))"
    step = let(gain, "z", "named_struct('i', a.i + 1, 's', greatest(z, 0D), 'st', if(z <= 0, a.i + 1, a.st), 'seen', if(z <= 0, cast(array() as "
               "array<string>), if(array_contains(a.seen, x), a.seen, array_append(a.seen, x))), 'best', greatest(a.best, z), "
               "'bs', if(z > a.best, a.st, a.bs), 'bn', if(z > a.best, a.i - a.st + 1, a.bn))")
    long = let(f"aggregate(g, {start}, (a, x) -> {step})", "v", f"struct({let('slice(g, v.bs + 1, v.bn)', 'u', of_span)} as d, v.bs as s, v.bs + v.bn - 1 as e)")
    nothing = "struct(0D as d, 0 as s, 0 as e)"
    common = let("array_intersect(g, t.b)", "c", f"if(size(c) < t.need, {nothing}, if(size(t.b) <= {SHORT}, {short}, {long}))")
    found = f"filter(transform(filter(ts, t -> t.need <= size(g) and {MAY_MATCH}), t -> struct({common} as p, t.name as name)), x -> x.p.d >= {dice}D)"
    alone = ("filter(f, x -> not array_contains(named, x.name) and not exists(f, y -> y.p.d > x.p.d and y.p.s <= x.p.e and x.p.s <= y.p.e "
             "and not (x.p.s <= y.p.s and y.p.e <= x.p.e and x.p.e - x.p.s > y.p.e - y.p.s)))")
    best = let(found, "f", let(alone, "k", "transform(array_distinct(transform(k, x -> x.name)), n -> "
               "struct(array_max(transform(filter(k, x -> x.name = n), x -> x.p.d)) as d, n as name))"))
    return let(f"array({', '.join(rows)})", "ts", best) if rows else "array()"


# SQL text: the words `hit` allow a match with the template t.
MAY_MATCH = "size(hit) >= t.least and size(array_intersect(t.words, hit)) >= t.least"


def _word_bound(bigrams: list[str], dice: float) -> str:
    """SQL text: the words of a template, and how many of them a match has at least."""
    words = sorted({w for b in bigrams for w in b.split()})
    return f"array({', '.join(map(_quoted, words))}) as words, {_least_words(bigrams, dice)} as least"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, dice: float = DICE,
         full=None) -> DataFrame:
    """One row per document: units, compared pairs, matches, the best licence, its coefficient, and all licences found."""
    tpl = template_bigrams(templates)
    array = "array(" + ", ".join(
        f"struct({_quoted(n)} as name, array({', '.join(map(_quoted, b))}) as b, {_word_bound(b, dice)})" for n, b in tpl) + ")"
    # Most bigrams of a unit that any template can match. A unit of more distinct words than that has more bigrams
    # too, so it is left out before its bigrams are made.
    most = int(max((len(b) for _, b in tpl), default=0) * (2 - dice) / dice) + 1
    words = "filter(split(trim(regexp_replace(lower(u), '[^\\\\p{L}\\\\p{N}]+', ' ')), ' '), x -> x <> '')"
    bigrams = "array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (p, q) -> concat(p, ' ', q)))"
    fits = f"filter(ts, x -> 2 * least(size(g), size(x.b)) >= {dice}D * (size(g) + size(x.b)))"
    # A pair that the words rule out stays below the least coefficient, so its common bigrams are not counted.
    pairs = (f"transform({fits}, t -> struct(if({MAY_MATCH}, 2D * size(array_intersect(g, t.b)) / (size(g) + size(t.b)), 0D) as d, "
             "t.name as name))")
    out = f"if(size(w) < 2 or size(array_distinct(w)) > {most} + 1, array(), {let(bigrams, 'g', pairs)})"
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # No word goes over a line's end, so the words of the whole text are those of its lines.
    docs = docs.withColumn("__lines", lines(F.col("__text"))).withColumn("__lines", F.expr(f"transform(__lines, u -> {words})"))
    docs = docs.withColumn("__units", F.expr("if(size(__lines) > 1, array_append(__lines, flatten(__lines)), __lines)"))
    every = [*templates, *(full_texts() if full is None else full)]
    grams = [b for _, b in template_bigrams(every) if b]
    known = ", ".join(map(_quoted, sorted({w for bigrams in grams for b in bigrams for w in b.split()})))
    hit = f"array_distinct(filter(flatten(__lines), x -> x in ({known})))" if known else "cast(array() as array<string>)"
    docs = docs.withColumn("__hit", F.expr(hit))
    compared = let("__hit", "hit", let("__t", "ts", f"transform(__units, w -> {out})"))
    found = docs.withColumn("__t", F.expr(array)).withColumn("__p", F.expr(f"flatten({compared})"))
    # Spans of the whole text, where its words allow a match with any template.
    least = min((_least_words(b, dice) for b in grams), default=1 << 30)
    spans = let("flatten(__lines)", "w", f"if(size(w) < 2, array(), {let(bigrams_in_order(), 'g', _spans(every, dice))})")
    none = "cast(array() as array<struct<d: double, name: string>>)"
    found = found.withColumn("__named", F.expr(f"transform(filter(__p, x -> x.d >= {dice}D), x -> x.name)")).withColumn("__s", F.expr(let(
        "__hit", "hit", f"if(size(hit) >= {least}, {let('__named', 'named', spans)}, {none})")))
    best = F.array_sort(F.concat(F.filter("__p", lambda x: x["d"] >= dice), "__s"), lambda a, b: F.when(a["d"] > b["d"], -1).when(
        a["d"] < b["d"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    found = found.withColumn("__m", best)
    return found.select(
        "doc_id", F.size("__units").cast("long").alias("n_units"), F.size("__p").cast("long").alias("n_compared"),
        F.size("__m").cast("long").alias("n_matches"), F.get("__m", F.lit(0))["name"].alias("licence"),
        F.get("__m", F.lit(0))["d"].alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__m", lambda x: x["name"]))), ",").alias("licences"),
    )


def bigrams_in_order() -> str:
    """SQL text: all bigrams of the words w, repeated ones too."""
    return "zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (p, q) -> concat(p, ' ', q))"


def lines(text: Column) -> Column:
    """Lines with a letter or digit; these are the units, and the whole text if it has more than one."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[\p{L}\p{N}]"))
