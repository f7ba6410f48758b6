"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

A text's units are its lines, its paragraphs (runs of lines between blank lines, where
they have several lines), and the whole text where it has several paragraphs. A unit is
normalised: A-Z in lower case, and every other character than a-z and 0-9 parts words. Its
set of word bigrams is compared to each template's by 2 * shared / (a + b). A score of t
needs a between b * t / (2 - t) and b * (2 - t) / t, so a unit is compared only to the
templates within these bounds, and units outside all of them are dropped by their number
of spaces before any bigram is made.

Defined results. A null, empty or blank text has no unit; a unit of fewer than two words
has no bigram and matches nothing. Each unit gives every template that reaches the
threshold. Repeated rows give their rows each.
Columns that clash with the new ones do not matter: only key and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least score, in hundredths.
LEAST = 80

# Notices and headings by which the licences' own texts ask to be named.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    """The sorted distinct word bigrams of a template."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    words = "".join(c if c in LOWER or c in "0123456789" else " " for c in low).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, least: int) -> tuple[int, int]:
    """Fewest and most bigrams with which a unit can reach the threshold against n."""
    return -(-n * least // (200 - least)), n * (200 - least) // least


def _normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " "))


def units_of(docs: DataFrame, key: str, text: str, fewest: int, most: int) -> DataFrame:
    """(key, row, kind, number, pairs): the units with fewest to most distinct bigrams.

    All of it is worked out inside one array before it is exploded: of columns, Spark
    would copy the expressions into every later filter and work them out again there.
    """
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n[\\x20\\t]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    whole = F.when(F.regexp_like(text, F.lit("\n[\\x20\\t]*\n")), F.array(F.col(text))).otherwise(F.array())
    tagged = lambda units, kind: F.transform(units, lambda u, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), u.alias("unit")))
    with_ = lambda x, name, value: F.struct(x["kind"].alias("kind"), x["number"].alias("number"), value.alias(name))
    units = F.concat(tagged(lines, "line"), tagged(paragraphs, "paragraph"), tagged(whole, "text"))
    # a word and the gap behind it take two characters at least, so n bigrams take 2 * n + 1
    units = F.filter(units, lambda x: F.length(x["unit"]) >= 2 * fewest + 1)
    units = F.transform(units, lambda x: with_(x, "words", F.split(_normal(x["unit"]), " ")))
    units = F.filter(units, lambda x: F.size(x["words"]) > fewest)
    after = lambda w, k: F.slice(w, F.lit(1 + k), F.size(w) - 1)
    units = F.transform(units, lambda x: with_(x, "pairs", F.array_distinct(F.zip_with(after(x["words"], 0), after(x["words"], 1), lambda a, b: F.concat(a, F.lit(" "), b)))))
    units = F.filter(units, lambda x: F.size(x["pairs"]).between(fewest, most))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.monotonically_increasing_id().alias("row"), F.explode(units).alias("u"))
    return rows.select(key, "row", "u.kind", "u.number", "u.pairs")


def matches(docs: DataFrame, templates: dict[str, str] | None = None, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, number, licence, shared, n_unit, n_template, dice) of every unit and template that reach the threshold."""
    sets = {k: bigrams_of(t) for k, t in (templates or TEMPLATES).items()}
    ranges = {k: bounds(len(s), least) for k, s in sets.items()}
    table = [(b, k, len(s), *ranges[k]) for k, s in sorted(sets.items()) for b in s]
    lows, highs = [lo for lo, _ in ranges.values()], [hi for _, hi in ranges.values()]
    # only a unit's bigrams that stand in a template within its bounds go on, so little is shuffled
    rows = units_of(docs, key, text, min(lows), max(highs)).select(key, "row", "kind", "number", F.size("pairs").alias("n_unit"), F.explode("pairs").alias("bigram"))
    hits = rows.join(F.broadcast(_templates(docs.sparkSession, table)), "bigram").where(F.col("n_unit").between(F.col("lo"), F.col("hi")))
    found = hits.groupBy(key, "row", "kind", "number", "n_unit", "licence", "n_template").agg(F.count("*").alias("shared"))
    found = found.where(200 * F.col("shared") >= least * (F.col("n_unit") + F.col("n_template")))
    dice = 2 * F.col("shared") / (F.col("n_unit") + F.col("n_template"))
    return found.select(key, "kind", F.col("number").cast("int").alias("number"), "licence", F.col("shared").cast("int").alias("shared"), "n_unit", "n_template", dice.alias("dice"))


def _templates(spark: SparkSession, table: list[tuple[str, str, int, int, int]]) -> DataFrame:
    """(bigram, licence, n_template, lo, hi): a row for each bigram of each template; the size is that of the templates."""
    rows = F.array(*[F.struct(F.lit(b).alias("bigram"), F.lit(k).alias("licence"), F.lit(n).alias("n_template"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, k, n, lo, hi in table])
    return spark.range(1).select(F.inline(rows))
