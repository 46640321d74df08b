"""Licence scan: Dice coefficient over word bigrams, DataFrame functions only.

A text is normalised (lower case, everything but letters and digits becomes a
space) line by line. Units are its lines and, if it has several, the whole
text. A unit's set is its distinct word bigrams (of one word: that word). A
template matches a unit if 2 * common / (|unit| + |template|) >= ``DICE``.

``op10_licence_windows`` has more units: besides those, all windows of
consecutive words, over line ends, of up to |template| * (2 - d) / d bigrams,
so a notice wrapped over lines or standing in prose is found at any position.
A best window begins and ends with a bigram of the template (else a shorter
one scores higher), so only those are looked at.

Pruning loses nothing. Dice >= d needs
    |template| * d / (2 - d) <= |unit| <= |template| * (2 - d) / d
and a common part of at least |template| * d / (2 - d); so of any
|template| - that + 1 of its bigrams the unit has one. Texts without a word of
those bigrams are dropped before any set is built; a unit is scored only
against templates whose size bounds it meets. Templates are literals in the
plan (a few dozen short texts, or the caller's), so nothing is joined or
broadcast.

Defined results: null, empty and blank texts have no matches; repeated lines
count once a document; ties in Dice are won by the template's name, in
order; repeated rows get a row each; an empty table gives none; only the id
and text columns are read. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

DICE = 0.6
#: Fixed: licence name -> template. Public notices and reference lines.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def _norm(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def templates(given: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(name, bigrams) by name."""
    return [(k, _bigrams(_norm(t))) for k in sorted(given) for t in given[k]]


def _needed(bigrams: list[str], dice: float) -> set[str]:
    """Words of which a matching unit has one: the longest of each bigram in
    the pigeonhole part (the bigrams whose longest word is longest)."""
    least = math.ceil(len(bigrams) * dice / (2 - dice) - 1e-9)
    word = sorted((max(b.split(), key=len) for b in bigrams), key=lambda w: (-len(w), w))
    return set(word[:len(bigrams) - least + 1])


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def _set(words: Column) -> Column:
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(_pairs(words)))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _distinct(found: Column) -> Column:
    return F.size(F.array_distinct(F.transform(found, lambda h: h.gram)))


def _best_window(bigrams: list[str], dice: float) -> Column:
    """Highest Dice of a window of the bigrams ``grams`` whose places of any
    template's bigrams are ``hits``; null if no window can reach ``dice``."""
    n, one = len(bigrams), bigrams[0]
    if " " not in one:  # a template of one word: a window of that word
        return F.when(F.array_contains("words", one), F.lit(1.0))
    least, span = math.ceil(n * dice / (2 - dice) - 1e-9), math.floor(n * (2 - dice) / dice + 1e-9)

    def from_here(run: Column) -> Column:
        def to_here(last: Column, k: Column) -> Column:
            first = F.get(run, F.lit(0)).at
            size = F.size(F.array_distinct(F.slice("grams", first + 1, last.at - first + 1)))
            return _let(_distinct(F.slice(run, F.lit(1), k + 1)), lambda c: F.when(c >= least, 2.0 * c / (size + n)))
        return F.array_max(F.transform(run, to_here))

    def starts(mine: Column) -> Column:
        runs = F.transform(mine, lambda first, k: F.filter(F.slice(mine, k + 1, F.lit(span)), lambda h: h.at < first.at + span))
        return F.array_max(F.transform(F.filter(runs, lambda r: _distinct(r) >= least), from_here))

    return _let(F.filter("hits", lambda h: h.gram.isin(bigrams)), lambda mine: F.when(_distinct(mine) >= least, starts(mine)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dice: float = DICE, given=None,
         windows: bool = False) -> DataFrame:
    """A row per document: doc_id, matches (array of struct licence, dice: the
    best of each matching licence, by licence). ``windows``: the units are also
    all windows of words."""
    known = templates(given or TEMPLATES)
    keys = sorted(set().union(*(_needed(b, dice) for _, b in known)))
    norm = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    near = F.arrays_overlap(F.split("norm", "[ \n]+"), F.array(*map(F.lit, keys)))
    units = F.concat(F.split("norm", "\n"), F.when(F.instr("norm", "\n") > 0, F.array(F.translate("norm", "\n", " "))).otherwise(
        F.array().cast("array<string>")))
    low = min(len(b) for _, b in known) * dice / (2 - dice)
    high = max(len(b) for _, b in known) * (2 - dice) / dice
    words = F.filter(F.transform(units, lambda u: F.split(F.trim(u), " +")),
                     lambda w: (F.size(w) >= max(1, low)) & F.arrays_overlap(w, F.array(*map(F.lit, keys))))
    sets = F.filter(F.transform(words, _set), lambda s: (F.size(s) >= low) & (F.size(s) <= high))
    none = F.array().cast("array<string>")
    flat = F.when(near, F.filter(F.split(F.translate("norm", "\n", " "), " +"), lambda w: w != "")).otherwise(none)
    rows = rows.select("doc_id", F.when(near, sets).otherwise(F.array().cast("array<array<string>>")).alias("sets"),
                       *[flat.alias("words")] * windows)
    if windows:
        every = sorted(set().union(*(b for _, b in known)))
        rows = rows.withColumn("grams", F.when(F.size("words") > 1, _pairs(F.col("words"))).otherwise(none))
        placed = F.transform("grams", lambda g, k: F.when(g.isin(every), F.struct(k.alias("at"), g.alias("gram"))))
        rows = rows.withColumn("hits", F.filter(placed, lambda h: h.isNotNull()))

    def best(name: str, bigrams: list[str]) -> Column:
        n, t = len(bigrams), F.array(*map(F.lit, bigrams))
        fit = F.filter(F.col("sets"), lambda s: (F.size(s) >= n * dice / (2 - dice)) & (F.size(s) <= n * (2 - dice) / dice))
        unit = F.array_max(F.transform(fit, lambda s: 2.0 * F.size(F.array_intersect(s, t)) / (F.size(s) + n)))
        return F.greatest(unit, _best_window(bigrams, dice)) if windows else unit

    per = {}
    for name, bigrams in known:
        per.setdefault(name, []).append(best(name, bigrams))
    found = [F.struct(F.lit(k).alias("licence"), F.array_max(F.array(*v)).alias("dice")) for k, v in per.items()]
    some = F.size("words" if windows else "sets") > 0
    return rows.select("doc_id", F.when(some, F.filter(F.array(*found), lambda m: m.dice >= dice))
                       .otherwise(F.array().cast("array<struct<licence:string,dice:double>>")).alias("matches"))


def op10_licences(spark, sf_dir: str) -> DataFrame:
    """All documents; a row each with its matching licences and the best."""
    return _with_best(scan(table(spark, sf_dir, "documents")))


def op10_licence_windows(spark, sf_dir: str) -> DataFrame:
    """The same with all windows of words as units, at any position."""
    return _with_best(scan(table(spark, sf_dir, "documents"), windows=True))


def _with_best(got: DataFrame) -> DataFrame:
    top = F.array_max(F.transform("matches", lambda m: m.dice))
    return got.select("doc_id", F.size("matches").cast("long").alias("n_licences"),
                      F.array_join(F.transform("matches", lambda m: m.licence), ",").alias("licences"),
                      F.get(F.filter("matches", lambda m: m.dice == top), F.lit(0)).licence.alias("best"),
                      F.round(top, 6).alias("best_dice"))


def oracle_sql(dice: float = DICE) -> str:
    """The same scan without pruning, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, [{', '.join(map(quote, b))}])" for k, b in templates())
    return f"""
WITH known(licence, grams) AS (VALUES {values}),
bodies AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g') AS norm FROM documents),
units AS (SELECT r, unnest(string_split(norm, chr(10))) AS u FROM bodies
    UNION SELECT r, replace(norm, chr(10), ' ') FROM bodies),
words AS (SELECT r, string_split_regex(trim(u), ' +') AS w FROM units WHERE trim(u) <> ''),
sets AS (SELECT DISTINCT r, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
scored AS (SELECT r, licence, max(2.0 * len(list_intersect(s, grams)) / (len(s) + len(grams))) AS dice
    FROM sets JOIN known ON len(s) >= len(grams) * {dice} / (2 - {dice}) AND len(s) <= len(grams) * (2 - {dice}) / {dice}
    GROUP BY r, licence),
best AS (SELECT r, count(*) AS n, string_agg(licence, ',' ORDER BY licence) AS names,
    arg_min(licence, (-dice, licence)) AS best, max(dice) AS top
    FROM scored WHERE dice >= {dice} GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_licences, coalesce(names, '') AS licences, best, round(top, 6) AS best_dice
FROM bodies LEFT JOIN best USING (r)"""
