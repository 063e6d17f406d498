"""License scans by MinHash bands over overlapping text windows (column expressions only).

A text's words are hashed into five-word shingles.  For each size class of templates, windows
slide over the shingles: as long as the class's largest template plus the stride, so that some
window holds a copy wherever it stands.  A window's minimum under each of ``K`` permutations
(hashes xor a constant) is a band of one row; a window that shares a band with a template is
a candidate, and only then the exact containment of the template's distinct shingles is
counted, 0.8 or more being a match.  A window can share a band only if it holds the shingle
with the template's minimum, so minima are taken of the windows around such shingles only.

Guarantee: a window with containment of at least 0.8 has a Jaccard similarity of at least
J = 0.8 t / (W + 0.2 t) with a template of t shingles, W being the window's length, so it
shares none of K bands with probability (1 - J)**K at most; K makes that at most ``MISS``.
Templates of up to four shingles need all of them, windows of their length at every place
have J = 1 there, and one band never misses.

All of it is one expression over a row: nothing is shuffled, and no text leaves its task.

Defined cases: null or empty text, or one of fewer than five words, matches nothing; a
template needs five words or more (others raise an error); repeated rows are scanned each for
itself; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 5
CONTAINED = 0.8
MISS = 1e-3
GROWTH = 1.25
# Public license notices, openings of public license texts, and short license texts whole.
_GNU = "under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {0} International License."
TEMPLATES = {
    "afl-3.0": "Licensed under the Academic Free License version 3.0",
    "agpl-3.0": f"This program is free software: you can redistribute it and/or modify it {_GNU.format('Affero General Public License', 3)}",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                          "License. You may obtain a copy of the License at"),
    "artistic-2.0": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met"),
    "bsd-3-clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                     "this software without specific prior written permission."),
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0": _CC.format("Attribution 4.0"),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": _CC.format("Attribution-NonCommercial-NoDerivatives 4.0"),
    "cc-by-nc-sa-4.0": _CC.format("Attribution-NonCommercial-ShareAlike 4.0"),
    "cc-by-sa-3.0": _CC.replace(" International", " Unported").format("Attribution-ShareAlike 3.0"),
    "cc-by-sa-4.0": _CC.format("Attribution-ShareAlike 4.0"),
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gfdl-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 "
                 "or any later version published by the Free Software Foundation"),
    "gpl-2.0-notice": f"This program is free software; you can redistribute it and/or modify it {_GNU.format('General Public License', 2)}",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": f"This program is free software: you can redistribute it and/or modify it {_GNU.format('General Public License', 3)}",
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    "lgpl-2.1": f"This library is free software; you can redistribute it and/or modify it {_GNU.format('Lesser General Public License', '2.1')}",
    "lgpl-3.0": f"This library is free software; you can redistribute it and/or modify it {_GNU.format('Lesser General Public License', 3)}",
    "mit": "Released under the MIT License.",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
                 "to deal in the Software without restriction"),
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising "
             "from the use of this software."),
}


class SizeClass(NamedTuple):
    """Templates of similar size, and the windows and bands that find them."""

    templates: list[tuple[str, list[int]]]
    window: int
    stride: int
    seeds: list[int]
    minima: list[list[int]]  # of the templates, for each band
    keys: list[int]  # the shingles that have these minima


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of the runs of five words."""
    places = F.when(F.size(w) >= WIDTH, F.sequence(F.lit(0), F.size(w) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.xxhash64(*[F.get(w, p + k) for k in range(WIDTH)]))


def size_classes(spark: SparkSession, templates: dict[str, str]) -> list[SizeClass]:
    """Classes of templates; the number of templates is the caller's."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    known = rows.select("name", F.array_sort(F.array_distinct(let(words(F.col("text")), shingles))).alias("s")).collect()
    if short := [r["name"] for r in known if not r["s"]]:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    groups: dict[int, list[tuple[str, list[int]]]] = {}
    for name, s in sorted(known):
        t = len(s)
        groups.setdefault(t if t < WIDTH else 4 + math.ceil(math.log(t / 4, GROWTH)), []).append((name, list(s)))
    out, rng = [], random.Random(5)
    for _, group in sorted(groups.items()):
        least, most = min(len(s) for _, s in group), max(len(s) for _, s in group)
        stride = 1 if least < WIDTH else max(1, least // 4)
        window = most + stride - 1
        worst = min(1.0 if len(s) < WIDTH else CONTAINED * len(s) / (window + (1 - CONTAINED) * len(s)) for _, s in group)
        bands = 1 if worst == 1 else math.ceil(math.log(MISS) / math.log(1 - worst))
        seeds = [rng.getrandbits(64) - (1 << 63) for _ in range(bands)]
        minima = [sorted({min(x ^ b for x in s) for _, s in group}) for b in seeds]
        out.append(SizeClass(group, window, stride, seeds, minima, sorted({m ^ b for b, ms in zip(seeds, minima, strict=True) for m in ms})))
    return out


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _permuted(b: int, x: Column) -> Column:
    return x.bitwiseXOR(F.lit(b).cast("long"))


def _class_matches(sh: Column, c: SizeClass) -> Column:
    """Array of (license, contained, first_word) of the class's templates found."""
    none = F.array().cast("array<struct<license:string,contained:double,first_word:int>>")

    def starts(p: Column) -> Column:
        """The windows that hold place ``p``."""
        first = F.greatest(F.ceil((p - (c.window - 1)) / c.stride), F.lit(0)).cast("int")
        return F.sequence(first * c.stride, F.floor(p / c.stride).cast("int") * c.stride, F.lit(c.stride))

    def least(window: Column, k: int) -> Column:
        return F.array_min(F.transform(window, partial(_permuted, c.seeds[k])))

    def near(p: Column) -> Column:
        """Whether the window at ``p`` shares a band with a template."""
        window = F.slice(sh, p + 1, c.window)
        out = F.lit(False)
        for k, minima in enumerate(c.minima):
            out = out | least(window, k).isin(*minima)
        return out

    def held(own: Column, p: Column) -> Column:
        return F.struct((-F.size(F.array_intersect(F.slice(sh, p + 1, c.window), own))).alias("n"), p.alias("p"))

    def verified(places: Column) -> Column:
        found = []
        for name, s in c.templates:
            need = math.ceil(CONTAINED * len(s) - 1e-9)
            each = F.transform(places, partial(held, _longs(s)))
            best = F.array_min(each)  # most shingles, then the first place
            one = F.struct(F.lit(name).alias("license"), (-best["n"] / F.lit(float(len(s)))).alias("contained"), best["p"].alias("first_word"))
            found.append(F.when(-best["n"] >= need, F.array(one)).otherwise(none))
        return F.concat(*found)

    # a window's minimum is a template's only if it holds the shingle that has this minimum
    places = F.filter(F.sequence(F.lit(0), F.size(sh) - 1), lambda p: F.get(sh, p).isin(*c.keys))
    windows = let(places, lambda ps: F.filter(F.array_distinct(F.flatten(F.transform(ps, starts))), near))
    some = let(windows, lambda ws: F.when(F.size(ws) > 0, verified(ws)).otherwise(none))
    return F.when(F.arrays_overlap(sh, _longs(c.keys)), some).otherwise(none)


def license_matches(text: Column, classes: list[SizeClass]) -> Column:
    """Array of (license, contained, first_word), by license."""
    none = F.array().cast("array<struct<license:string,contained:double,first_word:int>>")
    every = _longs(sorted({k for c in classes for k in c.keys}))
    found = lambda sh: F.array_sort(F.concat(*[_class_matches(sh, c) for c in classes]))
    return let(let(words(text), shingles), lambda sh: F.when(F.arrays_overlap(sh, every), found(sh)).otherwise(none))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, matches."""
    classes = size_classes(docs.sparkSession, TEMPLATES if templates is None else templates)
    return docs.select(F.col(id_col).alias("doc_id"), license_matches(F.col(text_col), classes).alias("matches"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join("matches.license", ",").alias("licenses"),
                      F.coalesce(F.array_max("matches.contained"), F.lit(0.0)).alias("contained"))


def _oracle() -> str:
    names = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))
    cut = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT name, {cut.format('text')} AS w FROM (VALUES {names}) v(name, text)),
ts AS (SELECT DISTINCT name, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS p FROM t)),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT doc_id, {cut.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, p - 1 AS p, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
hits AS (SELECT doc_id, name, n, p, ts.s, CASE WHEN n < 5 THEN 1 ELSE greatest(1, n // 4) END AS stride FROM ds JOIN ts ON ds.s = ts.s JOIN tn USING (name)),
wins AS (SELECT doc_id, name, n, s, unnest(range(CAST(greatest(0, ceil((p - n - stride + 2) / stride)) AS BIGINT), p // stride + 1)) AS k FROM hits),
got AS (SELECT doc_id, name, max(c / n) AS contained FROM (SELECT doc_id, name, n, k, count(DISTINCT s) AS c FROM wins GROUP BY ALL)
        WHERE c >= ceil(0.8 * n - 1e-9) GROUP BY ALL),
per AS (SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses, max(contained) AS contained FROM got GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, CAST(coalesce(contained, 0) AS DOUBLE) AS contained
FROM d LEFT JOIN per USING (doc_id)
"""


ORACLE = _oracle()
