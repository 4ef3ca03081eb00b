"""Licences of files: lines compared with templates, then inherited along directories.

Every line of every text is compared with licence templates by the cosine of sparse TF-IDF
vectors. A term's weight is ln((1 + N) / (1 + df)), with df and N counted over all texts; terms that no
template has count as never seen. The best template with a cosine of at least ``least`` is the
file's own licence.

A line that has none of a template's heaviest terms, so many that the rest is shorter than
``least`` times the whole, cannot reach ``least``; only lines with such a term are scored,
which changes no result.

A file without a licence takes that of the nearest directory above it with a licence file. All directories
above a file are joined with directories of licence files, and the deepest one stays. The licence files'
side is repeated over a few salts, as one directory may hold most files. Only built-in functions are used.

Defined results: a null or empty text has no licence of its own, a null path no directory; of several licence files in
one directory the highest cosine counts, then the lesser name. Rows with equal ids or paths are judged one by one.
Empty tables give empty results, other columns are not read."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: Licences with customary notices and first lines.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
LEAST = 0.8
SALTS = 16
#: Possessive, as Java's matcher would otherwise go one call deeper for every part of a term.
_TERM = "[a-z0-9]++(?:[.-][a-z0-9]++)*+"
#: Names of files that hold the licence of their directory.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def template_terms() -> list[tuple[str, list[str]]]:
    return [(name, re.findall(_TERM, text.lower())) for name, text in TEMPLATES]


def weights(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """Weights of the templates' terms (their number is fixed) and that of any other term."""
    known = sorted({t for _, words in template_terms() for t in words})
    has = F.array_intersect(terms(F.col(text_col)), F.array(*map(F.lit, known)))
    counted = docs.select(F.explode(F.concat(has, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}
    number = 1 + found.get("", 0)
    return {t: math.log(number / (1 + found.get(t, 0))) for t in known}, math.log(number)


def needed_terms(vector: dict[str, float], least: float) -> set[str]:
    """Heaviest terms of a template without which a line cannot reach the least cosine."""
    whole = math.sqrt(sum(w * w for w in vector.values()))
    kept: set[str] = set()
    for term in sorted(vector, key=lambda t: (-vector[t], t)):
        rest = math.sqrt(sum(w * w for t, w in vector.items() if t not in kept))
        if rest < least * whole * (1 - 1e-9):
            break
        kept.add(term)
    return kept


def own_licence(text: Column, weight: dict[str, float], other: float, least: float) -> Column:
    """Struct (cosine, licence) of the best line and template, or null."""
    vectors = []
    for name, words in template_terms():
        vectors.append((name, {t: words.count(t) * weight[t] for t in words}))
    needed = {t for _, v in vectors for t in needed_terms(v, least)}
    if not needed:
        return F.lit(None).cast("struct<cosine:double,licence:string>")
    any_needed = r"(?i)(?<![a-z0-9])(" + "|".join(sorted(map(re.escape, needed))) + r")(?![a-z0-9])"
    known = F.create_map(*[F.lit(x) for t, w in weight.items() for x in (t, w)])

    def score(line: Column) -> Column:
        words = F.array_sort(terms(line))
        different = F.array_distinct(words)
        count = lambda t: F.size(F.filter(words, lambda w: w == t))
        vector = F.transform(different, lambda t: F.struct(t.alias("t"), (count(t) * F.coalesce(F.element_at(known, t), F.lit(other))).alias("w")))

        def cosines(v: Column) -> Column:
            size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
            best = []
            for name, template in vectors:
                length = math.sqrt(sum(w * w for w in template.values()))
                table = F.create_map(*[F.lit(x) for t, w in template.items() for x in (t, w)])
                dot = F.aggregate(v, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(table, x["t"]), F.lit(0.0)))
                cosine = F.when((size > 0) & (F.lit(length) > 0), F.round(dot / (size * length), 9)).otherwise(F.lit(0.0))
                best.append(F.struct((-cosine).alias("minus"), F.lit(name).alias("licence")))
            return F.array_min(F.array(*best))

        return F.element_at(F.transform(F.array(vector), cosines), 1)

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(any_needed))
    found = F.array_min(F.transform(lines, score))
    scored = F.when(text.rlike(any_needed), found)
    return F.when(scored["minus"] <= -least, F.struct((-scored["minus"]).alias("cosine"), scored["licence"].alias("licence")))


def directories(path: Column) -> Column:
    """All directories above a path, the nearest first, with their depth; the root is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))


def scan(docs: DataFrame, path: Column, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Per row: id, ``path``, ``own`` (licence or null), ``licence`` and ``from_dir`` (where an
    inherited one comes from, else null)."""
    weight, other = weights(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), own_licence(F.col(text_col), weight, other, least).alias("found"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "licences")
    name = F.substring_index("path", "/", -1)
    files = rows.where(F.col("found").isNotNull() & name.rlike(LICENCE_FILE)).select(
        F.expr("substring(path, 1, greatest(char_length(path) - char_length(substring_index(path, '/', -1)) - 1, 0))").alias("dir"),
        F.struct((-F.col("found.cosine")).alias("minus"), F.col("found.licence").alias("licence")).alias("l"))
    holders = files.groupBy("dir").agg(F.min("l").alias("l")).select("dir", F.col("l.licence").alias("given"))
    spread = holders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    bare = rows.where(F.col("found").isNull() & F.col("path").isNotNull()).select("row", F.explode(directories(F.col("path"))).alias("d"))
    above = bare.select("row", "d.depth", "d.dir", F.pmod("row", F.lit(SALTS).cast("bigint")).alias("salt"))
    nearest = above.join(spread, ["dir", "salt"]).groupBy("row").agg(F.max(F.struct("depth", "dir", "given")).alias("n"))
    return rows.join(nearest, "row", "left").select(
        F.col("id").alias(id_col), "path", F.col("found.licence").alias("own"),
        F.coalesce("found.licence", "n.given").alias("licence"), F.col("n.dir").alias("from_dir"))
