"""License scans: sparse TF-IDF cosine against license templates, then inheritance down the directory tree.

Every document is a file of a tree; its path comes from its columns. The whole file, its paragraphs, its lines
and its sentences, wrapped ones too, are segments; each is compared with the templates: full texts of
licenses (license_texts/) and the short forms in which headers name or grant one. Terms are lower-cased words
and numbers, weighted by 1 + ln(count) and by inverse document frequency over the templates; a term of
no template has the largest. A segment has a template's license if their cosine reaches THRESHOLD and they
share LEAST terms. A file whose whole text has one is a license file, of that license; else its license is
that of its best segment.

Only texts and segments that can reach THRESHOLD are scored: by Cauchy's inequality, the terms that one shares
with a template must hold THRESHOLD squared of the template's squared length. Equal texts and equal segments
are scored once; all comparing is joins with the few thousand terms of the templates.

A file without a license of its own inherits that of the nearest ancestor directory with a license file, or
with one license that all its own headers agree on, by joins on the path's ancestors, at any depth up to the
root, the directory "". Directories of very many files, of which there are at most HOT, are joined by
broadcast, the others by a shuffle.

Defined cases: null or empty text has no license of its own; a null part of a path is the directory "_";
ties between templates go to the first by name; a directory whose license files disagree gives the most
frequent license, then the first by name; headers that disagree give none; repeated rows get a row each; texts
of one id are files of their own; other columns of the input stay out; only native functions are used.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import checkpointed

#: Short forms in which licenses are named or granted; (license, text).
SHORT_FORMS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction. MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
)
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*+"
THRESHOLD = 0.6
LEAST = 3
#: Directories with more than one in HOT of all files are joined by broadcast: there are at most HOT of them.
HOT = 1000
#: Scored segments are broadcast up to this number, else joined by a shuffle.
MAX_BROADCAST = 200_000


@lru_cache
def templates() -> tuple[tuple[str, str], ...]:
    """(license, text) of all templates, by name; read on the driver."""
    full = ((file.stem, file.read_text()) for file in (Path(__file__).parent / "license_texts").glob("*.txt"))
    return tuple(sorted((*SHORT_FORMS, *full)))


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def idf(spread: int) -> float:
    """Of a term that so many templates have; every template's own terms keep a positive weight."""
    return math.log((2 + len(templates())) / (1 + spread))


@lru_cache
def vocabulary() -> dict[str, tuple[float, list[float]]]:
    """Term -> its idf and its weight in each template, whose vectors have unit length."""
    counts = [terms(text) for _, text in templates()]
    spread = Counter(term for c in counts for term in c)
    found = {term: (idf(n), [0.0] * len(counts)) for term, n in sorted(spread.items())}
    for at, c in enumerate(counts):
        size = math.sqrt(sum(((1 + math.log(n)) * found[t][0]) ** 2 for t, n in c.items()))
        for t, n in c.items():
            found[t][1][at] = (1 + math.log(n)) * found[t][0] / size
    return found


def tree_path(*parts: Column) -> Column:
    """Directories joined by slashes; null parts are '_'."""
    return F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("_")) for p in parts))


def ancestors(directory: Column) -> Column:
    """(directory, distance) of a directory itself and of those above it, nearest first, the root "" last."""
    parts = F.split(directory, "/")
    depth = F.when(directory == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(F.array_join(F.slice(parts, 1, depth - k), "/").alias("directory"), k.alias("distance")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def segments(text: Column) -> Column:
    """The different segments of a text: the whole, paragraphs, lines, and the sentences of the paragraphs."""
    paragraphs = F.split(text, r"[\r\n][ \t\r]*[\r\n]\s*")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.;!?])\s+")))
    return F.array_distinct(F.concat(F.array(text), paragraphs, F.split(text, r"[\r\n]+"), sentences))


def hashed(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def known_terms(spark: SparkSession) -> DataFrame:
    """(term, idf, weights) of the fixed templates, to be broadcast: a few thousand rows."""
    table = json.dumps([{"term": t, "idf": i, "weights": [{"at": k, "w": w} for k, w in enumerate(of) if w]} for t, (i, of) in vocabulary().items()])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(table), "array<struct<term:string,idf:double,weights:array<struct<at:int,w:double>>>>")).alias("v"))
    return F.broadcast(rows.select("v.*"))


def reaching(said: DataFrame, text: str) -> DataFrame:
    """(h1, h2) of those of said (h1, h2, text) that share terms of enough weight with a template."""
    shared = said.select("h1", "h2", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).join(known_terms(said.sparkSession), "term")
    masses = shared.select("h1", "h2", F.explode("weights").alias("v")).groupBy("h1", "h2", "v.at").agg(F.sum(F.col("v.w") * F.col("v.w")).alias("mass"), F.count("*").alias("n"))
    return masses.where((F.col("mass") >= 0.999 * THRESHOLD**2) & (F.col("n") >= LEAST)).select("h1", "h2").distinct()


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most MAX_BROADCAST rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def scored(said: DataFrame) -> DataFrame:
    """(h1, h2, cosine, license) of the different segments said (h1, h2, segment) that have a license."""
    counted = said.select("h1", "h2", F.explode(tokens(F.col("segment"))).alias("term")).groupBy("h1", "h2", "term").agg(F.count("*").alias("n"))
    counted = counted.join(known_terms(said.sparkSession), "term", "left")
    counted = counted.select("h1", "h2", ((1 + F.log(F.col("n").cast("double"))) * F.coalesce("idf", F.lit(idf(0)))).alias("x"), "weights")
    sizes = counted.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = counted.select("h1", "h2", "x", F.explode("weights").alias("v")).groupBy("h1", "h2", "v.at").agg(F.sum(F.col("x") * F.col("v.w")).alias("dot"), F.count("*").alias("shared"))
    names = F.split(F.lit(" ".join(name for name, _ in templates())), " ")
    cosines = dots.where(F.col("shared") >= LEAST).join(sizes, ["h1", "h2"]).select("h1", "h2", F.round(F.col("dot") / F.col("size"), 12).alias("cosine"), (-F.col("at")).alias("first"))
    best = cosines.where(F.col("cosine") >= THRESHOLD).groupBy("h1", "h2").agg(F.max(F.struct("cosine", "first")).alias("b"))
    return best.select("h1", "h2", "b.cosine", F.get(names, -F.col("b.first")).alias("license"))


def own_licenses(texts: DataFrame) -> DataFrame:
    """(h1, h2, own): of each different text (h1, h2, text) with a license of its own, a struct (whole, cosine, license)."""
    candidates = checkpointed(reaching(texts, "text"))
    parts = texts.join(few(candidates), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    parts = parts.select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), F.explode(segments(F.col("text"))).alias("segment")).select("of1", "of2", *hashed("segment"), "segment")
    parts = checkpointed(parts.dropDuplicates(["of1", "of2", "h1", "h2"]))
    wanted = checkpointed(reaching(parts.select("h1", "h2", "segment").dropDuplicates(["h1", "h2"]), "segment"))
    said = parts.join(few(wanted), ["h1", "h2"], "left_semi")
    found = checkpointed(scored(said.select("h1", "h2", "segment").dropDuplicates(["h1", "h2"])))
    whole = (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2"))
    licensed = parts.select("of1", "of2", "h1", "h2", whole.alias("whole")).join(few(found), ["h1", "h2"])
    best = licensed.groupBy("of1", "of2").agg(F.max(F.struct("whole", "cosine")).alias("top"), F.collect_set(F.struct("whole", "cosine", "license")).alias("all"))  # a text's own segments
    names = F.transform(F.filter("all", lambda x: (x["whole"] == F.col("top.whole")) & (x["cosine"] == F.col("top.cosine"))), lambda x: x["license"])
    return best.select(F.col("of1").alias("h1"), F.col("of2").alias("h2"), F.struct("top.whole", "top.cosine", F.array_min(names).alias("license")).alias("own"))


def directory_licenses(files: DataFrame) -> DataFrame:
    """(directory, license): of its license files the most frequent, or else the one that all its headers agree on."""
    votes = files.where(F.col("own").isNotNull()).groupBy("directory", F.col("own.license").alias("license"), F.col("own.whole").alias("whole")).agg(F.count("*").alias("n"))
    best = votes.groupBy("directory").agg(F.max(F.when(F.col("whole"), F.col("n"))).alias("most"), F.countDistinct("license").alias("kinds"), F.min("license").alias("header"))
    named = votes.join(best, "directory").where(F.col("whole") & (F.col("n") == F.col("most"))).groupBy("directory").agg(F.min("license").alias("license"))
    agreed = best.where("most IS NULL AND kinds = 1").select("directory", F.col("header").alias("license"))
    return named.unionAll(agreed)


def nearest_licenses(files: DataFrame) -> DataFrame:
    """(directory, files, near): the nearest giver (distance, giver, license) of each directory that has one."""
    places = files.groupBy("directory").agg(F.count("*").alias("files"))
    above = places.select("directory", "files", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "files", F.col("a.directory").alias("giver"), F.col("a.distance").alias("distance"))
    given = directory_licenses(files).withColumnRenamed("directory", "giver")
    return above.join(given, "giver").groupBy("directory", "files").agg(F.min(F.struct("distance", "giver", "license")).alias("near"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, path, license, cosine, origin, directory) for every document; origin: own, inherited or none."""
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("*", *hashed("text"))
    own = checkpointed(own_licenses(rows.select("h1", "h2", "text")))
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    files = rows.select("doc_id", "path", "h1", "h2", parent.alias("directory")).join(few(own), ["h1", "h2"], "left")
    files = checkpointed(files.select("doc_id", "path", "directory", "own"))
    nearest = checkpointed(nearest_licenses(files))
    large = files.count() // HOT
    hot = F.broadcast(nearest.where(F.col("files") > large).select("directory", "near"))
    rest = nearest.where(F.col("files") <= large).select("directory", "near")
    out = files.join(hot, "directory").unionByName(files.join(hot.select("directory"), "directory", "left_anti").join(rest, "directory", "left"))
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    giver = F.when(F.col("own").isNull(), F.col("near.giver"))
    return out.select("doc_id", "path", F.coalesce("own.license", "near.license").alias("license"), F.col("own.cosine").alias("cosine"), origin.alias("origin"), giver.alias("directory"))
