"""License scans: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

Notices are taken from all files, whole texts: the lines and sentences that speak of licences, and, with the
marks of comments stripped and the wrapped lines of a paragraph joined, the sentences of headers. Equal ones are scored
once: terms are weighted by their frequency and by the log of how rare they are among all distinct
notices and templates, and the sparse vectors are multiplied through a join on the term. A template has
terms that a notice must hold (`needs`: the version and what tells a licence from its kin), so a notice without
a version is no notice of a versioned licence. A file's own licence is that of its best notice with a
cosine of at least `LEAST`. A file named like a licence file, or made
up of notices by half of its words or more, speaks for its directory. Files without a licence of
their own take that of the nearest directory above that has one; each directory meets its ancestors
by a join on their paths, once per directory however many files it has.

Defined results: null and empty texts have no notice; a null path has no directory and inherits
nothing; empty names in a path are passed over; of several licences with equal cosine the first name
wins, of several licence files of a directory the best cosine, then the first name. Sentences that several
licences share yield to others by a hundredth. Rows with equal paths are separate files. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoalmap.session import cut

LEAST = 0.5
# Sentences by licence in which files state them, and the terms a notice must hold.
NOTICES = (
    ("MIT", "Released under the MIT License", "mit"),
    ("MIT", "MIT License", "mit license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted free of charge"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
        "hereby granted free of charge",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "apache 2"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "general public 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "general public 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "general public 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "general public 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3", "lesser general public 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1", "lesser general public 2.1"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3", "affero general public 3"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License", "bsd 3 clause"),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
        "neither name endorse promote",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License", "bsd 2 clause"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0", "mozilla public 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License", "attribution 4"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", "cc by 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa 4"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd 4"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", "cc0 1"),
    ("ISC", "Released under the ISC License", "isc"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "hereby granted with or without fee",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("Proprietary", "All rights reserved", "all rights reserved"),
)
# Fixed value: a sentence of several licences, given to the one with least conditions.
SHARED = (
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "redistribution source binary forms",
    ),
)
# Fixed value: the header of the GNU licences by name and version.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_NAMES = (
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
)


def templates() -> list[tuple[str, str, str, float]]:
    """license, text, terms a notice must hold and weight of all templates, with the tag line of each licence."""
    headers = [(name, GNU.format(words, version), f"{words} {version}") for name, words, version in _GNU_NAMES]
    tags = [(name, f"SPDX-License-Identifier: {name}", f"spdx {name}") for name in sorted({n for n, *_ in NOTICES} - {"Proprietary"})]
    return [(*t, 1.0) for t in [*NOTICES, *headers, *tags]] + [(*t, 0.99) for t in SHARED]


SPEAKS = r"(?i)licen[cs]|spdx|public\s+domain|creative\s+commons|\bcc0\b|\bcc[ -]by\b|all\s+rights\s+reserved|hereby\s+granted|redistribution\s+and\s+use|neither\s+the\s+name"
FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
# Marks of comments at the start and end of a line.
MARKS = r"(?m)^[ \t]*(?:[#;%*]+|//+|/\*+|--+|<!--)[ \t]*|[ \t]*(?:\*+/|-->)[ \t\r]*$"
LINES, SENTENCES, PARAGRAPHS = r"[\n\r]+|(?<=[.!?])[ \t]+", r"(?<=[.!?])[ \t]+(?![0-9])", r"\r?\n(?:[ \t]*\r?\n)+"


def terms_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; version numbers keep their points, but no v before and no .0 behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\."), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(w, r"^v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*$", "$1"))


def notices_of(text: Column) -> Column:
    """(notice, joined) of a text: its lines and sentences that speak of licences, and the sentences of its
    paragraphs whose lines are joined."""
    lines = F.filter(F.split(text, LINES), lambda s: s.rlike(SPEAKS))
    whole = F.transform(F.split(F.regexp_replace(text, MARKS, ""), PARAGRAPHS), lambda p: F.regexp_replace(p, r"[ \t]*\r?\n[ \t]*|\r", " "))
    joined = F.filter(F.flatten(F.transform(whole, lambda p: F.split(p, SENTENCES))), lambda s: s.rlike(SPEAKS))
    named = lambda array, flag: F.transform(array, lambda s: F.struct(s.alias("notice"), F.lit(flag).alias("joined")))
    return F.concat(named(lines, False), named(joined, True))


def scored(distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """notice, license and cosine of distinct notices that match a template."""
    spark = distinct.sparkSession
    names = [(k, *t) for k, t in enumerate(templates())]
    shapes = spark.createDataFrame(names, "template int, license string, notice string, needs string, weight double")
    tf = lambda df, *keys: df.select(*keys, F.explode(terms_of(F.col("notice"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    ours, theirs = tf(distinct, "notice"), tf(shapes, "template", "license", "needs", "weight")
    seen = ours.groupBy("term").agg(F.count("*").alias("df")).unionByName(theirs.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    total = distinct.agg(F.count("*").alias("n")).first()["n"] + len(names)
    idf = seen.select("term", (F.log(F.lit(float(total + 1)) / F.col("df")) + 1).alias("idf"))
    ours = ours.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # A row per template and term: bounded by the templates.
    needs = F.array_distinct(terms_of(F.col("needs")))
    theirs = theirs.join(idf, "term").select("template", "license", "weight", "term", (F.col("tf") * F.col("idf")).alias("v"), F.size(needs).alias("needed"), F.array_contains(needs, F.col("term")).cast("int").alias("need"))
    theirs = theirs.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") ** 2).over(Window.partitionBy("template"))))
    norm = ours.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = ours.join(F.broadcast(theirs), "term").groupBy("notice", "template", "license", "weight", "needed").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.sum("need").alias("met"))
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", F.col("template") * -1)).alias("best")
    cosine = F.round(F.col("weight") * F.col("dot") / F.col("norm"), 9)
    found = dots.filter("met = needed").join(norm, "notice").withColumn("cosine", cosine).filter(F.col("cosine") >= least)
    return found.groupBy("notice").agg(best).select("notice", "best.license", "best.cosine")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, with their depth; the root is '' at depth 0."""
    names = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.struct(F.array_join(F.slice(names, 1, k), "/").alias("above"), k.alias("depth")))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """All columns of `files` (path, text) in `rest`, with license, cosine, origin ('own', 'inherited',
    or null) and from_directory."""
    names = F.filter(F.split(F.col("path").cast("string"), "/"), lambda x: x != "")
    directory = F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, F.size(names) - 1), "/"))
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "text"]).alias("rest"), F.col("text").cast("string").alias("text"), directory.alias("directory"), F.element_at(names, -1).alias("name"))
    # Only ids, paths and notices go on; the texts are read once.
    spoken = F.when(F.col("text").rlike(SPEAKS), notices_of(F.col("text")))
    n_words = F.when(spoken.isNotNull(), F.size(terms_of(F.col("text"))))
    rows = cut(rows.select("rest", "directory", "name", spoken.alias("notices"), n_words.alias("n_words"), F.monotonically_increasing_id().alias("_file")), "files")
    said = rows.filter("notices IS NOT NULL").select("_file", "directory", "name", "n_words", F.explode("notices").alias("x")).select("_file", "directory", "name", "n_words", "x.*")
    match = scored(said.select("notice").distinct(), least)
    said = said.join(match, "notice")
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", *_last_first("license"))).alias("best")
    # Lines and joined sentences hold the same words; the kind that matched more of them counts.
    size = F.size(terms_of(F.col("notice")))
    words = F.greatest(F.sum(F.when(F.col("joined"), size)), F.sum(F.when(~F.col("joined"), size))).alias("said")
    own = said.groupBy("_file", "directory", "name", "n_words").agg(best, words)
    own = cut(own.select("_file", "directory", "best.license", "best.cosine", (F.col("name").rlike(FILES) | (2 * F.col("said") >= F.col("n_words"))).alias("speaks")), "own")
    given = own.filter("speaks AND directory IS NOT NULL").groupBy(F.col("directory").alias("above")).agg(best).select("above", F.col("best.license").alias("given"), F.col("best.cosine").alias("given_cosine"))
    up = rows.select("directory").filter("directory IS NOT NULL").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("x")).select("directory", "x.*")
    nearest = up.join(given, "above").groupBy("directory").agg(F.max_by(F.struct("above", "given", "given_cosine"), "depth").alias("nearest"))
    out = rows.join(own.select("_file", "license", "cosine"), "_file", "left").join(nearest, "directory", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "rest",
        F.coalesce("license", "nearest.given").alias("license"),
        F.when(mine, F.col("cosine")).otherwise(F.col("nearest.given_cosine")).alias("cosine"),
        F.when(mine, "own").when(F.col("nearest").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("nearest.above")).alias("from_directory"),
    )


def _last_first(name: str) -> list[Column]:
    """Makes max_by prefer the first name in order among equals."""
    return [F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c))]


def document_files(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Documents as files: a directory per source and language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")
