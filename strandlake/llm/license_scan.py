"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line, every paragraph and the whole text is a sparse vector of word counts weighted by
log((N + 1) / (df + 1)) + 1, where N and df count all texts of the corpus. The best cosine to a
template of THRESHOLD or more names the text's own licence. A text that has the mark of a whole
licence (WHOLE) is compared with it too; if the cosine reaches THRESHOLD and half of the text's words
lie in runs of three of the licence, it is that licence. A text of which half the words lie in lines
or paragraphs that match, or in runs of the whole licence that it is, is a licence file and licenses
its directory, and so is a text that matches as a whole; texts without a licence of their own
take that of the nearest directory above them. Directories are resolved once for each directory,
so a directory with many files costs one look-up per file and no more.

Lines are passed over only where a bound shows that they cannot reach the threshold: words so
common that no template's vector lies to that share within them.

Defined results: null and empty texts have no licence of their own; a null path has no directory
and inherits nothing; where files of one directory name several licences, the better cosine and
then the smaller name counts; rows that repeat get the same result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from strandlake.llm.common import annotate, materialize, quoted
from strandlake.llm.kernels import string_column

THRESHOLD = 0.6
FILE_SHARE = 0.5

#: Short notices under which works are licensed, and openings of licence texts.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: Whole licences: the file in licenses/, and words that this licence has and its relatives lack. The licences CC BY and
#: CC BY-NC share the body of CC BY-SA, and their marks tell them apart.
WHOLE = {
    "Apache-2.0": ("Apache-2.0", "apache license version 2.0 january 2004"),
    "MIT": ("MIT", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    "GPL-3.0": ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    "GPL-2.0": ("GPL-2.0", "gnu general public license version 2 june 1991"),
    "LGPL-3.0": ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    "BSD-3-Clause": ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    "MPL-2.0": ("MPL-2.0", "mozilla public license version 2.0"),
    "CC-BY-4.0": ("CC-BY-SA-4.0", "creative commons attribution 4.0 international public license"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "creative commons attribution-sharealike 4.0 international public license"),
    "CC-BY-NC-4.0": ("CC-BY-SA-4.0", "creative commons attribution-noncommercial 4.0 international public license"),
    "CC0-1.0": ("CC0-1.0", "cc0 1.0 universal"),
    "ISC": ("ISC", "provided that the above copyright notice and this permission notice appear in all copies"),
    "Unlicense": ("Unlicense", "this is free and unencumbered software released into the public domain"),
}
RUN = 3

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def vocabulary() -> frozenset[str]:
    return frozenset(w for forms in TEMPLATES.values() for t in forms for w in words(t))


@cache
def whole_words(file: str) -> tuple[str, ...]:
    return tuple(words((resources.files("strandlake.llm") / "licenses" / f"{file}.txt").read_text("utf-8")))


@cache
def whole_runs(file: str) -> frozenset[tuple[str, ...]]:
    w = whole_words(file)
    return frozenset(w[i : i + RUN] for i in range(len(w) - RUN + 1))


@cache
def whole_vocabulary() -> frozenset[str]:
    return frozenset(w for file, _ in WHOLE.values() for w in whole_words(file))


class Matcher:
    """Cosines of word counts to the templates."""

    def __init__(self, idf: dict[str, float], unknown: float, least: float, whole_idf: dict[str, float] | None = None):
        self.idf, self.unknown, self.least = idf, unknown, least
        self.whole_idf = idf if whole_idf is None else whole_idf
        self.vectors = []
        for name, forms in TEMPLATES.items():
            for t in forms:
                v = {w: n * idf[w] for w, n in Counter(words(t)).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                self.vectors.append((name, {w: x / norm for w, x in v.items()}))
        inside = [0.0] * len(self.vectors)
        common = set()
        for w in sorted(vocabulary(), key=lambda w: (idf[w], w)):
            more = [x + v.get(w, 0.0) ** 2 for x, (_, v) in zip(inside, self.vectors)]
            if max(more) >= (0.99 * least) ** 2:
                break
            inside, _ = more, common.add(w)
        self.rare = vocabulary() - common

    def best(self, counts: Counter) -> tuple[float, str | None]:
        if self.rare.isdisjoint(counts):
            return 0.0, None
        norm = math.sqrt(sum((n * self.idf.get(w, self.unknown)) ** 2 for w, n in counts.items()))
        score, name = 0.0, None
        for t, v in self.vectors:
            s = sum(x * counts[w] * self.idf[w] for w, x in v.items() if w in counts) / norm
            if s > score + 1e-12:
                score, name = s, t
        return score, name

    def best_whole(self, found: list[str], counts: Counter) -> tuple[float, str | None, int]:
        """(cosine, whole licence that the words are, words in its runs)"""
        best, joined = (0.0, None, 0), None
        for name, (file, mark) in WHOLE.items():
            if joined is None:
                joined = f" {' '.join(found)} "
            if f" {mark} " not in joined:
                continue
            weight = lambda c: {w: n * self.whole_idf.get(w, self.unknown) for w, n in c.items()}
            x, y = weight(counts), weight(Counter(whole_words(file)))
            s = sum(v * y[w] for w, v in x.items() if w in y) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if s < self.least or s <= best[0]:
                continue
            runs, covered = whole_runs(file), set()
            for i in range(len(found) - RUN + 1):
                if tuple(found[i : i + RUN]) in runs:
                    covered.update(range(i, i + RUN))
            if len(covered) >= FILE_SHARE * len(found):
                best = (s, name, len(covered))
        return best

    def scan(self, text: str) -> tuple[str | None, float, int, int]:
        """(licence, its cosine, words in what matches, words)"""
        score, name, inside = 0.0, None, 0
        whole, paragraph, n_lines, n_paragraphs, in_lines, every = Counter(), Counter(), 0, 0, 0, []
        for line in [*text.split("\n"), ""]:
            found = words(line)
            every += found
            if found:
                counts = Counter(found)
                s, t = self.best(counts)
                in_lines += len(found) * (s >= self.least)
                score, name = max((score, name), (s, t), key=lambda x: x[0])
                paragraph.update(counts)
                n_lines += 1
            elif paragraph:
                if n_lines > 1:
                    s, t = self.best(paragraph)
                    in_lines = paragraph.total() if s >= self.least else in_lines
                    score, name = max((score, name), (s, t), key=lambda x: x[0])
                inside += in_lines
                whole.update(paragraph)
                n_paragraphs += 1
                paragraph, n_lines, in_lines = Counter(), 0, 0
        total = len(every)
        if n_paragraphs > 1:
            s, t = self.best(whole)
            inside = total if s >= self.least else inside
            score, name = max((score, name), (s, t), key=lambda x: x[0])
        s, t, covered = self.best_whole(every, whole)
        if t:  # it says more than lines, which may name other licences
            return t, s, max(inside, covered), total
        return (name, score, inside, total) if score >= self.least else (None, score, 0, total)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many have each word of the templates."""
    wanted = vocabulary() | whole_vocabulary()

    def run(batches):
        df, n = Counter(), 0
        for b in batches:
            for text in string_column(b.column(0)):
                df.update(wanted.intersection(words(text.as_py())))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*df, ""]), pa.array([*df.values(), n], pa.int64())], names=["w", "n"])

    rows = docs.select(quoted(text_col)).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r.w: r.n for r in rows}  # one row for each word of the templates and whole licences at most
    return counts.pop("", 0), counts


OWN = StructType([StructField("license", StringType()), StructField("score", DoubleType()), StructField("n_license", LongType()), StructField("n_words", LongType())])


def parents(path: Column) -> Column:
    """The directories above a path, the nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(docs: DataFrame, path: Column, text_col: str = "text", keep: list[str] | None = None, least: float = THRESHOLD) -> DataFrame:
    """For each row: a struct `row` of the columns `keep` (by default all), path, license, score, basis
    (own, inherited or null) and license_dir."""
    keep = docs.columns if keep is None else keep
    n, df = document_frequencies(docs, text_col)
    weight = lambda d: math.log((n + 1) / (d + 1)) + 1
    matcher = Matcher({w: weight(df.get(w, 0)) for w in vocabulary()}, weight(0), least, {w: weight(df.get(w, 0)) for w in whole_vocabulary()})

    def fn(column: pa.Array):
        found = [matcher.scan(x.as_py()) for x in column]  # one text at a time
        return [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]

    source = docs.select(F.struct(*[quoted(c) for c in keep]).alias("row"), path.alias("path"), quoted(text_col).alias("text"))
    found, s = annotate(source, "text", OWN, fn, ["row", "path"], "own")
    found = found.select("row", "path", F.col(s)["license"].alias("own"), F.col(s)["score"].alias("score"), (F.col(s)["n_license"] >= FILE_SHARE * F.col(s)["n_words"]).alias("is_file"), F.get(parents(F.col("path")), F.lit(0)).alias("dir"))
    found = materialize(found, "license-own")
    best = F.min(F.struct((-F.col("score")).alias("s"), "own"))["own"]
    licensed = found.where("own is not null and is_file and dir is not null").groupBy("dir").agg(best.alias("license"))
    above = found.where("own is null and dir is not null").select("dir").distinct().withColumn("up", F.explode(F.concat(F.array("dir"), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(parents(F.col("dir"))))))
    nearest = above.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "license"), F.length("up")).alias("near"))
    # Both sides are read from tables, so that Spark can split a directory that holds much of the corpus.
    out = found.join(materialize(nearest, "license-directories"), "dir", "left")
    inherited = F.when(F.col("own").isNull(), F.col("near"))
    basis = F.when(F.col("own").isNotNull(), "own").when(inherited.isNotNull(), "inherited")
    return out.select("row", "path", F.coalesce("own", inherited["license"]).alias("license"), "score", basis.alias("basis"), inherited["up"].alias("license_dir"))
