"""License scans with DataFrame functions only.

Files are compared with licence templates by the cosine of sparse TF-IDF
vectors; inverse document frequencies come from the whole corpus, for terms of the
templates; a term that no template has weighs as one that no file has.  Templates
are of two kinds.

Notices and titles take one line, so each line is compared with them.  A line
can only reach the threshold if it holds one of a few *anchor* terms: the
heaviest terms of each template, as many as are needed to push the norm of the
rest below the threshold (by Cauchy and Schwarz the rest alone cannot reach
it).  So only anchor lines are split into words and scored.

Full texts and usual headers run over lines.  Whole files, their first terms
(the header block), and windows of a template's length in terms are compared with them.
A file can only reach the threshold if it holds enough distinct terms of the template
(as many as its heaviest ones need, by Cauchy and Schwarz again).  In such a
file windows lie where a rare term of the template puts the template's begin.

Files without a licence of their own take that of the nearest ancestor
directory that holds a licence file, by joining paths level by level.
"""

from __future__ import annotations

import math
import pkgutil
import re
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

# One-line notices of common licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Other one-line notices and titles.
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-1.0-or-later", "GNU GENERAL PUBLIC LICENSE"),
    ("ISC", "ISC License"),
    ("LGPL-2.0-or-later", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "The Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "zlib License"),
]
#: Licences whose full text is a file of this name under ``licenses``.
FULL_TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1",
              "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
_GNU = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published "
        "by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
# Usual headers of source files.
HEADERS = [
    ("AGPL-3.0", _GNU.format(what="program", name="Affero General Public License", version="3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                   'by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", _GNU.format(what="program", name="General Public License", version="2")),
    ("GPL-3.0", _GNU.format(what="program", name="General Public License", version="3")),
    ("LGPL-2.1", _GNU.format(what="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser General Public License", version="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: A tag that names the licence itself.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)"

#: Least cosine of a line, file or window and a template.
LEAST_COSINE = 0.75
#: Square of the least cosine, less what rounding may take.
LEAST_SQUARE = (LEAST_COSINE * 0.999) ** 2
#: Rarest terms of a template that place windows, with so many of their places in it.
SEEDS, SEED_PLACES = 24, 4
#: Windows that overlap at one term, at most.
OVERLAP = 16
#: Base names of files whose licence holds for their directory.
LICENSE_FILE = r"^(?i)(licen[cs]e|copying|notice)([._-].*)?$"
_TERM = r"[^a-z0-9]+"


def _terms(text):
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), _TERM), lambda w: w != "")


def template_weights(docs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(license, term, weight of unit norm, anchor), (term, idf) and the idf of
    a term that no template has.  ``docs``: (row, text).

    The tables have a row per template term: their size depends on the
    templates alone."""
    counted = templates.select("license", F.explode(_terms(F.col("text"))).alias("term")) \
        .groupBy("license", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = [r.term for r in counted.select("term").distinct().orderBy("term").collect()]
    words = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.split(F.lower("text"), _TERM))
    seen = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.count()
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    idfs = stored(counted.select("term").distinct().join(seen, "term", "left").select("term", idf.alias("idf")), "idf")
    by = Window.partitionBy("license")
    w = counted.join(idfs, "term").withColumn("w", F.col("tf") * F.col("idf")) \
        .withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by)))
    lighter = by.orderBy("weight", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("upto", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(lighter))) \
        .withColumn("anchor", F.col("upto") >= LEAST_COSINE * 0.999)
    return stored(w.select("license", "term", "weight", "anchor"), "templates"), idfs, math.log(total + 1.0) + 1.0


def block_templates() -> list[tuple[str, str, str]]:
    """(template, license, text) of full texts and headers; ``template`` is the license with "text" or a number."""
    texts = [(f"{x} text", x, pkgutil.get_data(__package__, f"licenses/{x}.txt").decode()) for x in FULL_TEXTS]
    gpl = next(t for _, x, t in texts if x == "GPL-3.0")
    agpl = re.sub(r"(?i)\b(GNU)(\s+)(General Public License)", r"\1\2Affero \3", re.sub(r"(?i)\bGNU Affero\b", "GNU", gpl))
    texts.append(("AGPL-3.0 text", "AGPL-3.0", agpl))  # the GPL's words but for the name, and so apart from it by the name alone
    return texts + [(f"{x} {i}", x, t) for i, (x, t) in enumerate(HEADERS)]


def scan_blocks(docs: DataFrame, templates: list[tuple[str, str, str]]) -> DataFrame:
    """(row, text) -> (row, license, full, cosine): for every row that reaches LEAST_COSINE
    with a template as a whole, at its beginning or in a window, its best one: full
    texts (``full`` is 0) before headers (1), then cosine (ties: first by name).

    Terms weigh (1 + ln tf) x idf.  Lists collected here are of the templates
    alone; ``docs`` is split into words with one row for each template that a
    file may reach."""
    spark = docs.sparkSession
    split = {key: [w for w in re.split(_TERM, text.lower()) if w] for key, _, text in templates}
    vocabulary = sorted({w for ws in split.values() for w in ws})
    words = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.split(F.lower("text"), _TERM))
    # the words of each text that templates hold
    held = stored(docs.select("row", words.alias("words")).filter(F.size("words") > 0), "held")
    df = {r.term: r.df for r in held.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    total = docs.count()
    idf = {w: math.log((total + 1.0) / (df.get(w, 0) + 1.0)) + 1.0 for w in vocabulary}
    weights, seeds, tests, about, anchors = [], [], [], [], set()
    for key, name, _ in templates:
        ws = split[key]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(ws):
            places.setdefault(w, []).append(i)
        w = {t: (1 + math.log(len(at))) * idf[t] for t, at in places.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        heavy = sorted(w, key=lambda t: (-w[t], t))
        weights += [(key, t, x / norm) for t, x in w.items()]
        seeds += [(key, t, i) for t in sorted(w, key=lambda t: (-idf[t], t))[:SEEDS] for i in places[t][:SEED_PLACES]]
        upto = list(accumulate((w[t] / norm) ** 2 for t in heavy))
        need = 1 + sum(x < LEAST_SQUARE for x in upto)
        rare = heavy[: 1 + sum(x <= 1 - LEAST_SQUARE for x in upto)]  # without one of these the rest does not suffice
        anchors.update(rare)
        tests.append(F.when(F.arrays_overlap("words", F.array(*[F.lit(t) for t in rare])) & (
            F.size(F.array_intersect("words", F.array(*[F.lit(t) for t in heavy]))) >= need), F.lit(key)))
        about.append((key, name, int(not key.endswith(" text")), len(ws), max(1, len(ws) // OVERLAP)))
    weights = F.broadcast(spark.createDataFrame(weights, "template string, term string, weight double"))
    seeds = F.broadcast(spark.createDataFrame(seeds, "template string, term string, at int"))
    about = F.broadcast(spark.createDataFrame(about, "template string, license string, full int, size int, step int"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    may = held.filter(F.arrays_overlap("words", F.array(*[F.lit(t) for t in sorted(anchors)]))) \
        .select("row", "words", F.explode(F.array_compact(F.array(*tests))).alias("template"))
    # the exact bound: the template's weight on the terms that the file holds
    may = may.select("row", "template", F.explode("words").alias("term")).join(weights, ["template", "term"]) \
        .groupBy("row", "template").agg(F.sum(F.col("weight") * F.col("weight")).alias("square")).filter(F.col("square") >= LEAST_SQUARE)
    may = stored(may.join(about, "template").select("row", "template", "size", "step"), "may")
    terms = docs.join(may.select("row").distinct(), "row").select("row", F.posexplode(_terms(F.col("text"))).alias("pos", "term"))
    placed = stored(terms.join(may, "row"), "placed")
    start = F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - F.col("at")) / F.col("step")) * F.col("step")).cast("int")
    starts = placed.join(seeds, ["template", "term"]).select("row", "template", start.alias("start")) \
        .unionByName(may.select("row", "template", F.lit(0).alias("start"))).distinct()
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - F.col("size")) / F.col("step")) + 1).cast("int")
    inside = placed.withColumn("k", F.explode(F.sequence(low, F.floor(F.col("pos") / F.col("step")).cast("int")))) \
        .select("row", "template", "term", (F.col("k") * F.col("step")).alias("start")).join(starts, ["row", "template", "start"])
    whole = placed.select("row", "template", "term", F.lit(-1).alias("start"))
    counted = inside.unionByName(whole).groupBy("row", "template", "start", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = (1 + F.log("tf")) * F.coalesce("idf", F.lit(math.log(total + 1.0) + 1.0))
    scored = counted.join(idfs, "term", "left").withColumn("w", w).join(weights, ["template", "term"], "left") \
        .groupBy("row", "template", "start").agg((F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("cosine")) \
        .filter(F.col("cosine") >= LEAST_COSINE).join(about.select("template", "license", "full"), "template")
    best = scored.groupBy("row").agg(F.min(F.struct("full", (-F.round("cosine", 9)).alias("c"), "license")).alias("b"))
    return best.select("row", F.col("b.license").alias("license"), F.col("b.full").alias("full"), (-F.col("b.c")).alias("cosine"))


def scan_lines(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, text) -> (row, line_no, license, cosine): every line that reaches
    LEAST_COSINE with a template, with its best one (ties: first by name).  What
    follows a tab in ``license`` tells templates of one licence apart."""
    weights, idfs, other = template_weights(docs, templates)
    anchors = [r.term for r in weights.filter("anchor").select("term").distinct().orderBy("term").collect()]
    if not anchors:
        return docs.sparkSession.createDataFrame([], "row long, line_no int, license string, cosine double")
    has = r"(?i)(?<![a-z0-9])(?:" + "|".join(anchors) + r")(?![a-z0-9])"
    lines = docs.filter(F.col("text").rlike(has)).select("row", F.posexplode(F.split("text", r"\n|\r")).alias("line_no", "line")) \
        .filter(F.col("line").rlike(has))
    terms = lines.select("row", "line_no", F.explode(_terms(F.col("line"))).alias("term")) \
        .groupBy("row", "line_no", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = F.col("tf") * F.coalesce("idf", F.lit(other))
    terms = stored(terms.join(idfs, "term", "left").select("row", "line_no", "term", w.alias("w")), "lineterms")
    norms = terms.groupBy("row", "line_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(weights, "term").groupBy("row", "line_no", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, ["row", "line_no"]).select("row", "line_no", "license", (F.col("dot") / F.col("norm")).alias("cosine")) \
        .filter(F.col("cosine") >= LEAST_COSINE)
    best = cosines.groupBy("row", "line_no").agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "license")).alias("b"))
    return best.select("row", "line_no", F.substring_index("b.license", "\t", 1).alias("license"), (-F.col("b.c")).alias("cosine"))


def scan_tags(docs: DataFrame) -> DataFrame:
    """(row, text) -> (row, line_no, license, cosine): lines with an SPDX tag; the licence is the tag's expression, the cosine 1."""
    lines = docs.filter(F.col("text").rlike("(?i)SPDX-License-Identifier:")) \
        .select("row", F.posexplode(F.split("text", r"\n|\r")).alias("line_no", "line"))
    return lines.select("row", "line_no", F.regexp_extract("line", SPDX, 1).alias("license"), F.lit(1.0).alias("cosine")).filter("license != ''")


def _parent(path):
    """Directory of a path; the root is ''."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text",
                 templates: dict[str, str] | None = None, keep: tuple[str, ...] = (),
                 blocks: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(path, license, cosine, n_lines, license_from, + keep) for every row.

    ``license`` is that of the best full text in the file; else that of its SPDX
    tags (ties: first by name); else of its best header; else of its best line
    (ties: first by name); with ``license_from`` the path itself; else that of the nearest ancestor
    directory that holds a licence file (LICENSE, COPYING, NOTICE, with or
    without suffix) with a detected licence, with ``license_from`` that
    directory ('' is the root) and a null cosine; else null.  Of several
    licence files in a directory the best cosine counts, then the smallest
    licence name.  ``n_lines`` counts the file's own licence lines.  Null
    texts have no line; a null path has no ancestor.  Repeated rows each
    get a row, an empty table gives none.  Texts are read whole, whatever their length.
    Columns other than ``keep`` are ignored, whatever their names.  ``files`` is read more
    than once, so must be stable."""
    spark = prepare(files.sparkSession)
    notices = sorted(templates.items()) if templates else sorted(TEMPLATES.items()) + [(f"{k}\t{i}", t) for i, (k, t) in enumerate(TITLES)]
    frame = spark.createDataFrame(notices, "license string, text string")
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(path_col).alias("path"),
                        F.col(text_col).alias("text"), *keep)
    texts = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    # kinds by rank: full texts 0, tags 1, headers 2, notices 3; a tagged line counts once
    tags = scan_tags(texts).withColumn("rank", F.lit(1))
    notes = scan_lines(texts, frame).withColumn("rank", F.lit(3)).join(tags.select("row", "line_no"), ["row", "line_no"], "left_anti")
    blocks_ = scan_blocks(texts, blocks or block_templates()).select(
        "row", F.lit(None).cast("int").alias("line_no"), "license", "cosine", (2 * F.col("full")).alias("rank"))
    found = tags.unionByName(notes).unionByName(blocks_)
    own = found.groupBy("row").agg(F.count("line_no").alias("n_lines"), F.min(F.struct("rank", (-F.col("cosine")).alias("c"), "license")).alias("b")) \
        .select("row", "n_lines", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    told = stored(rows.select("row", "path", *keep).join(own, "row", "left"), "licenses")
    base = F.regexp_extract("path", r"[^/]*$", 0)
    dirs = told.filter(F.col("license").isNotNull() & base.rlike(LICENSE_FILE)).groupBy(_parent(F.col("path")).alias("dir")) \
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("dir", F.col("b.license").alias("license"))
    # each directory that lacks an answer -> its ancestors, nearest first
    lacking = told.filter("license is null and path is not null").select(_parent(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    steps = lacking.select("home", F.posexplode(above).alias("depth", "dir"))
    nearest = steps.join(dirs, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "license")).alias("b")) \
        .select("home", F.col("b.dir").alias("from_dir"), F.col("b.license").alias("inherited"))
    out = told.withColumn("home", F.when(F.col("license").isNull(), _parent(F.col("path")))).join(nearest, "home", "left")
    return out.select("path", F.coalesce("license", "inherited").alias("license"), "cosine",
                      F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
                      F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("from_dir")).alias("license_from"), *keep)
