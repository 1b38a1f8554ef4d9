"""The training-data operators against brute force, with the awkward rows: null
ids and texts, empty and long texts, repeated rows, extra columns, empty tables."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from importlib.metadata import distribution
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import common, decontaminate, jaccard_join, language_id, token_store
from reviewloom.llm.arc_to_warc import ArcRecord, arc_header, arc_record, members, pages_to_warc, read_arc, read_warc, sha1_base32, warc_record
from reviewloom.llm.block_naming import exact_duplicates
from reviewloom.llm.common import BATCH_BYTES, MIN_SPLITS, id_remainder, prepare, scratch_path, shingle_set, word_count
from reviewloom.llm.compression_quality import PIECE, SAMPLE_BYTES, SPREAD, _samples, classify_quality
from reviewloom.llm.decontaminate import contamination
from reviewloom.llm.jaccard_join import jaccard_components
from reviewloom.llm.language_id import characters, identify_languages
from reviewloom.llm.license_scan import TEMPLATES, license_scan
from reviewloom.llm.mixing import mix_sources, mixed_rows
from reviewloom.llm.pii_bootstrap import find_personal_data
from reviewloom.llm.token_store import EliasFano, TokenFile, WordCache, ef_encode, encode_documents, encode_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def frame(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------ Jaccard join --
def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, n, num):
    rng = random.Random(n)
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO\x0bWORDS", "é É", "é é", "x " * 30]
    for family in range(6):  # families of copies with more and more changed words
        base = words(rng, rng.choice([30, 80, 300]))
        for k in range(14):
            w = list(base)
            for _ in range(k if family else rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(2)]))
        texts += [texts[-1]] * 3
    texts += [" ".join(words(rng, 40)) for _ in range(40)]
    docs = frame(spark, texts).withColumn("id", F.lit("clash")).withColumn("cid", F.lit(1))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n=n, num=num).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, num, 100)


def test_jaccard_awkward_ids(spark):
    t = " ".join(f"a{i}" for i in range(50))
    rows = [(None, t), (7, t), (7, t), (3, t + " z"), (None, None), (None, "lonely text here"), (9, "lonely text there")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == Counter(
        [(None, 48, 3), (7, 48, 3), (7, 48, 3), (3, 49, 3), (None, 0, None), (None, 1, None), (9, 1, 9)])
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_of_long_and_odd_texts():
    long = " ".join(str(i) for i in range(300_000))  # more than one chunk
    assert len(shingle_set(long, 3)) == 299_998
    assert set(shingle_set(long, 3)) >= set(shingle_set(long[1_000_000:1_010_000].split(" ", 1)[1].rsplit(" ", 1)[0], 3))
    assert len(shingle_set("a b", 3)) == 1 and shingle_set("A B", 3) == shingle_set("a\nb", 3)
    assert shingle_set("a b", 3) != shingle_set("b a", 3)
    assert len(shingle_set("x" * 3_000_000, 3)) == 1
    assert len(shingle_set("a\x00b c d e", 1)) == 3  # only ASCII white space cuts


# ------------------------------------------------------------- exact dedup --
def test_exact_duplicates_blocks(spark):
    base = "abcdefgh" * 5
    texts = [base, base, base[:-1], base + "x", base[:16] + "Z" + base[17:], "", None, base[:8], base[:8], "é" * 9, "é" * 9, base]
    docs = frame(spark, texts).withColumn("row", F.lit(0)).withColumn("name", F.lit("n"))
    got = {r.id: r for r in exact_duplicates(docs, block=8).collect()}  # up to six blocks, odd numbers too
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_duplicates_awkward_ids(spark):
    rows = [(None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b"), (1, "c")]
    got = Counter((r.id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, False), (None, None, 2, True), (None, None, 2, False), (1, 1, 1, True)])
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ mixing --
def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit >= cap * sizes[s]}
        if not over:
            return out | {s: w[s] * unit for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_sources(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "a", "B", "é", None, "tiny"]), 0) for i in range(3000)]
    rows = [r if r[3] != "tiny" or r[0] % 40 == 0 else (*r[:3], "a", 0) for r in rows] + [(10**6, None, "en", "empty", 0), (10**6 + 1, "  ", "en", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit(0)).withColumn("s", F.lit("x"))
    got = mix_sources(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 60
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs.repartition(3)).collect()), key=str)
    mixed = Counter(r.doc_id for r in mixed_rows(docs).collect())
    assert mixed == Counter({r.id: r.copies for r in got if r.copies})
    assert mixed_rows(docs).columns == docs.columns
    for name in sizes:  # no single document more would come nearer, nor does one less
        mine = [r for r in got if r.source == name]
        low = min(r.copies for r in mine)
        gap = target[name] - taken[name]
        assert all(abs(gap - r.size) >= abs(gap) - 1 for r in mine if r.copies == low and low < 3)
    empty = spark.createDataFrame([], DOCS)
    assert mix_sources(empty).count() == 0 and mixed_rows(empty).count() == 0


@pytest.mark.parametrize("place", [0, 150, 299])
def test_mix_with_a_document_above_the_budget(spark, place):
    """A very long document anywhere in hash order costs no more than the best single step."""
    ids = spark.range(300).orderBy(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 15)).toPandas()["id"].tolist()
    size = {i: 10 for i in range(300)} | {ids[place]: 20_000}
    rows = [(i, "w " * n, "en", "a", 0) for i, n in size.items()] + [(None, f"x{i} " * 50, "en", "b", 0) for i in range(600)] + [(1000, "c " * 60_000, "en", "c", 0)]
    got = mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    # a: with all short documents, the long one is taken if that comes nearer; b: rows without id are told apart by their texts
    gap = target["a"] % 22_990 - 2_990
    assert gap > 0 and abs(target["a"] - taken["a"]) <= min(gap, abs(gap - 20_000)) + 1
    assert abs(target["b"] - taken["b"]) <= 50 and len({r.copies for r in got if r.source == "b"}) == 2


def test_scan_splits_stay_as_first_set(spark):
    prepare(spark)
    first = spark.conf.get(MIN_SPLITS)
    assert int(first) >= 1
    try:
        spark.conf.set(MIN_SPLITS, "37")
        prepare(spark)  # a deployment's own number holds
        assert spark.conf.get(MIN_SPLITS) == "37"
    finally:
        spark.conf.set(MIN_SPLITS, first)


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "a\x0b\x0cb\r\nc", " ", "a b c"]
    got = [r.n for r in frame(spark, texts).orderBy("doc_id").select(word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# ---------------------------------------------------------------- licences --
def test_license_scan(spark):
    mit = TEMPLATES["MIT"]
    files = [("r/LICENSE", f"intro\n{mit}\nmore"), ("r/a/b/x.py", "no words of the kind"), ("r/a/LICENSE.txt", "# " + TEMPLATES["Apache-2.0"].upper()),
             ("r/c.py", f"// {TEMPLATES['GPL-3.0']}"), ("r/c/d.py", None), ("q/z.py", ""), (None, "text"), ("r/a/b/x.py", "no words of the kind"),
             ("r/e.py", "the license of the work is under the public eye of many a general, said " * 3)]
    files = spark.createDataFrame(files, "path string, text string").withColumn("row", F.lit(1)).withColumn("license", F.lit("z")).drop("license")
    got = Counter((r.path, r.license, r.license_from) for r in license_scan(files).collect())
    assert got == Counter([("r/LICENSE", "MIT", "r/LICENSE"), ("r/a/b/x.py", "Apache-2.0", "r/a"), ("r/a/b/x.py", "Apache-2.0", "r/a"),
                           ("r/a/LICENSE.txt", "Apache-2.0", "r/a/LICENSE.txt"), ("r/c.py", "GPL-3.0", "r/c.py"), ("r/c/d.py", "MIT", "r"),
                           ("q/z.py", None, None), (None, None, None), ("r/e.py", "MIT", "r")])
    assert license_scan(files.limit(0)).count() == 0


def test_license_scan_real_files(spark):
    def installed(package, name):
        """A real licence file of an installed package."""
        (f,) = [f for f in distribution(package).files if str(f).endswith(name)]
        return f.read_text()

    mit, apache, bsd = installed("pluggy", "LICENSE"), installed("requests", "LICENSE"), installed("idna", "LICENSE.md")
    header = """#!/usr/bin/perl
# Copyright (C) 1999 Some One
#
# This is free software: you can redistribute it and/or
# modify it under the terms of the GNU General Public
# License as published by the Free Software
# Foundation, either version 3 of the License, or (at
# your option) any later version.
#
# It is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied
# warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
# PURPOSE.  See the GNU General Public License for more details.
""" + "print 1;\n" * 60
    rng = random.Random(5)
    noise = [" ".join(words(rng, 60)) + " the of and to this is in or" for _ in range(40)]
    files = {"a/LICENSE": mit, "b/LICENSE": apache, "c/LICENSE": bsd, "d/x.pl": header, "e/x.c": "// SPDX-License-Identifier: Apache-2.0\nint x;",
             "f/x.c": "MIT License", "g/x.c": "/* SPDX-License-Identifier: Zlib OR MIT */", "a/b/y.c": "int y;",
             "h/x.txt": " ".join(words(rng, 900)) + "\n" + mit + " ".join(words(rng, 900))} | {f"n/{i}": t for i, t in enumerate(noise)}
    frame_ = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r.path: r.license for r in license_scan(frame_).collect()}
    want = {"a/LICENSE": "MIT", "b/LICENSE": "Apache-2.0", "c/LICENSE": "BSD-3-Clause", "d/x.pl": "GPL-3.0", "e/x.c": "Apache-2.0",
            "f/x.c": "MIT", "g/x.c": "Zlib OR MIT", "a/b/y.c": "MIT", "h/x.txt": "MIT"}
    assert got == want | {f"n/{i}": None for i in range(40)}


# --------------------------------------------------------- decontamination --
def brute_contamination(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, ids = find(text), set(), set()
    for item, t in items:
        v = find(t)
        k = min(window, len(v))
        grams = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in grams:
                hit.update(range(i, i + k))
                ids |= {str(item)} - {"None"}
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most_bytes", [1 << 24, 4000])
def test_contamination(spark, most_bytes):
    rng = random.Random(1)
    items = [(1, " ".join(words(rng, 30))), (2, "Short, ITEM: here"), (10, " ".join(["same"] * 20)), (3, None), (4, "!!"), (2, "Short, ITEM: here"), (None, "no id at all")]
    a = items[0][1].split()
    texts = [None, "", "x " + "-".join(a[5:19]) + " y", " ".join(a[:12]), "short item here", "shortitem here short\nITEM'here", "same " * 25, "no ID at all " + "z " * 90,
             " ".join(words(rng, 300) + a + words(rng, 300)), "É short item here é", "short itém here", " ".join(a[3:16] + a[10:29])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit(1))
    docs = frame(spark, texts)
    got = {r.id: r for r in contamination(docs, bench, most_bytes=most_bytes).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) == brute_contamination(t, items), t
    assert [texts[2][a:z] for a, z in got[2].spans] == ["-".join(a[5:19])]
    assert contamination(docs.limit(0), bench).count() == 0
    assert not contamination(docs, bench.limit(0)).filter("n_hit > 0").count()


# --------------------------------------------------------------------- PII --
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(2)
    texts = [None, "", "a@b", "a@b.c d@e.f@g.h", "x.y@z.w_v@u.t", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111-1111 1111", "4111111111111111 4111111111111112",
             "+1 (234) 567-8901, +12 +1234567 +1-2-3-4-5-6-7-8", "é😀 a@b.cd 😀 +4930123456", "0" * 16, "0" * 400 + " 1.1.1.1", "9" * 50_000, "a" * 50_000, "a.a" * 20_000 + "@b" + ".c" * 20_000, "1." * 30_000]
    chars = "0123456789.@+-() ab\n"
    texts += ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(1500)]
    docs = frame(spark, texts).withColumn("kind", F.lit(1)).withColumn("row", F.lit("r"))
    got = {r.id: r for r in find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        n = Counter(x.split(":")[0] for x in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in RULES), t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    assert find_personal_data(docs.limit(0)).count() == 0


def test_bootstrap_finds_unseen_identifiers(spark):
    rng = random.Random(3)
    texts = [f"please mail: user{i}@mail{i}.example.com and go on" for i in range(30)]
    texts += [f"the number is {rng.randrange(1000)} and more, the end" for i in range(30)]
    texts += ["please mail: john.doe(at)example9 today", "please mail: jane7 today"]
    got = {r.id: r for r in find_personal_data(frame(spark, texts)).collect()}
    for i in (60, 61):
        kind, a, z = got[i].added.split(":")
        assert kind == "email" and texts[i][int(a):int(z)] == texts[i].split()[2]
    assert sum(r.n_added for r in got.values()) == 2


def test_bootstrap_counts_whole_patterns(spark):
    """Contexts of several words are judged as a whole, however common their last word is."""
    rng = random.Random(13)
    texts = [f"my phone number is +49 30 {rng.randrange(10**6, 10**7)} so far" for _ in range(30)]
    texts += [f"you may reach me at user{i}@mail{i}.example.org or so" for i in range(30)]
    texts += ["it is what it is and she is at home, at rest, at last " * 20 for _ in range(30)]
    texts += [f"and it is item{i} at place{i} now" for i in range(30)]
    texts += ["my phone number is 030/9988-77 today", "do reach me at jane7(at)host today"]
    got = {r.id: r for r in find_personal_data(frame(spark, texts)).collect()}
    for i, (kind, token) in ((120, ("phone", "030/9988-77")), (121, ("email", "jane7(at)host"))):
        k, a, z = got[i].added.split(":")
        assert (k, texts[i][int(a):int(z)]) == (kind, token)
    assert sum(r.n_added for r in got.values()) == 2


# ----------------------------------------------------- quality and language --
def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["river", "stone", "cloud", "walks", "under", "the", "a"]) for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["$$$", "!!", "BUY", "ZZ%", "###"]) + str(rng.randrange(99)) for _ in range(60)) for _ in range(150)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + [None, ""]
    docs = frame(spark, texts).withColumn("score", F.lit(2)).withColumn("label", F.lit(5))
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(300)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    out = id_remainder(F.col("doc_id"), 3) == 1
    got = {r.id: r for r in classify_quality(docs, labels, out).collect()}
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == (i + 1) % 2 and 0 <= got[i].score <= 1
    assert 0 <= got[300].score <= 1 and got[300].score == got[301].score
    flipped = labels.withColumn("quality", F.when(id_remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.id: r.score for r in classify_quality(docs, flipped, out).collect()} == {i: r.score for i, r in got.items()}  # held-out labels teach nothing
    assert classify_quality(docs.limit(0), labels, out).count() == 0
    assert {r.score for r in classify_quality(docs, labels.limit(0), out).collect()} == {0.5}


def test_quality_sample_with_long_texts(spark):
    """A text of more than the sample's bytes in first place leaves the others in."""
    ids = spark.range(60).orderBy(F.xxhash64(F.col("id").cast("string"))).toPandas()["id"].tolist()
    texts = [f"text {i} " * 30 for i in range(60)]
    texts[ids[0]] = "".join(f"long {i} " for i in range(700_000))
    assert len(texts[ids[0]]) > SAMPLE_BYTES
    docs = frame(spark, texts).select(F.col("doc_id").alias("id"), "text", F.lit(False).alias("held_out"))
    known = spark.range(60).select("id", (F.col("id") == -1).cast("int").alias("label"))
    counts, taken = _samples(docs, known)
    assert counts == {0: 60} and len(taken[0]) == 60 and not taken[1]
    long = taken[0][0]
    assert len(long) == SPREAD * PIECE and texts[ids[0]].encode().startswith(long[:PIECE]) and texts[ids[0]].encode().endswith(long[-PIECE:])


def test_languages(spark):
    rng = random.Random(6)
    parts = {"en": ["th", "er", "ing", "and", "of"], "fr": ["eau", "é", "ou", "ment", "què"], "el": ["αλ", "φα", "βη", "τα", "ος"]}
    rows = [(i, " ".join("".join(rng.choice(p) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([3, 40]))), lang, "s", 0)
            for i, (lang, p) in enumerate(list(parts.items()) * 80)]
    rows += [(900, None, "en", "s", 0), (901, "123 $$ \n", "en", "s", 0), (902, "", None, "s", 0), (903, "QJX ZZKW VVQP XXJ QQWZ " * 9, None, "s", 0), (None, "THE AND THING", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("best", F.lit(1)).withColumn("entropy", F.lit("e"))
    got = {r.id: r for r in identify_languages(docs, id_remainder(F.col("doc_id"), 4) != 2).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:240])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].rejected and got[None].lang_pred == "en" and not any(got[i].rejected for i in range(240))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify_languages(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify_languages(docs, F.lit(False)).collect()} == {"und"}
    assert bytes(characters("A1b É!").astype(np.uint8).tolist()) == b"   a b \xe9 "


def test_languages_in_shards(spark, monkeypatch):
    """Many grams of a hot language take none from a small one, and change no result."""
    rng = random.Random(16)
    hot = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(hot) for _ in range(80)), "hot", "s", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(["acorn", "bean", "cedar", "dahlia", "elm", "fig"]) for _ in range(8)), "small", "s", 0) for i in range(12)]
    rows += [(2000, None, "hot", "s", 0), (2001, "12 $", None, "s", 0), (None, "elm cedar", None, "s", 0), (2002, "QJX ZZKW " * 9, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)

    def run():
        return {r.id: r for r in identify_languages(docs, id_remainder(F.col("doc_id"), 4) != 2).collect()}

    want = run()
    monkeypatch.setattr("reviewloom.llm.language_id.MOST_GRAMS", 1500)
    got = run()
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.learned, r.lang_pred, r.rejected) == (want[k].learned, want[k].lang_pred, want[k].rejected)
        assert r.score == pytest.approx(want[k].score) and r.entropy == (want[k].entropy and pytest.approx(want[k].entropy))
    assert all(got[1000 + i].lang_pred == "small" for i in range(12)) and got[None].lang_pred == "small"


# ------------------------------------------------------------ tasks' memory --
def test_arrow_batches_are_bounded_in_bytes(spark):
    prepare(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    got = spark.range(0, 120, 1, 1).selectExpr("repeat('long text ', 50000) t").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 120
    assert max(r.size for r in got) < BATCH_BYTES + 600_000  # the row that exceeds the bound is the last of its batch


def test_tasks_give_memory_back(monkeypatch, tmp_path):
    """Once for each task, when the last batch was handed on."""
    class Spread:
        value = (np.zeros(1 << jaccard_join.FREQ_BITS, np.uint8), np.ones(1 << jaccard_join.FREQ_BITS, np.uint8))

    class Patterns:
        value = ("none", {})

    class Task:
        partitionId = staticmethod(lambda: 0)
        get = classmethod(lambda cls: cls)

    monkeypatch.setattr(token_store, "TaskContext", Task)
    released = []
    monkeypatch.setattr(common, "release_memory", lambda: released.append(len(out)))
    text = pa.array(["some words of a text", "others"])
    ids = pa.array([1, 2])
    tasks = [
        (jaccard_join._count_buckets(2), [text]), (jaccard_join._describe(2, 80, 100, Spread), [ids, text]), (jaccard_join._sets(2), [text]),
        (language_id._count, [pa.array(["en", "en"]), text]), (decontaminate._scan(Patterns), [ids, text]),
        (token_store._write(TOKENIZER, 2, 2, str(tmp_path), 3, True), [ids, text]),
    ]
    for run, columns in tasks:
        out = []
        released.clear()
        names = [f"c{i}" for i in range(len(columns))]
        for b in run(iter([pa.RecordBatch.from_arrays(columns, names)] * 2)):
            out.append(b)
        assert out and released == [len(out)], run


def test_released_memory_leaves_the_process():
    """What Arrow's pool and the C library hold after a task."""
    child = r"""
import re
import pyarrow as pa
from reviewloom.llm.common import releasing
kept = []
def size():
    return int(re.search(r"Anonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
@releasing
def run(batches):
    for n in batches:
        texts = [bytes(4000) for _ in range(n)]
        kept.append(bytes(4000))  # above all of them, like a cache's entry
        yield n
list(run([10])); before = size()
list(run([50000])); print(size() - before)
"""
    got = subprocess.run([sys.executable, "-c", child], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=60)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 50, got.stdout  # of 200 MB


# ------------------------------------------------------------- token files --
def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (2, 1), (300, 5), (1000, 10**6), (5000, 2**40), (700, 700)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano(n, *ef_encode(v))
        assert [ef[i] for i in range(n)] == v.tolist()
        assert 8 * (ef.high.nbytes + ef.packed.nbytes) <= n * (3 + max(0, np.log2(top / n))) + 256  # about two bits over the minimum
    f = TokenFile(b"".join(encode_file([None, 7], np.array([2, 0]), [np.array([5, 6], "<u2").tobytes()], 2)))
    assert [f.doc_id(0), f.doc_id(1)] == [None, 7] and f.ids(0).tolist() == [5, 6] and f.ids(1).tolist() == []
    with pytest.raises(ValueError):
        TokenFile(b"x" * 80)


def test_token_file_document_ids():
    lowest, highest = -(1 << 63), (1 << 63) - 1
    for keys in ([], [None], [7], [None, None, -5, -5, 0, 3, 3, 3, 900], [lowest, -1, 0, highest], [None, highest, highest]):
        f = TokenFile(b"".join(encode_file(keys, np.ones(len(keys), np.int64), [np.arange(len(keys), dtype="<u2").tobytes()], 2)))
        assert [f.doc_id(i) for i in range(f.n)] == keys
        assert [f.ids(i).tolist() for i in range(f.n)] == [[i] for i in range(len(keys))]
        assert all(f.find(k) == keys.index(k) for k in keys if k is not None)
        assert f.find(1) is None and f.find(lowest + 1) is None and f.find(highest - 1) is None
    for wrong in ([2, 1], [1, None]):
        with pytest.raises(ValueError):
            encode_file(wrong, np.ones(2, np.int64), [b"\0" * 4], 2)
    # ids and boundaries together: two sequences near log2(range / n) + 2 bits, where 64-bit tables take 16 bytes
    n = 20_000
    keys = np.sort(np.random.default_rng(1).choice(n * 50, n, replace=False)).tolist()
    parts = encode_file(keys, np.full(n, 300), [], 2)
    assert sum(map(len, parts)) <= n * (np.log2(50) + 2.5 + np.log2(300) + 2.5) / 8 + 200


ODD_TEXTS = ["", "a  b", "a \nb", " lead", "trail ", "x\n\ny", "it's we'll I'd 12a3 $$$ a-b", "日本語 テキスト ab", "é́ ñ ǆ ɐ", "a\tb\r\nc", " x y", "x y z", "'s 't", "a 's",
             "😀 ok 👍🏽", "<|endoftext|> x", "½ ² x²", "ªº _a__b", "word, word. Word! (x) a.b", "\x1c \x85 z", "\n", "q" * 300]


def test_word_cache_equals_whole_encoding():
    cache, rng = WordCache(TOKENIZER, 2), random.Random(8)
    texts = ODD_TEXTS + ["".join(rng.choice("ab é.,'1 \n ß!日") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [cache.encode(t) for t in texts] == cache.whole(texts) == [cache.encode(t) for t in texts]


def test_special_tokens_as_the_library_encodes(spark):
    from tokenizers import Tokenizer

    from reviewloom.llm.queries import op9_token_files

    t = Tokenizer.from_file(TOKENIZER)
    rows = list(enumerate([*ODD_TEXTS, "x <|endoftext|> y", "a<|endoftext|>b c", "plain words here"]))
    assert len(t.encode("x <|endoftext|> y", add_special_tokens=False).ids) == 4
    path = scratch_path(prepare(spark), "tables")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op9_token_files(spark, path).collect()}
    for i, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_encode_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    rows = [(i * 3, x) for i, x in enumerate(ODD_TEXTS)] + [(None, "none"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(5)
    got = sorted(encode_documents(docs, TOKENIZER).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, x) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert encode_documents(docs.limit(0), TOKENIZER).count() == 0


# -------------------------------------------------------------------- WARC --
@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nX-Page-Id: -4\r\n\r\n"
    bodies = [b"", b"\n\n", b"a\r\n\r\nb", bytes(range(256)) * 400, b"URL 1 2 3 4"]
    data = b"".join(gzip.compress(x) for x in [arc_header(version, "n.arc", "20200102030405")] + [arc_record(version, "n.arc", f"http://x/{i} é", "20200102030405", http + b) for i, b in enumerate(bodies)])
    records = list(read_arc(data))
    assert [r.http() for r in records] == [(http, b) for b in bodies]
    assert records[1].fields["URL"] == "http://x/1%20é" and ("Checksum" in records[0].fields) == (version == 2)
    for r, b in zip(records, bodies, strict=True):
        (h, block), = read_warc(gzip.compress(warc_record(r, "n", None)))
        assert block == http + b and h["WARC-Date"] == "2020-01-02T03:04:05Z" and h["WARC-Payload-Digest"] == f"sha1:{sha1_base32(b)}"
        (h, block), = read_warc(gzip.compress(warc_record(r, "n", (9, "urn:uuid:x"))))
        assert block == http and h["WARC-Type"] == "revisit" and h["WARC-Refers-To"] == "<urn:uuid:x>"
    with pytest.raises(ValueError):
        list(members(data[:-3]))
    with pytest.raises(ValueError):
        list(read_arc(gzip.compress(arc_header(version, "n", "20200102030405")) + gzip.compress(b"http://x 0 2020 text/html 99\nshort\n")))
    assert isinstance(records[0], ArcRecord)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_to_warc(spark, least):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nx", "x" * 200_000, "<p>a</p>", "ab", "ab"]
    rows = [(10 - i, None if i == 2 else f"http://h/{i} x\n", h) for i, h in enumerate(html)] + [(None, "u", "<p>a</p>"), (7, "u", "<p>b</p>"), (7, "u", "<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("f"))
    got = pages_to_warc(pages, least_bytes=least).collect()
    smallest = {}
    for p, _, h in rows:
        smallest[h or ""] = min(p if p is not None else 10**9, smallest.get(h or "", 10**9))
    want = Counter()
    for h in {h or "" for *_, h in rows}:
        same = [p for p, _, x in rows if (x or "") == h]
        b = h.encode()
        for k, p in enumerate(sorted(same, key=lambda p: (p is None, p))):
            own = k == 0 or len(b) < least
            want[p, len(b), sha1_base32(b), "response" if own else "revisit", None if own else smallest[h]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert len({r.record_id for r in got}) == len(got)
    assert pages_to_warc(pages.limit(0)).count() == 0
