"""License scans against brute-force cosines and a plain walk up the directories; licences that are easily taken for others."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from reviewloom.llm.common import prepare
from reviewloom.llm.license_scan import LEAST_COSINE, OVERLAP, TEMPLATES, block_templates, license_scan, scan_blocks, scan_lines


# Fixed value: the paragraph that the AGPL has and the GPL has not.
NETWORK = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you "
    "modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network "
    "(if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to "
    "the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of "
    "software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public "
    "License that is incorporated pursuant to the following paragraph.")


def terms(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def idf_of(texts, templates):
    known = {w for t in templates for w in terms(t)}
    df = Counter(w for t in texts for w in set(terms(t)) & known)
    return lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1


def cosine(a, b, idf, weight):
    a, b = ({w: weight(n) * idf(w) for w, n in Counter(x).items()} for x in (a, b))
    dot = sum(x * b.get(w, 0) for w, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0


def rows(spark, texts):
    prepare(spark)
    return spark.createDataFrame(list(enumerate(texts)), "row long, text string")


def test_lines_against_all_cosines(spark):
    rng = random.Random(3)
    pool = [w for t in TEMPLATES.values() for w in terms(t)] + [f"x{i}" for i in range(40)]
    texts = [None, "", "\n\n"]
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = terms(rng.choice(list(TEMPLATES.values())))
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(pool)
            lines.append(" ".join(words) if rng.random() < 0.7 else " ".join(rng.choices(pool, k=9)))
        texts.append(rng.choice(["\n", "\r\n"]).join(lines))
    texts = [t if t is not None else "" for t in texts]
    idf, want = idf_of(texts, TEMPLATES.values()), {}
    for i, t in enumerate(texts):
        for k, line in enumerate(re.split(r"\n|\r", t)):
            best = min((-round(cosine(terms(line), terms(x), idf, lambda n: n), 9), name) for name, x in TEMPLATES.items())
            if -best[0] >= LEAST_COSINE:
                want[i, k] = (best[1], -best[0])
    templates = spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")
    got = {(r.row, r.line_no): (r.license, r.cosine) for r in scan_lines(rows(spark, texts), templates).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    for k, (name, c) in want.items():
        assert got[k][0] == name and abs(got[k][1] - c) < 1e-6


def test_blocks_against_all_windows(spark):
    """A file's result is at least its whole cosine and at most that of the best window; none is found without one."""
    rng = random.Random(8)
    templates = [t for t in block_templates() if t[0] in ("MIT text", "ISC text", "Zlib text", "BSD-2-Clause text", "Unlicense text")]
    noise = [f"n{i}" for i in range(300)]
    texts = []
    for i in range(40):
        words = terms(templates[i % len(templates)][2])
        for _ in range(rng.choice([0, 5, 20, 60, 120])):
            words[rng.randrange(len(words))] = rng.choice(noise)
        around = rng.choice([0, 0, 10, 80])
        texts.append(" ".join(rng.choices(noise, k=around) + words + rng.choices(noise, k=around)))
    texts += [" ".join(rng.choices(noise, k=200)) for _ in range(10)]
    idf, damped = idf_of(texts, [t for *_, t in templates]), lambda n: 1 + math.log(n)
    got = {r.row: r for r in scan_blocks(rows(spark, texts), templates).collect()}
    by_name = {name: terms(t) for _, name, t in templates}
    hits = 0
    for i, t in enumerate(texts):
        words = terms(t)
        whole = max(cosine(words, x, idf, damped) for x in by_name.values())
        windows = {name: max(cosine(words[at: at + len(x)], x, idf, damped) for at in range(0, len(words), max(1, len(x) // OVERLAP))) for name, x in by_name.items()}
        if whole >= LEAST_COSINE + 1e-6:
            assert i in got and got[i].cosine >= whole - 1e-6
        if i in got:
            hits += 1
            most = max(windows[got[i].license], cosine(words, by_name[got[i].license], idf, damped))
            assert LEAST_COSINE <= got[i].cosine <= most + 1e-6
        else:
            assert max(windows.values()) < LEAST_COSINE + 0.1
    assert hits > 15 and not any(i in got for i in range(40, 50))


def test_inheritance_against_a_walk(spark):
    rng = random.Random(11)
    dirs = [""] + ["/".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(60)]
    names, files = list(TEMPLATES), {}
    for d in dirs:
        for f in ("LICENSE", "copying.md", "x.py", "y.py"):
            kind = rng.random()
            text = TEMPLATES[rng.choice(names)] if kind < (0.35 if f[0] in "Lc" else 0.1) else rng.choice(["", "plain words", None])
            files[f"{d}/{f}" if d else f] = text
    own = {p: next((k for k in names if TEMPLATES[k] == t), None) for p, t in files.items()}
    held = {}
    for p, name in own.items():
        d, _, f = p.rpartition("/")
        if name and f in ("LICENSE", "copying.md"):
            held.setdefault(d, set()).add(name)

    got = {r.path: (r.license, r.license_from) for r in license_scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    for p in files:
        want = [own[p]] if own[p] else None
        at, where = p, p
        while want is None and at:
            at = at.rpartition("/")[0]
            want, where = (sorted(held[at]), at) if at in held else (None, None)
        # of two licence files in one directory either may have the better cosine
        assert (got[p][0] in want and got[p][1] == where) if want else got[p] == (None, None), p


def test_easily_confused(spark):
    gpl, agpl, lgpl = ({x: t for k, x, t in block_templates() if k.endswith(" text")}[x] for x in ("GPL-3.0", "AGPL-3.0", "LGPL-3.0"))
    # an AGPL file with its own preamble and without the section's fixed wording
    rewritten = gpl.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    preamble = rewritten.index("Preamble")
    own_words = rewritten[:preamble] + "Preamble\n\nThe GNU Affero General Public License is a copyleft license for software run on network servers.\n" + \
        rewritten[rewritten.index("TERMS AND CONDITIONS"):]
    unlicense = next(t for _, x, t in block_templates() if x == "Unlicense")
    rng = random.Random(2)
    files = {
        "a/LICENSE": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3", "b/LICENSE": agpl, "c/LICENSE": own_words, "d/LICENSE": gpl, "e/LICENSE": lgpl,
        "f/LICENSE": "The Unlicense", "g/UNLICENSE": unlicense.replace("\n", "\r\n"), "h/x.c": "// This is free and unencumbered software released into the public domain.",
        "i/LICENSE": "GNU GENERAL PUBLIC LICENSE\nVersion 3", "j/LICENSE": "Copyright (c) 1995 Some One\n\n" + next(t for _, x, t in block_templates() if x == "Zlib"),
        "k/x.hpp": "// Distributed under the Boost Software License, Version 1.0.", "l/LICENSE": "Eclipse Public License - v 2.0", "m/LICENSE": "zlib License",
        "n/x.py": "# Licensed under the GNU Affero General Public License, version 3.",
        "o/LICENSE": rewritten.replace("  14. Revised", f"{NETWORK}\n\n  14. Revised"), "p/LICENSE": own_words + NETWORK}
    files |= {f"z/{i}": " ".join(f"w{rng.randrange(400)}" for _ in range(80)) + " the of and to is in or free software" for i in range(30)}
    frame = spark.createDataFrame(list(files.items()), "path string, text string").withColumn("w", F.lit(1)).withColumn("template", F.lit("x"))
    got = {r.path: r.license for r in license_scan(frame).collect()}
    want = {"a/LICENSE": "AGPL-3.0", "b/LICENSE": "AGPL-3.0", "c/LICENSE": "AGPL-3.0", "d/LICENSE": "GPL-3.0", "e/LICENSE": "LGPL-3.0", "f/LICENSE": "Unlicense",
            "g/UNLICENSE": "Unlicense", "h/x.c": "Unlicense", "i/LICENSE": "GPL-1.0-or-later", "j/LICENSE": "Zlib", "k/x.hpp": "BSL-1.0", "l/LICENSE": "EPL-2.0",
            "m/LICENSE": "Zlib", "n/x.py": "AGPL-3.0", "o/LICENSE": "AGPL-3.0", "p/LICENSE": "AGPL-3.0"}
    assert got == want | {f"z/{i}": None for i in range(30)}
