"""Merkle manifest, substring dedup and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewloom.llm.merkle_manifest import folded, leaf_digest, merkle_manifest, siblings_text
from reviewloom.llm.spelling_variants import spelling_variants
from reviewloom.llm.substring_dedup import lengths_of, repeated_passages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --------------------------------------------------------------- manifest --
def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(hashes, fanout):
    """root and, for each leaf, the list of (left, right) siblings."""
    paths = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, p in enumerate(at):
            lo = p // fanout * fanout
            run = hashes[lo:lo + fanout]
            paths[leaf].append(("".join(run[:p - lo]), "".join(run[p - lo + 1:])))
        hashes = [sha("".join(hashes[i:i + fanout])) for i in range(0, len(hashes), fanout)]
        at = [p // fanout for p in at]
    return hashes[0], paths


def brute_manifest(rows, fanout):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        leaf = sha("".join(enc(v) for v in r))
        by[r[3]].append(((r[0] is not None, r[0] or 0, leaf), r, leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[0])], fanout) for s in names]
    root, tops = brute_tree([t[0] for t in trees], fanout)
    out = []
    for s, (sub, paths), top in zip(names, trees, tops, strict=True):
        for (_, r, leaf), path in zip(sorted(by[s], key=lambda x: x[0]), paths, strict=True):
            out.append((r[0], leaf, sub, root, path + top))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [2, 16])
def test_merkle_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, f"Text {i} é" * rng.randrange(4), "en", rng.choice(["a", "a", "a", "b", "B", "é", "c9", None, ""]), i) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "x", None, "lone", None), (5, "again", None, "a", 0), (5, "again", None, "a", 0),
             (400, "y" * 200_000, "de", "a", 1), (401, "", "-", "a", -1), (402, "z", "en", "\U0001F600", 1), (403, "z", "en", "￮", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("tree", F.lit(1)).withColumn("path", F.lit("clash"))
    leaf = leaf_digest(*[F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])
    found = merkle_manifest(docs, leaf, keep={"bad": F.lit(sha("tampered"))}, fanout=fanout)
    found = found.withColumns({"ok": folded(F.col("leaf"), F.col("path")) == F.col("root"),
                               "no": folded(F.col("bad"), F.col("path")) == F.col("root"), "all": siblings_text(F.col("path"))})
    got = found.collect()
    want = brute_manifest(rows, fanout)
    assert sorted(((r.id, r.leaf, r.subroot, r.root, [tuple(x) for x in r.path]) for r in got), key=str) == want
    assert all(r.ok and not r.no for r in got)
    assert Counter(r["all"] for r in got) == Counter("".join(a + b for a, b in w[4]) for w in want)
    # one leaf alone, and none
    one = merkle_manifest(docs.filter("doc_id = 402"), leaf).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []
    assert merkle_manifest(docs.limit(0), leaf).count() == 0


# --------------------------------------------------------------- passages --
def brute_passages(rows, words):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [1 << 70 if i is None else i for i, _ in rows]
    least = {}
    for o, w in zip(order, split, strict=True):
        for k in range(len(w) - words + 1):
            g = tuple(w[k:k + words])
            least[g] = min(least.get(g, o), o)
    out = []
    for (i, _), o, w in zip(rows, order, split, strict=True):
        gone = {k + j for k in range(len(w) - words + 1) if least[tuple(w[k:k + words])] < o for j in range(words)}
        ranges = []
        for k in sorted(gone):
            if ranges and ranges[-1][1] == k:
                ranges[-1][1] = k + 1
            else:
                ranges.append([k, k + 1])
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), [tuple(r) for r in ranges], sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [1, 2, 7, 50])
def test_repeated_passages(spark, words):
    rng = random.Random(words)
    kinds = 12 if words < 5 else 500
    passage = [[f"w{rng.randrange(kinds)}" for _ in range(rng.choice([words, words + 1, 2 * words, 5 * words + 3]))] for _ in range(8)]
    rows = []
    for i in rng.sample(range(200), 90):
        w = [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(3 * words + 2))]
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passage))
            if rng.random() < 0.3:  # one word short of a window, or a changed word
                p = p[1:] if rng.random() < 0.5 else p[: len(p) // 2] + ["Other"] + p[len(p) // 2:]
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    long = " ".join(f"u{k}" for k in range(9000))
    rows += [(300, long), (301, "x " + long + " y"), (302, long), (302, long), (299, None), (298, ""), (297, " \n"), (None, long), (None, "only null " * 40),
             (None, "only null " * 40), (303, "same " * (4 * words)), (304, "same " * (2 * words)), (305, "Same " * (2 * words)), (306, "é x " * (2 * words)), (307, "é x\x0b" * words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"row": F.lit("clash"), "names": F.lit(0), "id": F.lit(7)})
    path = f"/tmp/{spark.sparkContext.applicationId}-passages-{words}"
    docs.write.mode("overwrite").parquet(path)
    got = repeated_passages(spark.read.parquet(path), words=words).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, [tuple(x) for x in r.ranges], r.kept_sha256) for r in got), key=str) == brute_passages(rows, words)
    assert repeated_passages(spark.read.parquet(path).limit(0), words=words).count() == 0


def test_lengths():
    assert lengths_of(50) == [13, 25, 50] and lengths_of(100) == [13, 25, 50, 100] and lengths_of(1) == [1, 1, 1] and lengths_of(7) == [2, 4, 7]


# --------------------------------------------------------------- spelling --
def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows, every):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    close = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 2 * n[w] else None for w, v in close.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n), key=str)


@pytest.mark.parametrize("every", [None, 5])
def test_spelling_variants(spark, every):
    rng = random.Random(every or 0)
    letters = "abcÀàÿ×é"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "ababa"]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(60)):
            s = rng.choice(stems[: rng.randrange(1, len(stems) + 1)])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(s))
                s = rng.choice([s[:k] + s[k + 1:], s[:k] + rng.choice(letters) + s[k:], s[:k] + rng.choice(letters) + s[k + 1:]])
            w.append(s.upper() if rng.random() < 0.1 and s.isascii() else s)
        rows.append((i, rng.choice([" ", "-", "1", "Ā"]).join(w)))
    rows += [(None, "aaaaa aaaaaa bab"), (3, rows[3][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "q" * 50_000 + " " + "rare words here"), (503, "aaaaab " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "id": F.lit(2)})
    got = spelling_variants(docs, drop_every=every).collect()
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got), key=str) == brute_spelling(rows, every)
    assert spelling_variants(docs.limit(0)).count() == 0
