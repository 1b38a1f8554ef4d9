"""The bootstrap of personal data as a whole against brute force, and on planted contexts."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from reviewloom.llm import pii_bootstrap as pii

from .test_operators import brute_spans, frame

KINDS = ["email", "ip", "card", "phone", "secret"]


def pattern(gap):
    m = re.search(r"(\S+\s*\S?\s*\S?)\s*$", gap[-80:], re.ASCII)
    p = re.sub("[0-9]", "", re.sub(r"\s+", " ", m[1]).lower()).strip(" ") if m else ""
    return p if re.search(r"[^\W\d_]{2}", p) else None


def brute_bootstrap(texts):
    """For each text the list of added (kind, start, end)."""
    base, free = [], []
    for i, t in enumerate(texts):
        spans = [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in brute_spans(t))]
        last = {}
        for kind, rule in pii.RULES.items():
            at = 0
            for m in re.finditer(rule.replace(r"(?:\G|", "(?:"), t):
                if (kind, m.start(), m.end()) in spans:
                    last[kind, m.start()] = t[at:m.start()]
                at = m.end()
        base += [(KINDS.index(k), pattern(last[k, a]), t[a:z].lower(), last[k, a]) for k, a, z in spans]
        at = 0
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", t):
            body = re.sub(r"^(?:[^\w]|_)*|(?:[^\w]|_)*$", "", m[0]) if "@" not in m[0] else re.sub(r"^[^\w@]*|[^\w@]*$", "", m[0])
            start = m.start() + m[0].index(body)
            p, at = pattern(t[at:m.start()]), m.end()
            if body and p and not any(a < start + len(body) and z > start for _, a, z in spans):
                free.append((i, start, start + len(body), body.lower(), p))
    seeds = {(k, p, tok) for k, p, tok, _ in base if p}
    seeds |= {(4, p, tok) for _, _, _, tok, p in free if re.search(pii.SHAPES["secret"], tok)}
    known = {(k, p) for k, p, _ in seeds}
    edges = {e: 1.0 for e in seeds} | {(k, p, tok): 0.0 for _, _, _, tok, p in free for k, q in known if q == p and (k, p, tok) not in seeds}
    score = {(k, tok): s for (k, _, tok), s in sorted(edges.items(), key=lambda x: x[1])}
    first = defaultdict(set)
    for (k, _, tok), s in edges.items():
        first[k, tok].add(s)
    assert all(len(v) == 1 for v in first.values())  # of these texts: no token is a seed under one pattern only
    for _ in range(pii.ROUNDS):
        of = defaultdict(list)
        for k, p, tok in edges:
            of[k, p].append((k, tok))
        conf = {key: sum(score[x] for x in v) / (len(v) + 1) for key, v in of.items()}
        new = defaultdict(float)
        for k, p, tok in edges:
            new[k, tok] += math.log(1 - min(conf[k, p], 0.999))
        score = {x: max(max(first[x]), 1 - math.exp(v)) for x, v in new.items()}
    n_seeds = Counter((k, p) for k, p, _ in seeds)
    good = {key: c for key, c in conf.items() if c >= pii.LEAST_CONFIDENCE and n_seeds[key] >= pii.LEAST_SEEDS}
    before = Counter(p for _, p, _, gap in base if gap[-1:].isspace()) + Counter(p for *_, p in free)
    total = Counter()
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            total[pattern(" ".join(w[max(0, i - 2):i + 1]))] += 1
    good = {(k, p): c for (k, p), c in good.items() if total[p] and before[p] >= pii.LEAST_SPECIFIC * total[p]}
    out = defaultdict(list)
    for i, a, z, _, p in free:
        best = max(((c, -k) for (k, q), c in good.items() if q == p), default=None)
        if best:
            out[i].append((-best[1], a, z))
    return [sorted(out[i]) for i in range(len(texts))]


def make_texts():
    rng = random.Random(17)
    filler = ["the", "a", "it", "was", "so", "on", "walk", "green", "at", "x", "of 2", "no 17", "is", "in"]
    hexkey = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    contexts = {"email": ("please write to", lambda: f"u{rng.randrange(999)}@mail{rng.randrange(99)}.example.com"), "phone": ("call", lambda: f"+49 30 {rng.randrange(10**6, 10**7)}"),
                "ip": ("from host", lambda: ".".join(str(rng.randrange(256)) for _ in range(4))), "secret": ("token =", lambda: f'"{hexkey(40)}"')}
    unseen = {"email": lambda: f"jane{rng.randrange(99)}(at)host", "phone": lambda: f"030/{rng.randrange(1000, 9999)}-77", "ip": lambda: f"node{rng.randrange(99)}x", "secret": lambda: f'"AK{rng.randrange(10**9)}xyz"'}
    texts, planted = [], []
    for i in range(400):
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 30))]
        kind = rng.choice(list(contexts))
        lead, make = contexts[kind]
        new = i % 5 == 0
        value = unseen[kind]() if new else make()
        text = " ".join(words[:5] + [lead, value] + words[5:])
        texts.append(text)
        planted.append((kind, text.index(value), value) if new else None)
    texts += [" ".join(rng.choice(filler) for _ in range(40)) for _ in range(100)] + [f"commit {hexkey(40)} went {rng.choice(filler)} {hexkey(40)}" for _ in range(2)]
    return texts, planted


def test_whole_bootstrap(spark):
    texts, planted = make_texts()
    got = {r.id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    added = [sorted((KINDS.index(k), int(a), int(z)) for k, a, z in (s.split(":") for s in got[i].added.split(",") if s)) for i in range(len(texts))]
    assert added == brute_bootstrap(texts)
    # recall and precision on identifiers that no base rule knows
    found = sum(any(a >= p[1] and z <= p[1] + len(p[2]) and KINDS[k] == p[0] for k, a, z in added[i]) for i, p in enumerate(planted) if p)
    assert found >= 0.9 * sum(p is not None for p in planted)
    right = sum(1 for i, x in enumerate(added) for _ in x if i < 400 and (planted[i] or "token =" in texts[i]))
    assert right >= 0.9 * sum(map(len, added))
    assert all(got[i].n_spans == len(got[i].spans.split(",")) if got[i].spans else got[i].n_spans == 0 for i in range(len(texts)))


def test_words_of_the_corpus_as_patterns(spark):
    """What is counted for a pattern is what _pattern() gives for the words up to there."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1:= \n\té=") for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts = [t for t in texts if t.strip()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    tails = {r.id: r.t for r in df.select("id", pii.words_of(F.lower("text")).alias("w")).select("id", F.transform(pii._tails(F.col("w")), lambda x: F.trim(F.regexp_replace(x, "[0-9]", ""))).alias("t")).collect()}
    ups = spark.createDataFrame([(i, k, " ".join(t.split()[:k + 1]) + " ") for i, t in enumerate(texts) for k in range(len(t.split()))], "id long, k int, gap string")
    for r in ups.select("id", "k", pii._pattern(F.col("gap")).alias("p")).collect():
        tail = tails[r.id][r.k]
        assert r.p == (tail if re.search(r"[^\W\d_]{2}", tail) else None), texts[r.id]
