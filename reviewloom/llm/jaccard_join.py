"""N-gram Jaccard join: which documents share at least a given part of their
word shingles, and what groups those links form.

Method.  Every text becomes a set of shingle hashes.  Texts with equal sets
form one class, and only class representatives are compared.  Shingles are put
in one global order, rarest first; two sets that reach the threshold must then
share a shingle within short prefixes of both, so only prefixes are joined.
Candidates pass

* the length filter (the smaller set has at least t times the larger one),
* the positional filter (what is left after the shared shingle's positions
  could still reach the needed overlap),
* the suffix filter (hash-bucket histograms bound the symmetric difference),

and each surviving pair is verified once, on the whole sets.

Groups of near copies are not expanded into all pairs: each prefix group is
first walked in an order of its own and only near neighbours are verified; links
found give first components; then only pairs that lie in *different* components
are joined, filtered and verified.  Pairs inside a component cannot change it, so
the components equal those over all links.

The order by rarity comes from document frequencies over the whole corpus, kept
in a fixed number of hash buckets: a few MB whatever the corpus size.  Any
order gives the same result; a good one gives few candidates.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import mix64, prepare, releasing, shingle_set, stored

#: Buckets of the document-frequency table (one byte each when broadcast).
FREQ_BITS = 21
_RANGE = 1 << 15
#: A prefix group expected to exceed this many sets is dealt out in parts.
GROUP_ROWS = 1 << 14
#: Neighbours on each side that a set is compared with in each of its prefix
#: groups: at first, and then for neighbours of other components.
NEIGHBOURS = (6, 96)
#: Mean number of shingles in a bucket of the suffix histogram.
_PER_BUCKET = 4


def _ceil_div(a, b):
    return -(-a // b)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FREQ_BITS)).astype(np.int64)


# ------------------------------------------------- corpus-wide frequencies --
def _count_buckets(n: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FREQ_BITS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(counts, _bucket(shingle_set(t, n)), 1)
        yield from _blobs(counts)
    return run


def _blobs(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = [(i, zlib.compress(counts[i * _RANGE:(i + 1) * _RANGE].tobytes(), 1))
             for i in range(len(counts) // _RANGE) if counts[i * _RANGE:(i + 1) * _RANGE].any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()),
                                      pa.array([z for _, z in parts], pa.binary())], ["part", "counts"])


def _sum_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(z), np.int64)
            total[i] = total[i] + got if i in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                      pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
                                     ["part", "counts"])


def frequency_levels(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash bucket, a level that grows with the number of sets in the
    whole corpus that hold a shingle of the bucket, and the number of parts
    that a prefix group of the bucket is dealt into.  2 x 2**FREQ_BITS bytes,
    whatever the input."""
    schema = "part int, counts binary"
    partial = texts.mapInArrow(_count_buckets(n), schema)
    sums = partial.repartition("part").mapInArrow(_sum_blobs, schema)
    counts = np.zeros(1 << FREQ_BITS, np.int64)
    for r in sums.collect():  # at most 2**FREQ_BITS / _RANGE rows
        counts[r.part * _RANGE:(r.part + 1) * _RANGE] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    levels = np.minimum(255, 5 * np.log2(counts + 1)).astype(np.uint8)
    own = np.maximum(0, counts - 2 * np.median(counts))  # what stands out from the other shingles of a bucket
    parts = np.minimum(255, 1 + own // GROUP_ROWS).astype(np.uint8)
    return levels, parts


# ------------------------------------------------------------ sets of rows --
def _histogram(u: np.ndarray) -> np.ndarray:
    """Counts (at most 255) over 2**k ranges of re-mixed hashes."""
    bits = max(0, int(len(u) // _PER_BUCKET).bit_length())
    at = (mix64(u) >> np.uint64(40)).astype(np.int64) >> (24 - min(bits, 16))
    return np.minimum(255, np.bincount(at, minlength=1 << min(bits, 16))).astype(np.uint8)


def _set_key(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set."""
    a = mix64(u)
    b = mix64(u ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def _describe(n: int, num: int, den: int, levels):
    """Text -> size, key, histogram and rare-first prefix of its set."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value[0]
        for b in batches:
            size, k1, k2, hist, prefix = [], [], [], [], []
            for t in b.column(1).to_pylist():
                u = shingle_set(t, n)
                m = len(u)
                size.append(m)
                x, y = _set_key(u)
                k1.append(x)
                k2.append(y)
                hist.append(_histogram(u).tobytes() if m else b"")
                order = np.lexsort((u, level[_bucket(u)]))[: m - _ceil_div(num * m, den) + 1] if m else u
                prefix.append(u[order].tobytes() if m else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(hist, pa.binary()), pa.array(prefix, pa.binary())],
                ["id", "n", "k1", "k2", "hist", "prefix"])
    return run


def _prefix_rows(levels):
    """One row for each shingle of a prefix: (token, part, id, n, position)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = levels.value[1]
        for b in batches:
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            lens = np.array([len(x) for x in sets], np.int64)
            u = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            cid, pos = np.repeat(ids, lens), np.arange(len(u)) - np.repeat(np.cumsum(lens) - lens, lens)
            s = parts[_bucket(u)].astype(np.uint64)
            part = mix64(u ^ mix64(cid.astype(np.uint64))) % np.maximum(s, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(np.where(s > 1, part.astype(np.int16), -1).astype(np.int16)),
                 pa.array(cid), pa.array(np.repeat(n, lens).astype(np.int32)), pa.array(pos.astype(np.int32))],
                ["token", "part", "cid", "n", "pos"])
    return run


def _neighbours(num: int, den: int, reach: int, members: bool):
    """Rows sorted by (token, part, ..) -> the filtered pairs of near neighbours
    of different components (``other`` set) and, with ``members``, the rows
    whose token is shared (``other`` null)."""
    names = ("token", "part", "cid", "n", "pos", "component")
    schema = pa.schema([("token", pa.int64()), ("part", pa.int16()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()),
                        ("other", pa.int64())])

    def batch(c: dict[str, np.ndarray], alone: np.ndarray, pairs: list[np.ndarray], others: list[np.ndarray]) -> pa.RecordBatch:
        """One batch of the rows ``alone`` and of all pairs: many small ones cost the JVM memory."""
        at = np.concatenate([alone, *pairs])
        other = pa.array(np.concatenate([np.zeros(len(alone), np.int64), *others]), mask=np.arange(len(at)) < len(alone))
        return pa.RecordBatch.from_arrays(
            [pa.array(c["token"][at]), pa.array(c["part"][at]), pa.array(c["cid"][at]), pa.array(c["n"][at]), pa.array(c["pos"][at]), other], schema=schema)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None   # the last rows so far, which are neighbours of the next ones
        linked = []   # whether each of them shares its token with a row before it
        todo = 0      # how many of them were not written yet: the last one, if any
        for b in batches:
            if not b.num_rows:
                continue
            c = {k: b.column(k).to_numpy() for k in names}
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            old = len(linked)
            size = len(c["token"])
            same = (c["token"][1:] == c["token"][:-1]) & (c["part"][1:] == c["part"][:-1])
            shared = c["part"] >= 0  # a group dealt out in parts is a large one
            shared[:old] |= np.array(linked, bool)
            shared[1:] |= same
            shared[:-1] |= same
            fresh = np.arange(max(0, old - todo), size - 1)
            alone, pairs, others = fresh[shared[fresh]] if members else fresh[:0], [], []
            some = np.flatnonzero(shared)  # only these have neighbours
            old = int(shared[:old].sum())
            tok, part, n, pos, of = c["token"][some], c["part"][some], c["n"][some].astype(np.int64), c["pos"][some], c["component"][some]
            for step in range(1, reach + 1):
                z = np.arange(max(step, old), len(some))
                z = z[(tok[z] == tok[z - step]) & (part[z] == part[z - step])]
                if not len(z):
                    break
                a = z - step
                need = _ceil_div(num * (n[a] + n[z]), num + den)
                ok = (den * np.minimum(n[a], n[z]) >= num * np.maximum(n[a], n[z])) & (of[a] != of[z]) & (np.minimum(n[a] - pos[a], n[z] - pos[z]) >= need)
                pairs.append(some[z[ok]])
                others.append(c["cid"][some[a[ok]]])
            if len(alone) or any(map(len, pairs)):
                yield batch(c, alone, pairs, others)
            held, linked, todo = {k: c[k][-reach:] for k in names}, shared[-reach:].tolist(), 1
        if members and held is not None and linked[-1]:
            yield batch(held, np.array([len(linked) - 1]), [], [])
    return run


# -------------------------------------------------------------- components --
#: Links that one task joins to a forest, about.
TASK_LINKS = 1 << 20


@releasing
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (x, y) of a task -> (node, component): each node and the least node it is linked to within the task."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    links = np.concatenate(parts, 1) if parts else np.empty((2, 0), np.int64)
    nodes, at = np.unique(links, return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:  # nodes are numbered in order, so the least number is the least node
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def _components(links: DataFrame) -> DataFrame:
    """Stored links (x, y) -> (node, component) for every node of a link.

    Tasks of a bounded number of links join theirs to forests first.  If that takes
    one task, its forest is the answer; else the forests' edges are joined in rounds."""
    tasks = -(-links.count() // TASK_LINKS)
    forest = stored(links.coalesce(max(1, tasks)).mapInArrow(_forest, "node long, component long"), "forest")
    return forest if tasks <= 1 else stored(connected_components(forest, src="node", dst="component"), "labels")


# ------------------------------------------------------------ verification --
def _sets(n: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, n) for t in b.column(0).to_pylist()]
            keys = [_set_key(u) for u in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(u) for u in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())],
                ["n", "k1", "k2", "members"])
    return run


def _suffix_ok(hx: bytes, hy: bytes, most: int) -> bool:
    """False only if the histograms prove a symmetric difference above ``most``."""
    x, y = np.frombuffer(hx, np.uint8).astype(np.int64), np.frombuffer(hy, np.uint8).astype(np.int64)
    if len(x) != len(y):  # fold the finer one; sums of capped counts stay lower bounds only if none is capped
        if max(x.max(), y.max()) == 255:
            return True
        if len(x) > len(y):
            x = x.reshape(len(y), -1).sum(1)
        else:
            y = y.reshape(len(x), -1).sum(1)
    return int(np.abs(x - y).sum()) <= most


def _filter_pairs(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nx, ny = b.column("nx").to_numpy(), b.column("ny").to_numpy()
            most = nx + ny - 2 * _ceil_div(num * (nx + ny), num + den)
            ok = [_suffix_ok(p, q, int(m)) for p, q, m in
                  zip(b.column("hx").to_pylist(), b.column("hy").to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("x").filter(pa.array(ok, pa.bool_())),
                                              b.column("y").filter(pa.array(ok, pa.bool_()))], ["x", "y"])
    return run


def _verify(num: int, den: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist(), strict=True):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(den * both >= num * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column("x").filter(pa.array(ok, pa.bool_())),
                                              b.column("y").filter(pa.array(ok, pa.bool_()))], ["x", "y"])
    return run


#: Ids of a semi-join that go to the tasks as a broadcast; more are shuffled.
MOST_BROADCAST_IDS = 1 << 20


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of class ids -> those whose sets reach the threshold.

    The suffix filter runs on the classes' histograms; only for pairs that
    pass it are the texts read again and their whole sets compared."""
    side = classes.select("cid", "n", "hist")
    named = pairs.join(side.toDF("x", "nx", "hx"), "x").join(side.toDF("y", "ny", "hy"), "y")
    left = stored(named.mapInArrow(_filter_pairs(num, den), "x long, y long"), "candidates")
    cids = left.select(F.col("x").alias("cid")).unionByName(left.select(F.col("y").alias("cid"))).distinct()
    wanted = stored(classes.select("cid", "rep", "k1", "k2", "n").join(cids, "cid", "left_semi"), "wanted")
    ids = wanted.select("rep").distinct()
    ids = F.broadcast(ids) if wanted.count() <= MOST_BROADCAST_IDS else ids
    found = texts.join(ids, texts.id.eqNullSafe(F.col("rep")), "left_semi")
    sets = found.select("text").mapInArrow(_sets(n), "n long, k1 long, k2 long, members binary")
    sets = stored(sets.join(wanted.drop("rep"), ["k1", "k2", "n"]).select("cid", "members").dropDuplicates(["cid"]), "members")
    full = left.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")
    return stored(full.mapInArrow(_verify(num, den), "x long, y long"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                       num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two rows link when ``den * |A & B| >= num * |A | B|`` for their sets A, B
    of distinct ``n``-word shingles (A-Z lower-cased, words split at ASCII
    white space; fewer words: the whole sequence is one shingle).
    ``component_id`` is the smallest id reachable over links, own id included.

    Null, empty or blank texts have no shingle, link with nothing and keep
    their own id.  Rows with a null id take part like others; a group of which
    no row has an id has a null ``component_id``.  Repeated rows each get a
    row.  Other columns of ``docs`` are ignored.  An empty table gives no row.
    Hash values stand for shingles: 64 bits each, 128 bits for a whole set."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts.select("text"), n))
    schema = "id long, n long, k1 long, k2 long, hist binary, prefix binary"
    rows = stored(texts.mapInArrow(_describe(n, num, den, levels), schema), "sets")

    # equal sets: one class each, named by an integer
    key = ["k1", "k2", "n"]
    classes = stored(rows.filter("n > 0").groupBy(*key)
                     .agg(F.min("id").alias("rep"), F.first(F.struct("hist", "prefix")).alias("s"))
                     .select(*key, "rep", "s.hist", "s.prefix", F.monotonically_increasing_id().alias("cid")), "classes")

    # prefix groups: near neighbours, and the rows that share a token.  Sets of
    # like size stand together, in an order that differs from group to group
    like = F.floor(F.log(F.col("n")) / math.log(den / num)) if num < den else F.col("n")
    grams = classes.select("cid", "n", "prefix").mapInArrow(
        _prefix_rows(levels), "token long, part short, cid long, n int, pos int").withColumn("component", F.col("cid"))
    pair = (F.greatest("cid", "other").alias("x"), F.least("cid", "other").alias("y"))

    def near(rows: DataFrame, turn: int) -> DataFrame:
        mixed_up = F.xxhash64("token", "cid", F.lit(turn))
        return rows.repartition("token", "part").sortWithinPartitions("token", "part", like, mixed_up).mapInArrow(
            _neighbours(num, den, NEIGHBOURS[turn], turn == 0), "token long, part short, cid long, n int, pos int, other long")

    joined = stored(near(grams, 0), "prefixes")
    members = joined.filter("other is null").drop("other")
    tried = joined.filter("other is not null").select(*pair).distinct()
    links = _links(tried, classes, texts, n, num, den)
    label = _components(links)

    def mixed(rows: DataFrame) -> DataFrame:
        """The prefix rows of tokens that more than one component holds."""
        m = rows.drop("component").join(label.withColumnRenamed("node", "cid"), "cid", "left") \
                .withColumn("component", F.coalesce("component", "cid"))
        tokens = m.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
                  .filter("lo < hi").select("token")
        return stored(m.join(tokens, "token", "left_semi"), "mixed")

    # once more among neighbours, then all that may still join two components.  Components
    # only grow, so each turn looks at the tokens that the turn before left
    need = f"({num} * (a.n + b.n) + {num + den - 1}) div {num + den}"
    m = members
    for turn in (1, 2):
        m = mixed(m)
        if m.isEmpty():
            break
        if turn == 1:
            met = near(m, 1).select(*pair)
        else:
            met = m.alias("a").join(m.alias("b"), F.expr(
                "a.token = b.token and a.component != b.component and (a.n < b.n or a.n = b.n and a.cid < b.cid)"
                f" and {den}L * a.n >= {num}L * b.n and least(a.n - a.pos, b.n - b.pos) >= {need}")) \
                .select(F.greatest("a.cid", "b.cid").alias("x"), F.least("a.cid", "b.cid").alias("y"))
        more = stored(met.distinct().join(tried, ["x", "y"], "left_anti"), "more")
        tried = tried.unionByName(more)
        found = _links(more, classes, texts, n, num, den)
        if not found.isEmpty():
            links = links.unionByName(found)
            label = _components(links)

    named = classes.select("cid", *key, "rep").join(label.withColumnRenamed("node", "cid"), "cid", "left") \
                   .withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select(*key, "component_id")
    return rows.select("id", *key).join(named, key, "left") \
               .select("id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
