"""Substring dedup: passages of many words that also stand in an earlier document.

Method: level-wise doubling.  Windows of a short length are named by hashes; those that
occur in one text alone are given up, those that repeat are extended to
(about) twice the length, whose names come from the names of their two
halves, until the wanted length is reached or no candidates survive: for
50 words 13, 25 and 50.

A repeated passage of the full length holds a repeated window of each shorter
length, and also the one with the least name among them, which is the same in
every copy.  So at the levels below the last one, each position of the full
length stands for its least shorter window: about one name in twenty
words is compared instead of one per word, and no repeat is missed.

Equal texts form a class; only its first document is compared, the others repeat it
whole.  Windows meet by hash partitioning and map-side least and greatest ids,
so a passage that a third of all documents share is no hot spot: no
group of documents is collected and no pair of documents is formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, stored, word_hashes

_U = np.uint64
_INT64 = np.dtype("<i8")
#: The shortest length is the first below this many words.
SHORTEST = 15
#: Ids of a semi-join that go to the tasks as a broadcast; more are shuffled.
MOST_BROADCAST_IDS = 1 << 20


def lengths_of(words: int) -> list[int]:
    """The lengths of the levels, from the first to the last, which is ``words``: each
    is half the next one, rounded up; three levels at least."""
    out = [words]
    while out[0] >= SHORTEST or len(out) < 3:
        out.insert(0, -(-out[0] // 2))
    return out


# ------------------------------------------------------------------- names --
def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix64(mix64(a + _U(salt)) * _U(0x2545F4914F6CDD1D) + b)


def extend(names: np.ndarray, length: int, to: int, salt: int = 1) -> np.ndarray:
    """Names of the windows of ``to`` words from those of ``length`` (at most twice as long):
    a window is its first and its last ``length`` words."""
    step = to - length
    return _pair(names[: max(0, len(names) - step)], names[step:], salt + to)


def window_names(words: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of ``length`` words."""
    names, have = words, 1
    while have < length:
        to = min(2 * have, length)
        names, have = extend(names, have, to), to
    return names


def least_in(names: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` consecutive names, by doubling."""
    have = 1
    while have < span and len(names):
        step = min(have, span - have)
        names = np.minimum(names[: max(0, len(names) - step)], names[step:])
        have += step
    return names


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# ------------------------------------------------------------------- tasks --
_STRETCH = ["cid", "id", "at", "names"]


def _describe(words: int, first: int):
    """(row, id, text) -> word count, hashes of all words and distinct names of the first level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, key, names = [], [], [], []
            for t in b.column(2).to_pylist():
                data = _data(t)
                h = word_hashes(data)
                kept = b" ".join(data.split())
                n.append(len(h))
                sha = hashlib.sha256(kept)
                digest.append(sha.hexdigest())
                # words joined by one space: equal digests, equal words
                key.append(sha.digest()[:16])
                names.append(np.unique(least_in(window_names(h, first), words - first + 1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(key, pa.binary()),
                 pa.array(names, pa.binary())], ["row", "id", "n_words", "digest", "key", "names"])
    return run


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, names) -> a row for each name."""
    for b in batches:
        sets = [np.frombuffer(x, _INT64) for x in b.column(1).to_pylist()]
        lens = np.array([len(x) for x in sets], np.int64)
        names = np.concatenate(sets) if sets else np.empty(0, _INT64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.repeat(b.column(0).to_numpy(), lens))], ["name", "cid"])


def _cut(words: int, first: int, second: int):
    """(cid, id, text, hits) -> the stretches of the text whose windows may repeat.

    ``at``: starts and lengths of runs of positions; ``names``: of each run's windows of ``second``
    words, as many as its windows of full length need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names = [], []
            for t, hits in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                short = window_names(word_hashes(_data(t)), first)
                some = np.isin(least_in(short, words - first + 1), hits.values.to_numpy().view(np.uint64))
                starts, ends = _runs(some)
                longer = extend(short, first, second)
                more = words - second  # windows of the second length that a full one reaches beyond its start
                at.append(np.concatenate([starts, ends - starts]).astype(_INT64).tobytes())
                names.append(b"".join(longer[s: e + more].tobytes() for s, e in zip(starts, ends, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(names, pa.binary())], _STRETCH)
    return run


def _stretches(at: bytes, names: bytes, more: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start, number of positions and names of each run."""
    place, have = np.frombuffer(at, _INT64), np.frombuffer(names, np.uint64)
    half, done = len(place) // 2, 0
    for s, k in zip(place[:half].tolist(), place[half:].tolist(), strict=True):
        yield s, k, have[done: done + k + more]
        done += k + more


def _least_names(words: int, length: int):
    """Stretches -> the distinct names of this level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, names in zip(b.column("at").to_pylist(), b.column("names").to_pylist(), strict=True):
                least = [least_in(x, words - length + 1) for _, _, x in _stretches(at, names, words - length)]
                out.append(np.unique(np.concatenate(least)).tobytes() if least else b"")
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(out, pa.binary())], ["cid", "names"])
    return run


def _extended(words: int, length: int, to: int):
    """Stretches with the repeated names of their level (hits) -> stretches of the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ats, out = [], []
            for at, names, hits in zip(b.column("at").to_pylist(), b.column("names").to_pylist(), b.column("hits"), strict=True):
                good = hits.values.to_numpy().view(np.uint64)
                starts, sizes, parts = [], [], []
                for s, _, x in _stretches(at, names, words - length):
                    longer = extend(x, length, to)
                    for i, j in zip(*_runs(np.isin(least_in(x, words - length + 1), good)), strict=True):
                        starts.append(s + i)
                        sizes.append(j - i)
                        parts.append(longer[i: j + words - to].tobytes())
                ats.append(np.array(starts + sizes, _INT64).tobytes())
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("id"), pa.array(ats, pa.binary()), pa.array(out, pa.binary())], _STRETCH)
    return run


def _full_rows(words: int, length: int):
    """Stretches with the repeated names of the last level but one -> a row for each
    window of full length that may repeat: two names and its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, i, at, names, hits in zip(b.column("cid").to_pylist(), b.column("id").to_pylist(), b.column("at").to_pylist(),
                                               b.column("names").to_pylist(), b.column("hits"), strict=True):
                good = hits.values.to_numpy().view(np.uint64)
                one, two, pos = [], [], []
                for s, k, x in _stretches(at, names, words - length):
                    some = np.flatnonzero(np.isin(least_in(x, words - length + 1), good))
                    one.append(extend(x, length, words)[some])
                    two.append(_pair(x[words - length:], x[:k], 7)[some])
                    pos.append(s + some)
                if not pos:
                    continue
                p = np.concatenate(pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)),
                     pa.array(np.full(len(p), cid, np.int64)), pa.array(np.full(len(p), i, np.int64)), pa.array(p.astype(np.int64))],
                    ["one", "two", "cid", "id", "pos"])
    return run


def _kept(words: int):
    """(row, text, starts of repeated windows) -> removed ranges of words and what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges, removed, digest = [], [], []
            for t, at in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                parts = _data(t).split()
                mask = np.zeros(len(parts) + 1, np.int64)
                starts = at.values.to_numpy()
                np.add.at(mask, starts, 1)
                np.add.at(mask, starts + words, -1)
                s, e = _runs(np.cumsum(mask)[:-1] > 0)
                left, done = [], 0
                for i, j in zip(s.tolist(), e.tolist(), strict=True):
                    left += parts[done:i]
                    done = j
                left += parts[done:]
                ranges.append([{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist(), strict=True)])
                removed.append(int((e - s).sum()))
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["row", "ranges", "n_removed", "kept"])
    return run


# ---------------------------------------------------------------- operator --
def _repeated(names: DataFrame, name: str) -> DataFrame:
    """(cid, names) -> (cid, hits): the names that several classes have, for each class that has one."""
    rows = stored(names.mapInArrow(_name_rows, "name long, cid long"), name)
    shared = rows.groupBy("name").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("name")
    # a row's names are at most its words
    return rows.join(shared, "name", "left_semi").groupBy("cid").agg(F.collect_list("name").alias("hits"))


def _of_rows(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts whose row number is in ``rows``, a stored table."""
    ids = rows.select("row")
    return texts.join(F.broadcast(ids) if rows.count() <= MOST_BROADCAST_IDS else ids, "row", "left_semi")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """(id, n_words, n_removed, ranges, kept_sha256) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged.  A word is removed
    if a window of ``words`` consecutive words covers it whose sequence also starts
    in a row with a smaller id; windows are judged on the input.  ``ranges``
    lists the removed words as {start, end} (from 0, end exclusive), merged and in
    order; ``kept_sha256`` is of the words left, joined by one space, in UTF-8.

    Null, empty and short texts have no window and lose nothing.  A null id is
    larger than all others; rows that repeat an id do not remove from each
    other.  Ids are whole numbers.  ``docs`` is read more than once, so must be
    stable, such as a table.  An empty table gives no row.  Other columns are
    ignored.  Names are 64-bit hashes, of full windows two of them: a false
    match of the last level needs a collision beside a true repeat of half its length."""
    prepare(docs.sparkSession)
    levels = lengths_of(words)
    first, second = levels[:2]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    texts = rows.select("row", "text")
    prints = stored(rows.mapInArrow(_describe(words, first), "row long, id long, n_words long, digest string, key binary, names binary"), "prints")
    # equal texts: the first document stands for all
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = stored(prints.filter(F.col("n_words") >= words).groupBy("key")
                     .agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("copies"), F.first("names").alias("names"))
                     .select("key", F.col("f.row").alias("cid"), F.col("f.id").alias("first_id"), "names"), "classes")

    ids = classes.select("cid", F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("id"))
    found = stored(_repeated(classes.select("cid", "names"), "names").join(ids, "cid"), "hits").withColumnRenamed("cid", "row")
    cut = _of_rows(texts, found).join(found, "row").select("row", "id", "text", "hits")
    stretch = "cid long, id long, at binary, names binary"
    now = stored(cut.mapInArrow(_cut(words, first, second), stretch), "stretches")
    for length, to in zip(levels[1:-1], levels[2:], strict=True):
        hits = _repeated(now.mapInArrow(_least_names(words, length), "cid long, names binary"), "names")
        joined = now.join(hits, "cid")
        if to < words:
            now = stored(joined.mapInArrow(_extended(words, length, to), stretch), "stretches")
    full = stored(joined.mapInArrow(_full_rows(words, levels[-2]), "one long, two long, cid long, id long, pos long"), "windows")

    # a window repeats if the least id that has its names is smaller than the row's
    least = full.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("one", "two", "least")
    gone = full.join(least, ["one", "two"]).filter("id > least").groupBy("cid").agg(F.collect_set("pos").alias("starts"))
    gone = stored(gone.withColumnRenamed("cid", "row"), "removed")
    shape = "row long, ranges array<struct<start:long,end:long>>, n_removed long, kept string"
    lost = _of_rows(texts, gone).join(gone, "row").select("row", "text", "starts").mapInArrow(_kept(words), shape)
    lost = stored(lost, "kept").withColumnRenamed("row", "cid")

    # every row: what its class has, or all words gone if the class began with a smaller id
    whole = classes.select("key", "cid", "first_id").join(lost, "cid", "left")
    again = F.col("cid").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return prints.select("id", "n_words", "digest", "key").join(whole, "key", "left").select(
        "id", "n_words",
        F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(again, everything).otherwise(F.coalesce("ranges", nothing)).alias("ranges"),
        F.when(again, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"))
