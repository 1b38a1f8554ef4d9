"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to words (A-Z lower-cased; separators are the
ASCII characters that are neither letter nor digit).  Every window of 13 words
(an item of fewer words is one window) becomes a pattern with a space on both
sides.  The automaton over all patterns scans each document's normalised text
once; matches are mapped back to word numbers, and to offsets of the original
text for documents that have any.

The patterns come from the benchmark alone.  They go to the tasks as one
broadcast of at most ``most_bytes``; a larger benchmark is dealt into shards of
that size by item, each with a scan of its own, and the hits are united.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, releasing, stored

#: Words of a window.
WINDOW = 13
#: Bytes of normalised benchmark text in one automaton.
MOST_BYTES = 16 << 20

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def patterns(items: list[tuple[int | None, list[bytes]]], window: int = WINDOW) -> dict[str, tuple[int, list[int]]]:
    """Pattern -> its number of words and the items that hold it."""
    out: dict[str, tuple[int, list]] = {}
    for item, words in items:
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            key = (b" " + b" ".join(words[i:i + k]) + b" ").decode("latin-1")
            got = out.setdefault(key, (k, []))[1]
            if item is not None and item not in got:
                got.append(item)
    return out


def _automaton(found: dict[str, tuple[int, list[int]]]):
    a = ahocorasick.Automaton()
    for key, value in found.items():
        a.add_word(key, value)
    a.make_automaton()
    return a


_built: dict[str, object] = {}


def _scan(spread):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = spread.value
        if key not in _built:
            _built.clear()
            _built[key] = _automaton(found) if found else None
        a = _built[key]
        for b in batches:
            n_words, hit, items, spans = [], [], [], []
            for t in b.column(1).to_pylist():
                words = normal_words(t)
                n_words.append(len(words))
                text = (b" " + b" ".join(words) + b" ").decode("latin-1")
                got, who, gaps = [], set(), None
                for end, (k, ids) in a.iter(text) if a is not None else ():
                    if gaps is None:
                        gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                    last = int(np.searchsorted(gaps, end))  # the closing space follows word number last - 1
                    got.append((last - k, last))
                    who.update(ids)
                runs = _united(got)
                hit.append([i for r in runs for i in range(*r)])
                items.append(sorted(who))
                spans.append(_offsets(t, runs) if runs else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())),
                 pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["id", "n_words", "hit", "items", "spans"])
    return run


def _united(got: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping word ranges merged."""
    out: list[list[int]] = []
    for a, z in sorted(got):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(r) for r in out]


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[list[int]]:
    """Word ranges -> [start, end) in code points of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [[at[a][0], at[z - 1][1]] for a, z in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans, contaminated) for every row of ``docs``.

    A document word inside any occurrence of a window is hit.  ``items`` are
    the ids of items with occurring windows, sorted as strings; an item without
    an id marks words but is not listed.  ``spans`` are the hit ranges in code points.
    Contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null texts have no
    words; null or wordless items no windows; rows that repeat an item count as
    one item.  Repeated rows of ``docs`` each get a row, null ids included."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    # a window's words are at most `window` times those of the item
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = 1 + int(size) * (window + 1) // most_bytes
    schema = "id long, n_words long, hit array<int>, items array<long>, spans array<array<long>>"

    def scan(shard: int, frame: DataFrame, columns: str = schema) -> DataFrame:
        part = bench if shards == 1 else bench.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard)
        found = patterns([(r.item, normal_words(r.text)) for r in part.collect()], window)
        key = hashlib.sha256("\n".join(f"{k}{v}" for k, v in sorted(found.items())).encode("utf-8", "surrogatepass")).hexdigest()
        return frame.mapInArrow(_scan(spark.sparkContext.broadcast((key, found))), columns)

    if shards == 1:
        out = scan(0, texts)
    else:
        rows = texts.select(F.monotonically_increasing_id().alias("id"), "text")
        each = None
        for s in range(shards):
            one = stored(scan(s, rows), "hits")
            each = one if each is None else each.unionByName(one)
        joined = each.groupBy("id").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")).withColumnRenamed("id", "row")
        out = texts.select(F.monotonically_increasing_id().alias("row"), "id").join(joined, "row").drop("row")
    n_hit = F.size("hit").cast("long")
    return out.select("id", "n_words", n_hit.alias("n_hit"),
                      F.array_sort(F.col("items").cast("array<string>")).alias("items"), "spans",
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
