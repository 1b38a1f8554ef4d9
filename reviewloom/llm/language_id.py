"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; runs of other characters than letters become one space.
Character 4-grams are counted by language over all labelled texts.  From them
come, for each language, continuation counts of the lower orders, discounts, and
interpolated Kneser-Ney probabilities.  The models are kept together: for each
order one sorted array of n-gram hashes with a column of log probabilities for
each language, and one of context hashes with the back-off weights.  Large
models are dealt into shards by the two middle characters of a 4-gram: all that
its probability needs of orders 3 and 4 then lies in its shard, and orders 1 and
2 are in each.  A text's log probability is the sum over the shards, one pass each.

A text is given the language of the lowest cross-entropy per character.  A
logistic curve over the lead on the second gives the score, and a text is
rejected if it has no letter or its cross-entropy lies above all that the
labelled texts show, by a margin.  Curve and bound come from all labelled texts,
by sums over the table of their leads.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, releasing, scratch_path, stored

ORDER = 4
#: Counts of 4-grams by language in a shard, and cells (distinct 4-grams x languages) of
#: its tables, about.  They bound the memory of what is built and broadcast at once; no gram and no language is left out.
MOST_GRAMS = 2_000_000
MOST_CELLS = 8_000_000
#: Nats by which a rejected text exceeds every cross-entropy of labelled texts.
MARGIN = 0.5
#: Fewest characters of a text that sets the bound of rejection.
LEAST_CHARS = 40

_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _table[0]


def characters(text: str | None) -> np.ndarray:
    """Lower-cased letters (16 bits each) with one 32 (space) before and after
    each run of letters; ORDER - 1 spaces in front.  Empty without letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint64)
    before = np.concatenate(([False], letter[:-1]))
    kept = np.where(letter, c & 0xFFFF, 32)[letter | before].astype(np.uint64)
    tail = [] if kept[-1] == 32 else [32]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint64), kept, np.array(tail, np.uint64)])


def grams(c: np.ndarray) -> np.ndarray:
    """4-grams as 64-bit keys, 16 bits a character, the last one lowest."""
    g = c[ORDER - 1:].copy()
    for k in range(1, ORDER):
        g |= c[ORDER - 1 - k: len(c) - k] << np.uint64(16 * k)
    return g


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed within a batch."""
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(c := characters(text)):
                by.setdefault(lang, []).append(grams(c))
        for lang, all_ in by.items():
            key, n = np.unique(np.concatenate(all_), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(key)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                                             ["lang", "gram", "n"])


# ------------------------------------------------------------------ models --
@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]        # by order 1..4: sorted n-grams of all languages
    logs: list[np.ndarray]        # log probabilities, a column for each language
    contexts: list[np.ndarray]    # by order 2..4: sorted contexts
    backoff: list[np.ndarray]     # log back-off weights
    unseen: np.ndarray            # log probability of a character that no text has
    slope: float = 1.0
    offset: float = 0.0
    most: float = np.inf          # highest accepted cross-entropy
    shard: int = 0
    shards: int = 1

    def entropies(self, c: np.ndarray) -> np.ndarray:
        """Mean negative log probability per character, for each language; of several shards the part of this one."""
        key, n = np.unique(grams(c), return_counts=True)
        if self.shards > 1:
            own = _shard(key, self.shards) == self.shard
            key, n = key[own], n[own]
        total = np.zeros(len(self.languages))
        weight = np.zeros((len(key), len(self.languages)))
        for k in range(ORDER, 0, -1):
            at, hit = _find(self.keys[k - 1], key)
            total += n[hit] @ (self.logs[k - 1][at[hit]] + weight[hit])
            key, n, weight = key[~hit], n[~hit], weight[~hit]
            if k == 1:
                total += n @ (self.unseen + weight)
                break
            if not len(key):
                break
            at, hit = _find(self.contexts[k - 2], key >> np.uint64(16))
            weight[hit] += self.backoff[k - 2][at[hit]]
            key = key & np.uint64((1 << 16 * (k - 1)) - 1)
        return -total / (len(c) - ORDER + 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    """Number of the shard of each 4-gram, from its two middle characters."""
    middle = (gram >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
    return (middle * np.uint64(40503) >> np.uint64(8)) % np.uint64(shards)


def build_models(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, lowest: list | None = None,
                 discounts: list | None = None) -> Models:
    """Interpolated Kneser-Ney models from 4-gram counts (``lang``: index).  For
    a shard, ``lowest`` has the counts of orders 1 and 2 and ``discounts`` those of
    orders 3 and 4 (by language) over all shards."""
    L = len(languages)
    # counts by order: the highest counts texts, a lower one the distinct extensions to the left
    counts = [None] * ORDER
    counts[ORDER - 1] = (lang, gram, n.astype(np.float64))
    for k in range(ORDER - 1, 0, -1):
        l, g, _ = counts[k]
        low = g & np.uint64((1 << 16 * k) - 1)
        order = np.lexsort((low, l))
        l, low = l[order], low[order]
        first = np.concatenate(([True], (l[1:] != l[:-1]) | (low[1:] != low[:-1]))) if len(l) else np.empty(0, bool)
        start = np.flatnonzero(first)
        counts[k - 1] = (l[start], low[start], np.diff(np.concatenate((start, [len(l)]))).astype(np.float64))
    if lowest:
        counts[:2] = lowest
    every = np.unique(counts[0][1])
    base = np.full(L, np.log(1.0 / (len(every) + 1)))
    models = Models(languages, [], [], [], [], base)
    for k in range(1, ORDER + 1):
        l, g, c = counts[k - 1]
        keys = np.unique(g)
        table = np.zeros((len(keys), L))
        table[np.searchsorted(keys, g), l] = c
        d = discounts[k - 3] if discounts and k > 2 else np.array([_discount(float((c[l == i] == 1).sum()), float((c[l == i] == 2).sum())) for i in range(L)])
        ctx = np.unique(keys >> np.uint64(16))
        at = np.searchsorted(ctx, keys >> np.uint64(16))
        total, kinds = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
        np.add.at(total, at, table)
        np.add.at(kinds, at, table > 0)
        known = total > 0
        gamma = np.where(known, d * kinds / np.where(known, total, 1), 1.0)  # an unseen context backs off whole
        lower = np.exp(_lower(models, keys, k))
        own = np.maximum(table - d, 0) / np.where(known, total, 1)[at]
        models.keys.append(keys)
        models.logs.append(np.log(own + gamma[at] * lower).astype(np.float32))
        if k > 1:
            models.contexts.append(ctx)
            models.backoff.append(np.log(gamma).astype(np.float32))
        else:
            models.unseen = np.log(gamma[0] * np.exp(base)) if len(gamma) else base
    return models


def _discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def _lower(m: Models, keys: np.ndarray, k: int) -> np.ndarray:
    """Log probability of the last character of each ``k``-gram by order k - 1."""
    if k == 1:
        return np.broadcast_to(m.unseen, (len(keys), len(m.languages)))
    at, _ = _find(m.keys[k - 2], keys & np.uint64((1 << 16 * (k - 1)) - 1))  # every suffix was counted
    return m.logs[k - 2][at].astype(np.float64)


def train(labelled: DataFrame) -> Iterator[Models]:
    """(id, lang, text) -> models, shard by shard.  Counts cover all rows, whole texts and all grams."""
    counts = stored(labelled.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = [r.lang for r in labelled.select("lang").distinct().orderBy("lang").collect()]  # one short name for each label
    index = {x: i for i, x in enumerate(languages)}

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = df.toArrow()
        return (np.array([index[x] for x in got.column("lang").to_pylist()], np.int64),
                got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy())

    cells = counts.select("gram").distinct().count() * len(languages)
    shards = max(1, -(-counts.count() // MOST_GRAMS), -(-cells // MOST_CELLS))
    if shards == 1:
        yield build_models(languages, *arrays(counts.select("lang", "gram", "n")))
        return
    one = F.count(F.lit(1)).alias("n")
    third = stored(counts.groupBy("lang", F.col("gram").bitwiseAND((1 << 48) - 1).alias("gram")).agg(one), "grams3")
    second = stored(third.groupBy("lang", F.col("gram").bitwiseAND((1 << 32) - 1).alias("gram")).agg(one), "grams2")
    first = second.groupBy("lang", F.col("gram").bitwiseAND((1 << 16) - 1).alias("gram")).agg(one)
    low = []
    for df in (first, second):
        l, g, n = arrays(df.select("lang", "gram", "n"))
        order = np.lexsort((g, l))
        low.append((l[order], g[order], n[order].astype(np.float64)))
    discounts = []
    for df in (third, counts):
        kinds = {r.lang: r for r in df.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discounts.append(np.array([_discount(float(kinds[x].n1), float(kinds[x].n2)) if x in kinds else 0.5 for x in languages]))
    middle = F.shiftrightunsigned("gram", 16).bitwiseAND(0xFFFFFFFF)
    dealt = stored(counts.withColumn("shard", F.shiftright(middle * 40503, 8) % shards), "dealt")
    for i in range(shards):
        m = build_models(languages, *arrays(dealt.filter(F.col("shard") == i).select("lang", "gram", "n")), low, discounts)
        m.shard, m.shards = i, shards
        yield m


def _best(e: np.ndarray, languages: list[str]) -> tuple[str, float, float]:
    """Best language, its entropy, and its lead on the second."""
    i = int(np.argmin(e))
    return languages[i], float(e[i]), float(np.partition(e, 1)[1] - e[i]) if len(e) > 1 else float(e[i])


def _part(spread):
    """(row, text) -> (row, shard, chars, part): a shard's share of the entropies."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for b in batches:
            chars, part = [], []
            for text in b.column(1).to_pylist():
                c = characters(text)
                chars.append(max(0, len(c) - ORDER + 1))
                part.append(m.entropies(c).tolist() if len(c) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.repeat(pa.scalar(m.shard, pa.int32()), len(chars)), pa.array(chars, pa.int64()), pa.array(part, pa.list_(pa.float64()))],
                                             ["row", "shard", "chars", "part"])
    return run


def _sums(languages: list[str]):
    """(row, chars, parts in the order of the shards) -> best and second language's entropy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_best(np.sum(p, 0), languages) if p else (None, None, None) for p in b.column(2).to_pylist()]
            best, h, lead = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(h, pa.float64()), pa.array(lead, pa.float64()), b.column(1)],
                                             ["row", "best", "entropy", "lead", "chars"])
    return run


def _measured(rows: DataFrame, folder: str, models: Models, shards: Iterator[Models]) -> DataFrame:
    """(row, text) -> (row, best, entropy, lead, chars) by a pass over ``rows`` for each shard."""
    context = rows.sparkSession.sparkContext
    for m in chain([models], shards):
        spread = context.broadcast(m)
        rows.select("row", "text").mapInArrow(_part(spread), "row long, shard int, chars long, part array<double>").write.mode("append").parquet(folder)
        spread.destroy()
    parts = rows.sparkSession.read.parquet(folder).groupBy("row").agg(
        F.first("chars").alias("chars"), F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("shard", "part")))), lambda x: x["part"]).alias("parts"))
    return parts.mapInArrow(_sums(models.languages), "row long, best string, entropy double, lead double, chars long")


def _measure(spread):
    """(id, .., text) -> best and second language's entropy."""
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for b in batches:
            best, h, lead, chars = [], [], [], []
            for text in b.column("text").to_pylist():
                c = characters(text)
                if not len(c) or not m.languages:
                    best.append(None), h.append(None), lead.append(None), chars.append(0)
                    continue
                found = _best(m.entropies(c), m.languages)
                best.append(found[0]), h.append(found[1]), lead.append(found[2]), chars.append(len(c) - ORDER + 1)
            rest = [(b.schema.names[i], b.column(i)) for i in range(b.num_columns) if b.schema.names[i] != "text"]
            yield pa.RecordBatch.from_arrays([x for _, x in rest] + [pa.array(best, pa.string()), pa.array(h, pa.float64()), pa.array(lead, pa.float64()), pa.array(chars, pa.int64())],
                                             [k for k, _ in rest] + ["best", "entropy", "lead", "chars"])
    return run


def _fit_curve(cases: DataFrame) -> tuple[float, float]:
    """(slope, offset) of 1 / (1 + exp(-(slope * lead + offset))) over all rows (lead, right), with smoothed
    targets and a small penalty: a job that sums over the rows for each Newton step, as in ``fit_logistic``."""
    at = cases.agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n1"), F.avg("lead").alias("mean"), F.stddev_pop("lead").alias("std")).first()
    n1, n0 = at.n1, at.n - at.n1
    if not n1 or not n0:
        return 0.0, math.log((n1 + 1) / (n0 + 1))
    scale = at.std if at.std > 0 else 1.0
    x = (F.col("lead") - at.mean) / scale
    t = F.when(F.col("right"), (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    w, offset = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * w + offset))))
        h, e = p * (1 - p) + 1e-9, p - t
        got = cases.agg(F.sum(h * x * x), F.sum(h * x), F.sum(h), F.sum(e * x), F.sum(e)).first()
        step = np.linalg.solve([[got[0] + 0.01, got[1]], [got[1], got[2]]], [got[3] + 0.01 * w, got[4]])
        w, offset = (float(v - s) for v, s in zip((w, offset), np.clip(step, -2, 2)))
        if np.abs(step).max() < 1e-9:
            break
    return w / scale, offset - w * at.mean / scale


def calibrate(models: Models, labelled: DataFrame) -> None:
    """Score curve and bound of rejection from (lang, best, entropy, lead, chars) of all labelled texts."""
    right = F.col("lang") == F.col("best")
    cases = labelled.filter("best is not null").select("lead", right.alias("right"), "entropy", (right & (F.col("chars") >= LEAST_CHARS)).alias("long"))
    most = cases.agg(F.coalesce(F.max(F.when(F.col("long"), F.col("entropy"))), F.max("entropy"))).first()[0]
    if most is not None:
        models.slope, models.offset = _fit_curve(cases)
        models.most = most + MARGIN


def identify_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, learned, lang_pred, score, entropy, rejected) for every row.

    Models learn from rows with ``learn`` true, a text and a language.
    ``lang_pred`` is a learned language, or ``und`` (score 0) if the text is
    null or has no letter, or if nothing was learned.  ``rejected`` is true for
    those and for texts whose cross-entropy per character exceeds the calibrated bound.
    Equal entropies: first language by name.  There may be any number of languages: what
    exceeds MOST_CELLS is dealt into more shards, with a pass over the texts each.  Texts
    may have any length.  Rows with null or repeated ids each get a row, an empty table gives none; other columns are ignored.  ``docs`` is read more than once, so must be stable."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learned"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = rows.filter("learned and lang is not null and text is not null").select("id", "lang", "text")
    shards = train(labelled)
    models = next(shards)
    has_text = F.col("text").isNotNull().alias("has_text")
    if models.shards > 1:
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        found = stored(_measured(rows, scratch_path(spark, "parts"), models, shards), "measured")
        told = rows.select("row", "id", "learned", "lang", has_text).join(found, "row")
    else:
        kind = dict(rows.dtypes)["id"]
        told = stored(rows.select("id", "learned", "lang", has_text, "text").mapInArrow(
            _measure(spark.sparkContext.broadcast(models)),
            f"id {kind}, learned boolean, lang string, has_text boolean, best string, entropy double, lead double, chars long"), "measured")
    calibrate(models, stored(told.filter("learned and lang is not null and has_text").select("lang", "best", "entropy", "lead", "chars"), "leads"))
    out = told.select("id", "learned", "best", "entropy", "lead", "chars")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), models.slope * F.col("lead") + models.offset))))
    return out.select("id", "learned", F.coalesce("best", F.lit("und")).alias("lang_pred"),
                      F.when(F.col("best").isNull(), 0.0).otherwise(score).alias("score"), "entropy",
                      (F.col("best").isNull() | (F.col("entropy") > F.lit(models.most))).alias("rejected"))
