"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a share of all words.  A source that has more than its share
keeps the documents whose hash lies below a threshold; one that has less
repeats all documents and repeats once more those below the threshold.  The
threshold comes from histograms of words by source and hash bucket: cumulated
sums find the bucket that holds the budget, and only that boundary bucket is
split again by the next bits of the hash, until the hash is used up.  No row is
sorted, and thresholds of smaller budgets are nested in those of larger ones.

A document longer than the budget is left out of the histogram.  Where the first document above the budget
ends a threshold, the search goes on behind it among those that fit into what is left, a fixed number
of times; then the one document that brings the sum nearest to the target is taken, if any does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, word_count

#: Bits of the hash, and bits used by each histogram.
HASH_BITS = 60
LEVEL_BITS = 15
#: No document is taken more often than this.
MOST_REPEATS = 3
#: Thresholds of a source, one behind the other.
TURNS = 3


def row_hash(id_col: Column, text_col: Column) -> Column:
    """60 bits of the id's md5; a row without id is hashed by its text."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), text_col.cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], cap: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> plus ``target``: the sources' shares of all
    words by weight, at most ``cap`` times a source's size, the excess shared
    by weight among the others until none is above.

    The final share of an uncapped source is weight x level, where sources are
    capped in order of cap / weight; running sums over the sources in that
    order give the level.  One row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), k + 1).cast("long"))
    limit = F.col("source_size") * cap
    up = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    w = weighed.withColumn("total", F.sum("source_size").over(everyone)) \
        .withColumn("weights", F.sum("weight").over(everyone)) \
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0))) \
        .withColumn("rest_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("capped", limit * F.col("rest_weight") <= F.col("rest") * F.col("weight")) \
        .withColumn("place", F.row_number().over(up)) \
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("place", "rest", "rest_weight"))).over(everyone))
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.rest_weight")
    return w.select("source", "source_size",
                    F.when(F.col("capped"), limit.cast("double")).otherwise(share).alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, hash, size) and (source, budget, threshold) -> (source, threshold, rest): the
    largest hash threshold whose rows of at most ``budget`` words, from the given threshold on, hold
    at most ``budget``; and what is left of it."""
    of = F.expr("source <=> of")
    limits = budgets.select(F.col("source").alias("of"), F.col("budget").alias("most"), F.col("threshold").alias("start"))
    rows = rows.join(limits, of).filter("size <= most and hash >= start").select("source", "hash", "size")
    open_ = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("base"))
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        # rows of the source that lie in its boundary bucket
        inside = rows.join(open_.withColumnRenamed("source", "of"), of).drop("of") \
            .filter(F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("base", shift + LEVEL_BITS))
        sums = inside.groupBy("source", "base", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run))
        # the boundary bucket is the first whose running sum exceeds the budget
        cut = sums.groupBy("source", "base", "left").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("below")))).alias("b"),
            F.max("upto").alias("all"))
        shifted = F.shiftleft(F.col("b.bucket"), shift)
        whole = F.shiftleft(F.shiftright("base", shift + LEVEL_BITS) + 1, shift + LEVEL_BITS)
        cut = cut.select("source", F.coalesce(shifted, whole).alias("base"), F.col("b").isNull().alias("closed"),
                         (F.col("left") - F.coalesce("b.below", "all")).alias("left"))
        done = stored(cut, "thresholds")
        closed = done.filter("closed") if shift == HASH_BITS - LEVEL_BITS else closed.unionByName(done.filter("closed"))
        open_ = done.filter("not closed").drop("closed")
    return closed.drop("closed").unionByName(open_).select("source", F.col("base").alias("threshold"), F.col("left").alias("rest"))


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MOST_REPEATS) -> DataFrame:
    """(source, hash, size) -> (s, source_size, target, whole, steps, last), one row per source:
    each row is taken ``whole`` times, and once more if a step {most, threshold} has its
    size at most ``most`` and its hash below ``threshold``, or if it is the ``last`` {hash, size}."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, list(weights), cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    plan = targets.withColumn("whole", whole).select(
        F.col("source").alias("s"), "source_size", "target", "whole", budget.alias("budget"), F.lit(0).cast("long").alias("threshold"),
        F.array().cast("array<struct<most:long,threshold:long>>").alias("steps"))
    rows = rows.select("source", "hash", "size")
    for _ in range(TURNS):
        cuts = hash_thresholds(rows, plan.select(F.col("s").alias("source"), "budget", "threshold")).withColumnRenamed("threshold", "next")
        both = plan.join(cuts, plan.s.eqNullSafe(cuts.source), "left")
        step = F.array(F.struct(F.col("budget").alias("most"), F.col("next").alias("threshold")))
        plan = stored(both.select("s", "source_size", "target", "whole", F.coalesce("rest", "budget").alias("budget"),
                                  F.coalesce("next", "threshold").alias("threshold"),
                                  F.when(F.col("next").isNull(), F.col("steps")).otherwise(F.concat("steps", step)).alias("steps")), "plan")
    # of the rows that are left, the one that comes nearest to the target
    miss = F.abs(F.col("budget") - F.col("size"))
    left = rows.join(plan, rows.source.eqNullSafe(plan.s)).filter(~_in_steps() & (miss < F.col("budget")))
    last = left.groupBy(F.col("s").alias("source")).agg(F.min(F.struct(miss.alias("miss"), "hash", "size")).alias("last"))
    return stored(plan.join(last, plan.s.eqNullSafe(last.source), "left").select("s", "source_size", "target", "whole", "steps", "last"), "plan")


def _in_steps() -> Column:
    return F.exists("steps", lambda x: (F.col("size") <= x["most"]) & (F.col("hash") < x["threshold"]))


def _copies(cap: int) -> Column:
    last = F.coalesce((F.col("hash") == F.col("last.hash")) & (F.col("size") == F.col("last.size")), F.lit(False))
    return F.least(F.lit(cap).cast("long"), F.col("whole") + (_in_steps() | last).cast("long"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                              word_count(F.col(text_col).cast("string")).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")), "sizes")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (1, 2, 3), cap: int = MOST_REPEATS) -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) for every row.

    ``size`` counts ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources are ordered
    by code point, null last, and weigh ``weights`` in turn.  ``copies`` is how
    often the mix takes the row, ``taken`` is copies x size.  No single further
    document brings a source's taken words nearer to its target (unless rows repeat
    an id).  Reruns agree: the hash is the id's md5, without an id the text's;
    rows that repeat an id and a size are taken or left together.  Rows without
    words are taken as often as hash and threshold say, with 0 words.  An empty
    table gives no row.  Other columns are ignored."""
    rows = _sizes(docs, id_col, text_col, source_col)
    plan = mixing_plan(rows, weights, cap)
    return rows.join(plan, rows.source.eqNullSafe(plan.s)).withColumn("copies", _copies(cap)) \
        .select("id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), cap: int = MOST_REPEATS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; same columns.  Rows are
    filtered and repeated where they lie, against the plan's row of their source."""
    plan = mixing_plan(_sizes(docs, id_col, text_col, source_col), weights, cap)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash(F.col(id_col), F.col(text_col)).alias("hash"),
                      word_count(F.col(text_col).cast("string")).alias("size"), F.col(source_col).cast("string").alias("source"))
    taken = row.join(plan, row.source.eqNullSafe(plan.s)).withColumn("copies", _copies(cap).cast("int")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
