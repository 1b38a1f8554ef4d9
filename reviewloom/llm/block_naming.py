"""Exact dedup by deterministic block naming.

Equal texts are found by giving every text an integer name that is equal for
equal texts and only for them.  A text is cut into blocks of a fixed number of
bytes.  The distinct blocks are sorted and numbered; then adjacent pairs of
numbers are sorted and numbered, again and again, until one number is left of
each text.  Numbers are given by comparing the blocks themselves, so two
different texts can never get the same name; no hash decides equality.

A 64-bit fingerprint is used only to leave out texts that need no name: one
whose fingerprint occurs once differs from all others and is its own group.
The blocks of the others are the only texts that are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: Bytes of a block.
BLOCK = 1 << 14


def _named(items: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` in sorted order within their partitions, each with an
    integer name.  Written once, so that every reader sees the same names."""
    distinct = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses"))  # summed on the map side first
    return stored(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
                  .drop("uses"), "names")


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, data binary) -> (row, level, name): equal data, equal (level, name).
    ``row`` must be unique."""
    n = F.greatest(F.lit(1), F.ceil(F.length("data") / F.lit(block))).cast("int")
    cut = texts.select("row", n.alias("blocks"), F.posexplode(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.substring(F.col("data"), i * block + 1, F.lit(block)))).alias("pos", "piece"))
    cut = stored(cut, "blocks")
    names = _named(cut, ["piece"])
    now = stored(cut.join(names, "piece").select("row", "blocks", "pos", "name"), "level0")
    done = [now.filter("blocks = 1").select("row", F.lit(0).alias("level"), "name")]
    level = 0
    while True:
        level += 1
        now = now.filter("blocks > 1")
        if now.isEmpty():
            break
        half = F.expr("pos div 2").cast("int")
        pairs = now.groupBy("row", "blocks", half.alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stored(pairs, "pairs")
        names = _named(pairs, ["a", "b"])
        now = stored(pairs.join(names, ["a", "b"]).select(
            "row", F.expr("(blocks + 1) div 2").cast("int").alias("blocks"), F.col("half").alias("pos"), "name"),
            f"level{level}")
        done.append(now.filter("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when they are identical; null counts as empty.  Of equal
    texts the row with the largest id stays (a null id is smaller than all; of
    rows that repeat one id, just one stays).  ``docs`` must be a stable
    relation such as a table scan: it is read twice.  Empty tables give no
    row; other columns are ignored."""
    prepare(docs.sparkSession)
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), data.alias("data"))
    slim = stored(rows.select("row", "id", F.xxhash64("data").alias("print"), F.length("data").alias("bytes"),
                              F.unhex(F.sha2("data", 256)).alias("sha")), "prints")
    again = slim.groupBy("print", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeated = stored(slim.join(again, ["print", "bytes"], "left_semi").select("row", "id"), "repeated")
    names = block_names(rows.select("row", "data").join(repeated.select("row"), "row", "left_semi"), block)
    named = stored(repeated.join(names, "row"), "identities")
    groups = named.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("last"))
    found = named.join(groups, ["level", "name"]).select(
        "row", "group_size", F.col("last.id").alias("keep_id"), (F.col("row") == F.col("last.row")).alias("kept"))
    return slim.join(found, "row", "left").select(
        "id", F.when(F.col("kept").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
