"""Merkle manifest of a table: a hash tree per source, and one over the sources.

Method: lag/lead windows.  The leaves of a source stand in order of their id;
node number p of a level belongs to run p div 16.  Per level, a window over each
run has lag and lead columns at the fixed offsets 1 to 15, masked by the node's slot
and the run's length: they are the node's siblings.  The rows of first
children (slot 0) hash the parents, which are the nodes of the next level.
Going down again, each node's siblings are put before its parent's path, so
every leaf ends up with the siblings of all its levels.

A source may hold any share of all rows: places come from a range partitioning with
counts per partition, windows and joins are over runs of 16 nodes, and no
task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

FANOUT = 16
#: Rows of a partition lie in this many low bits of monotonically_increasing_id.
_PLACE_BITS = 33


def leaf_digest(*fields: Column) -> Column:
    """Hash of a row's fields: each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def siblings_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def _ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their place in ``order`` within their tree, and ``n``, its size.

    Sorted by ranges; a row's place is its place in its partition and the counts of
    those before it.  The sorted rows are written, so places hold."""
    placed = stored(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                    .withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", _PLACE_BITS).alias("part")
    # a row for each tree in each partition
    counts = placed.groupBy(tree, part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(tree).orderBy("part")
    counts = counts.select(tree, "part", "first", (F.sum("c").over(before) - F.col("c")).alias("before"),
                           F.sum("c").over(Window.partitionBy(tree)).alias("n"))
    return placed.withColumn("part", part).join(counts, [tree, "part"]) \
        .withColumn("pos", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (tree, pos, n, hash) -> plus run, slot, and ``left`` and ``right``: the
    hashes of the run's other nodes before and after the node, in order."""
    run = Window.partitionBy("tree", "run").orderBy("pos")
    nodes = nodes.withColumn("run", F.expr(f"pos div {fanout}")).withColumn("slot", F.col("pos") % fanout) \
        .withColumn("length", F.least(F.lit(fanout), F.col("n") - F.col("run") * fanout))
    none = F.lit("")
    left = [F.when(F.col("slot") >= k, F.lag("hash", k).over(run)).otherwise(none) for k in range(fanout - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < F.col("length"), F.lead("hash", k).over(run)).otherwise(none) for k in range(1, fanout)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)}).drop("length")


def _levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes (tree, pos, n, hash) of each level, from the leaves up.  ``n`` is
    the tree's number of nodes in the level; trees end with the level that has one."""
    levels = [leaves]
    while not levels[-1].filter("n > 1").isEmpty():
        first = _with_siblings(levels[-1].filter("n > 1").select("tree", "pos", "n", "hash"), fanout).filter("slot = 0")
        levels.append(stored(first.select("tree", F.col("run").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                                          F.sha2(F.concat("hash", "right"), 256).alias("hash")), "level"))
    return levels


def _down(levels: list[DataFrame], fanout: int, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The leaves with ``path`` and what ``top`` gives the single node of each tree.

    ``path`` lists {left, right} of each level, from the leaf up."""
    above = None
    for nodes in reversed(levels):
        now = top(nodes.filter("n = 1"))
        if above is not None:
            parents = above.drop("n", "hash").withColumnsRenamed({"pos": "run", "path": "rest"})
            below = _with_siblings(nodes.filter("n > 1"), fanout).join(parents, ["tree", "run"])
            own = F.array(F.struct("left", "right"))
            below = below.withColumn("path", F.concat(own, "rest")).drop("run", "slot", "left", "right", "rest")
            now = now.unionByName(below)
        above = now
    return above


def merkle_manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", source_col: str = "source",
                    keep: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, <keep>, leaf, subroot, root, path) for every row of ``docs``.

    ``leaf`` is a row's hash in lowercase hex (see leaf_digest).  Per source,
    leaves ascend by id; while several nodes remain, every ``fanout`` consecutive
    ones (the last run may have fewer, even one) become the hash of
    their hashes; what remains is ``subroot``.  Subroots in order of their source (null
    first, by UTF-8 bytes) give ``root`` in the same way.  ``path`` has for
    each level, via subroot to root, the hashes of the run's other nodes:
    ``left`` and ``right`` of the node, concatenated, '' where there is none.

    Null fields have a hash of their own; texts of any length are hashed as a
    whole.  Rows with a null id come first in their source.  Rows that repeat an id are ordered by
    their hash, so the tree is the same however rows are stored; equal rows
    each are a leaf.  An empty table gives no row.  Other columns of ``docs`` are ignored."""
    prepare(docs.sparkSession)
    keep = keep or {}
    # names sort like the sources: null first
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    rows = stored(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("hash"),
                              *[c.alias(f"keep_{k}") for k, c in keep.items()]), "leaves")
    levels = _levels(_ranked(rows, "tree", "id", "hash"), fanout)
    # leaves of several sources have a node in each of the levels below their own subroot
    narrow = ("tree", "pos", "n", "hash")
    subroots = levels[0].filter("n = 1").select(*narrow)
    for nodes in levels[1:]:
        subroots = subroots.unionByName(nodes.filter("n = 1").select(*narrow))
    named = _ranked(subroots.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "hash"), "all", "name")
    named = named.withColumnRenamed("all", "tree")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    top = _down(_levels(named, fanout), fanout,
                lambda one: one.withColumns({"root": F.col("hash"), "path": nothing}))
    tops = stored(top.select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "subroots")
    found = _down(levels, fanout, lambda one: one.join(tops, "tree"))
    return found.select("id", *[F.col(f"keep_{k}").alias(k) for k in keep], F.col("hash").alias("leaf"), "subroot", "root", "path")
