"""Spelling variant grouping: words of a corpus that differ by one code point.

Method: pivotal grams.  The distinct words' bigrams have one global order, rarest
first.  A word's prefix is its three rarest bigrams (and those that are
as rare as the third); among them dynamic programming chooses the two disjoint ones,
the pivots, that are rarest together.  One edit changes at most one of two
disjoint bigrams, so of two near words the one whose prefix ends earlier has
a pivot that stands in the other's prefix.  Pivots are therefore looked up among
prefix bigrams only, with position limits: the edit lies before, in, between or behind
the pivots, each place leaves one of them where it was, counted from the word's start or
end, together with what lies on the far side of the edit; and the lengths differ by one at
most.  Pairs found are verified by edit distance, once per pair.

The words are counted first, so a word that makes up a third of the corpus is one
row.  The join's keys hold the untouched parts, not the bigram alone, so groups are
small: mostly a word's own near words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

# The runs that are words; A-Z are lower-cased.
RUNS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 2
#: Edits, disjoint pivots (one more) and the bigrams of a prefix.
EDITS = 1
PREFIX = GRAM * EDITS + 1


def corpus_words(docs: DataFrame, id_col: str, text_col: str, every: int | None) -> DataFrame:
    """(word, n): the runs of letters of all texts, with their occurrences.

    With ``every``, a run loses one code point where ``every`` divides the crc32 of
    ``<id>:<run>``; its place is that crc32 modulo the run's length."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUNS), 0)).alias("run"))
    runs = runs.withColumn("run", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER)))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        runs = runs.withColumn("run", F.when(h % every == 0, cut).otherwise(F.col("run")))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- prefixes --
def _bigrams(word: Column) -> Column:
    """Array of {pos, gram}, positions from 0."""
    return F.transform(F.sequence(F.lit(0), F.length(word) - GRAM),
                       lambda i: F.struct(i.alias("pos"), F.substr(word, i + 1, F.lit(GRAM)).alias("gram")))


def _best_pivots(grams: Column) -> Column:
    """Of {pos, gram, rank} in order of position, the EDITS + 1 disjoint ones of least total
    rank: for each number k of pivots the best choice among the bigrams up to here, which
    either leaves this bigram out or puts it behind the best k - 1 that end before it.

    The state holds, for the latest position and the one before, the best choice of
    each k; a bigram is disjoint from all that start two places earlier."""
    none = F.struct(F.lit(float("inf")).alias("cost"), F.array().cast("array<int>").alias("at"))
    empty = F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("at"))
    first = F.array(empty, *[none] * (EDITS + 1))
    start = F.struct(F.lit(-9).alias("pos"), first.alias("now"), first.alias("before"))

    def step(s: Column, g: Column) -> Column:
        # what ends before this bigram: all up to the last one, unless that is its neighbour
        free = F.when(g["pos"] - s["pos"] >= GRAM, s["now"]).otherwise(s["before"])
        took = [F.struct((free[k - 1]["cost"] + g["rank"]).alias("cost"), F.concat(free[k - 1]["at"], F.array(g["pos"])).alias("at"))
                for k in range(1, EDITS + 2)]
        best = [F.when(took[k - 1]["cost"] < s["now"][k]["cost"], took[k - 1]).otherwise(s["now"][k]) for k in range(1, EDITS + 2)]
        return F.struct(g["pos"].alias("pos"), F.array(s["now"][0], *best).alias("now"), s["now"].alias("before"))

    return F.aggregate(grams, start, step, lambda s: s["now"][EDITS + 1]["at"])


def prefixes(words: DataFrame) -> DataFrame:
    """(word) of at least PREFIX + 1 code points -> (word, prefix, pivots): {pos, gram,
    rank} of the prefix by position, and the pivots' positions."""
    grams = words.select("word", F.explode(_bigrams(F.col("word"))).alias("b")).select("word", "b.pos", "b.gram")
    # rarer is smaller, ties by name.  RUNS has 90 letters after lower-casing, so there are at most 8 100 bigrams
    rank = grams.groupBy("gram").agg(F.count(F.lit(1)).cast("double").alias("freq"))
    ranked = grams.join(F.broadcast(rank), "gram").groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("freq", "gram", "pos"))).alias("all"))  # a word's own bigrams
    end = F.col("all")[PREFIX - 1]
    inside = F.filter("all", lambda g: (g["freq"] < end["freq"]) | ((g["freq"] == end["freq"]) & (g["gram"] <= end["gram"])))
    by_place = F.array_sort(F.transform(inside, lambda g: F.struct(g["pos"].alias("pos"), g["gram"].alias("gram"), g["freq"].alias("rank"))))
    return ranked.select("word", by_place.alias("prefix")) \
        .withColumn("pivots", _best_pivots(F.col("prefix")))


# -------------------------------------------------------------------- pairs --
#: Code points of the other end, or next to the bigram, that a key may hold besides.
MORE = (0, 2, 4)


def _key(kind: int, part: Column, other: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(kind), part, other, size)


def _head(n: Column) -> Column:
    return F.substr("word", F.lit(1), n)


def _tail(n: Column) -> Column:
    return F.substr("word", F.length("word") - n + 1)


def _largest(n: Column) -> Column:
    """The largest of MORE that is at most ``n``."""
    return F.when(n >= MORE[2], F.lit(MORE[2])).when(n >= MORE[1], F.lit(MORE[1])).otherwise(F.lit(MORE[0]))


def _offered(at: Column) -> Column:
    """Keys under which a word with a prefix bigram at ``at`` is found.  Kind 0: the word up to the
    bigram's end and some last code points; 1: some more behind the bigram; 2 and 3: the same from the other end."""
    size, none = F.length("word"), F.lit("")
    before, behind = at, size - at - GRAM
    out = []
    for k in MORE:
        out.append(F.when(behind >= k, _key(0, _head(at + GRAM), _tail(F.lit(k)), size)))
        out.append(F.when(before >= k, _key(2, _tail(size - at), _head(F.lit(k)), size)))
        if k:
            out.append(F.when(behind >= k, _key(1, _head(at + GRAM + k), none, size)))
            out.append(F.when(before >= k, _key(3, _tail(size - at + k), none, size)))
    return F.array(*out)


def _wanted(size: Column) -> Column:
    """Keys of near words of ``size`` code points, for each place that the edit can have
    to the pivots a and b: behind b, before a, between, in b, in a."""
    a, b, n = F.col("pivots")[0], F.col("pivots")[1], F.length("word")
    none = F.lit("")
    gap, behind = _largest(b - a - GRAM), n - b - GRAM
    in_b = F.when(gap > 0, _key(1, _head(a + GRAM + gap), none, size)).otherwise(_key(0, _head(a + GRAM), _tail(_largest(behind)), size))
    in_a = F.when(gap > 0, _key(3, _tail(n - b + gap), none, size)).otherwise(_key(2, _tail(n - b), _head(_largest(a)), size))
    return F.array(_key(0, _head(b + GRAM), none, size), _key(2, _tail(n - a), none, size),
                   _key(0, _head(a + GRAM), _tail(_largest(n - b)), size), in_b, in_a)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word) -> (a, b), a < b: all pairs that differ by exactly one inserted, deleted or replaced code point.

    Words are distinct and have at least PREFIX + 1 code points."""
    table = stored(prefixes(words), "prefixes")
    n = F.length("word")
    wanted = table.select("word", F.explode(F.array_distinct(F.flatten(F.array(*[_wanted(n + d) for d in (-1, 0, 1)])))).alias("key"))
    offered = table.select("word", F.explode("prefix.pos").alias("at")).select("word", F.explode(_offered(F.col("at"))).alias("key")) \
        .filter("key is not null")
    # estimates know nothing of the keys that a word explodes to, so no side may be taken for a small one
    p, q = wanted.alias("p"), offered.hint("merge").alias("q")
    met = p.join(q, F.expr("p.key = q.key and p.word != q.word"))
    # verified before equal pairs, found by both of their words, are joined to one
    near = met.filter(F.levenshtein("p.word", "q.word", EDITS) == EDITS)
    return near.select(F.least("p.word", "q.word").alias("a"), F.greatest("p.word", "q.word").alias("b")).distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last one, by pointer jumping.

    A form occurs at least twice as often as its word, so chains are short and end."""
    jump = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = jump.alias("a").join(jump.alias("b"), F.expr("a.root = b.word"), "left")
        longer = stored(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        jump = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return jump


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5,
                      least_count: int = 3, ratio: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased,
    with at least ``least_length`` code points (4 or more) and
    ``least_count`` occurrences (``n``) over all texts.  Two words are near if they
    differ by exactly one inserted, deleted or replaced code point; ``n_near``
    counts a word's near words.  ``form`` is the near word of largest n
    (ties: the smallest by code point), if that is at least ``ratio`` (2 or more) times n, else
    null; ``form_n`` is its n.  ``root`` follows forms to the last one; it
    is the word itself without a form.

    ``drop_every`` makes misspellings for a test: see corpus_words; then a null id counts as ''.
    Null and empty texts have no words; texts may have any length.  Repeated rows
    count as often as they stand.  An empty table gives no row.  Other columns are ignored."""
    if least_length <= PREFIX or ratio < 2:
        raise ValueError("words need a prefix of bigrams, and forms twice their word's occurrences")
    prepare(docs.sparkSession)
    counts = corpus_words(docs, id_col, text_col, drop_every) \
        .filter((F.length("word") >= least_length) & (F.col("n") >= least_count))
    counts = stored(counts, "words")
    pairs = stored(near_pairs(counts.select("word")), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(counts.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    # the smallest name of the largest count: counts are compared first, negated
    best = near.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("name"))).alias("f"))
    rows = counts.join(best, "word", "left")
    good = -F.col("f.less") >= F.col("n") * ratio
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              F.when(good, F.col("f.name")).alias("form"), F.when(good, -F.col("f.less")).alias("form_n")), "forms")
    roots = _followed(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
