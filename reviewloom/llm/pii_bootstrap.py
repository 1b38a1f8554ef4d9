"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  They
seed a bootstrap, together with tokens that have the shape of a secret (long
hexadecimal keys, which are reported only if a pattern finds them): the words
before a seed form lexical patterns; a pattern also
precedes other identifier-like tokens (tokens with a digit or '@').  Patterns
and tokens form a bipartite graph, counted over all documents.  Scores go back
and forth: a pattern's confidence is the score of the tokens it precedes over
their number (smoothed), a token's score is the chance that at least one of its
patterns is right.  Tokens of high-confidence patterns are added as spans of
the pattern's kind, but for patterns that mostly stand elsewhere, such as
articles: of all occurrences of the whole pattern (its words and what stands
between and after them), a part of LEAST_SPECIFIC must precede an identifier.

The graph has a row per distinct (pattern, token), aggregated by Spark; each
round joins and aggregates it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

# The base rules, in the order in which spans are listed.  The
# lookbehinds and possessive quantifiers change no match; they make each linear:
# a run that fails from its first character fails from every later one.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = list(RULES)
#: Kinds that have seeds by shape, but no base spans: the whole token, lower-cased.
SHAPES = {"secret": r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}$"}
KINDS = BASE + list(SHAPES)
#: A text without these characters has no span of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Tokens that may be identifiers: white-space separated, with a digit or '@'.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Code points before a token in which its context is looked for.
CONTEXT = 80
#: Rounds of scoring; least confidence and number of distinct seeds of a pattern that adds spans.
ROUNDS = 3
LEAST_CONFIDENCE = 0.6
LEAST_SEEDS = 3
LEAST_SPECIFIC = 0.2


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of at most 19 digits is a multiple of 10."""
    def worth(i):
        """Of the digit number ``i`` from the right."""
        x = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") * (2 - i % 2)
        return x - F.when(x > 9, 9).otherwise(0)

    each = F.transform(F.sequence(F.lit(1), F.length(digits)), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    return n.between(8, 15)


def _occurrences(rows: DataFrame, pattern: str, condition: Column, *more: Column) -> DataFrame:
    """(row, text) -> (row, start, end, match, gap): every match with its place in code points.

    Splitting at the pattern gives the gaps between the matches; running
    sums of the lengths of gaps and matches give the places.  ``gap`` is the text
    before a match since the last one."""
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    gaps = F.split("text", pattern, -1)
    pairs = F.arrays_zip(found.alias("match"), F.slice(gaps, 1, F.greatest(F.lit(1), F.size(found))).alias("gap"))
    hits = rows.filter(condition).select("row", F.posexplode(pairs).alias("i", "p")) \
        .filter("p.match is not null") \
        .select("row", "i", "p.match", F.length("p.gap").alias("before"), F.length("p.match").alias("len"), F.expr(f"right(p.gap, {CONTEXT})").alias("gap"))
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("len")).over(upto)
    return hits.select("row", (end - F.col("len")).alias("start"), end.alias("end"), "match", "gap")


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, text) -> (row, kind, start, end, match, gap) of the base rules: leftmost,
    not overlapping within a kind; matches that fail a check are dropped."""
    out = None
    for k, kind in enumerate(BASE):
        condition = F.col("text").rlike("[0-9]" if _NEEDS[kind] is None else "\\" + _NEEDS[kind])
        one = _occurrences(rows, RULES[kind], condition).filter(_valid(kind, F.col("match"))) \
            .select("row", F.lit(k).alias("kind"), "start", "end", "match", "gap")
        out = one if out is None else out.unionByName(one)
    return out


def _pattern(gap: Column) -> Column:
    """Lower-cased letters of the last word before a token with what stands
    between them, digits and outer space left out; null if there is no letter."""
    tail = F.regexp_extract(gap, r"(\S+\s*\S?\s*\S?)\s*$", 1)
    p = F.regexp_replace(F.lower(F.regexp_replace(tail, r"\s+", " ")), r"[0-9]", "")
    return F.when(p.rlike(r"\p{L}{2}"), F.trim(p))


def learn_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, token, seed) with ``seed`` 1.0 or 0.0 -> (kind, pattern, confidence, seeds).

    ``edges`` has a row per distinct (pattern, token) and kind that has a seed
    under the pattern."""
    scores = edges.select("kind", "token", F.col("seed").alias("score")).distinct()
    conf = None
    for _ in range(rounds):
        conf = stored(edges.join(scores, ["kind", "token"]).groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.sum("seed").alias("seeds")), "patterns")
        new = edges.join(conf, ["kind", "pattern"]).groupBy("kind", "token").agg(
            F.greatest(F.max("seed"), 1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        scores = stored(new, "scores")
    return conf


def words_of(text: Column) -> Column:
    """The words of a text, split at white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _tails(w: Column) -> Column:
    """For each word of the column ``w`` of words what _pattern() takes from there, digits still in it: the word, and one or
    two before it if it has less than three code points (the second one only if both are single ones)."""
    def tail(x: Column, i: Column) -> Column:
        one, two = F.get(w, i - 1), F.get(w, i - 2)
        short = F.concat_ws(" ", F.when((F.length(x) == 1) & (F.length(one) == 1), two), one, x)
        return F.when(F.length(x) > 2, x).otherwise(short)

    return F.transform(w, tail)


def _specific(good: DataFrame, base: DataFrame, free: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the ``good`` patterns (kind, pattern, confidence, seeds) of whose
    occurrences in all texts enough precede a base span or a token.

    A pattern occurs where white space ends a word and _pattern() gives it for
    the words up to there; tokens stand only behind white space.  All words of
    the corpus are counted before digits are taken out and patterns joined, so
    what is shuffled are the distinct words of a task."""
    good = stored(good, "good")
    if good.isEmpty():
        return good
    patterns = good.select("pattern").distinct()
    before = base.filter(F.col("gap").rlike(r"\s$")).select(_pattern(F.col("gap")).alias("pattern")).unionByName(free.select("pattern")) \
        .join(patterns, "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("before"))
    words = texts.select(words_of(F.lower("text")).alias("w")).select(F.explode(_tails(F.col("w"))).alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("n"))
    total = words.select(F.trim(F.regexp_replace("tail", "[0-9]", "")).alias("pattern"), "n").groupBy("pattern").agg(F.sum("n").alias("total"))
    apt = before.join(total, "pattern").filter(F.col("before") >= LEAST_SPECIFIC * F.col("total")).select("pattern")
    return good.join(apt, "pattern", "left_semi")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, added, n_spans) for every row.

    The counts and ``base_sha256`` are of the base rules; ``spans`` lists base
    and added spans as kind:start:end (code points, end exclusive) by kind (secret last), then
    start; ``n_spans`` counts them.  A span that the bootstrap adds has the kind of its pattern, never
    overlaps a base span and is listed again in ``added``.  Null and empty texts
    have none; texts of any length are read as a whole.  Rows with null or repeated ids each get a row,
    an empty table gives none.  ``docs`` is read more than once, so must be stable.  Its other columns are ignored."""
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = rows.select("row", "text")
    base = stored(base_spans(texts), "spans")
    # identifier-like tokens that touch no base span, with their contexts
    tokens = _occurrences(texts, _TOKEN, F.col("text").rlike("[0-9@]"))
    body = F.regexp_extract("match", r"^[^0-9@\p{L}]*(.*?)[^0-9@\p{L}]*$", 1)
    lead = F.length(F.regexp_extract("match", r"^[^0-9@\p{L}]*", 0))
    tokens = tokens.select("row", (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length(body)).alias("end"),
                           F.lower(body).alias("token"), _pattern(F.col("gap")).alias("pattern")).filter("token != '' and pattern is not null")
    # base spans and tokens of a row, in order; a token is free if no span that began before it ends after its start
    mark = base.select("row", "start", "end", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("pattern"), F.lit(0).alias("free"))
    both = tokens.withColumn("free", F.lit(1)).unionByName(mark)
    left = Window.partitionBy("row").orderBy("start", "free").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("row").orderBy("start", F.desc("free")).rowsBetween(1, Window.unboundedFollowing)
    ends = F.max(F.when(F.col("free") == 0, F.col("end"))).over(left)
    begins = F.min(F.when(F.col("free") == 0, F.col("start"))).over(right)
    both = both.withColumn("ends", ends).withColumn("begins", begins)
    free = stored(both.filter("free = 1 and (ends is null or ends <= start) and (begins is null or begins >= end)")
                  .select("row", "start", "end", "token", "pattern"), "tokens")
    seeds = base.select("kind", _pattern(F.col("gap")).alias("pattern"), F.lower("match").alias("token")).filter("pattern is not null")
    for k, shape in enumerate(SHAPES.values(), len(BASE)):
        seeds = seeds.unionByName(free.filter(F.col("token").rlike(shape)).select(F.lit(k).alias("kind"), "pattern", "token"))
    seeds = seeds.distinct().withColumn("seed", F.lit(1.0))
    seeds = stored(seeds, "seeds")
    known = seeds.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"))
    others = free.select("pattern", "token").distinct().join(known.select("kind", "pattern"), "pattern") \
        .select("kind", "pattern", "token").join(seeds, ["kind", "pattern", "token"], "left_anti").withColumn("seed", F.lit(0.0))
    edges = stored(seeds.unionByName(others), "edges")
    good = learn_patterns(edges).filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS))
    good = _specific(good, base, free, texts)
    best = good.groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b")) \
        .select("pattern", (-F.col("b.k")).alias("kind"))
    added = free.join(best, "pattern").select("row", "kind", "start", "end", F.lit(1).alias("extra"))
    spans = base.select("row", "kind", "start", "end", F.lit(0).alias("extra")).unionByName(added)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    per = spans.groupBy("row").agg(
        *[F.sum(F.when((F.col("kind") == k) & (F.col("extra") == 0), 1).otherwise(0)).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sort_array(F.collect_list(F.struct("kind", "start", "end", "extra", F.concat_ws(":", name, "start", "end").alias("s")))).alias("all"))

    def listed(condition=None):
        rows_ = F.col("all") if condition is None else F.filter("all", condition)
        return F.array_join(F.transform(rows_, lambda x: x["s"]), ",")

    per = per.select("row", *[f"n_{k}" for k in BASE], F.sha2(listed(lambda x: x["extra"] == 0), 256).alias("base_sha256"),
                     listed().alias("spans"), F.size(F.filter("all", lambda x: x["extra"] == 1)).cast("long").alias("n_added"),
                     listed(lambda x: x["extra"] == 1).alias("added"), F.size("all").cast("long").alias("n_spans"))
    zero = F.lit(0).cast("long")
    return rows.select("row", "id").join(per, "row", "left").select(
        "id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", zero).alias("n_added"), F.coalesce("added", F.lit("")).alias("added"),
        F.coalesce("n_spans", zero).alias("n_spans"))
