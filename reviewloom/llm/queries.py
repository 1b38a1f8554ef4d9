"""The contract's queries opN_<name> and the pipeline, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arc_to_warc import pages_to_warc
from .block_naming import exact_duplicates
from .common import id_remainder, prepare, read_table
from .compression_quality import classify_quality
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .license_scan import license_scan
from .merkle_manifest import folded, leaf_digest, merkle_manifest, siblings_text
from .mixing import mix_sources
from .pii_bootstrap import find_personal_data
from .spelling_variants import spelling_variants
from .substring_dedup import repeated_passages
from .token_store import encode_documents

#: The id that ends each document in op9 and the pipeline's last stage.
END_ID = 2
#: The tokenizer file of op9; every machine has it at this place.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard similarity 0.9 or more."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_components(docs, n=3, num=90, den=100).withColumnRenamed("id", "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of a group stays."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_duplicates(docs).withColumnRenamed("id", "doc_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes of each document."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def document_path():
    """A place for a document: its source is a repository; each tenth document is a licence file."""
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("p"), F.expr("doc_id div 1000")),
                       F.concat(F.lit("m"), F.expr("doc_id div 100 % 10")), name)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each document: its own lines', or that of the nearest directory with a licence file."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source").withColumn("path", document_path())
    return license_scan(docs, keep=("doc_id",)).select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "n_lines", "license_from")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word windows of benchmark items."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by base rules and bootstrapped context patterns."""
    prepare(spark)
    return find_personal_data(read_table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document; learned where crc32(doc_id) mod 3 is not 1."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return classify_quality(docs, labels, id_remainder(F.col("doc_id"), 3) == 1).withColumnRenamed("id", "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; learned where crc32(doc_id) mod 4 is not 2."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify_languages(docs, id_remainder(F.col("doc_id"), 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as files and read back."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(docs, TOKENIZER, END_ID, special=True).withColumnRenamed("id", "doc_id")


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC, converted to WARC, read back."""
    prepare(spark)
    found = pages_to_warc(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document; every fifth one's text is tampered with and checked."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 5) == 0),
                      leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered))
    found = merkle_manifest(docs, leaf_digest(*[F.col(c) for c in docs.columns]), keep={"tampered": tampered})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                        F.sha2(siblings_text(F.col("path")), 256).alias("proof_sha256"),
                        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document outside the 50-word windows that an earlier document has too."""
    prepare(spark)
    found = repeated_passages(read_table(spark, sf_dir, "documents", "doc_id", "text"), words=50)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with the near word that each is most likely a spelling of."""
    prepare(spark)
    return spelling_variants(read_table(spark, sf_dir, "documents", "doc_id", "text"), drop_every=97)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_exact_dedup, op3_source_mixing, op4_license_scan, op5_decontamination,
    op6_personal_data, op7_quality, op8_language_id, op9_token_files, op10_arc_to_warc,
    op11_merkle_manifest, op12_substring_dedup, op13_spelling_variants, pipeline)}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str) -> str:
    return f"regexp_extract_all({_LOWER}, '{pattern}')"


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    bit = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))"
    data = (f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))")
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: {bit}), 4294967295)"

_MIX_TURNS = "\n".join(f"""x{k} AS (SELECT *, sum(size) FILTER (NOT took AND size <= left_) OVER (PARTITION BY source ORDER BY h) AS upto FROM y{k - 1}),
z{k} AS (SELECT *, min(h) FILTER (NOT took AND size <= left_ AND upto > left_) OVER (PARTITION BY source) AS stop FROM x{k}),
y{k} AS (SELECT doc_id, source, h, size, source_size, target, whole, took OR (size <= left_ AND h < coalesce(stop, h + 1)) AS took,
  CAST(left_ - coalesce(sum(size) FILTER (NOT took AND size <= left_ AND h < coalesce(stop, h + 1)) OVER (PARTITION BY source), 0) AS BIGINT) AS left_ FROM z{k}),"""
                        for k in (1, 2, 3))

ORACLES = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_WORD)} AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
        ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op3_source_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
-- the level of uncapped shares: the one L with sum(min(weight * L, 3 * size)) = all words
c AS (SELECT a.source, sum(b.source_size) - 3 * coalesce(sum(b.source_size) FILTER (b.source_size * a.weight < a.source_size * b.weight), 0) AS rest,
             sum(b.weight) - coalesce(sum(b.weight) FILTER (b.source_size * a.weight < a.source_size * b.weight), 0) AS rest_weight
      FROM w a CROSS JOIN w b GROUP BY a.source),
k AS (SELECT w.*, 3 * source_size * rest_weight <= rest * weight AS capped, rest, rest_weight FROM w JOIN c ON w.source IS NOT DISTINCT FROM c.source),
v AS (SELECT *, first_value(rest) OVER o AS r, first_value(rest_weight) OVER o AS rw FROM k
      WINDOW o AS (ORDER BY capped, source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(r AS DOUBLE) * weight / rw END AS target FROM v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
y0 AS (SELECT d.*, source_size, target, whole, CAST(round(target - whole * source_size) AS BIGINT) AS left_, false AS took FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
-- three times: by hash, those that fit into what is left, up to the first that would exceed it
{_MIX_TURNS}
l AS (SELECT source, min({{'miss': abs(left_ - size), 'h': h}}) AS last FROM y3 WHERE NOT took AND abs(left_ - size) < left_ GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * least(3, whole + CASE WHEN took OR (last IS NOT NULL AND last.h = h) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM y3 LEFT JOIN l ON y3.source IS NOT DISTINCT FROM l.source""",
    "op5_decontamination": f"""
WITH b AS (SELECT item_id, {_words(_BENCH_WORD)} AS a FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(a)) AS k, unnest(list_transform(range(1, len(a) - least(13, len(a)) + 2), lambda i: array_to_string(a[i : i + least(13, len(a)) - 1], ' '))) AS g
      FROM b WHERE len(a) > 0),
d AS (SELECT doc_id, {_words(_BENCH_WORD)} AS a FROM documents),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, unnest(range(1, len(a) - k + 2)) AS i, unnest(list_transform(range(1, len(a) - k + 2), lambda i: array_to_string(a[i : i + k - 1], ' '))) AS g
      FROM d JOIN ks ON len(a) >= k),
m AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.g = g.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(a) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op10_arc_to_warc": """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, sha1(b) AS hex FROM p),
d AS (SELECT page_id, url, octet_length(b) AS payload_bytes, min(page_id) OVER (PARTITION BY b) AS first,
             array_to_string(list_transform(range(0, 32), lambda i:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
      FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS hit,
       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
f AS (SELECT *, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM d),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf, hit FROM f),
-- the trees of the sources
a AS (SELECT 0 AS l, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS hash, doc_id FROM h
      UNION ALL
      SELECT l + 1, source, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)), NULL FROM a WHERE n > 1 GROUP BY l, source, pos // 16),
subs AS (SELECT source, l AS height, hash AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos FROM a WHERE n = 1),
-- the tree over them
b AS (SELECT 0 AS l, pos, (SELECT count(*) FROM subs) AS n, subroot AS hash FROM subs
      UNION ALL
      SELECT l + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY l, pos // 16),
-- one list of levels for each leaf: its source's, then those above
ways AS (SELECT h.doc_id, h.source, s.height, s.pos AS top, s.subroot, a.pos, CASE WHEN hit THEN low_leaf ELSE leaf END AS start, leaf
         FROM h JOIN a ON a.l = 0 AND a.doc_id = h.doc_id JOIN subs s ON s.source IS NOT DISTINCT FROM h.source),
steps AS (SELECT w.doc_id, a.l AS step, coalesce(string_agg(a.hash, '' ORDER BY a.pos) FILTER (a.pos < (w.pos >> (4 * a.l))), '') AS lft,
                 coalesce(string_agg(a.hash, '' ORDER BY a.pos) FILTER (a.pos > (w.pos >> (4 * a.l))), '') AS rgt
          FROM ways w JOIN a ON a.source IS NOT DISTINCT FROM w.source AND a.n > 1 AND a.pos // 16 = (w.pos >> (4 * (a.l + 1))) GROUP BY w.doc_id, a.l
          UNION ALL
          SELECT w.doc_id, w.height + b.l, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < (w.top >> (4 * b.l))), ''),
                 coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > (w.top >> (4 * b.l))), '')
          FROM ways w JOIN b ON b.n > 1 AND b.pos // 16 = (w.top >> (4 * (b.l + 1))) GROUP BY w.doc_id, w.height, b.l),
proof AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS step, start AS node FROM ways
         UNION ALL SELECT f.doc_id, f.step + 1, sha256(lft || node || rgt) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step),
ends AS (SELECT doc_id, arg_max(node, step) AS folded FROM fold GROUP BY doc_id)
SELECT w.doc_id, w.leaf, w.subroot, r.hash AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = r.hash AS verified
FROM ways w JOIN ends e ON e.doc_id = w.doc_id LEFT JOIN proof p ON p.doc_id = w.doc_id JOIN b r ON r.n = 1""",
    "op12_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS a FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(a) - 48)) AS i, unnest(list_transform(range(1, len(a) - 48), lambda i: array_to_string(a[i : i + 49], ' '))) AS g FROM w WHERE len(a) >= 50),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN f USING (g) WHERE least < doc_id),
o AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS i FROM w),
k AS (SELECT doc_id, count(x.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (x.i IS NULL) AS kept FROM o LEFT JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT run, doc_id || ':' || run AS key, count(*) AS n FROM o GROUP BY ALL),
h AS (SELECT run, n, {_crc32("key")} AS h FROM c),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
      FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
-- words with one code point left out, and its place
x AS (SELECT word, unnest(range(1, length(word) + 1)) AS i, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS rest FROM w),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word FROM x a JOIN w b ON a.rest = b.word
      UNION SELECT b.word, a.word FROM x a JOIN w b ON a.rest = b.word),
m AS (SELECT p.word, count(*) AS n_near, arg_min(other, (-w.n, encode(other))) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = p.other GROUP BY p.word),
f AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
      FROM w LEFT JOIN m ON m.word = w.word),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, e.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) e ON e.word = f.word""",
}
