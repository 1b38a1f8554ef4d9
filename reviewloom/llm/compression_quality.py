"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts.  A
text is cut into pieces of a fixed size, every piece is compressed with both,
and the difference of the two total sizes, divided by their sum, says which
kind of text it resembles.  That sum over the text's own size says how
repetitive the text is, however little it resembles either kind.  A logistic
curve over both, fitted on labelled texts that built no dictionary, gives a
calibrated score.

Dictionaries and curve come from bounded samples of labelled rows (SAMPLE_ROWS and
SAMPLE_BYTES a class, SPREAD pieces of a long text); scoring covers every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: Most labelled rows, and bytes of text, taken of each class; a third of them builds the curve.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 6 << 20
#: Bytes of a dictionary and of a piece of text.
DICTIONARY = 64 << 10
PIECE = 2 << 10
#: A longer text gives so many pieces, spread evenly over it, to the sample.
SPREAD = 16
LEVEL = 3


def _pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def _dictionary(texts: list[bytes]) -> bytes:
    """Dictionary of the texts' pieces; raw content where there is too little to train on."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


class Scorer:
    """Compressed sizes with both dictionaries, as two normalised numbers."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for d in (good, bad):
            own = zstandard.ZstdCompressionDict(d)
            own.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False)
            self.both.append((c, len(c.compress(b""))))

    def measure(self, data: bytes) -> tuple[float, float, float]:
        """(difference over sum, sum over size, its square); the difference is
        positive for texts nearer to the good ones.  Zeros for an empty text."""
        pieces = _pieces(data)
        if not pieces:
            return 0.0, 0.0, 0.0
        # without what an empty frame takes
        good, bad = (sum(max(1, len(c.compress(p)) - empty) for p in pieces) for c, empty in self.both)
        ratio = (bad + good) / (2 * len(data))
        return (bad - good) / (bad + good), ratio, ratio * ratio


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(w, b) of 1 / (1 + exp(-(x w + b))) by Newton steps, with smoothed
    targets and a small penalty on w.  ``x``: a row per case."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return np.zeros(x.shape[1]), math.log((n1 + 1) / (n0 + 1))
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    f = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.diag([0.01] * x.shape[1] + [0.0])
    w = np.zeros(f.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p) + 1e-9)[:, None]).T @ f + penalty, f.T @ (p - t) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _samples(docs: DataFrame, known: DataFrame) -> tuple[dict[int, int], dict[int, list[bytes]]]:
    """Number of labelled rows, and sample texts, of each class.

    The ids are drawn first, from the tables without texts; only the texts of
    at most 2 * SAMPLE_ROWS ids, a bounded broadcast, are then read."""
    key = F.xxhash64(F.col("id").cast("string")).alias("key")
    labelled = stored(docs.filter(~F.col("held_out")).select("id").join(known, "id").select("id", "label", key), "labelled")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [labelled.filter(F.col("label") == k).orderBy("key", "id").limit(SAMPLE_ROWS) for k in (0, 1)]
    drawn = stored(drawn[0].unionByName(drawn[1]).dropDuplicates(["id"]), "drawn")
    data = docs.join(F.broadcast(drawn), "id").select("label", "key", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    room = F.octet_length("text") - PIECE
    spread = F.concat(*[F.substr(F.col("text"), F.floor(room * i / (SPREAD - 1)).cast("int") + 1, F.lit(PIECE)) for i in range(SPREAD)])
    texts = stored(data.withColumn("text", F.when(room > PIECE * (SPREAD - 1), spread).otherwise(F.col("text"))), "samples")
    taken: dict[int, list[bytes]] = {}
    for label in (0, 1):
        size, got = 0, []
        for r in texts.filter(F.col("label") == label).orderBy("key").select("text").toLocalIterator():
            if len(got) == SAMPLE_ROWS:
                break
            if size + len(r.text) > SAMPLE_BYTES:  # a shorter one may fit
                continue
            size += len(r.text)
            got.append(bytes(r.text))
        taken[label] = got
    return counts, taken


def train(docs: DataFrame, known: DataFrame) -> tuple[bytes, bytes, np.ndarray, float]:
    """(id, held_out, text) and (id, label 0/1) -> both dictionaries and the curve.

    Rows are taken in the order of the id's hash, up to the bounds above."""
    counts, taken = _samples(docs, known)
    fit = {k: [t for i, t in enumerate(v) if i % 3 == 0] for k, v in taken.items()}
    made = {k: _dictionary([t for i, t in enumerate(v) if i % 3]) or b"\x00" * 8 for k, v in taken.items()}
    scorer = Scorer(made[1], made[0])
    x = np.array([scorer.measure(t) for k in (0, 1) for t in fit[k]], float).reshape(-1, 3)
    y = np.array([k for k in (0, 1) for _ in fit[k]], float)
    # classes are sampled apart: bring the curve's offset back to their shares
    a, b = fit_logistic(x, y)
    share = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)) - math.log((len(fit[1]) + 1) / (len(fit[0]) + 1))
    return made[1], made[0], a, b + share


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, a, b = model.value
        scorer = Scorer(good, bad)
        for batch in batches:
            x = np.array([scorer.measure(_bytes(t)) for t in batch.column(2).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(x @ a + b, -30, 30))))], ["id", "held_out", "score"])
    return run


def classify_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Labels of rows with ``held_out`` are never read.  A label is taken from
    ``labels`` by id; null labels and labels other than 0 and 1 are left out,
    of labels that contradict each other the larger counts.  Without labels of
    a class the score is the smoothed share of the other.  Null and empty
    texts have zeros as measures and so the curve's offset as score.  Rows with null
    or repeated ids each get a row."""
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)") \
        .groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(rows, known))
    out = rows.mapInArrow(_score(model), f"id {dict(rows.dtypes)['id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
