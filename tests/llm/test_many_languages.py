"""Language identification with more labels than languages of the world have codes in a table."""

import random

import numpy as np
from pyspark.sql import functions as F

from reviewloom.llm import language_id as lid
from reviewloom.llm.compression_quality import fit_logistic

from .test_operators import DOCS


def test_many_labels(spark, monkeypatch):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    rows = []
    for k in range(260):  # each label has letters of its own
        own = letters[3 * k % 900: 3 * k % 900 + 3] + [chr(97 + k % 26)]
        for j in range(3):
            rows.append((3 * k + j, " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(12)), f"l{k:03}", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    assert lid.MOST_CELLS >= 1_000_000
    monkeypatch.setattr(lid, "MOST_CELLS", 4_000_000)
    got = {r.id: r for r in lid.identify_languages(docs, F.col("doc_id") % 3 != 2).collect()}
    assert len(got) == len(rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in rows) >= 0.95 * len(rows)


def test_calibration_counts_every_labelled_text(spark):
    """The curve is that of all rows, and the bound lies above the one row of highest cross-entropy."""
    rng = np.random.default_rng(8)
    lead = rng.exponential(0.6, 9001)
    right = rng.random(9001) < 1 / (1 + np.exp(-(2 * lead - 0.4)))
    entropy = np.append(rng.uniform(1, 3, 9000), 7.5)
    right[-1] = True
    rows = [("a" if r else "b", "a", float(e), float(x), 50) for r, e, x in zip(right, entropy, lead)]
    some = spark.createDataFrame(rows + [("a", None, None, None, 0)], "lang string, best string, entropy double, lead double, chars long")
    models = lid.Models(["a", "b"], [], [], [], [], np.zeros(2))
    lid.calibrate(models, some)
    slope, offset = fit_logistic(lead[:, None], right.astype(float))
    assert models.most == 7.5 + lid.MARGIN
    assert abs(models.slope - slope[0]) < 1e-6 and abs(models.offset - offset) < 1e-6
