"""Text -> L2-normalised vector, with a zero vector for blank text.

Two ways in:
* ``hashing_embedder`` - the offline default, all Spark ML: hashed term
  frequencies (``HashingTF``), ``IDF`` fitted by one distributed aggregation,
  ``Normalizer``; JVM-side throughout.
* ``model_embedder`` - a user-supplied model behind an iterator pandas UDF:
  the model is built once per Python worker and applied to Arrow batches;
  a text whose embedding fails gets the zero vector (the original rule).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, split_words
from ..functions.vectors import zero_vector


def hashing_embedder(df: DataFrame, text_col: str = "content", dim: int = 384,
                     out_col: str = "embedding") -> DataFrame:
    tok = df.withColumn("__tok", split_words(F.lower(F.col(text_col))))
    tf = HashingTF(numFeatures=dim, inputCol="__tok", outputCol="__tf").transform(tok)
    idf = IDF(inputCol="__tf", outputCol="__tfidf").fit(tf).transform(tf)
    nv = Normalizer(p=2.0, inputCol="__tfidf", outputCol="__n").transform(idf)
    vec = vector_to_array("__n")
    return nv.withColumn(out_col, F.when(is_blank(text_col), zero_vector(dim)).otherwise(vec)) \
             .drop("__tok", "__tf", "__tfidf", "__n")


def model_embedder(df: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
                   text_col: str = "content", out_col: str = "embedding") -> DataFrame:
    """``make_model()`` returns ``encode(texts) -> (n, dim) array``."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_model()
        zero = [0.0] * dim
        for texts in batches:
            vals = texts.fillna("").tolist()
            out = [zero] * len(vals)
            idx = [i for i, t in enumerate(vals) if t.strip()]
            try:
                enc = np.asarray(encode([vals[i] for i in idx]), dtype=np.float64) if idx else np.zeros((0, dim))
                norms = np.linalg.norm(enc, axis=1, keepdims=True)
                enc = np.divide(enc, norms, out=np.zeros_like(enc), where=norms > 0)
                for j, i in enumerate(idx):
                    out[i] = enc[j].tolist()
            except Exception:  # per-batch failure -> retry per text, failures get zeros
                for i in idx:
                    try:
                        v = np.asarray(encode([vals[i]]), dtype=np.float64)[0]
                        n = np.linalg.norm(v)
                        out[i] = (v / n).tolist() if n > 0 else zero
                    except Exception:
                        out[i] = zero
            yield pd.Series(out)

    return df.withColumn(out_col, embed(F.col(text_col)))
