"""The pipeline's stages against brute force, and the registered queries."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewloom.llm import queries

from .test_operators import DOCS, brute_components, brute_contamination


def make_docs(spark):
    rng = random.Random(11)
    parts = {"en": ["th", "er", "ing", "and", "of"], "fr": ["eau", "é", "ou", "ment", "què"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        w = ["".join(rng.choice(parts[lang]) for _ in range(4)) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(w), lang, rng.choice(["a", "b", "c", None]), 1))
        if i % 8 == 0:
            w[3] = "changed"
            rows.append((1000 + i, " ".join(w), lang, "a", 2))
    item = " ".join(rows[5][1].split()[2:18])
    rows.append((2000, "lead in words " + item, "en", "b", 3))
    rows += [(3000, None, "en", "a", 0), (3001, "12 34", None, "a", 0), (None, "erthandof thering ofand", None, None, None), (5, rows[5][1], "en", "a", 1)]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = make_docs(spark)
    spark.createDataFrame(rows, DOCS).withColumn("__extra", F.lit(1)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}-{name}"))
    tables = [sorted((tuple(r) for r in d.collect()), key=str) for d in seen]
    assert all(d.columns == docs.columns for d in seen[1:-1])
    # languages: those without a letter go
    assert Counter(tables[1]) == Counter(r for r in tables[0] if re.search(r"[^\W\d_]", r[1] or ""))
    # near duplicates: one of each group, the smallest id
    groups = {}
    for r, (_, g) in zip(tables[1], brute_components([r[1] for r in tables[1]], 5, 80, 100), strict=True):
        groups.setdefault(g, []).append(r)
    assert len(tables[2]) == len(groups) < len(tables[1])
    assert sorted(-1 if r[0] is None else r[0] for r in tables[2]) == sorted(min((r[0] for r in g if r[0] is not None), default=-1) for g in groups.values())
    # decontamination
    assert tables[3] == [r for r in tables[2] if not brute_contamination(r[1], [(1, item)])[3]] and len(tables[3]) < len(tables[2])
    # the mix repeats and drops whole rows; token files hold every row
    assert set(tables[4]) <= set(tables[3]) and max(Counter(tables[4]).values()) <= 3
    assert Counter(r[0] for r in tables[5]) == Counter(r[0] for r in tables[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == tables[5]


def test_registered():
    names = list(entry.queries())
    assert set(queries.QUERIES) <= set(names) and set(queries.ORACLES) <= set(entry.oracle_sql())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
