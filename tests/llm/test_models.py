"""Classifiers by held-out accuracy and odd rows."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandweave.llm import labelled
from demandweave.llm.labelled import Sample
from demandweave.llm.quality_classifier import QualityModel
from demandweave.llm.toxicity import ToxicityModel, windows

CASES = [("quality", QualityModel, 3, 1, 0.98), ("toxic", ToxicityModel, 4, 2, 0.9)]


def ranked(score, label):
    """Share of pairs of unlike labels that the scores order rightly."""
    place = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    ones = label == 1
    return (place[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


@pytest.mark.parametrize("label, model, modulus, rest, least", CASES)
def test_held_out_rows_are_ranked(spark, sf, label, model, modulus, rest, least):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labelled.sample(docs, labels, label, modulus, rest, 3000)
    assert len(known.texts) <= 6000 and set(known.labels) == {0, 1}
    test = labels.filter(labelled.held_out("doc_id", modulus, rest)).select("doc_id", label)
    scored = labelled.scored(docs.join(test, "doc_id"), model(known)).select("score", label).toPandas()
    assert ranked(scored["score"].to_numpy(), scored[label].to_numpy()) >= least
    assert scored["score"].between(0, 1).all()


@pytest.mark.parametrize("model", [QualityModel, ToxicityModel])
def test_odd_rows_and_labels(spark, model):
    good, bad = b"Some fair words in a row make a text that reads well. ", b"JUNK### !!! &&& scum *** "
    fitted = model(Sample([good * n for n in range(1, 30)] + [bad * n for n in range(1, 30)], [1] * 29 + [0] * 29, 0.8))
    docs = spark.createDataFrame(
        [(0, None), (1, ""), (2, " "), (3, "x"), (4, "word " * 100_000), (5, "🙂é"), (5, "🙂é"), (None, "a")], "doc_id long, text string"
    ).withColumn("score", F.lit("mine"))
    rows = labelled.scored(docs, fitted).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[5]["score"] == rows[6]["score"] and rows[0]["score"] == rows[1]["score"]
    assert labelled.scored(docs.limit(0), fitted).count() == 0
    only = model(Sample([good], [1], 1.0))
    assert {r["score"] for r in labelled.scored(docs, only).collect()} == {1.0}


def test_sample_leaves_out_held_out_and_contradicted_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(0, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    found = labelled.sample(docs, labels, "toxic", 4, 2, 10)
    assert len(found.texts) == len(set(found.texts)) <= 20
    held = {r["text"] for r in docs.filter(labelled.held_out("doc_id", 4, 2)).collect()}
    allowed = {r["text"] for r in docs.filter(~labelled.held_out("doc_id", 4, 2)).collect()}
    assert {t.decode() for t in found.texts} <= allowed and held
    assert labelled.sample(docs.limit(0), labels.limit(0), "toxic", 4, 2, 10).texts == []


def test_copies_take_one_place_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "copy" if i < 400 else f"text {i}") for i in range(440)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i >= 400 else 1) for i in range(440)], "doc_id long, toxic int")
    found = labelled.sample(docs, labels, "toxic", 1, 1, 21)
    assert sorted(found.texts) == sorted({r["text"].encode() for r in docs.collect()}) and sum(found.labels) == 21
    small = labelled.sample(docs, labels, "toxic", 1, 1, 10)
    assert len(set(small.texts)) == len(small.texts) == 20 and sum(small.labels) == 10


@pytest.mark.parametrize("label, model, modulus, rest, least", CASES)
def test_held_out_rows_are_ranked_by_the_models_in_use(spark, sf, label, model, modulus, rest, least):
    per_class = sys.modules[model.__module__].PER_CLASS
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labelled.sample(docs, labels, label, modulus, rest, per_class)
    assert max(known.labels.count(0), known.labels.count(1)) <= per_class
    test = labels.filter(labelled.held_out("doc_id", modulus, rest)).select("doc_id", label)
    scored = labelled.scored(docs.join(test, "doc_id"), model(known)).select("score", label).toPandas()
    assert ranked(scored["score"].to_numpy(), scored[label].to_numpy()) >= least


def test_windows_cover_every_byte():
    ends = np.array([0, 0, 1, 32, 33, 200])
    spans, row = windows(ends)
    seen = np.zeros(200, bool)
    for (start, size), r in zip(spans.tolist(), row.tolist()):
        assert ends[r] <= start and start + size <= ends[r + 1] and 0 < size <= 32
        seen[start : start + size] = True
    assert seen.all()
