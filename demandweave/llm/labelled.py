"""A bounded sample of labelled texts to fit a classifier on, and scoring by a fitted one."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.session import stored

from .words import in_batches, small_batches, text_buffer, with_columns


@dataclass
class Sample:
    texts: list[bytes]
    labels: list[int]
    #: Share of label 1 among all rows that may be learnt from, whatever the sample's own.
    rate: float


def held_out(doc_id, modulus: int, rest: int) -> F.Column:
    """Whether a row is kept from learning, by the checksum of its id as text; not so for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int) -> Sample:
    """At most ``per_class`` distinct texts of each label, the first by a hash of their smallest id; equal texts are
    one before they are counted. Only rows that are not held out are read. An id or a text with two labels, and a
    null label, teach nothing."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~held_out("doc_id", modulus, rest))
    known = known.groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("label")).filter("low = label")
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    texts = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    distinct = (
        texts.select("doc_id", "key")
        .join(known.select("doc_id", "label"), "doc_id")
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"), F.min("doc_id").alias("id"))
        .filter("label = high")
    )
    distinct = stored(distinct.select("key", "label", "id"), "distinct")
    first = [distinct.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id", "key").limit(per_class) for v in (0, 1)]
    chosen = first[0].unionByName(first[1])
    rows = (
        texts.join(F.broadcast(chosen.withColumnRenamed("id", "doc_id")), ["doc_id", "key"])
        .groupBy("key", "doc_id", "label")
        .agg(F.first("text").alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "key")
        .select("text", "label")
        .collect()
    )
    total = sum(count.values())
    return Sample([r["text"].encode() for r in rows], [int(r["label"]) for r in rows], count.get(1, 0) / total if total else 0.5)


def scored(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) by a model with ``score(bytes, offsets)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries and weights: a few KB to a few MB

    def run(batches):
        for batch in small_batches(batches, text):
            data, ends = text_buffer(batch.column(text))
            yield with_columns(batch, score=pa.array(shared.value.score(data, ends), pa.float64()))

    docs = docs.drop("score").withColumn("score", F.lit(0.0))
    return in_batches(docs, run, docs.schema)
