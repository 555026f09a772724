"""Corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` stores each stage's result as Parquet and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from demandweave.llm import bpe, decontaminate, jaccard_join, quality_rules, secrets
from demandweave.session import stored


def _counted(docs, before):
    """``docs`` with n_chars made true again where the text is not that of ``before``'s row."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """Documents link from a similarity of 0.8 on shingles of five words. Of each group of linked rows one with the
    smallest id stays, whichever rows share ids: rows are told apart by id and a hash of the text. Rows without an
    id, or without words, link with nothing and stay."""
    keyed = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    groups = jaccard_join.JaccardJoin(size=5, least=80, doc_id="__row").groups(keyed.select("__row", "text"))
    groups = groups.filter("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("__row"))
    groups = groups.agg(F.min("component_id").alias("group"), F.count("*").alias("copies"))
    ids = keyed.filter("doc_id is not null").select("__row", "doc_id").distinct()
    groups = stored(groups.join(ids, "__row"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    gone = groups.join(first, "group").filter(F.col("__row") != F.col("first.__row")).select("__row")
    kept = keyed.join(gone, "__row", "left_anti")
    # only rows that occur several times, with id and text, need another look
    again = stored(groups.filter("copies > 1").select("__row"), "again")
    if not again.isEmpty():
        place = F.row_number().over(Window.partitionBy("__row").orderBy(F.xxhash64(*docs.columns)))
        several = kept.join(again, "__row", "left_semi").withColumn("__place", place).filter("__place = 1").drop("__place")
        kept = kept.join(again, "__row", "left_anti").unionByName(several)
    return kept.select(*docs.columns)


def benchmark_passages(spark, docs, sf_dir):
    """Passages of benchmark items are cut out of the texts; the documents stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = decontaminate.remove(docs.withColumn("__before", F.col("text")), benchmark)
    return _counted(cut, "__before").select(*docs.columns)


def secret_values(spark, docs, sf_dir):
    """Secrets are replaced in the texts; the documents stay."""
    redacted = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    touched = F.contains("text", F.lit(secrets.REDACTED))
    return redacted.withColumn("n_chars", F.when(touched, F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def tokens(spark, docs, sf_dir):
    """Token ids of each text, and whether they decode to it again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(docs.select("doc_id", "text"), path)
    whole = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_values),
    ("BPE encoding and decoding", tokens),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs


#: SQL cannot express the posterior of the rules, the forest or the tokenizer: tests use brute force.
ORACLE_SQL = None
