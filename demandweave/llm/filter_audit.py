"""How filters of documents interact: what each removes in every order in which they could be applied.

Four filters read a text alone. The fifth asks whether a smaller doc_id has the same text, by a left-semi join on
the text's hash, the exact text and the id. Failures of all five are united per document into a combination of
bits, and combinations are counted per part. Everything else follows from at most 32 counts a part, so all 120
orders cost nothing more.

Copies of one text meet as one row per task before they travel, and the rows of a text are dealt over salts.

Defined cases: a null text is empty, a null part the empty string. Empty texts have no words: they fail the
word count alone, and the copy filter when a smaller id is empty as well. Each row is a document of its own; rows
that share their id are not copies of each other, but all are of a smaller id. A row without an id is never a copy,
makes none and has no labels. An id with several labels counts as good or toxic if one of them says so. Texts are
read whole. An empty table gives no rows. Only id, text and part are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandweave.session import stored

WORD, LETTERS, SYMBOLS = r"[^\x20\x09-\x0D]+", "[^A-Z]+", "[#$%&*|]"
FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
#: Tasks over which the rows of one text are dealt; adaptive execution splits further.
SALTS = 16


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, LETTERS, "")) > 3 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(f, BIT[k]).otherwise(0) for k, f in fails.items()), F.lit(0))


def copies(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, key, part) of the rows whose text a smaller id has as well. ``keyed`` has doc_id and key of ``docs``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = keyed.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    met = met.filter("least < most").select("key", "least", salts)
    texts = docs.select("doc_id", "part", "text", F.md5("text").alias("key")).filter("doc_id is not null")
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(met, ["key", "salt"])
    texts = stored(texts, "copies")  # of all texts, those that several ids seem to share
    witness = texts.groupBy("key", "text").agg(F.min("doc_id").alias("smaller")).select("key", "text", "smaller", salts)
    later = texts.filter("doc_id > least")
    return (
        later.alias("l")
        .join(
            witness.alias("w"),
            (F.col("l.key") == F.col("w.key"))
            & (F.col("l.salt") == F.col("w.salt"))
            & (F.col("l.text") == F.col("w.text"))
            & (F.col("w.smaller") < F.col("l.doc_id")),
            "left_semi",
        )
        .select("doc_id", "key", "part")
    )


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that fail exactly the filters of a mask."""
    keyed = stored(
        docs.select("doc_id", "part", F.md5("text").alias("key"), text_failures(F.col("text")).alias("bits")), "failures"
    )
    alike = copies(docs, keyed).withColumns({"bits": F.lit(BIT["E"]), "n": F.lit(0)})
    failed = keyed.withColumn("n", F.lit(1)).unionByName(alike).groupBy("doc_id", "key", "part")
    failed = failed.agg(F.bit_or("bits").alias("mask"), F.sum("n").alias("n"))
    known = labels.filter("doc_id is not null").groupBy("doc_id")
    known = known.agg(*(F.max((F.col(c) == 1).cast("int")).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))))
    named = failed.filter("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    unnamed = failed.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return named.unionByName(unnamed).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def steps() -> list[dict]:
    """Every step of every order: its filter's bit, and the bits of the filters before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            out.append({"filter_order": "".join(order), "step": k + 1, "bit": BIT[name], "before": before})
            before |= BIT[name]
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", part="lang") -> DataFrame:
    """Counts per part, order and step. Of a mask of k bits each filter is first in 120 / k of the orders: that is
    what the filter removes of it over all orders."""
    docs = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
    )
    counts = combinations(docs, labels)
    every = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = counts.withColumn("s", F.explode(every)).select("part", "mask", "n", "good", "toxic", "s.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    share = F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )
