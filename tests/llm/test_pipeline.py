"""The registered queries against SQL, and the pipeline's stages against brute force."""

import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from demandweave.llm import bpe, words
from demandweave.session import stored

from .test_operators import brute_groups, brute_hits

TABLES = ("documents", "pages", "benchmark", "labels")


def test_every_operator_has_a_query():
    names = [re.match(r"op(\d+)_", n) for n in entry.queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op5_url_filters", "op8_decontamination", "op10_warc", "op11_minhash_dedup", "op12_filter_audit", "op13_collocations"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in rel.description].index(c) for c in cols]
    theirs = sorted(repr([r[i] for i in place]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == theirs and theirs


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def after(name, docs):
        out = stored(stages[name](spark, docs, sf))
        assert out.columns == docs.columns
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    judged, left = after("quality rules", docs)
    assert set(left.items()) <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    groups = brute_groups([(r["doc_id"], r["text"]) for r in judged.collect()])
    single, left = after("n-gram Jaccard join", judged)
    assert sorted(left) == sorted(d for d, _, c in groups if d == c)
    cut, texts = after("benchmark decontamination", single)
    for doc, text in left.items():
        assert brute_hits(texts[doc], items)[1] == 0 and (texts[doc] == text or brute_hits(text, items)[1])
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if texts[r["doc_id"]] != left[r["doc_id"]])
    clean, hidden = after("secret scans", cut)
    assert set(hidden) == set(texts) and not [t for t in hidden.values() if re.search(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}", t)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages["BPE encoding and decoding"](spark, clean, sf).collect():
        assert r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == library.encode(hidden[r["doc_id"]], add_special_tokens=False).ids


def test_stages_on_odd_and_empty_rows(spark, sf):
    rows = [(0, None, None, None, None), (None, "", "en", None, 0), (1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for frame, n in ((docs, 4), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            count = out.count()
            if name == "n-gram Jaccard join":
                assert count == n
            elif name == "quality rules":
                assert count == 0
            else:
                assert count == frame.count()


def test_near_duplicates_link_from_four_fifths_of_five_words(spark, sf):
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[30] = near[60] = "other"  # 86 of 106 shingles of five words, 89 of 105 of four
    far[20] = far[50] = far[80] = "unlike"  # 81 of 111
    rows = [(i, " ".join(x), "en", "s", 0) for i, x in enumerate((words, near, far))]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert left == sorted(d for d, _, c in brute_groups([r[:2] for r in rows], size=5, least=80) if d == c) == [0, 2]


def test_rows_that_share_an_id_go_only_for_a_near_copy(spark, sf):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one), (1, two), (1, None), (1, " "), (2, one), (3, three), (3, three), (3, three + " more"), (3, ""), (None, one), (0, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns and sum(r in ((3, three), (3, three + " more")) for r in left) == 1
    want = [(1, one), (1, None), (1, " "), (3, ""), (None, one), (0, two)]
    assert sorted((r for r in left if r[0] != 3 or not r[1]), key=repr) == sorted(want, key=repr)


def test_workers_get_small_batches_and_longer_rows_whole(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes], "longest": [max(map(len, b.column("text").to_pylist()))]})

    def sent(limit):
        spark.conf.set(name, limit)
        rows = spark.range(0, 6000, 1, 1).selectExpr("repeat(if(id = 100, 'long row ', 'row '), if(id = 100, 1000000, 1000)) as text")
        got = words.in_batches(rows, sizes, "n long, size long, longest long").collect()
        assert sum(r["n"] for r in got) == 6000 and max(r["longest"] for r in got) == 9_000_000
        return max(r["size"] for r in got if r["longest"] < 9_000_000)

    try:
        for limit in (before, "64m"):
            assert sent(limit) < 1.1 * words.ARROW_BYTES
        assert sent("100k") < 120_000 and spark.conf.get(name) == "100k"
    finally:
        spark.conf.set(name, before)


def test_a_task_of_the_token_stage_has_one_worker(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = corpus_pipeline.tokens(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


def test_round_trip_is_encoding_then_decoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(0, None, 1), (None, "", 2), (1, "it's é\u3042\n\n  x <|endoftext|>", 3), (1, "same text", 4), (1, "same text", 4), (2, "ab cd " * 200_000 + "ab" * 500, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded long").repartition(2)
    for frame in (docs, docs.limit(0)):
        one, two = bpe.round_trip(frame, path), bpe.decode(bpe.encode(frame, path), path)
        assert one.schema == two.schema
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert all(r["decoded"] == (r["text"] or "") for r in bpe.round_trip(docs, path).collect())
