"""Faults that were found once: passages over several benchmark blocks, line breaks in URLs, dates off UTC."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandweave.llm import collocations as C
from demandweave.llm import decontaminate, warc
from demandweave.session import stored

from .test_mining import PHRASES, brute_phrases, rows_of
from .test_operators import brute_hits


@pytest.mark.parametrize("block_words", [1, 20, 60])
def test_no_passage_is_left_over_many_blocks(spark, block_words):
    items = [("1", "aa bb cc"), ("2", "dd ee"), ("3", "ff gg"), ("4", " ".join(f"x{i}" for i in range(30)))]
    rng, rows = random.Random(block_words), [(0, "ff aa dd ee bb cc gg"), (1, "nothing here"), (2, None), (3, "")]
    words = "aa bb cc dd ee ff gg x1 x2 x3".split()
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__cut", F.lit("mine")).repartition(3)
    out = decontaminate.remove(docs, spark.createDataFrame(items, "item_id string, text string"), block_words=block_words)
    left = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and len(left) == len(rows) and all(r["__cut"] == "mine" for r in left.values())
    for doc, text in rows:
        assert brute_hits(left[doc]["text"], items)[1] == 0
        assert left[doc]["text"] == text or brute_hits(text, items)[1]
    assert left[0]["text"].split() == []


def test_line_breaks_in_urls_stay_out_of_headers(spark):
    urls = ["http://a.org/x\r\ny", "http://a.org/x\ny", "http://a.org/x\ry", None, "http://b.org/"]
    pages = spark.createDataFrame([(i, u, "page " * 40) for i, u in enumerate(urls)], "page_id long, url string, html string")
    keys = {r["page_id"]: r["urlkey"] for r in warc.archive(pages).collect()}
    assert keys[0] == "org,a)/x%0D%0Ay" and keys[1] == "org,a)/x%0Ay" and keys[2] == "org,a)/x%0Dy" and len(keys) == 5


def test_dates_are_utc_in_any_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.createDataFrame([(1,), (1_710_054_000,), (-1,)], "s long").select(warc.utc(F.timestamp_seconds("s")).alias("d"))
            assert [r["d"] for r in rows.collect()] == ["1970-01-01T00:00:01Z", "2024-03-10T07:00:00Z", "1969-12-31T23:59:59Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_collocation_hashes_travel_as_gaps():
    hashes = np.unique(np.random.default_rng(5).integers(0, 1 << 64, 1 << 20, np.uint64))
    groups = 51
    firsts = [C.first_of_group(b, groups) for b in range(groups)] + [1 << 64]
    size = 0
    for b in range(groups):
        own = hashes[(hashes >= np.uint64(firsts[b])) & (hashes <= np.uint64(firsts[b + 1] - 1))]
        packed = C.gaps(own, b, groups)
        assert np.array_equal(C.from_gaps(packed, len(own), b, groups), own)
        size += len(packed)
    assert size <= 6.1 * len(hashes)
    one = np.array([(1 << 64) - 1], np.uint64)  # alone in its group, and the last hash of all
    assert C.from_gaps(C.gaps(one, 0, 1), 1, 0, 1).tolist() == one.tolist()
    for x in ([0], [255, 0], [256], [70_000, 3], [1 << 40, 5]):
        assert C.widened(C.narrow(np.array(x)), len(x)).tolist() == x


def test_collocations_are_looked_for_by_three_bytes():
    hashes = np.unique(np.random.default_rng(6).integers(0, 1 << 40, 1 << 20, np.uint64))
    groups, size = 51, 0
    firsts = [C.first_of_group(b, groups, C.CUT) for b in range(groups)] + [1 << 40]
    for b in range(groups):
        own = hashes[(hashes >= np.uint64(firsts[b])) & (hashes < np.uint64(firsts[b + 1]))]
        packed = C.gaps(own, b, groups, C.CUT)
        assert np.array_equal(C.from_gaps(packed, len(own), b, groups, C.CUT), own)
        size += len(packed)
    assert size <= 3.1 * len(hashes)
    codes = np.random.default_rng(7).zipf(1.3, 100_000).clip(0, 60_000).astype(np.uint16).tobytes()
    assert len(C.squeezed(codes)) < 0.7 * len(codes) and C.loosened(C.squeezed(codes)) == codes
    assert C.loosened(C.squeezed(b"")) == b""


@pytest.mark.parametrize("cut", [24, 57, 63])
def test_collocations_are_exact_where_short_hashes_meet(spark, cut):
    rng = random.Random(cut)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30))), rng.choice(["en", "de"])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    found = C.Collocations(support=8, cut=cut).top_phrases(docs)
    assert rows_of(found, *PHRASES) == brute_phrases(rows, 8)


def test_words_are_counted_once_and_places_are_batches(spark):
    docs = spark.createDataFrame([(f"a b c d{i % 2}, e{i}", "en") for i in range(60)], "text string, lang string").repartition(5)
    rows, often = C.Collocations().frequent(docs)
    there = {r["row"] for r in rows.collect()}
    by_place = {r["hash"]: r for r in often.collect()}
    assert len(by_place) == often.count() == 5 + 4 + 3 + 2  # words, pairs, threes and fours
    assert sorted(r["n"] for r in by_place.values() if r["row"] is None) == [30, 30, 60, 60, 60]
    assert {r["row"] for r in by_place.values()} - {None} <= there


def test_shuffle_files_go_when_the_counts_are_stored(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(name, None)
    kept = C.kept(spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count(), "kept")
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 10 and spark.conf.get(name, None) == was
    stored(spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count(), "plain")
    assert files() - before  # outside of it they stay, for frames that are run again
