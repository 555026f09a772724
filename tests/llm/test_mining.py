"""Min-max hashing, filter audit and collocations against brute force and odd rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from demandweave.llm import collocations, filter_audit, minhash
from demandweave.llm.words import SPACES, byte_table, flat_words, hashed_words

from .test_operators import brute_groups, near_copies, odd, rows_of  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_are_hashed_alike_and_apart():
    table = byte_table(SPACES, lower=True)
    texts = pa.array(["", None, "A b  c", "ab ba", " \tÜ x\n", "y" * 700_000 + " q", "tail", "a b c", "yy yyy aab aba baa"])
    words, offsets = flat_words(texts, table)
    hashes, own = hashed_words(texts, table)
    assert own.tolist() == offsets.tolist()
    assert len(set(zip(words.to_pylist(), hashes.tolist()))) == len(set(words.to_pylist())) == len(set(hashes.tolist()))
    assert len(hashed_words(pa.array([], pa.string()), table)[0]) == 0


# 11


def kept_groups(rows):
    return [(*r, True if r[0] is None else r[0] == r[2]) for r in brute_groups(rows, size=2, least=80)]


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3), (3, 16)])
def test_minhash_finds_every_link(spark, seed, block):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = minhash.MinMaxDedup(block=block).groups(docs)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(kept_groups(rows), key=repr)


def test_minhash_holds_apart_what_a_common_pivot_does_not_join(spark):
    """Copies of one text, each unlike the next: chains of links only, through no common origin."""
    rng, rows = random.Random(5), []
    text = [f"w{i}" for i in range(120)]
    for i in range(60):
        rows.append((i, " ".join(text)))
        for _ in range(4):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    found = minhash.MinMaxDedup(block=4).groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(kept_groups(rows), key=repr)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for common in (300, 600, 900):
        a, b = np.sort(every[:1000]), np.sort(every[1000 - common : 2000 - common])
        left, right = minhash.signatures([a, b], 512)
        assert abs((left == right).mean() - common / (2000 - common)) < 0.06
        one = ((a * minhash.multipliers(1)[0]) >> np.uint64(32)).astype(np.uint32)
        assert len(np.unique(one)) == 1000
    assert minhash.signatures([], 4).shape == (0, 8)


def test_minhash_on_odd_rows(spark, odd):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = minhash.MinMaxDedup().groups(odd)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(kept_groups(rows), key=repr)
    assert minhash.MinMaxDedup().groups(odd.limit(0)).count() == 0


# 12


def brute_audit(docs, labels):
    """Every order applied filter by filter to the rows themselves."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(x is not None and x < d and (t or "") == text for x, t, _ in docs),
        }
        parts.setdefault(lang or "", []).append((d, fails))
    out = []
    for part, rows in parts.items():
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone, after = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                early = sum(r[1][f] for r in rows) - len(gone)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                lost = [sum(r[0] in x for r in gone) for x in (good, toxic)]
                lines.append((part, "".join(order), k + 1, len(after), len(gone), early, alone, *lost, f))
                left = after
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out, key=repr)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_every_order(spark):
    rng, rows = random.Random(4), []
    for i in range(150):
        words = [rng.choice(["a", "B", "Word", "#x", "long", "other"]) if rng.random() < 0.6 else f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 150, 260]))]
        rows.append((rng.choice([i, i, None, 7]), rng.choice([" ".join(words), "same text", "", None]), rng.choice(["en", "de", None, ""])))
    rows += [(500 + i, "copy " * 210, "en") for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in list(range(600)) + [7, 7, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("mine")).withColumn("key", F.lit(1))
    found = filter_audit.audit(docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows_of(found, *AUDIT) == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 13


def brute_phrases(docs, support, absorbed=80, top=2000):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    often = {x: a for x, a in f.items() if a >= support}
    out = []
    for (lang, q), a in often.items():
        if len(q) < 2:
            continue
        cuts = [(2_000_000 * a // (f[lang, q[:k]] + f[lang, q[k:]]), k) for k in range(1, len(q))]
        score, k = min(cuts)
        longer = [b for (x, p), b in often.items() if x == lang and len(p) > len(q) and any(p[i : i + len(q)] == q for i in range(len(p)))]
        if not any(100 * b >= absorbed * a for b in longer):
            out.append((lang, -score, -a, " ".join(q).encode(), f[lang, q[:k]], f[lang, q[k:]]))
    ranked = []
    for lang in n:
        for rank, (_, score, a, q, x, y) in enumerate(sorted(r for r in out if r[0] == lang)[:top], 1):
            ranked.append((lang, rank, q.decode(), -a, x, y, n[lang], -score))
    return sorted(ranked, key=repr)


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("support, top, shards, bits", [(5, 2000, 4, 1 << 20), (3, 7, 3, 1 << 12), (30, 2000, 1, 1 << 20)])
def test_collocations_against_counting(spark, support, top, shards, bits):
    rng, rows = random.Random(support), []
    word = lambda: rng.choice(["aa", "Bb", "c", "dé", "e\x1cf", "漢", "to", "of"]) + rng.choice(["", "", "x"])
    for _ in range(120):
        text = "".join(word() + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "-"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice([text, text + " new york city hall", "Same same same same", None, ""]), rng.choice(["en", "en", None, "und", ""])))
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("hash", F.lit("mine")).repartition(5)
    found = collocations.Collocations(support=support, top=top, shards=shards, bits=bits).top_phrases(docs)
    assert rows_of(found, *PHRASES) == brute_phrases(rows, support, top=top)


def test_collocations_on_odd_rows(spark, odd):  # noqa: F811
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    rows = [(r["text"], None) for r in docs.collect()]
    assert rows_of(collocations.Collocations(support=2).top_phrases(docs), *PHRASES) == brute_phrases(rows, 2)
    assert collocations.Collocations().top_phrases(docs.limit(0)).count() == 0
    assert collocations.Collocations().top_phrases(docs.filter("text is null")).count() == 0


def test_the_new_queries_are_registered():
    assert {"op11_minhash_dedup", "op12_filter_audit", "op13_collocations"} <= set(entry.queries()) & set(entry.oracle_sql())
