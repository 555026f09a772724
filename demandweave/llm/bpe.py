"""Byte-level BPE encoding and decoding by a contiguous rank array per word.

A word's parts lie in one array and the ranks of adjacent pairs in another beside it. The smallest rank
is found by scanning, the boundary behind it goes, and the two neighbouring ranks are looked up again.
Words longer than LONG_WORD bytes, where scanning would be quadratic, keep the same ranks in a heap with
linked neighbours: same merges in the same order. Encoded short words are remembered in a bounded cache of two
generations.

The tokenizer file's bytes travel as a broadcast (a vocabulary: a few MB whatever the corpus).

Defined cases: null text counts as empty: no tokens, decoded text empty. Any length is encoded whole.
Repeated rows give repeated rows. An empty table gives an empty one. Other columns pass through unless
they bear an output's name, which is then replaced.
"""

from __future__ import annotations

import heapq
import json
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import in_batches, small_batches, with_columns

LONG_WORD = 96
CACHE_WORDS = 60_000
NONE = 1 << 60
#: Fixed value: the split pattern that byte-level tokenizers of this family use.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    shown = {b: chr(b) for b in plain}
    return [shown[b] if b in shown else chr(next(other)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder made from the content of a tokenizer JSON file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if spec.get("normalizer") or model.get("dropout") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE files are read")
        vocab, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.base = [vocab[c] for c in letters]
        self.rank_of, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault((vocab[left], vocab[right]), rank)
            self.made.append(vocab[left + right])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        names = sorted(added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        parts = [self.base[b] for b in word]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        rank_of = self.rank_of
        ranks = [rank_of.get(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of.get((parts[i], parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank_of.get((parts[i - 1], parts[i]), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        rank_of, n = self.rank_of, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank_of.get(pair, NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank_of.get((parts[i], parts[j]), NONE) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of.get((parts[i], parts[after[j]]), NONE)) < NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of.get((parts[before[i]], parts[i]), NONE)) < NONE:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]

    def word(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            parts = self.merge(text.encode())
            out = pack(f"<{len(parts)}I", *parts)
        if len(text) <= LONG_WORD:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.older = {}, self.known
            self.known[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece in self.specials.split(text) if self.specials else [text]:
            if piece in self.added:
                out.append(self.added[piece])
            else:
                out += [self.known.get(w) or self.word(w) for w in self.split.findall(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")


_loaded: dict[str, ByteBPE] = {}


def _loader(spark, path: str):
    """Function that gives a task the tokenizer; a Python worker builds it once for all its tasks."""
    with open(path, "rb") as f:
        content = f.read()
    shared, name = spark.sparkContext.broadcast(content), xxhash.xxh3_128_hexdigest(content)

    def load() -> ByteBPE:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = ByteBPE(shared.value)
        return _loaded[name]

    return load


def _encoded(bpe: ByteBPE, batches, text: str):
    for batch in small_batches(batches, text):
        ids = [bpe.encode(t or "") for t in batch.column(text).to_pylist()]
        yield with_columns(
            batch, n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), ids=pa.array(ids, pa.binary())
        )


def _decoded(bpe: ByteBPE, batches, ids: str):
    for batch in small_batches(batches, ids):
        yield with_columns(
            batch, decoded=pa.array([bpe.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.string())
        )


def _with_ids(docs: DataFrame) -> DataFrame:
    return docs.drop("n_tokens", "ids").withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"")})


def _with_decoded(encoded: DataFrame) -> DataFrame:
    return encoded.drop("decoded").withColumn("decoded", F.lit(""))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit)."""
    load = _loader(docs.sparkSession, tokenizer_path)
    docs = _with_ids(docs)
    return in_batches(docs, lambda batches: _encoded(load(), batches, text), docs.schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (string), the text its ``ids`` stand for; null ids give an empty text."""
    load = _loader(encoded.sparkSession, tokenizer_path)
    encoded = _with_decoded(encoded)
    return in_batches(encoded, lambda batches: _decoded(load(), batches, ids), encoded.schema)


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` encoded, then decoded from those ids: the columns of both. A task has one worker and one tokenizer
    for the two, and texts and ids reach it once."""
    load = _loader(docs.sparkSession, tokenizer_path)
    docs = _with_decoded(_with_ids(docs))

    def run(batches):
        bpe = load()
        return _decoded(bpe, _encoded(bpe, batches, text), "ids")

    return in_batches(docs, run, docs.schema)
