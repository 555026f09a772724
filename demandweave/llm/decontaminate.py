"""Benchmark decontamination: an FM-index per shard of documents, searched backward for every test phrase.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item, or the whole of a shorter item. A
shard is a few MB of documents. Its index holds the words that occur in phrases; every other word only parts
runs, and runs shorter than the shortest phrase cannot hold one, so they are left out of the index. Backward
search runs for all phrases at once, positions come from sampled suffixes, and the hit spans of a document are
merged. Nothing is shuffled.

Phrases go to the tasks in blocks of at most BLOCK_WORDS words each, however large the benchmark is; the
documents stream through one search per block.

Defined cases: null or empty text has no words and no hits; a null or empty item has no phrase; an item
without id marks words but is not listed. Items that share an id count as one. Texts are searched whole. Equal
rows get equal results; either table may be empty. Other columns pass through; a column that bears an output's
name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.session import stored

from .fm_index import FMIndex
from .words import byte_table, flat_words, in_batches, small_batches, text_buffer, with_columns

WINDOW = 10
BLOCK_WORDS = 200_000
#: ASCII that is neither a letter nor a digit parts words.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TABLE = byte_table(SEPARATORS, lower=True)
SPANS = "array<struct<first:long,last:long>>"


class Phrases:
    """The phrases of a block of items as symbols, and the items of each."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        flat, offsets = flat_words(pa.array(texts, pa.string()), TABLE)
        coded = flat.dictionary_encode()
        self.vocabulary, symbols = coded.dictionary, coded.indices.to_numpy() + 2  # 0 end, 1 any other word
        items_of: dict[bytes, set] = {}
        for i, item in enumerate(ids):
            own = symbols[offsets[i] : offsets[i + 1]]
            for j in range(max(1, len(own) - window + 1) if len(own) else 0):
                items_of.setdefault(own[j : j + window].tobytes(), set()).add(item)
        self.lengths = np.array([len(p) // symbols.itemsize for p in items_of], np.int64)
        self.matrix = np.full((len(items_of), window), -1, np.int64)
        for k, phrase in enumerate(items_of):
            self.matrix[k, window - self.lengths[k] :] = np.frombuffer(phrase, symbols.dtype)
        self.items = [sorted(x for x in items if x is not None) for items in items_of.values()]

    def __bool__(self):
        return len(self.items) > 0

    def find(self, flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, phrase) of every occurrence in the rows' words; words count from the shard's start."""
        coded, none = flat.dictionary_encode(), np.empty(0, np.int64)
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy() + 2
        symbols = known[coded.indices.to_numpy()]
        # runs of phrase words within a row
        edge = np.zeros(len(symbols) + 1, bool)
        edge[offsets] = True
        inside = symbols > 1
        begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        long = stops - begins >= self.lengths.min()
        begins, sizes = begins[long], (stops - begins)[long] + 1  # one more for the symbol that parts runs
        if not len(begins):
            return none, none, none
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
        text = np.where(np.arange(len(place)) == np.repeat(np.cumsum(sizes) - 1, sizes), 1, symbols[np.minimum(place, len(symbols) - 1)])
        index = FMIndex(text, len(self.vocabulary) + 2)
        phrase, at = index.locate(*index.search(self.matrix))
        first = place[at]
        return np.searchsorted(offsets, first, "right") - 1, first, phrase


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int):
    """Phrases of the benchmark, some items at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        words = len((row[1] or "").encode()) // 2 + 1
        if ids and size + words > block_words:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += words
    if ids:
        yield Phrases(ids, texts, window)


def merged(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of hit words."""
    padded = np.concatenate([[False], hit, [False]])
    return np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(~padded[1:] & padded[:-1]) - 1


def _search(phrases: Phrases, column: pa.Array):
    """Words per row, a mask of hit words over the shard, offsets of rows, and (row, phrase) pairs."""
    flat, offsets = flat_words(column, TABLE)
    row, first, phrase = phrases.find(flat, offsets) if len(flat) else (np.empty(0, np.int64),) * 3
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[phrase], -1)
    pairs = np.unique(np.stack([row, phrase], axis=1), axis=0)
    return offsets, np.cumsum(change)[:-1] > 0, pairs


def find(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text",
         window=WINDOW, block_words=BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hits (merged spans of word numbers) and items (ids as strings, in order)."""
    sc = docs.sparkSession.sparkContext
    out = docs.drop("n_words", "hits", "items").withColumns(
        {"n_words": F.lit(None).cast("long"), "hits": F.array().cast(SPANS), "items": F.array().cast("array<string>")}
    )

    def searching(shared):
        def run(batches):
            phrases = shared.value
            for batch in small_batches(batches, text):
                offsets, hit, pairs = _search(phrases, batch.column(text))
                old_hits, old_items = batch.column("hits"), batch.column("items")
                found = [set(x) for x in old_items.to_pylist()]
                for row, phrase in pairs.tolist():
                    found[row].update(phrases.items[phrase])
                spans = []
                for i, old in enumerate(old_hits.to_pylist()):
                    own = hit[offsets[i] : offsets[i + 1]]
                    for s in old:
                        own[s["first"] : s["last"] + 1] = True
                    spans.append([{"first": a, "last": b} for a, b in zip(*(x.tolist() for x in merged(own)))] if own.any() else [])
                yield with_columns(
                    batch,
                    n_words=pa.array(np.diff(offsets), pa.int64()),
                    hits=pa.array(spans, old_hits.type),
                    items=pa.array([sorted(x) for x in found], old_items.type),
                )

        return run

    none = Phrases([], [], window)
    for phrases in filter(None, blocks(benchmark, item_id, item_text, window, block_words)):
        none = None
        out = in_batches(out, searching(sc.broadcast(phrases)), out.schema)
    if none is not None:  # no phrase at all: only words are counted

        def count(batches):
            for batch in small_batches(batches, text):
                offsets = flat_words(batch.column(text), TABLE)[1]
                yield with_columns(batch, n_words=pa.array(np.diff(offsets), pa.int64()))

        out = in_batches(out, count, out.schema)
    return out


def cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between words of the same span."""
    data, _ = text_buffer(pa.array([text]))
    word = np.concatenate([[False], TABLE[data] != 32, [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    raw, at, out = data.tobytes(), 0, []
    for first, last in zip(*merged(hit)):
        out.append(raw[at : starts[first]])
        at = ends[last]
    return b"".join([*out, raw[at:]]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text",
           window=WINDOW, block_words=BLOCK_WORDS) -> DataFrame:
    """``docs`` with every hit span cut out of the text; where a cut brings words together so that a phrase
    arises anew, that goes too. Texts without a hit are not touched."""
    sc, schema, flagged = docs.sparkSession.sparkContext, docs.schema, "__cut"

    def cutting(shared, flag=None):
        def run(batches):
            phrases = shared.value
            for batch in small_batches(batches, text):
                column, rows = batch.column(text), np.arange(len(batch))
                texts = None
                while len(rows):
                    offsets, hit, pairs = _search(phrases, column)
                    touched = np.unique(pairs[:, 0])
                    if not len(touched):
                        break
                    texts = batch.column(text).to_pylist() if texts is None else texts
                    for i in touched.tolist():
                        texts[rows[i]] = cut(texts[rows[i]], hit[offsets[i] : offsets[i + 1]])
                    rows = rows[touched]
                    column = pa.array([texts[i] for i in rows], pa.string())
                if texts is not None:
                    changed = {text: pa.array(texts, pa.string())}
                    if flag:
                        before = batch.column(text).to_pylist()
                        changed[flag] = pc.or_(batch.column(flag), pa.array([a != b for a, b in zip(texts, before)]))
                    batch = with_columns(batch, **changed)
                yield batch

        return run

    found = list(filter(None, blocks(benchmark, item_id, item_text, window, block_words)))
    if len(found) < 2:
        for phrases in found:
            docs = in_batches(docs, cutting(sc.broadcast(phrases)), schema)
        return docs
    # a cut made for one block may join words into a phrase of any other: rows that were cut look at all blocks again
    while flagged in docs.columns:
        flagged += "_"
    clean = docs.limit(0)
    while True:
        docs = docs.withColumn(flagged, F.lit(False))
        for phrases in found:
            docs = in_batches(docs, cutting(sc.broadcast(phrases), flagged), docs.schema)
        docs = stored(docs, "cut")
        clean = clean.unionByName(docs.filter(~F.col(flagged)).drop(flagged))
        docs = docs.filter(flagged).drop(flagged)
        if docs.isEmpty():
            return clean
