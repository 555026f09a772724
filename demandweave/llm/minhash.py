"""Near duplicates by min-max hashing, linked exactly.

Each set of word shingles is hashed under some permutations, and both the smallest and the largest value are kept
under each: twice the signature for one evaluation, unbiased, with less variance than minima alone. Runs of values
make bands; documents that agree on a whole band meet. With 32 bands of 4 values a pair of similarity 0.8 misses all
of them once in 20 million, a closer one less often. Pairs that meet, and whose signatures do not tell them apart,
are decided on their full sets.

* Equal sets are one node from the start: copies cost one row each.
* In a band all nodes are first paired with one of them, the pivot: the one that meets the most others over all its
  bands, as the origin of many near copies does. Each node is proved against its most similar pivot first. Groups of
  near copies become one component that way, without their pairs being listed.
* What a band still holds apart is compared in cells of sizes, a cell and the one above it. Small cells are compared
  within a task. Large ones are dealt into blocks, and each pair of blocks is a group of its own, so no group grows
  with the data and no pair is left out. Nodes that are in one component already are not compared, and a pair is
  named by the first band that it shares only.

Sets are compared by 64-bit shingle hashes and told apart by a 64-bit hash of the set. They are not kept: those that
some pair needs are made again.

Defined cases: text is lower-cased in A-Z; null, empty and blank texts have an empty set, link with nothing and are
kept. With fewer words than a shingle, the whole sequence is the only shingle. Rows with the same id count as one
document and are kept or go together. A row without an id links nothing, its component is null and it is kept. Ids
are integers. Texts are read whole; tables may be empty. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.session import stored

from .bitmaps import bitmap, found
from .components import components
from .words import SPACES, byte_table, hashed_words, in_batches, mixed, small_batches, window_hashes

TABLE = byte_table(SPACES, lower=True)
PERMUTATIONS, ROWS = 96, 5
#: Share of the signature in which a pair must agree to be proved, that much below ``least``: 5.2 standard deviations
#: of 192 values at a similarity of 0.8, a chance of one in ten million.
SLACK = 0.15
#: Nodes of a band and a cell of sizes that are compared in one group.
BLOCK = 1024
#: Bits of the filter that finds the documents whose sets are needed; a fixed 4 MB.
FILTER_BITS = 1 << 25


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, offsets = hashed_words(column, TABLE)
    windows = window_hashes(hashes, size)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers; hashes times one of them, cut to their upper half, is one permutation's order."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """A row of minima and then maxima per set; sets must not be empty."""
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    if sets:
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        every = mixed(np.concatenate(sets))
        for i, by in enumerate(multipliers(permutations)):
            values = ((every * by) >> np.uint64(32)).astype(np.uint32)
            out[:, i] = np.minimum.reduceat(values, starts)
            out[:, permutations + i] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band; bands of different places never share one but by chance."""
    bands = signature.shape[1] // rows
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(signature), 0)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F) + signature[:, r : bands * rows : rows].astype(np.uint64))
    return keys.view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def signature_matrix(column: pa.Array) -> np.ndarray:
    """A row of bytes per document: one value in 256 agrees by chance, which never hides a pair."""
    return np.stack([np.frombuffer(x, np.uint8) for x in column.to_pylist()])


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    for side in "ab":
        pairs = pairs.join(labels.toDF(side, f"of_{side}"), side, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def cell_counts(shingles: np.ndarray) -> bytes:
    """Shingles per cell. The L1 distance of two such counts never exceeds the symmetric difference of the sets;
    clipping keeps distances from growing."""
    counts = np.bincount((mixed(shingles) >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


class MinMaxDedup:
    """``least`` is the similarity in hundredths from which documents link; ``size`` the words of a shingle."""

    def __init__(self, least=80, size=2, permutations=PERMUTATIONS, rows=ROWS, block=BLOCK, doc_id="doc_id", text="text"):
        self.least, self.size, self.permutations, self.rows, self.block = least, size, permutations, rows, block
        self.doc_id, self.text = doc_id, text

    def _nodes(self, docs: DataFrame) -> DataFrame:
        size, permutations, rows = self.size, self.permutations, self.rows

        def run(batches):
            for batch in small_batches(batches, "text"):
                sets = shingle_sets(batch.column("text"), size)
                signature = signatures([s for s in sets if len(s)], permutations)
                full = zip(band_keys(signature, rows).tolist(), signature.astype(np.uint8))
                rest = [(node_of(s), *next(full)) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "node": pa.array([r[0] for r in rest], pa.int64()),
                        "bands": pa.array([r[1] for r in rest], pa.list_(pa.int64())),
                        "signature": pa.array([None if r[2] is None else r[2].tobytes() for r in rest], pa.binary()),
                        "cells": pa.array([cell_counts(s) if len(s) else None for s in sets], pa.binary()),
                    }
                )

        schema = "doc_id long, n_shingles long, node long, bands array<long>, signature binary, cells binary"
        return in_batches(docs, run, schema).withColumn("row", F.monotonically_increasing_id())

    # what meets in a band

    def _met(self, content: DataFrame) -> DataFrame:
        """(key, node, n, pivot) of the bands that several nodes share."""
        bands = stored(content.select(F.explode("bands").alias("key"), "node", "n"), "bands")
        shared = bands.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        met = stored(bands.join(shared, "key"), "shared")
        degree = met.groupBy("node").agg(F.sum("members").alias("degree"))
        pivots = met.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot"))
        return met.drop("members").join(pivots, "key")

    def _open(self, met: DataFrame, labels: DataFrame, content: DataFrame) -> DataFrame:
        """Pairs of nodes that share a band, have sizes and cell counts within reach, are in different components, and
        whose signatures agree enough."""
        least, block, floor = self.least, self.block, self.least / 100 - SLACK
        own = met.select("key", "node", "n").join(labels, "node", "left")
        own = own.withColumn("component", F.coalesce("component", "node"))
        parted = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        own = own.join(parted.filter("low < high").select("key"), "key")
        step = 1.001 * float(np.log(100 / least))
        # linked sets lie in the same cell of sizes or in the next one: each cell also gets the one above it
        cell = F.floor(F.log(F.col("n").cast("double")) / step)
        own = own.withColumn("cell", F.explode(F.array(cell, cell - 1))).withColumn("home", F.col("cell") == cell)
        own = stored(own, "open")
        # one component in a cell has nothing to compare
        cells = own.groupBy("key", "cell").agg(
            F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")
        )
        cells = cells.filter("low < high").select("key", "cell", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
        own = own.join(cells, ["key", "cell"])
        mine = F.pmod(F.hash("node"), "blocks")
        own = own.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = F.xxhash64("key", "cell", F.least("mine", "other"), F.greatest("mine", "other"))
        own = own.select(group.alias("group"), "key", "node", "n", "component", "home")
        own = own.join(content.select("node", "signature", "bands", "cells"), "node")
        own = own.repartition("group").sortWithinPartitions("group", "n", "node")

        def pairs(table: pa.Table) -> pa.RecordBatch:
            group, key, node, n, component, home = (
                table.column(c).to_numpy() for c in ("group", "key", "node", "n", "component", "home")
            )
            signature = signature_matrix(table.column("signature"))
            cells = signature_matrix(table.column("cells")).astype(np.int16)
            bands = table.column("bands").combine_chunks()
            bands = bands.flatten().to_numpy().reshape(len(group), -1)
            out, at, step = [], np.arange(len(group)), 1
            while len(at):
                at = at[at + step < len(group)]
                at = at[(group[at] == group[at + step]) & (100 * n[at] >= least * n[at + step])]
                for i in range(0, len(at), 8192):
                    x = at[i : i + 8192]
                    x = x[(component[x] != component[x + step]) & (home[x] | home[x + step])]
                    x = x[(signature[x] == signature[x + step]).mean(1) >= floor]
                    shared = bands[x] == bands[x + step]
                    x = x[bands[x, shared.argmax(1)] == key[x]]
                    gap = np.abs(cells[x] - cells[x + step]).sum(1, dtype=np.int64)
                    x = x[(100 + least) * gap <= (100 - least) * (n[x] + n[x + step])]
                    out.append(np.stack([node[x], node[x + step]], 1))
                step += 1  # sizes ascend: beyond the window nothing comes back
            out = np.sort(np.concatenate([*out, np.empty((0, 2), np.int64)]), axis=1)
            return pa.RecordBatch.from_pydict({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

        def run(batches):
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table if rest is None else pa.concat_tables([rest, table])
                group = table.column("group").to_numpy()
                # the last group may go on in the next batch
                cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
                if cut:
                    yield pairs(table.slice(0, cut))
                rest = table.slice(cut)
            if rest is not None and len(rest):
                yield pairs(rest)

        return in_batches(own, run, "a long, b long").distinct()

    # proof

    def _alike(self, pairs: DataFrame, content: DataFrame) -> DataFrame:
        """Pairs whose signatures agree enough, with the share in which they do."""
        least, floor, both = self.least, self.least / 100 - SLACK, pairs.distinct()
        small = content.select("node", "n", "signature")
        for side in "ab":
            both = both.join(small.toDF(side, f"n_{side}", f"signature_{side}"), side)
        both = both.filter(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))

        def run(batches):
            for batch in batches:
                if len(batch):
                    a, b = (signature_matrix(batch.column(c)) for c in ("signature_a", "signature_b"))
                    share = (a == b).mean(1)
                    cols = {"a": batch.column("a"), "b": batch.column("b"), "share": pa.array(share)}
                    yield pa.RecordBatch.from_pydict(cols).filter(pa.array(share >= floor))

        return in_batches(both, run, "a long, b long, share double")

    def _sets(self, docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, shingles) of ``nodes``, from one document each; a bitmap of fixed size spares the other texts."""
        size = self.size
        needed = stored(classes.join(nodes, "node", "left_semi").select("node", F.xxhash64("doc_id").alias("hash")), "needed")
        mask = docs.sparkSession.sparkContext.broadcast(bitmap(needed.select("hash"), FILTER_BITS))

        def run(batches):
            for batch in small_batches(batches, "text"):
                batch = batch.filter(pa.array(found(mask.value, batch.column("hash").to_numpy())))
                sets = [s for s in shingle_sets(batch.column("text"), size) if len(s)]
                own = {node_of(s): s.tobytes() for s in sets}
                cols = {"node": pa.array(list(own), pa.int64()), "shingles": pa.array(list(own.values()), pa.binary())}
                yield pa.RecordBatch.from_pydict(cols)

        texts = docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("hash"), "text")
        sets = in_batches(texts, run, "node long, shingles binary").join(needed.select("node"), "node", "left_semi")
        # a copy that shares the id's bit brings the same set again
        return stored(sets.dropDuplicates(["node"]), "sets")

    def _links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        least = self.least
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

        def run(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                    # both are sorted and free of repeats
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[at] == y).sum())
                    keep.append(100 * common >= least * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return in_batches(both, run, "a long, b long")

    def groups(self, docs: DataFrame) -> DataFrame:
        """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
        docs = docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).alias("text"))
        nodes = stored(self._nodes(docs), "nodes")
        named = nodes.filter("node is not null and doc_id is not null")
        classes = named.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n")
        )
        classes = stored(classes, "classes")
        content = nodes.select("row", "bands", "signature", "cells").join(classes.select("row", "node", "n"), "row")
        content = stored(content.drop("row"), "content")
        met = stored(self._met(content), "met")
        # an id with several texts joins their nodes
        several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
        links = named.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
        stars = met.filter("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        stars = stored(self._alike(stars, content), "stars")
        sets = self._sets(docs, ends(stars), classes)
        # each node with its most similar pivot, then with all its pivots, then all that a band still holds apart;
        # pairs whose ends are joined by then need no proof
        near = stars.groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a")).select("a", "b")
        links = stored(links.unionByName(self._links(near, sets)), "links")
        labels = stored(components(links), "labels")
        near = stored(apart(stars.select("a", "b"), labels), "near")
        if not near.isEmpty():
            links = links.unionByName(stored(self._links(near, sets), "links"))
            labels = stored(components(links), "labels")
        near = stored(self._open(met, labels, content), "near")
        if not near.isEmpty():
            more = ends(near).join(sets.select("node"), "node", "left_anti")
            sets = sets.unionByName(self._sets(docs, more, classes))
            links = links.unionByName(stored(self._links(near, sets), "links"))
            labels = stored(components(links), "labels")
        label = classes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "doc_id")
        smallest = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_node = label.join(smallest, "label").select("node", "component_id")
        return (
            nodes.select("doc_id", "n_shingles", "node")
            .join(of_node, "node", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
            .select("doc_id", "n_shingles", "component_id", "kept")
        )
