"""Exact Jaccard join of word-shingle sets, as a metric-space join.

Jaccard distance is a metric, and the links sought lie within a radius r of each other. The pivots that make
regions are shingles: a document lies in the region of each of the first shingles of its set, in one order for
all, as many as it could lose and still be within r of another, so linked documents share a region (documents
as first pivots would not part unlike texts: almost all are at distance 1 from almost every other, so their
triangle windows would replicate everything everywhere). Frequent shingles come last in the order, so that a
passage that many documents share makes no region.

* Within a region windows replace all pairs: sizes (their triangle inequality with the empty set), then the L1
  distance of counts in a few cells, which never exceeds the symmetric difference. Pairs left are verified on
  their sets.
* A region above LARGE documents takes one document as pivot, and pairs all others with it. When
  its links are known and joined, a region that is one component is done. Otherwise it is joined again: those
  outside its largest component against all, in windows of sizes with boundary documents replicated.

Equal sets are one node from the start. Copies thus cost one row each. Packed numbers are shuffled, not sets;
sets are shuffled for pairs that pass the windows only.

Sets are compared by 64-bit shingle hashes and told apart by a 64-bit hash of the set.

Defined cases: text is lower-cased in A-Z; null, empty and blank texts have an empty set and link with nothing.
With fewer words than a shingle, the whole sequence is the only shingle. Rows with the same id count as one
document. A row without an id links nothing, its component is null. Texts are read whole; tables may be empty.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandweave.session import stored

from .components import components
from .words import SPACES, byte_table, hashed_words, in_batches, mixed, small_batches, window_hashes

TABLE = byte_table(SPACES, lower=True)
#: Documents of a region that are still compared pair by pair.
LARGE = 64
#: A shingle in more documents than this is frequent; the most frequent MOST_FREQUENT are ordered last. That
#: bounds a broadcast; regions of others are joined all the same.
FREQUENT, MOST_FREQUENT = 64, 500_000
CELLS = 512
#: Shingles that a task collects before it sends them on.
FLUSH = 1 << 18
#: Large regions that a document lists, the smallest of its own; listing fewer only repeats comparisons.
LISTED = 16
#: Central documents of a large region that its documents are compared with before all others.
PIVOTS = 4
#: Bits of the filter that finds the documents whose sets are needed; a fixed 4 MB. False finds cost time only.
FILTER_BITS, FILTER_PARTS = 1 << 25, 64


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


def node_of(shingles: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64)) if len(shingles) else None


def cell_counts(shingles: np.ndarray) -> bytes:
    """Shingles per cell; clipping keeps differences from growing."""
    counts = np.bincount((mixed(shingles) >> np.uint64(55)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def cell_matrix(column) -> np.ndarray:
    """A row of counts per document."""
    return np.stack([np.frombuffer(x, np.uint8) for x in column.to_pylist()]).astype(np.int16)


def marks(shingles: np.ndarray) -> np.ndarray:
    """32 bits of each hash. Shingles that share them are frequent together; any such order is the same for all."""
    return (mixed(shingles) >> np.uint64(32)).astype(np.uint32)


def region_count(n: int, least: int) -> int:
    """First shingles of a set of n, of which a linked document has at least one among its own."""
    return n - (least * n + 99) // 100 + 1 if n else 0


class JaccardJoin:
    """``least`` is the similarity in hundredths from which documents link; ``size`` the words of a shingle."""

    def __init__(self, least=85, size=4, doc_id="doc_id", text="text", large=LARGE, frequent=FREQUENT):
        self.least, self.size, self.doc_id, self.text, self.large, self.frequent = least, size, doc_id, text, large, frequent

    # sets and nodes

    def _nodes(self, docs: DataFrame, buckets: int) -> DataFrame:
        """Rows of kind 0: a document's node, size and cell counts. Rows of kind 1: marks a and their counts b, of the
        shingles that can come first: a fixed quarter of all, by hash."""
        size = self.size

        def marked(held):
            mark, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = (mark % np.uint32(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            mark, n = mark[order], np.minimum(n[order], 255).astype(np.uint8)
            full = [(b, i, j) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
            return rows(
                kind=[1] * len(full),
                bucket=[b for b, _, _ in full],
                a=[mark[i:j].tobytes() for _, i, j in full],
                b=[n[i:j].tobytes() for _, i, j in full],
            )

        def rows(**columns):
            n = len(columns["kind"])
            return pa.RecordBatch.from_pydict({c: pa.array(columns.get(c, [None] * n), t) for c, t in types.items()})

        def run(batches):
            held, n = [], 0
            for batch in small_batches(batches, "text"):
                sets = shingle_sets(batch.column("text"), size)
                nodes = [node_of(s) for s in sets]
                all_of = np.concatenate([*dict(zip(nodes, sets)).values(), np.empty(0, np.uint64)])
                held.append(marks(all_of[all_of < np.uint64(1 << 62)]))
                n += len(held[-1])
                yield rows(
                    kind=[0] * len(sets),
                    doc_id=batch.column("doc_id"),
                    n_shingles=[len(s) for s in sets],
                    node=nodes,
                    cells=[cell_counts(s) for s in sets],
                )
                if n >= FLUSH:
                    yield marked(held)
                    held, n = [], 0
            if n:
                yield marked(held)

        types = {"kind": pa.int32(), "doc_id": pa.int64(), "n_shingles": pa.int64(), "node": pa.int64(), "cells": pa.binary()}
        types |= {"bucket": pa.int32(), "a": pa.binary(), "b": pa.binary()}
        schema = "kind int, doc_id long, n_shingles long, node long, cells binary, bucket int, a binary, b binary"
        return in_batches(docs, run, schema)

    def _frequent(self, packed: DataFrame) -> np.ndarray:
        """Marks of the most frequent of the shingles that can come first."""
        frequent = self.frequent

        def total(batches):
            found, counts = [], []
            for batch in batches:
                found += [np.frombuffer(x, np.uint32) for x in batch.column("a").to_pylist()]
                counts += [np.frombuffer(x, np.uint8) for x in batch.column("b").to_pylist()]
            if not found:
                return
            mark, back = np.unique(np.concatenate(found), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts), len(mark)).astype(np.int64)
            often = n > frequent
            yield pa.RecordBatch.from_pydict({"mark": pa.array(mark[often].astype(np.int64)), "n": pa.array(n[often])})

        counted = in_batches(packed.repartition("bucket"), total, "mark long, n long")
        top = counted.orderBy(F.desc("n"), "mark").limit(MOST_FREQUENT).select("mark").toPandas()
        return np.sort(top["mark"].to_numpy(np.int64).astype(np.uint32))

    # regions

    def _candidates(self, docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
        """Rows (kind, a, b, n): a pair with the pivot of a region, another pair of a small region, or a member
        b of size n of the large region a."""
        size, least, most = self.size, self.least, self.large
        last = docs.sparkSession.sparkContext.broadcast(frequent)

        def replicate(batches):
            held, size_held = [], 0
            for batch in small_batches(batches, "text"):
                for node, own in {node_of(s): s for s in shingle_sets(batch.column("text"), size)}.items():
                    if node is None:
                        continue
                    if len(last.value):
                        own_marks = marks(own)
                        at = np.minimum(np.searchsorted(last.value, own_marks), len(last.value) - 1)
                        late = last.value[at] == own_marks
                        own = np.concatenate([own[~late], own[late]]) if late.any() else own
                    first = own[: region_count(len(own), least)].copy()
                    held.append((first, np.full(len(first), node), np.full(len(first), len(own))))
                    size_held += len(first)
                if size_held >= FLUSH:
                    yield from regions(held)
                    held, size_held = [], 0
            if held:
                yield from regions(held)

        def regions(held):
            token, node, n = (np.concatenate(x) for x in zip(*held))
            # a shingle frequent in this task: its documents meet here, only their pivot travels
            order = np.lexsort((node, token))
            token, node, n = token[order], node[order], n[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n = token[fresh], node[fresh], n[fresh]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(start, len(token)))
            large = np.repeat(count > most, count)
            head = np.zeros(len(token), bool)
            head[start] = True
            bucket = (token % np.uint64(buckets)).astype(np.int32)
            for kind, chosen in ((0, ~large | head), (1, large)):
                at = np.flatnonzero(chosen)
                at = at[np.argsort(bucket[at], kind="stable")]
                cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
                full = [(b, at[i:j]) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array([kind] * len(full), pa.int32()),
                        "bucket": pa.array([b for b, _ in full], pa.int32()),
                        "a": pa.array([token[i].tobytes() for _, i in full], pa.binary()),
                        "b": pa.array([node[i].tobytes() for _, i in full], pa.binary()),
                        "n": pa.array([n[i].tobytes() for _, i in full], pa.binary()),
                    }
                )

        def join(batches):
            got = {0: ([], [], []), 1: ([], [], [])}
            for batch in batches:
                for kind, *cols in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "n"))):
                    for into, raw, of in zip(got[kind], cols, (np.uint64, np.int64, np.int64)):
                        into.append(np.frombuffer(raw, of))
            none = np.empty(0, np.int64)
            token, node, n = (np.concatenate([*x, none.astype(t)]) for x, t in zip(got[0], (np.uint64, np.int64, np.int64)))
            met = tuple(np.concatenate([*x, none.astype(t)]) for x, t in zip(got[1], (np.uint64, np.int64, np.int64)))
            # groups that met in one batch, each with the pivot it sent
            order = np.lexsort((node, n, token))
            token, node, n = token[order], node[order], n[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n = token[fresh], node[fresh], n[fresh]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else none
            count = np.diff(np.append(start, len(token)))
            region = np.repeat(np.arange(len(start)), count)
            pivot = np.minimum.reduceat(node, start) if len(start) else none
            known = np.isin(token[start], met[0]) if len(met[0]) else np.zeros(len(start), bool)
            large = (count > most) | known
            stars = [np.stack([pivot[region], node], 1)[(count > 1)[region]]]
            if len(met[0]):
                at = np.searchsorted(token[start], met[0])
                stars.append(np.stack([pivot[at], met[1]], 1))
            other, step = [], 1
            small = np.flatnonzero((~large & (count > 2))[region])
            while len(small):
                small = small[small + step < len(node)]
                small = small[region[small] == region[np.minimum(small + step, len(region) - 1)]]
                near = small[100 * n[small] >= least * n[small + step]]
                other.append(np.stack([node[near], node[near + step]], 1))
                small, step = near, step + 1  # sizes ascend: beyond the window nothing comes back
            big = np.concatenate([np.flatnonzero(large[region])]) if len(token) else none
            for kind, pairs in ((1, stars), (2, other)):
                pairs = np.concatenate([*pairs, np.empty((0, 2), np.int64)])
                pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
                yield rows(kind, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
            yield rows(3, np.append(token[big], met[0]).view(np.int64), np.append(node[big], met[1]), np.append(n[big], met[2]))

        def rows(kind, a, b, n):
            cols = {"kind": np.full(len(a), kind, np.int32), "a": a, "b": b, "n": n}
            return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

        packed = in_batches(docs.select("text"), replicate, "kind int, bucket int, a binary, b binary, n binary")
        return in_batches(packed.repartition("bucket"), join, "kind int, a long, b long, n long")

    # verification

    def _near(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs that the windows on sizes and cell counts let pass, with the gap between their counts."""
        least = self.least
        small = classes.select("node", "n_shingles", "cells")
        both = pairs.select("a", "b").distinct()
        for side in "ab":
            both = both.join(small.toDF(side, f"n_{side}", f"cells_{side}"), side)
        both = both.filter(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))

        def run(batches):
            for batch in batches:
                if len(batch):
                    a, b = (cell_matrix(batch.column(c)) for c in ("cells_a", "cells_b"))
                    gap = np.abs(a - b).sum(1, dtype=np.int64)
                    sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                    near = (100 + least) * gap <= (100 - least) * sizes
                    cols = {"a": batch.column("a"), "b": batch.column("b"), "gap": pa.array(gap)}
                    yield pa.RecordBatch.from_pydict(cols).filter(pa.array(near))

        return in_batches(both, run, "a long, b long, gap long")

    def _sets(self, docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in pairs, from one document each. A false find of the filter brings a
        node that no pair has, a repeated id a set twice: joins drop the one, and links are made distinct."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = stored(nodes.join(classes, "node").select("node", "doc_id"), "needed")
        bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
        width = FILTER_BITS // FILTER_PARTS

        def mark(batches):
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                bits = batch.column(1).to_numpy()
                for p in np.unique(bits // width).tolist():
                    own = parts.setdefault(p, np.zeros(width, bool))
                    own[bits[bits // width == p] % width] = True
            cols = [(p, np.packbits(v).tobytes()) for p, v in parts.items()]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([c[0] for c in cols], pa.int64()), "bits": pa.array([c[1] for c in cols], pa.binary())}
            )

        marked = needed.select(F.floor(bit / width).alias("part"), bit.alias("bit")).distinct().repartition(FILTER_PARTS, "part")
        mask = np.zeros((FILTER_PARTS, width // 8), np.uint8)
        for part, bits in in_batches(marked, mark, "part long, bits binary").collect():
            mask[part] |= np.frombuffer(bits, np.uint8)
        shared, size = docs.sparkSession.sparkContext.broadcast(mask.reshape(-1)), self.size

        def run(batches):
            for batch in small_batches(batches, "text"):
                bits = batch.column("bit").to_numpy()
                found = (shared.value[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1 == 1
                batch = batch.filter(pa.array(found))
                sets = shingle_sets(batch.column("text"), size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array([node_of(s) for s in sets], pa.int64()),
                        "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                    }
                )

        found = in_batches(docs.filter("doc_id is not null").withColumn("bit", bit), run, "node long, shingles binary")
        return found

    def _links(self, docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        least, sets = self.least, self._sets(docs, pairs, classes)
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

    def _again(self, members: DataFrame, labels: DataFrame, classes: DataFrame, central: bool) -> DataFrame:
        """Pairs of large regions that are more than one component, in windows of sizes. ``central``: every
        document with the few that lie closest to the middle of its first region's cell counts. Otherwise all that
        is left: those outside a region's largest component against all."""
        least = self.least
        own = members.select(F.col("a").alias("region"), F.col("b").alias("node"), "n").distinct()
        own = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = stored(own.groupBy("region", "component").count(), "sizes")
        largest = sizes.groupBy("region").agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("parts"))
        open_ = largest.filter("parts > 1").select("region", F.col("top.component").alias("largest"))
        step = 1.001 * float(np.log(100 / least))
        # linked sets lie in the same cell of sizes or in the next one: each cell also gets the one above it
        cell = F.floor(F.log(F.col("n").cast("double")) / step)
        own = own.join(open_, "region").withColumn("outside", F.col("component") != F.col("largest"))
        own = own.withColumn("cell", F.explode(F.array(cell, cell - 1))).withColumn("home", F.col("cell") == cell)
        # two documents may share many regions: they are compared in the first that both list
        lists = own.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("region")), 1, LISTED).alias("listed"))
        own = own.join(lists, "node").join(classes.select("node", "cells"), "node")

        def run(key, group):
            cols = {c: group.column(c).to_numpy() for c in ("node", "n", "component", "outside", "home")}
            cells, region = cell_matrix(group.column("cells")), key[0].as_py()
            none = np.iinfo(np.int64).max
            listed = np.array([x + [none] * (LISTED - len(x)) for x in group.column("listed").to_pylist()], np.int64)
            n, component = cols["n"], cols["component"]
            if central:
                middle = np.abs(cells - cells.mean(0)).sum(1)
                pivots, own = np.argsort(middle, kind="stable")[:PIVOTS], np.flatnonzero(listed[:, 0] == region)
                a, b = np.repeat(pivots, len(own)), np.tile(own, len(pivots))
                near = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
                a, b = a[near], b[near]
                gap = np.concatenate([np.abs(cells[p] - cells[b[a == p]]).sum(1, dtype=np.int64) for p in np.unique(a)] or [a])
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                close = (100 + least) * gap <= (100 - least) * (n[a] + n[b])
                return pa.table({"a": cols["node"][a[close]], "b": cols["node"][b[close]]})
            # the most common of the smaller regions as bits: most pairs that meet elsewhere are told by them
            smaller, times = np.unique(listed[listed < region], return_counts=True)
            mask = np.zeros(len(listed), np.uint64)
            for bit, other in enumerate(smaller[np.argsort(-times)[:64]]):
                mask |= (listed == other).any(1).astype(np.uint64) << np.uint64(bit)
            out = [np.empty((0, 2), np.int64)]
            for i in np.flatnonzero(cols["outside"]).tolist():
                near = (mask & mask[i] == 0) & (component != component[i]) & (cols["home"] | cols["home"][i])
                near &= (100 * np.minimum(n, n[i]) >= least * np.maximum(n, n[i]))
                at = np.flatnonzero(near)
                close = (100 + least) * np.abs(cells[at] - cells[i]).sum(1, dtype=np.int64) <= (100 - least) * (n[at] + n[i])
                at = at[close]
                common = np.where(np.isin(listed[at], listed[i]), listed[at], none).min(1, initial=none)
                at = at[(common == none) | (common >= region)]
                out.append(np.stack([np.full(len(at), cols["node"][i]), cols["node"][at]], 1))
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

        return own.groupBy("region", "cell").applyInArrow(run, "a long, b long").distinct()

    def groups(self, docs: DataFrame) -> DataFrame:
        """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links)."""
        docs = docs.select(F.col(self.doc_id).cast("long").alias("doc_id"), F.col(self.text).alias("text"))
        spark = docs.sparkSession
        buckets = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        read = stored(self._nodes(docs, buckets), "nodes")
        nodes = read.filter("kind = 0").select("doc_id", "n_shingles", "node", "cells")
        named = nodes.filter("node is not null and doc_id is not null")
        classes = named.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("cells").alias("cells")
        )
        classes = stored(classes, "classes")
        found = stored(self._candidates(docs, self._frequent(read.filter("kind = 1").select("bucket", "a", "b")), buckets), "regions")
        pivots, others, large = (found.filter(F.col("kind") == k) for k in (1, 2, 3))
        # an id with several texts joins their nodes
        several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
        links, labels = named.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"), None
        # first each document with the closest of its pivots, then with all of them and with the central documents
        # of large regions, then whatever small regions pair and large ones still hold apart; pairs whose ends
        # are joined by then need no proof
        for step in range(3):
            if step == 0:
                near = self._near(pivots, classes)
                near = near.groupBy("b").agg(F.min_by("a", F.struct("gap", "a")).alias("a")).select("a", "b")
            else:
                pairs = (pivots if step == 1 else others).select("a", "b")
                pairs = pairs.unionByName(self._again(large, labels, classes, step == 1))
                for side in "ab":
                    pairs = pairs.join(labels.toDF(side, f"of_{side}"), side, "left")
                near = self._near(pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")), classes).select("a", "b")
            near = stored(near, "near")
            if labels is None or not near.isEmpty():
                new = stored(self._links(docs, near, classes), "links")
                links = links.unionByName(new)
                labels = stored(components(links), "labels")
        label = classes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "doc_id")
        smallest = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_node = label.join(smallest, "label").select("node", "component_id")
        return (
            nodes.drop("cells")
            .join(of_node, "node", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
            .select("doc_id", "n_shingles", "component_id")
        )
