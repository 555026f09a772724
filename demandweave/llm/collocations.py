"""Phrases that stand together more often than their parts would, mined shard by shard (SON).

A phrase with ``support`` occurrences in all has, in some shard, its proportional share of them. So every shard is
mined completely at the support lowered to its share of all words, level by level: words, then pairs of words that
are frequent there, then three and four words all of whose pairs are. What is frequent in some shard is a candidate,
and candidates are counted over all texts exactly. No word is passed over in its shard, so the shards' counts of words
add up to the exact ones, and only candidates of two words and more are counted once more.

Texts are read once: words are stored as their numbers in a batch's list of distinct words. Counting travels as
packed hashes, sorted and each as its distance from the one before, with its count in a task. Bitmaps of fixed size
stand for sets of frequent phrases: what they pass by chance is counted and dropped, so a full one costs time and loses
nothing. The groups that are counted in one place hold a bounded number of phrases, as many groups as the number of
words asks for. What was shuffled goes as soon as its counts are stored.

Phrases are told apart by 64-bit hashes of their language and words. Where candidates of two words and more are only
looked for, the first 40 bits do: phrases alike in them are candidates together or not at all, and each is counted by
itself afterwards. A phrase takes its words from one stored batch that holds it.

Defined cases: a null text is empty, a null language ``und``, and one that is named so belongs to it. Texts are
lower-cased in A-Z and read whole. Pieces end at ``.,;:!?`` and at line ends, words at blanks and tabs. Repeated rows
and copies count as often as they occur. Ties are broken by the phrase in the order of its bytes. An empty table gives
no rows. Only text and language are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandweave.session import shuffles_freed, stored

from .bitmaps import bitmap, found
from .words import byte_table, flat_words, in_batches, mixed, release, small_batches, text_buffer

SPACES, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = byte_table(SPACES + BREAKS, lower=True)
LONGEST = 4
#: Shards, each dealt over the cluster as it is; support 30 becomes 10 in each.
SHARDS = 3
#: Bits of the sets of frequent phrases: 16 MB.
FILTER_BITS = 1 << 27
#: Phrases that a task collects before it counts and sends them, and words per group that is counted in one place.
FLUSH, GROUP_WORDS = 1 << 20, 1_500_000
#: Bits of a hash that are left out where phrases are only looked for.
CUT = 24
#: Phrases that are spelled before they are handed on.
SPELLED = 4096

_B = np.uint64(0xC2B2AE3D27D4EB4F)


def text_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def each_row(batch: pa.RecordBatch):
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def code_type(distinct: int) -> type:
    return np.uint16 if distinct < 1 << 16 else np.uint32


def pieces_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in order, and the number of the piece that each lies in."""
    data, ends = text_buffer(column)
    words, _ = flat_words(column, TABLE)
    inside = TABLE[data] != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    first[starts] = inside[starts]
    ended = np.isin(data, np.frombuffer(BREAKS, np.uint8)).astype(np.int64)
    ended[starts] += 1  # a text never goes on in the next one
    return words, np.cumsum(ended)[first]


class Phrases:
    """The stored words of a batch as hashes, and the windows over them that no break cuts."""

    def __init__(self, lang: int, own: np.ndarray, codes: bytes):
        self.codes, self.own = np.frombuffer(codes, code_type(len(own))).astype(np.int64), mixed(own)
        self.lang = np.array([lang], np.int64).view(np.uint64)
        self.breaks = self.codes == 0
        self.cut = np.cumsum(self.breaks)
        self.words = self.own[np.maximum(self.codes, 1) - 1]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words, and whether it lies within a piece."""
        n = max(0, len(self.codes) - k + 1)
        out = np.full(n, (self.lang + np.uint64(k))[0], np.uint64)
        for j in range(k):
            out = mixed(out * _B + self.words[j : j + n])
        return out, ~self.breaks[:n] & (self.cut[k - 1 :][:n] == self.cut[:n])


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(x) // n] = np.frombuffer(x, np.uint8).reshape(n, -1)
    return out.view("<i8").ravel().astype(np.int64, copy=False)


def squeezed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def loosened(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def first_of_group(group: int, groups: int, cut: int = 0) -> int:
    """The smallest hash of a group; groups are equal ranges of hashes, of which the last ``cut`` bits are left out."""
    return -(-(group << 32) // groups) << 32 >> cut


def gaps(hashes: np.ndarray, group: int, groups: int, cut: int = 0) -> bytes:
    """Rising hashes of a group, each as its distance from the one before: that of a million takes six bytes, or
    three where 24 bits are left out."""
    return narrow(np.diff(hashes, prepend=np.uint64(first_of_group(group, groups, cut))))


def from_gaps(x: bytes, n: int, group: int, groups: int, cut: int = 0) -> np.ndarray:
    return np.cumsum(widened(x, n).view(np.uint64)) + np.uint64(first_of_group(group, groups, cut))


def kept(df: DataFrame, hint: str) -> DataFrame:
    """Stored, and what was shuffled for it is gone."""
    with shuffles_freed(df.sparkSession):
        return stored(df, hint)


def per_shard(hashes: np.ndarray, shard: int) -> np.ndarray:
    """The hash of a phrase in one shard."""
    return mixed(hashes ^ mixed(np.array([shard + 1], np.uint64)))


class Collocations:
    """``support`` occurrences make a candidate; ``absorbed`` hundredths of them inside one longer candidate drop it."""

    def __init__(self, support=30, absorbed=80, top=2000, shards=SHARDS, text="text", lang="lang", bits=FILTER_BITS, cut=CUT):
        self.support, self.absorbed, self.top, self.shards, self.bits, self.cut = support, absorbed, top, shards, bits, cut
        self.text, self.lang = text, lang

    def coded(self, docs: DataFrame) -> DataFrame:
        """(row, lang, shard, n_words, words, codes): the words of a batch of texts of one language. Words are
        numbered from 1 in the list of distinct ones, 0 ends a piece; list and numbers are compressed. A task's texts
        make one shard's."""
        shards = self.shards

        def run(batches):
            shard = TaskContext.get().partitionId() % shards
            for batch in small_batches(batches, "text"):
                langs = batch.column("lang")
                out = {c: [] for c in ("lang", "shard", "n_words", "words", "codes")}
                for lang in pc.unique(langs).to_pylist():
                    words, piece = pieces_of(batch.filter(pc.equal(langs, lang)).column("text"))
                    if not len(words):
                        continue
                    coded = words.dictionary_encode()
                    distinct = coded.dictionary.to_pylist()
                    ends = np.flatnonzero(np.diff(piece)) + 1
                    codes = np.insert(coded.indices.to_numpy() + 1, ends, 0)
                    out["lang"].append(lang)
                    out["shard"].append(shard)
                    out["n_words"].append(len(words))
                    out["words"].append(squeezed("\n".join(distinct).encode()))
                    out["codes"].append(squeezed(codes.astype(code_type(len(distinct))).tobytes()))
                types = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

        docs = docs.select(
            F.col(self.text).alias("text"), F.coalesce(F.col(self.lang).cast("string"), F.lit("und")).alias("lang")
        )
        schema = "lang string, shard int, n_words long, words binary, codes binary"
        return in_batches(docs, run, schema).withColumn("row", F.monotonically_increasing_id())

    # counting

    def _counted(self, rows: DataFrame, phrases, groups: int, finish, schema: str, cut=0, place=False, met=False) -> DataFrame:
        """What ``finish`` makes of {shard: (hashes, times, rows)}, the phrases of one range of hashes, each with its
        occurrences and, with ``place``, a row that holds it. ``phrases`` gives (hashes, times) of a stored
        batch, the hashes without their last ``cut`` bits. With ``met`` all shards of a range come together."""
        shards, firsts = self.shards, np.array([first_of_group(b, groups, cut) for b in range(groups)], np.uint64)

        def merged(parts):
            hashes, times = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.argsort(hashes)
            hashes = hashes[order]
            start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            times = np.add.reduceat(times[order], start)
            rows = np.concatenate([np.broadcast_to(p[2], len(p[0])) for p in parts])[order[start]] if place else None
            return hashes[start], times, rows

        def packed(held):
            out = {c: [] for c in ("shard", "bucket", "size", "h", "n", "row", "rows")}
            for shard, parts in held.items():
                hashes, times, rows = merged(parts)
                own_rows = np.unique([p[2] for p in parts])
                cuts = np.append(np.searchsorted(hashes, firsts), len(hashes))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[b], cuts[b + 1])
                    out["shard"].append(shard)
                    out["bucket"].append(b)
                    out["size"].append(cuts[b + 1] - cuts[b])
                    out["h"].append(gaps(hashes[own], b, groups, cut))
                    out["n"].append(narrow(times[own]))
                    out["row"].append(narrow(np.searchsorted(own_rows, rows[own])) if place else b"")
                    out["rows"].append(own_rows.tobytes() if place else b"")
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

        def count(batches):
            held, size = {}, 0
            for batch in batches:
                for r in each_row(batch):
                    own = phrases(r)
                    if len(own[0]):
                        held.setdefault(r["shard"], []).append((*own, r["row"]))
                        size += len(own[0])
                    if size >= FLUSH:
                        yield packed(held)
                        held, size = {}, 0
            if held:
                yield packed(held)
            release()

        def total(batches):
            held = {}
            for batch in batches:
                for r in each_row(batch):
                    n = r["size"]
                    hashes = from_gaps(r["h"], n, r["bucket"], groups, cut)
                    row = np.frombuffer(r["rows"], np.int64)[widened(r["row"], n)] if place else None
                    held.setdefault(r["bucket"], {}).setdefault(r["shard"], []).append((hashes, widened(r["n"], n), row))
            for bucket in sorted(held):
                cols = finish({shard: merged(parts) for shard, parts in sorted(held.pop(bucket).items())})
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()})
            release()

        sent = in_batches(rows, count, "shard int, bucket int, size int, h binary, n binary, row binary, rows binary")
        to = F.col("bucket") if met else (F.col("bucket") + F.col("shard") * (groups // shards)) % groups
        return in_batches(sent.repartitionById(groups, to.cast("int")), total, schema)

    def frequent(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The stored batches, and (hash, n, row) of every phrase of up to LONGEST words with ``support`` occurrences,
        exactly; row is one that holds the phrase, and null for single words."""
        spark, support, bits, cut = docs.sparkSession, self.support, self.bits, self.cut
        rows = kept(self.coded(docs), "coded")
        words = dict(rows.groupBy("shard").agg(F.sum("n_words")).collect())  # a row per shard
        total = sum(words.values())
        least = {s: max(1, math.ceil(support * w / total)) for s, w in words.items()}
        groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / GROUP_WORDS))
        plain = rows.select("row", F.xxhash64("lang").alias("lang"), "shard", "words", "codes")
        share = lambda df, column: spark.sparkContext.broadcast(bitmap(df.select(F.col(column).alias("hash")), bits))

        def view(r):
            return Phrases(r["lang"], text_hashes(loosened(r["words"]).decode().split("\n")), loosened(r["codes"]))

        def single(r):
            p = view(r)
            each = mixed((p.lang + np.uint64(1)) * _B + p.own)
            return each, np.bincount(p.codes, minlength=len(each) + 1)[1:]

        def distinct(hashes):
            return np.unique(hashes, return_counts=True)

        def marked(of):
            """(hash, mark) of what is frequent in a shard; mark is its hash there."""
            own = {s: hashes[times >= least[s]] for s, (hashes, times, _) in of.items()}
            marks = np.concatenate([per_shard(hashes, s) for s, hashes in own.items()])
            return {"hash": np.concatenate(list(own.values())).view(np.int64), "mark": marks.view(np.int64)}

        def added(of):
            """Words with their marks, n being 0, and what is frequent in all with its number."""
            marks = marked(of)["mark"]
            hashes, at = np.unique(np.concatenate([h for h, _, _ in of.values()]), return_inverse=True)
            n = np.zeros(len(hashes), np.int64)
            np.add.at(n, at, np.concatenate([times for _, times, _ in of.values()]))
            often, none = n >= support, np.zeros(len(marks), np.int64)
            cols = {"hash": (none, hashes[often].view(np.int64)), "mark": (marks, np.zeros(int(often.sum()), np.int64)), "n": (none, n[often])}
            return {c: np.concatenate(v) for c, v in cols.items()}

        def exact(of):
            (hashes, times, rows), = of.values()
            often = times >= support
            return {"hash": hashes[often].view(np.int64), "n": times[often], "row": rows[often]}

        def shortened(hashes):
            return hashes >> np.uint64(cut)

        def known(p, shard, bits, k):
            """Whether each window of k words is known in the shard."""
            hashes, within = p.windows(k)
            within[within] = found(bits, per_shard(shortened(hashes[within]), shard))
            return within

        ones = kept(self._counted(plain, single, groups, added, "hash long, mark long, n long", met=True), "mined")
        known_ones = share(ones.filter("n = 0"), "mark")

        def double(r):
            p = view(r)
            each = mixed((p.lang + np.uint64(1)) * _B + p.own)
            one = found(known_ones.value, per_shard(each, r["shard"]))[np.maximum(p.codes, 1) - 1]
            hashes, within = p.windows(2)
            return distinct(shortened(hashes[within & one[:-1] & one[1:]]))

        twos = kept(self._counted(plain, double, groups, marked, "hash long, mark long", cut=cut), "mined")
        known_twos = share(twos, "mark")

        def longer(r):
            p, out = view(r), []
            two = known(p, r["shard"], known_twos.value, 2)
            for k in range(3, LONGEST + 1):
                hashes, within = p.windows(k)
                for j in range(k - 1):
                    within &= two[j : j + len(within)]
                out.append(hashes[within])
            return distinct(shortened(np.concatenate(out)))

        more = kept(self._counted(plain, longer, groups, marked, "hash long, mark long", cut=cut), "mined")
        united = share(twos.unionByName(more), "hash")

        def candidates(r):
            """Windows of two words and more that are frequent in some shard, as all shorter ones in them are."""
            p, out, within = view(r), [], None
            for k in range(2, LONGEST + 1):
                shorter = within
                hashes, within = p.windows(k)
                if k > 2:
                    within &= shorter[:-1] & shorter[1:]
                within[within] = found(united.value, shortened(hashes[within]))
                out.append(hashes[within])
            return distinct(np.concatenate(out))

        one_place = plain.withColumn("shard", F.lit(0))
        counted = self._counted(one_place, candidates, groups, exact, "hash long, n long, row long", place=True)
        alone = ones.filter("n > 0").select("hash", "n", F.lit(None).cast("long").alias("row"))
        return rows, kept(counted, "frequent").unionByName(alone)

    # scoring

    def _spelled(self, rows: DataFrame, often: DataFrame) -> DataFrame:
        """(lang, hash, k, a, phrase, parts) of frequent phrases of two words and more; parts are the hashes of all
        shorter windows in it."""
        where = often.filter("row is not null").groupBy("row").agg(F.collect_list(F.struct("hash", "n")).alias("places"))
        met = rows.select("row", "lang", F.xxhash64("lang").alias("lang_hash"), "words", "codes").join(where, "row")

        def spelled(lang, words, p, of, own):
            out = {c: [] for c in ("lang", "hash", "k", "a", "phrase", "parts")}
            for h, n, at, k in own:
                out["lang"].append(lang)
                out["hash"].append(h)
                out["k"].append(k)
                out["a"].append(n)
                out["phrase"].append(" ".join(words[c - 1] for c in p.codes[at : at + k]))
                parts = [(j, b) for j in range(1, k) for b in range(k - j + 1)]
                out["parts"].append([{"k": j, "at": b, "hash": int(of[j - 1][at + b])} for j, b in parts])
            return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

        def run(batches):
            for batch in batches:
                places = batch.column("places")
                for i, r in enumerate(each_row(batch.drop_columns(["places"]))):
                    words = loosened(r["words"]).decode().split("\n")
                    p = Phrases(r["lang_hash"], text_hashes(words), loosened(r["codes"]))
                    of, own = [p.windows(1)[0].view(np.int64)], []
                    wanted, n = (places[i].values.field(c).to_numpy() for c in ("hash", "n"))
                    order = np.argsort(wanted)
                    wanted, n = wanted[order], n[order]
                    for k in range(2, LONGEST + 1):
                        hashes, within = p.windows(k)
                        of.append(hashes.view(np.int64))
                        at = np.flatnonzero(within)
                        which = np.minimum(np.searchsorted(wanted, of[-1][at]), len(wanted) - 1)
                        at, which = (x[wanted[which] == of[-1][at]] for x in (at, which))
                        which, first = np.unique(which, return_index=True)
                        own += zip(wanted[which].tolist(), n[which].tolist(), at[first].tolist(), [k] * len(which))
                    for j in range(0, len(own), SPELLED):
                        yield spelled(r["lang"], words, p, of, own[j : j + SPELLED])
            release()

        part = pa.struct([("k", pa.int32()), ("at", pa.int32()), ("hash", pa.int64())])
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(part))
        schema = "lang string, hash long, k int, a long, phrase string, parts array<struct<k:int,at:int,hash:long>>"
        return in_batches(met, run, schema)

    def top_phrases(self, docs: DataFrame) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score."""
        rows, often = self.frequent(docs)
        totals = rows.groupBy("lang").agg(F.sum("n_words").alias("n"))
        spelled = kept(self._spelled(rows, often), "spelled")
        parts = spelled.select("a", F.explode("parts").alias("p")).select("a", F.col("p.k").alias("pk"), F.col("p.hash").alias("part"))
        # drop what lies almost always in one longer candidate
        around = parts.filter("pk > 1").groupBy("part").agg(F.max("a").alias("longer"))
        left = spelled.join(around.withColumnRenamed("part", "hash"), "hash", "left")
        inside = F.lit(100) * F.col("longer").cast("decimal(20,0)") >= F.lit(self.absorbed) * F.col("a").cast("decimal(20,0)")
        left = left.filter(~F.coalesce(inside, F.lit(False))).select("lang", "hash", "k", "a", "phrase", "parts")
        # each cut is a window from the first word on, and the one that goes on to the last
        of = lambda at, k: F.expr(f"filter(parts, p -> p.at = {at} and p.k = {k})[0].hash")
        cuts = left.select("hash", "k", "a", "parts", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
        cuts = cuts.select("hash", "a", "cut", of("0", "cut").alias("first"), of("cut", "k - cut").alias("rest"))
        count = often.select("hash", "n")
        for side, as_ in (("first", "l"), ("rest", "r")):
            cuts = cuts.join(count.toDF(side, as_), side)
        score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
        cuts = cuts.withColumn("score", score.cast("long"))
        lowest = cuts.groupBy("hash").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
        scored = left.select("lang", "hash", "a", "phrase").join(lowest, "hash")
        scored = scored.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.top)
        out = ranked.join(totals, "lang").withColumn("rank", F.col("rank").cast("long"))
        return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
