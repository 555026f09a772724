"""WARC archives, and one index over all captures by an external merge.

Pages become WARC records. A task orders its captures by URL key and time and packs them into archives of a
bounded size, so that every archive is a sorted run. Reading parses the archives by their lengths and hashes
the payloads found. The runs' index lines are then dealt out by ranges of (URL key, time, id), bounded in rows
whatever one host holds and however long the table, and a loser tree merges the runs of each range with the keys
of one small batch per run in memory: partitions in order are the global capture history.

Of records with equal payloads of LEAST_SHARED bytes or more, the one with the smallest id is the response and
the others are revisits without payload, which keep its digest and length. Copies are found from digests
alone, counted before the shuffle; payloads are never shuffled by digest unless the list of shared
digests is too long for Spark to broadcast.

Defined cases: null html is an empty payload; null url an empty target. Line breaks in a URL are escaped in its
header. Equal rows with equal ids: one of them is the response. A null id counts as the largest, and its
record is written without one. Tables may be empty. Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from demandweave.session import remember, stored, work_folder

from .url_filters import url_parts
from .words import in_batches

LEAST_SHARED = 100
#: An archive is closed at about so many bytes; a larger record has one to itself.
ARCHIVE_BYTES = 16 << 20
#: Index lines that one task merges, about; a line takes about 300 bytes.
RANGE_LINES = 200_000
#: Lines of a run whose keys are decoded at a time.
CURSOR_LINES = 64
INDEX = (
    "page_id long, urlkey string, captured string, archive string, offset long, length long,"
    " payload_bytes long, payload_digest string, record_type string, refers_to long"
)
KEYS = ("urlkey", "captured", "page_id")


def url_key(url) -> F.Column:
    """Host labels from the top, then the path: captures of a site, and of a page, lie side by side."""
    host, path = url_parts(url)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def one_line(url) -> F.Column:
    """The URL with line breaks escaped, as header fields need it."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def utc(when) -> F.Column:
    """A point in time as a WARC date, whatever the session's time zone."""
    seconds = F.unix_seconds(when)
    day, rest = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    parts = [F.lpad(x.cast("string"), 2, "0") for x in (F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)]
    return F.concat(day.cast("string"), F.lit("T"), F.concat_ws(":", *parts), F.lit("Z"))


def shared_digests(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(digest, first_id, n_first) of payloads that several records carry: the smallest id and its rows."""
    body = F.coalesce(F.col(html), F.lit(""))
    ids = pages.filter(F.octet_length(body) >= LEAST_SHARED).select(
        F.sha2(body, 256).alias("digest"), F.col(page_id).cast("long").alias("id")
    )
    counted = ids.groupBy("digest", "id").count()
    first = F.min(F.struct(F.col("id").isNull(), "id", "count"))  # nulls last
    found = counted.groupBy("digest").agg(first.alias("first"), F.sum("count").alias("n")).filter("n > 1")
    return found.select("digest", F.col("first.id").alias("first_id"), F.col("first.count").alias("n_first"))


def captures(pages: DataFrame, page_id="page_id", url="url", html="html", captured=None) -> DataFrame:
    """One row per record to write, revisits told from responses."""
    body = F.coalesce(F.col(html), F.lit(""))
    when = captured if captured is not None else F.timestamp_seconds(F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(10**9)))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.coalesce(one_line(F.col(url)), F.lit("")).alias("target"),
        F.coalesce(url_key(one_line(F.col(url))), F.lit("")).alias("urlkey"),
        utc(when).alias("captured"),
        body.alias("html"),
        F.sha2(body, 256).alias("digest"),
    )
    first = stored(shared_digests(pages, page_id, html), "digests")
    rows = rows.join(first, "digest", "left")
    # several rows may bear the first id: one of them is the response, so those alone are numbered
    first_row = F.col("page_id").eqNullSafe(F.col("first_id"))
    alone = rows.filter(F.col("n_first").isNull() | (F.col("n_first") == 1) | ~first_row)
    number = F.row_number().over(Window.partitionBy("digest").orderBy("urlkey", "captured"))
    several = rows.filter((F.col("n_first") > 1) & first_row).withColumn("revisit", number > 1)
    return alone.withColumn("revisit", F.col("n_first").isNotNull() & ~first_row).unionByName(several)


def record(row: dict) -> bytes:
    """A WARC record, without the line break that ends it."""
    kind = "revisit" if row["revisit"] else "response"
    name = lambda kind, i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind}/{i}/{row["digest"]}')}>"
    payload = row["html"].encode()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    head += [f"WARC-Record-ID: {name(kind, row['page_id'])}", f"WARC-Date: {row['captured']}", f"WARC-Target-URI: {row['target']}"]
    head += [f"WARC-Payload-Digest: sha256:{row['digest']}", f"URL-Key: {row['urlkey']}"]
    if row["page_id"] is not None:
        head.append(f"Page-ID: {row['page_id']}")
    if row["revisit"]:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {name('response', row['first_id'])}", f"Refers-To-Page-ID: {row['first_id']}"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n"


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Sorted runs of ``captures`` rows as WARC files below ``path``, through Spark's own writer."""

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                one = record(row)
                if parts and size + len(one) > archive_bytes:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([b"\r\n".join(parts)]).cast(pa.string())})
                    parts, size = [], 0
                parts.append(one)
                size += len(one) + 2
        if parts:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"\r\n".join(parts)]).cast(pa.string())})

    runs = in_batches(rows.sortWithinPartitions(*KEYS), run, "value string")
    # a row is a whole archive and the line separator ends its last record
    runs.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes):
    """(offset, length, headers, payload) of each record; a record's end follows from its length alone."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        head = dict(h.split(": ", 1) for h in data[at : head_end - 4].decode().split("\r\n")[1:])
        end = head_end + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", head_end) + 4
        head["payload"] = int(re.search(rb"Content-Length: (\d+)", data[head_end:body])[1])
        yield at, end + 4 - at, head, data[body:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index line per record found in the archives below ``path``, in the order of each archive."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = []
                for offset, length, head, payload in parse(data.as_py()):
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                    number = lambda k: int(head[k]) if k in head and head[k] != "None" else None
                    lines.append(
                        (number("Page-ID"), head["URL-Key"], head["WARC-Date"], file, offset, length)
                        + (head["payload"], digest, head["WARC-Type"], number("Refers-To-Page-ID"))
                    )
                cols = list(zip(*lines)) or [()] * len(names)
                kinds = [pa.int64() if " long" in c else pa.string() for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, cols, kinds)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return in_batches(files, run, INDEX)


def loser_merge(runs: list, key):
    """Rows of sorted runs in one order: each inner node of a tree keeps the loser of its match, so a new row
    plays only the losers on its way up."""
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else [])
        return
    last = (1,)  # after every key, which begins with 0
    heads = [iter(run) for run in runs]
    rows = [next(h, None) for h in heads]
    keys = [last if r is None else (0, *key(r)) for r in rows]
    losers = [-1] * k

    def play(i):
        node = (i + k) // 2
        while node:
            other = losers[node]
            if other < 0:  # the first to arrive waits for its match
                losers[node] = i
                return -1
            if keys[other] < keys[i]:
                losers[node], i = i, other
            node //= 2
        return i

    winner = -1
    for i in range(k):
        winner = max(winner, play(i))
    while keys[winner] != last:
        yield rows[winner]
        rows[winner] = next(heads[winner], None)
        keys[winner] = last if rows[winner] is None else (0, *key(rows[winner]))
        winner = play(winner)


def merge_index(index: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """All index lines in global order of URL key, time and id.

    ``index`` is counted first, so pass a stored one: the ranges' number follows from its rows, and a range has about
    ``range_lines`` of them however large the table. Spark's sorter, which spills, brings a range run by run. The lines
    stay in Arrow columns; the tree holds the keys of one small batch per run and gives the lines' places in order.
    """
    schema, lines_schema = index.schema, to_arrow_schema(index.schema)

    def run(batches):
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts, lines_schema)
        order = loser_merge(list(run_cursors(table)), lambda row: row[0])
        while places := [place for _, place in itertools.islice(order, 10_000)]:
            yield from table.take(places).to_batches()

    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // range_lines))
    dealt = index.repartitionByRange(parts, *KEYS).sortWithinPartitions("archive", "offset")
    return in_batches(dealt, run, schema)


def run_cursors(table: pa.Table, batch: int = CURSOR_LINES):
    """For each run of a range, lines of an archive side by side, an iterator of (key, place in the table) that
    decodes the keys of ``batch`` lines at a time."""
    names = pc.run_end_encode(table.column("archive"))
    ends, at = [], 0
    for chunk in names.chunks:
        ends += (np.asarray(chunk.run_ends) + at).tolist()
        at = ends[-1] if ends else 0
    keys = table.select(list(KEYS))

    def cursor(begin, end):
        for at in range(begin, end, batch):
            rows = keys.slice(at, min(batch, end - at))
            for i, (site, when, page) in enumerate(zip(*(c.to_pylist() for c in rows.columns)), at):
                yield (site, when, page is None, page or 0), i

    # a run that goes on in the table's next chunk is cut there: its parts are sorted runs as well
    yield from (cursor(a, b) for a, b in itertools.pairwise([0, *ends]))


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as WARC archives below ``path`` (default: a new folder in the work folder), read them
    back, and return the merged index of all captures. A folder of its own goes when the program ends."""
    spark = pages.sparkSession
    if path is None:
        path = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
        remember(spark, path)
    write_archives(captures(pages, **columns), path)
    return merge_index(stored(read_archives(spark, path), "index"))
