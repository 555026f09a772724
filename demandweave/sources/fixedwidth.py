"""Fixed-width binary files (dBase layout) through Arrow file systems: headers and ranges of records are read by
position, so no task holds a whole file, no record is shuffled and a file may be of any size. The writer lays
part files of the same layout, one folder per month.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import require_columns
from ..session import ship_package

#: Schemes that Arrow opens by their own name; others are read through Spark unless asked for.
ARROW_SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs")
#: What a header may take at most: 32 bytes, and 32 for each of the format's 255 fields.
HEADER_BYTES = 32 * 257
#: Bytes of records in a written part file, which a task holds before it writes them.
PART_BYTES = 64 << 20
HEADER = ("month string, path string, length long, records long, header int, record int, "
          "fields array<struct<name:string,kind:string,at:int,width:int>>")


def scheme(spark: SparkSession, path: str) -> str:
    """Scheme of the file system that serves a path, the default one where the path names none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).getUri().getScheme()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).makeQualified(p).toString()


def open_system(path: str):
    """(Arrow file system, path within it) of a qualified path."""
    from urllib.parse import quote

    from pyarrow import fs

    name, colon, rest = path.partition(":")
    if not colon or name == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(("s3:" if name in ("s3a", "s3n") else name + ":") + quote(rest, safe="/@:"))


# ---------------------------------------------------------------- reading

def parse_sizes(raw: bytes) -> tuple[int, int, int]:
    """Record count, header size, record size."""
    return struct.unpack("<IHH", raw[4:12])


def parse_fields(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, offset in the record, width) of each column; byte 0 of a record marks deletion."""
    out, at, offset = [], 32, 1
    while at + 32 <= len(raw) and raw[at] != 0x0D:
        width = raw[at + 16]
        out.append((raw[at:at + 11].split(b"\0")[0].decode("ascii"), chr(raw[at + 11]), offset, width))
        at, offset = at + 32, offset + width
    return out


def headers(files: DataFrame) -> DataFrame:
    """(month, path, length, records, header, record, fields) of (month, path, length): the first bytes of each
    file are read where its row is. A file cut short has as many records as it holds whole."""

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(T._parse_datatype_string(HEADER))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                system, path = open_system(row["path"])
                with system.open_input_file(path) as f:
                    raw = f.read(HEADER_BYTES)
                if len(raw) < 32:
                    raise ValueError(f"{row['path']} has no header")
                records, header, record = parse_sizes(raw)
                held = max(0, row["length"] - header) // record if record else 0
                names = ("name", "kind", "at", "width")
                rows.append(row | {"records": min(records, held), "header": header, "record": record,
                                   "fields": [dict(zip(names, f)) for f in parse_fields(raw[:header])]})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    ship_package(files.sparkSession)
    return files.select("month", "path", "length").mapInArrow(read, HEADER)


def read_ranges(heads: DataFrame, decode, schema: T.StructType, range_bytes: int, tasks: int) -> DataFrame:
    """Rows of all files. ``decode(raw, row)`` makes a record batch of an array (records, record size) of bytes.

    The rows dealt to the tasks name ranges, they do not hold them; a task reads one range of about ``range_bytes`` at a
    time. Positions are 64 bits wide.
    """
    per_range = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.col("record")))
    ranges = heads.where("records > 0").withColumn("first", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("records") - 1, per_range))).select(
        "month", "path", "record", "fields",
        (F.col("header").cast("long") + F.col("first") * F.col("record")).alias("at"),
        F.least(per_range, F.col("records") - F.col("first")).alias("count"))

    def read(batches):
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_system(row["path"])
                size = row["count"] * row["record"]
                with system.open_input_file(path) as f:
                    raw = f.read_at(size, row["at"])
                if len(raw) < size:
                    raise ValueError(f"{row['path']} became shorter while it was read")
                yield decode(np.frombuffer(raw, np.uint8).reshape(-1, row["record"]), row)

    ship_package(heads.sparkSession)
    return ranges.repartition(tasks).mapInArrow(read, schema)


# ---------------------------------------------------------------- writing

_KIND = {"string": "C", "date": "D", "boolean": "L"}
_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")
_NUMBER_WIDTH = 24


def layout(df: DataFrame, widths: dict[str, int] | None = None) -> list[tuple[str, str, int]]:
    """(name, type, width) of each column but SOURCE_MONTH. Text widths that the caller does not give are the
    longest values, found in one pass that returns one row; the format ends at 255 bytes and 10 letters a name."""
    widths, out = dict(widths or {}), []
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != "SOURCE_MONTH"]
    missing = [c for c in text if c not in widths]
    if missing:
        found = df.agg(*[F.max(F.length(c)).alias(c) for c in missing]).first()
        widths |= {c: max(1, found[c] or 1) for c in missing}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if f.name == "SOURCE_MONTH":
            continue
        if kind not in _KIND and kind not in _NUMBERS:
            raise ValueError(f"{f.name}: the layout has no type for {kind}")
        width = {"date": 8, "boolean": 1, "string": widths.get(f.name)}.get(kind, _NUMBER_WIDTH)
        if not f.name.isascii() or len(f.name) > 10 or width > 255:
            raise ValueError(f"{f.name}: names end at 10 ASCII letters, values at 255 bytes")
        out.append((f.name, _KIND.get(kind, "N"), width))
    return out


def header_bytes(fields: list[tuple[str, str, int]], records: int) -> bytes:
    size, record = 32 + 32 * len(fields) + 1, 1 + sum(w for _, _, w in fields)
    out = bytes([3, 0, 1, 1]) + struct.pack("<IHH", records, size, record) + bytes(20)
    for name, kind, width in fields:
        out += name.encode("ascii").ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([width, 0]) + bytes(14)
    return out + b"\r"


def _cells(values, kind: str, width: int) -> list[bytes]:
    """Values of a column as bytes of the column's width, missing ones blank."""
    if kind == "D":
        text = ["" if v is None else v.strftime("%Y%m%d").rjust(8, "0") for v in values]
    elif kind == "L":
        text = ["" if v is None else "T" if v else "F" for v in values]
    elif kind == "N":
        text = ["" if v is None else str(v).rjust(width) for v in values]
    else:
        text = ["" if v is None else v for v in values]
    out = [t.encode("latin-1").ljust(width) for t in text]
    wide = next((t for t, b in zip(text, out) if len(b) > width), None)
    if wide is not None:
        raise ValueError(f"{wide!r} is wider than {width} bytes")
    return out


def write_binary_table(df: DataFrame, root: str, table_file: str, widths: dict[str, int] | None = None,
                       deleted: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write <root>/<SOURCE_MONTH>/<table_file>/part-*: rows of a month may lie in any task, each of which writes
    its own parts of at most ``part_bytes``. Returns (SOURCE_MONTH, files, records).

    ``deleted`` names a boolean column that marks records instead of being written. A part gets its name only when
    it is whole, and the name depends on the task alone, so a task that runs again replaces its parts. Null
    months, and values that the layout cannot hold, are errors.
    """
    spark = df.sparkSession
    require_columns(df, ["SOURCE_MONTH", *([deleted] if deleted else [])])
    fields = layout(df.drop(deleted) if deleted else df, widths)
    record = 1 + sum(w for _, _, w in fields)
    target = qualified(spark, root)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, parts, month, held, number = TaskContext.get().partitionId(), [], None, [], 0
        system, base = open_system(target)

        def flush():
            nonlocal held, number
            folder = f"{base}/{month}/{table_file}"
            system.create_dir(folder, recursive=True)
            hidden = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                f.write(header_bytes(fields, len(held)))
                f.write(b"".join(held))
            system.move(hidden, f"{folder}/part-{task:06d}-{number:05d}")
            parts.append({"SOURCE_MONTH": month, "records": len(held)})
            held, number = [], number + 1

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            marks = [b"*" if m else b" " for m in columns[deleted]] if deleted else [b" "] * batch.num_rows
            cells = [_cells(columns[n], k, w) for n, k, w in fields]
            for m, *row in zip(columns["SOURCE_MONTH"], marks, *cells):
                if m is None:
                    raise ValueError("a row has no SOURCE_MONTH")
                if held and (m != month or len(held) * record >= part_bytes):
                    flush()
                month = m
                held.append(b"".join(row))
        if held:
            flush()
        yield pa.RecordBatch.from_pylist(parts, schema=pa.schema([("SOURCE_MONTH", pa.string()), ("records", pa.int64())]))

    ship_package(spark)
    done = df.sortWithinPartitions("SOURCE_MONTH").mapInArrow(write, "SOURCE_MONTH string, records long").collect()
    return spark.createDataFrame([tuple(r) for r in done], "SOURCE_MONTH string, records long").groupBy(
        "SOURCE_MONTH").agg(F.count("*").alias("files"), F.sum("records").alias("records"))
