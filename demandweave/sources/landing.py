"""Monthly landing folders: <root>/<MONTH>/<TABLE>.<ext>, one folder per snapshot month.

Months may differ: a table has every column that any of its months has, null where a month lacks it, and a
column whose type differs between months is read as text. Fixed-width binary files (dBase layout) are cut into
ranges of records, so one large file keeps many tasks busy, and a range is decoded column by column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.cleaning import source_month_date
from ..session import ship_package
from . import fixedwidth
from .fixedwidth import HEADER_BYTES, parse_fields, parse_sizes

#: Month folder and file (or folder) of a landed path; part files belong to the folder above them.
_PATH = r"([^/]+)/([^/]+?)(?:/[^/]*part-[^/]*)?$"
#: Bytes of records that one task decodes at a time.
RANGE_BYTES = 16 << 20
#: Bytes of records that one task is dealt, a range at a time.
TASK_BYTES = 8 * RANGE_BYTES

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_KINDS = {"N": "double", "F": "double", "D": "date", "L": "boolean"}


def file_name(table: str, fmt: str) -> str:
    """Name under which a format lands a table."""
    return f"{table}.{S.LANDING_EXTENSIONS[fmt]}"


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def months(spark: SparkSession, root: str) -> list[str]:
    """Month folders, oldest first; an empty folder counts."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = [f.getPath().getName() for f in path.getFileSystem(conf).listStatus(path) if f.isDirectory()]
    if not found:
        return []
    dated = spark.createDataFrame([(m,) for m in found], "month string")
    return [r[0] for r in dated.orderBy(source_month_date(F.col("month")).asc_nulls_last(), "month").collect()]


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(month, file, size_bytes) of every landed file; no content is read, part files count for their folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_extract("path", _PATH, 1).alias("month"),
        F.regexp_extract("path", _PATH, 2).alias("file"), F.col("length").alias("size_bytes")
    ).where(~F.col("file").startswith("_") & ~F.col("file").startswith(".")).groupBy("month", "file").agg(
        F.sum("size_bytes").alias("size_bytes"))


# ---------------------------------------------------------------- self-describing formats

def _month_frame(spark, root: str, month: str, table: str, fmt: str, **options) -> DataFrame:
    """One table of one month, columns found by name in its own files."""
    if fmt == "csv":
        options = {"header": True, "inferSchema": True} | options
    path = f"{root}/{month}/{{{table},{file_name(table, fmt)}}}"
    return spark.read.options(**options).format(fmt).load(path).withColumn("SOURCE_MONTH", F.lit(month))


def union_months(frames: list[DataFrame]) -> DataFrame:
    """All rows and all columns; SOURCE_MONTH last. Types that differ between frames meet as text."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    names = [c for c in kinds if c != "SOURCE_MONTH"] + ["SOURCE_MONTH"]
    mixed = [c for c in names if len(kinds[c]) > 1]
    alike = [df.withColumns({c: F.col(c).cast("string") for c in mixed if c in df.columns}) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike).select(*names)


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet",
               schema: T.StructType | None = None, **options) -> DataFrame:
    """One landed table over all months, tagged with SOURCE_MONTH from the path.

    Columns are bound by name. With ``schema`` all months are one scan; without it every month is read by
    its own header or footer.
    """
    if fmt == "binary":
        return read_binary_table(spark, root, table, schema, **options)
    if schema is not None and fmt != "csv":
        path = f"{root}/*/{{{table},{file_name(table, fmt)}}}"
        df = spark.read.options(**options).schema(schema).format(fmt).load(path)
        return df.withColumn("SOURCE_MONTH", F.regexp_extract(F.col("_metadata.file_path"), _PATH, 1))
    frames = []
    for m in months(spark, root):
        try:
            frames.append(_month_frame(spark, root, m, table, fmt, **options))
        except AnalysisException as e:
            if not _missing(e):
                raise
    if not frames:
        raise FileNotFoundError(f"no landed file of {table} under {root}")
    df = union_months(frames)
    if schema is not None:
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schema.fields], "SOURCE_MONTH")
    return df


def read_month(spark: SparkSession, root: str, month: str, tables: list[str] | None = None,
               fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """All required tables of one month; a missing one is an error."""
    out = {}
    for t in tables or S.LANDING_TABLES:
        if fmt == "binary":
            out[t] = read_binary_table(spark, root, t, month=month, **options)
            continue
        try:
            out[t] = _month_frame(spark, root, month, t, fmt, **options)
        except AnalysisException as e:
            if _missing(e):
                raise FileNotFoundError(f"no landed file of {t} in {month}") from e
            raise
    return out


def read_all_months(spark: SparkSession, root: str, tables: list[str] | None = None,
                    fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Every table over every month, lazily."""
    return {t: read_table(spark, root, t, fmt, **options) for t in tables or S.LANDING_TABLES}


def run_extract(spark: SparkSession, root: str, tables: list[str] | None = None,
                fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Configured tables of all months."""
    return read_all_months(spark, root, tables, fmt, **options)


def landed_columns(spark: SparkSession, root: str, tables: list[str] | None = None,
                   fmt: str = "parquet") -> DataFrame:
    """(table, month, position, column, dtype) of every landed file, from headers and footers alone."""
    tables = tables or S.LANDING_TABLES
    if fmt == "binary":
        heads = [_headers(spark, root, t).withColumn("table", F.lit(t)) for t in tables]
        kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
        cells = reduce(DataFrame.unionByName, heads).select(
            "table", "month", F.posexplode("fields").alias("position", "f"))
        return cells.select("table", "month", "position", F.col("f.name").alias("column"),
                            F.coalesce(kinds[F.col("f.kind")], F.lit("string")).alias("dtype"))
    rows = []
    for m in months(spark, root):
        for t in tables:
            try:
                found = _month_frame(spark, root, m, t, fmt).drop("SOURCE_MONTH").dtypes
            except AnalysisException as e:
                if not _missing(e):
                    raise
                continue
            rows += [(t, m, i, name, kind) for i, (name, kind) in enumerate(found)]
    return spark.createDataFrame(rows, "table string, month string, position int, column string, dtype string")


# ---------------------------------------------------------------- fixed-width binary tables

def _files(spark: SparkSession, root: str, table: str, month: str = "*") -> DataFrame:
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{month}/{file_name(table, 'binary')}")
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no landed file of {table} under {root}/{month}") from e
        raise
    return files.select(F.regexp_extract("path", _PATH, 1).alias("month"), "path", "length", "content")


def _headers(spark: SparkSession, root: str, table: str, month: str = "*", seek: bool | None = None) -> DataFrame:
    """(month, path, length, records, header, record, fields) of every file, parsed where the file is read."""
    if _seekable(spark, root, seek):
        return fixedwidth.headers(_files(spark, root, table, month))
    head = _files(spark, root, table, month).select(
        "month", "path", "length", F.expr(f"substring(content, 1, {HEADER_BYTES})").alias("content"))
    parsed = F.udf(lambda raw: parse_fields(bytes(raw)), "array<struct<name:string,kind:string,at:int,width:int>>", useArrow=False)
    ship_package(spark)
    counts = F.udf(lambda raw: parse_sizes(bytes(raw)), "struct<records:long,header:int,record:int>", useArrow=False)
    return head.select("month", "path", "length", counts("content").alias("s"), parsed("content").alias("fields")).select(
        "month", "path", "length", "s.*", "fields")


def _seekable(spark: SparkSession, root: str, seek: bool | None) -> bool:
    return fixedwidth.scheme(spark, root) in fixedwidth.ARROW_SCHEMES if seek is None else seek


def binary_schema(spark: SparkSession, root: str, table: str, month: str = "*", seek: bool | None = None) -> T.StructType:
    """Columns of one table over its files: the union of all headers, oldest month first. Headers are read on
    the executors; one row per distinct column and type comes back."""
    heads = _headers(spark, root, table, month, seek)
    cells = heads.select(source_month_date(F.col("month")).alias("day"), "month",
                         F.posexplode("fields").alias("position", "f"))
    rows = cells.groupBy("f.name", "f.kind").agg(
        F.min(F.struct(F.col("day").isNull(), "day", "month", "position")).alias("first")
    ).orderBy("first").collect()
    kinds: dict[str, set[str]] = {}
    for r in rows:
        kinds.setdefault(r["name"], set()).add(_KINDS.get(r["kind"], "string"))
    return T.StructType([T.StructField(n, T._parse_datatype_string(k.pop() if len(k) == 1 else "string"))
                         for n, k in ((n, set(k)) for n, k in kinds.items())])


def _column(raw, dtype: str):
    """One column of a range of records (an array of fixed-width byte strings) as Arrow."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if raw.dtype.itemsize and (raw.view(np.uint8) < 128).all():
        text = pa.array(raw.tolist(), pa.binary()).cast(pa.string())
    else:
        text = pa.array([b.decode("latin-1") for b in raw.tolist()], pa.string())
    text = pc.utf8_trim_whitespace(pc.replace_substring(text, "\0", ""))
    text = pc.if_else(pc.equal(pc.utf8_length(text), 0), None, text)
    if dtype == "double":
        return pc.if_else(pc.match_substring_regex(text, _NUMBER), text, None).cast(pa.float64())
    if dtype == "date":
        days = pc.if_else(pc.match_substring_regex(text, "^[0-9]{8}$"), text, None)
        return pc.strptime(days, format="%Y%m%d", unit="s", error_is_null=True).cast(pa.date32())
    if dtype == "boolean":
        upper = pc.utf8_upper(text)
        known = pc.is_in(upper, value_set=pa.array(["T", "Y", "F", "N"]))
        return pc.if_else(known, pc.is_in(upper, value_set=pa.array(["T", "Y"])), None)
    return text


def read_binary_table(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None,
                      month: str = "*", range_bytes: int = RANGE_BYTES, seek: bool | None = None) -> DataFrame:
    """Binary snapshots of one table. A column that a file lacks is null, deleted records are skipped, values
    that do not fit their declared type are null.

    Ranges of records are read by position through Arrow, so files of any size spread over the tasks. Where Arrow
    does not know the file system by its scheme, or with ``seek=False``, Spark's own reader brings each file into
    one task (2 GiB at most) and its ranges are dealt out from there.
    """
    by_position = _seekable(spark, root, seek)
    schema = schema or binary_schema(spark, root, table, month, by_position)
    wanted = {f.name: f.dataType.simpleString() for f in schema.fields}
    out_schema = T.StructType([*schema.fields, T.StructField("SOURCE_MONTH", T.StringType())])

    def decode(raw, row):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        raw = raw[raw[:, 0] != ord("*")]
        places = {f["name"]: f for f in row["fields"]}
        columns = []
        for name, dtype in wanted.items():
            f = places.get(name)
            if f is None or not f["width"]:
                columns.append(pa.nulls(len(raw)))
                continue
            cut = np.ascontiguousarray(raw[:, f["at"]:f["at"] + f["width"]])
            columns.append(_column(cut.view(f"S{f['width']}").reshape(-1), dtype))
        columns.append(pa.array([row["month"]] * len(raw), pa.string()))
        shape = to_arrow_schema(out_schema)
        return pa.RecordBatch.from_arrays(
            [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type)
             for c, f in zip(columns, shape)], schema=shape)

    heads = _headers(spark, root, table, month, by_position)
    least = spark.sparkContext.defaultParallelism
    if by_position:
        size = _files(spark, root, table, month).agg(F.sum("length")).first()[0] or 0
        tasks = max(least, -(-size // min(TASK_BYTES, 8 * range_bytes)))
        return fixedwidth.read_ranges(heads, decode, out_schema, range_bytes, min(tasks, 100_000))

    def decode_all(batches):
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                raw = np.frombuffer(row["records"], np.uint8)
                yield decode(raw[: len(raw) // row["record"] * row["record"]].reshape(-1, row["record"]), row)

    ship_package(spark)
    per_range = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.col("record")))
    ranges = _files(spark, root, table, month).join(F.broadcast(heads.drop("month", "length")), "path").withColumn(
        "first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("records") - 1, F.lit(0)), per_range)))
    start = (F.col("header") + F.col("first") * F.col("record") + 1).cast("int")
    size = (F.least(per_range, F.col("records") - F.col("first")) * F.col("record")).cast("int")
    cut = ranges.select("month", "record", "fields", F.substring("content", start, size).alias("records"))
    return cut.repartition(least).mapInArrow(decode_all, out_schema)
