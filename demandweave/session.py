"""Session helpers shared by tests, bench and plans."""

from __future__ import annotations

import atexit
import contextlib
import io
import pathlib
import sys
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "demandweave") -> SparkSession:
    """Session for tests and benches; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """Shared folder for tables stored on the way: the one the cluster names in spark.checkpoint.dir, or
    one below the warehouse where none is set. Never a folder of one machine's own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def stored(df: DataFrame, hint: str = "table") -> DataFrame:
    """The same rows, written as Parquet in the work folder and read back: lineage ends here, columns stay
    prunable, statistics are real, and the loss of executors costs nothing. Removed when the program ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{hint}-{uuid.uuid4().hex}"
    remember(spark, path)  # before the write: a part of it may be left when it fails
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Writes begun inside leave no shuffle files behind: they go when the write is over, not when the driver's heap
    happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch_schema(spark: SparkSession, hint: str) -> str:
    """A new catalog schema whose folder is removed when the program ends."""
    name = f"{hint}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    remember(spark, spark.catalog.getDatabase(name).locationUri)
    return name


_stored: list[tuple[SparkSession, str]] = []


def remember(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the program ends."""
    if not _stored:
        atexit.register(remove_stored)
    _stored.append((spark, path))


def remove_stored() -> None:
    """Delete what ``stored`` has written so far in this program."""
    while _stored:
        spark, path = _stored.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package: a small archive in the work folder, added once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, packed = pathlib.Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = f"{work_folder(spark)}/package-{uuid.uuid4().hex}/{root.name}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    remember(spark, path.rpartition("/")[0])


_shipped: set[str] = set()


def ship_by_value() -> None:
    """Make this package's Python functions travel inside the task instead of by module name, so
    workers need no copy of the package on their path."""
    from pyspark.cloudpickle import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def cut_lineage(df: DataFrame) -> DataFrame:
    """A stored copy: survives the loss of executors, unlike cached or local blocks."""
    return stored(df, "cut")
