"""Documents of many runs: evaluations, alerts and the like, whose fields may change from run to run.

A run is a folder of Parquet files with one VARIANT column, so fields keep their types, new ones need no change of
what is stored, and a reader names the fields it wants. A run that is written again replaces itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class DocumentStore:
    """Documents of one kind below ``root``, a folder per run. Runs are ordered by name, so names that sort by time
    make the last one the latest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, run: str) -> None:
        """Store the rows as documents of one run. A run without rows is a run: it has no documents."""
        if not _RUN.fullmatch(run):
            raise ValueError(f"{run!r} is no run name: letters, digits, '_', '.' and '-'")
        document = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        df.select(document.alias("document")).write.mode("overwrite").parquet(f"{self.root}/run={run}")

    def runs(self) -> list[str]:
        """Names of the runs that were written to the end, in order."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(conf)
        if not system.exists(path):
            return []
        done = [f.getPath() for f in system.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith("run=")]
        return sorted(p.getName()[4:] for p in done if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def documents(self, runs: list[str] | None = None) -> DataFrame:
        """(run, document) of the named runs, of all when none are named. Other runs' files are not listed."""
        known = self.runs()
        missing = sorted(set(runs or ()) - set(known))
        if missing:
            raise FileNotFoundError(f"no run {missing} under {self.root}")
        wanted = known if runs is None else runs
        schema = T.StructType().add("document", T.VariantType()).add("run", T.StringType())
        if not wanted:
            empty = self.spark.range(0)
            return empty.select(F.lit("").alias("run"), F.to_variant_object(F.struct("id")).alias("document"))
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(
            *[f"{self.root}/run={r}" for r in wanted]).select("run", "document")

    def load(self, schema: str | T.StructType, runs: list[str] | None = None, strict: bool = False) -> DataFrame:
        """The named fields as columns, after ``run``. A field that a document lacks is null; one whose value does not
        fit the type is null too, or an error with ``strict``."""
        fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
        get = F.variant_get if strict else F.try_variant_get
        return self.documents(runs).select("run", *[
            get("document", f'$["{f.name}"]', f.dataType.simpleString()).alias(f.name) for f in fields])

    def latest(self, schema: str | T.StructType) -> DataFrame:
        """The documents of the last run; no rows where nothing was written yet."""
        return self.load(schema, self.runs()[-1:])

    def fields(self, runs: list[str] | None = None) -> DataFrame:
        """(run, schema): the fields of each run's documents and their types, met over all its documents."""
        return self.documents(runs).groupBy("run").agg(F.schema_of_variant_agg("document").alias("schema"))
