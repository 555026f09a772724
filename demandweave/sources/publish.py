"""Versioned forecast store with a publish gate.

A run writes its own directory once. Promotion adds a one-row pointer beside the earlier ones, and readers take
the newest: a pointer appears when its write commits and nothing is replaced, so a reader always finds a whole
forecast. A run below the gate adds no pointer.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.quality import check_forecast_store
from ..operators.serving import repair_snapshot
from ..functions.guards import require_no_violations


def _one_row_json(spark: SparkSession, columns: dict, path: str) -> None:
    spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).coalesce(1).write.mode(
        "overwrite").json(path)


def write_run(forecast: DataFrame, requested: DataFrame, failed: DataFrame, root: str, run_id: str,
              min_success: float = S.PUBLISH_MIN_SUCCESS) -> dict:
    """Write a run, promote it if enough items succeeded, and return its manifest.

    Failed ids go to a table of their own: their number grows with the catalogue.
    """
    spark = forecast.sparkSession
    path = f"{root}/runs/run_id={run_id}"
    forecast.write.mode("overwrite").parquet(f"{path}/forecast")
    stored = spark.read.parquet(f"{path}/forecast").select("Medicine_ID").distinct()
    wanted = requested.select("Medicine_ID").distinct()
    lost = wanted.join(stored, "Medicine_ID", "left_anti").join(
        failed.select("Medicine_ID", "reason"), "Medicine_ID", "left").withColumn(
        "reason", F.coalesce("reason", F.lit("neither forecast nor reported as failed")))
    lost.write.mode("overwrite").parquet(f"{path}/failed")
    n, ok = wanted.count(), stored.join(wanted, "Medicine_ID", "left_semi").count()
    if n == 0:
        raise ValueError("no items requested")
    published = ok / n >= min_success
    note = (f"{ok}/{n} items succeeded ({ok / n:.1%}); "
            + ("published" if published else f"below the {min_success:.0%} gate, latest kept"))
    manifest = {"run_id": run_id, "medicines_requested": n, "medicines_succeeded": ok,
                "medicines_failed": n - ok, "output_path": f"{path}/forecast",
                "published": published, "publish_note": note}
    _one_row_json(spark, {**{k: F.lit(v) for k, v in manifest.items()},
                          "completed_at": F.current_timestamp()}, f"{path}/manifest")
    if published:
        _one_row_json(spark, {"run_id": F.lit(run_id), "path": F.lit(f"{path}/forecast"),
                              "promoted_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")},
                      f"{root}/pointers/{uuid.uuid4().hex}")
    return manifest


def latest_forecast(spark: SparkSession, root: str, check: bool = True) -> DataFrame | None:
    """Published snapshot with repaired columns, or None before the first promotion."""
    try:
        pointers = spark.read.schema("run_id string, path string, promoted_at string").json(f"{root}/pointers/*")
        pointer = pointers.orderBy(F.desc("promoted_at"), F.desc("run_id")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if pointer is None:
        return None
    df = repair_snapshot(spark.read.parquet(pointer["path"]))
    if check:
        require_no_violations(check_forecast_store(df), "forecast store")
    return df


def save_documents(df: DataFrame, path: str) -> None:
    """Alerts, evaluations: one JSON document per row."""
    df.write.mode("overwrite").json(path)


def load_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored documents, or an empty set where none were written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
