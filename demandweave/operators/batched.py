"""Quantile models that forecast many items in one call.

Spark packs every item's context into one row, tasks hand their items to the model in batches, and what the model
returns is checked item by item. A failing batch is halved until the failing items stand alone, so k bad items in a
batch of n cost about 2 k log2(n) calls and take no other item with them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ship_by_value
from .forecast import _quantile_names, monotone_quantiles

BATCH_ITEMS = 256


class Batch(NamedTuple):
    """What a model is called with: ids, one dense array of daily demand each, and the last day of each."""

    items: list
    values: list
    last_days: object  # numpy datetime64[D], one per item


def pack_contexts(history: DataFrame, context: int = S.CONTEXT_LENGTH, tasks: int | None = None) -> DataFrame:
    """(MDCODE, days, last, ages, quantities): one row per item, the days with a row among its last ``context``.

    Two rows of a day add up and a null quantity counts as none. Windows and grouping share one shuffle; a packed
    row is bounded by ``context``. ``tasks`` deals the items anew, for models that are slow next to their input.
    """
    w = W.partitionBy("MDCODE")
    tail = history.select(F.col("MDCODE").cast("string").alias("MDCODE"), "INVDT", F.coalesce(
        F.col("Demand_Qty").cast("double"), F.lit(0.0)).alias("q")).withColumns(
        {"first": F.min("INVDT").over(w), "last": F.max("INVDT").over(w)}).withColumn(
        "age", F.datediff("last", "INVDT")).where(F.col("age") < context)
    packed = tail.groupBy("MDCODE").agg(
        (F.datediff(F.max("last"), F.max("first")) + 1).alias("days"), F.max("last").alias("last"),
        F.array_sort(F.collect_list(F.struct("age", "q"))).alias("rows")).select(
        "MDCODE", "days", "last", F.col("rows.age").alias("ages"), F.col("rows.q").alias("quantities"))
    return packed.repartition(tasks, "MDCODE") if tasks else packed


def dense(batch, context: int):
    """(sizes, starts, values) of packed rows: all contexts in one array, zeros where a day has no row."""
    import numpy as np

    sizes = np.minimum(batch.column("days").to_numpy(zero_copy_only=False), context).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ages = batch.column("ages")
    counts = np.diff(ages.offsets.to_numpy())
    # flatten() heeds the offsets of a sliced batch
    at = np.repeat(starts[1:] - 1, counts) - ages.flatten().to_numpy(zero_copy_only=False)
    values = np.zeros(starts[-1])
    np.add.at(values, at, batch.column("quantities").flatten().to_numpy(zero_copy_only=False))
    return sizes, starts, values


def output_fault(dates, quantiles, horizon: int, levels: int) -> str | None:
    """Why one item's raw output cannot be used, if it cannot. Levels out of order are no fault: they are repaired."""
    import numpy as np

    if quantiles.shape != (horizon, levels) or dates.shape != (horizon,):
        return f"{dates.shape[0] if dates.ndim else 0} dates and values of shape {quantiles.shape}, expected {(horizon, levels)}"
    if np.isnat(dates).any():
        return "invalid dates"
    steps = np.diff(dates.astype("datetime64[D]").astype(np.int64))
    if (steps == 0).any() or len(np.unique(dates)) < horizon:
        return "dates occur twice"
    if (steps < 0).any():
        return "dates are not sorted"
    if not np.isfinite(quantiles).all():
        return "values are not finite"
    if (quantiles < 0).any():
        return "values are negative"
    return None


def isolate(call: Callable, batch: Batch) -> list:
    """The call's result per item, or the exception that the item raises when it is alone."""
    try:
        out = list(call(batch))
        if len(out) != len(batch.items):
            raise ValueError(f"{len(out)} results for {len(batch.items)} items")
        return out
    except Exception as e:  # noqa: BLE001  an item's failure is data, not a job failure
        if len(batch.items) == 1:
            return [e]
        half = len(batch.items) // 2
        return isolate(call, Batch(*(c[:half] for c in batch))) + isolate(call, Batch(*(c[half:] for c in batch)))


def batched_quantile_slot(history: DataFrame, fn: Callable, horizon: int = S.HORIZON,
                          context: int = S.CONTEXT_LENGTH, levels=S.QUANTILE_LEVELS, point_level: float = 0.5,
                          min_observations: int = S.MIN_OBSERVATIONS, batch_items: int = BATCH_ITEMS,
                          tasks: int | None = None, factory: bool = False) -> DataFrame:
    """Rows like those of ``quantile_slot``, by a model that is called once per ``batch_items`` items.

    ``fn(batch, horizon, levels)`` returns per item an array (horizon, levels), or a pair (dates, array); without
    dates the days after the item's last one are meant. With ``factory`` a task calls ``fn()`` once to load the model.
    An item is reported in one row with ``error`` set if its history is shorter than ``min_observations``, the
    model fails on it, or its output has the wrong shape, invalid, repeated or unsorted dates, or values that are
    negative or not finite. ``Order_Repaired`` marks days whose levels fell and were raised to a running maximum.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_by_value()
    names, levels = _quantile_names(levels), list(levels)
    schema = ("Medicine_ID string, Forecast_Date date, " + ", ".join(f"{c} double" for c in names)
              + ", Context_Length_Used int, Order_Repaired boolean, error string")
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = fn() if factory else fn
        call = lambda b: model(b, horizon, levels)
        ahead = np.arange(1, horizon + 1)

        def rows_of(batch):
            sizes, starts, values = dense(batch, context)
            ids, last = batch.column("MDCODE").to_pylist(), batch.column("last").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            days = batch.column("days").to_numpy(zero_copy_only=False)
            enough = np.flatnonzero(days >= min_observations)
            found = isolate(call, Batch([ids[i] for i in enough], [values[starts[i]:starts[i + 1]] for i in enough], last[enough])) if len(enough) else []
            good, quantiles, dates = [], [], []
            faults = {i: f"{days[i]} observations, minimum is {min_observations}" for i in np.flatnonzero(days < min_observations)}
            for i, out in zip(enough, found):
                try:
                    if isinstance(out, Exception):
                        raise out
                    when, q = out if isinstance(out, tuple) else (last[i] + ahead, out)
                    when, q = np.asarray(when, "datetime64[D]"), np.asarray(q, dtype=float)
                    fault = output_fault(when, q, horizon, len(levels))
                except Exception as e:  # noqa: BLE001
                    fault = str(e) or type(e).__name__
                if fault:
                    faults[i] = fault
                else:
                    good.append(i), quantiles.append(q), dates.append(when)
            n, bad = len(good) * horizon, list(faults)
            q = np.concatenate(quantiles) if good else np.zeros((0, len(levels)))
            fell = (np.diff(q, axis=1) < 0).any(axis=1)
            none = [None] * len(bad)
            day = np.concatenate(dates) if good else np.zeros(0, "datetime64[D]")
            join = lambda a, b, t: pa.concat_arrays([pa.array(a, t), pa.array(b, t)])
            return pa.RecordBatch.from_arrays([
                join(np.repeat([ids[i] for i in good], horizon).tolist(), [ids[i] for i in bad], pa.string()),
                join(day, none, pa.date32()), *[join(q[:, k], none, pa.float64()) for k in range(len(levels))],
                join(np.repeat(sizes[good], horizon).astype(np.int32), none, pa.int32()),
                join(fell, none, pa.bool_()), join([None] * n, [faults[i] for i in bad], pa.string())], schema=shape)

        for batch in batches:
            for at in range(0, batch.num_rows, batch_items):
                yield rows_of(batch.slice(at, batch_items))

    out = pack_contexts(history, context, tasks).mapInArrow(run, schema)
    point = names[levels.index(point_level)]
    return monotone_quantiles(out, names).withColumn("Predicted_Demand", F.bround(F.col(point), 2)).withColumns(
        {c: F.when(F.col("error").isNull(), F.col(c)) for c in [*names, "Predicted_Demand"]})


def last_week_means(batch: Batch, horizon: int, levels):
    """Deterministic stub model: mean of the last 7 days times twice the level, for a whole batch."""
    import numpy as np

    means = np.array([v[-7:].mean() for v in batch.values])
    return np.tile(means[:, None, None] * 2 * np.asarray(levels), (1, horizon, 1))
