"""Smoothing states that merge: a month's state joins the state of all months before it.

Every smoothing model is a weighted sum whose weights fall with the distance from the end of history. A stretch of a
series therefore has a state of fixed size, measured from its own end, and two stretches that follow each other have
the state of both: the earlier sums are multiplied by what the later stretch took from them. ``combine`` is
associative, so states may be kept per month, merged in any grouping, and extended by one month without the history.

The state of an item: first and last day with a row, k days with demand, the first and last of them, the first
quantity v1, and the sums size, occ and gaps, all measured from the last day; total; and tail, the last PERIOD days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .forecast import ALPHA, BETA, PERIOD, daily_models, model_rows, over_horizon

STATE = ["first", "last", "k", "first_hit", "last_hit", "v1", "size", "occ", "gaps", "total", "tail"]


def _keep(rate: float, steps) -> Column:
    return F.pow(F.lit(1 - rate), steps)


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def segment_states(daily: DataFrame, by: list[str] = (), alpha=ALPHA, beta=BETA, item="MDCODE", when="INVDT",
                   qty="Demand_Qty") -> DataFrame:
    """One state per item, and per value of ``by`` (such as a month), from one pass over a daily series.

    ``daily`` has one row per item and day; days without a row have no demand.
    """
    keys = [item, *by]
    whole, earlier = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    rows = daily.select(*keys, F.col(when).alias("day"), F.col(qty).cast("double").alias("q"))
    rows = rows.withColumn("hit_day", F.when(F.col("q") > 0, F.col("day")))
    rows = rows.withColumns({
        "later": F.count("hit_day").over(whole) - F.coalesce(F.count("hit_day").over(earlier), F.lit(0)) - 1,
        "before": F.max("hit_day").over(earlier),
        "end": F.max("day").over(whole),
    })
    hit, weight = F.col("hit_day").isNotNull(), alpha * _keep(alpha, F.col("later"))
    age = F.datediff("end", "day")
    return rows.groupBy(*keys).agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.count("hit_day").alias("k"),
        F.min("hit_day").alias("first_hit"), F.max("hit_day").alias("last_hit"),
        F.min_by(F.when(hit, F.col("q")), F.col("hit_day")).alias("v1"),
        _sum(F.when(hit, weight * F.col("q"))).alias("size"),
        _sum(F.when(hit, beta * _keep(beta, age))).alias("occ"),
        _sum(F.when(hit & F.col("before").isNotNull(), weight * F.datediff("day", "before"))).alias("gaps"),
        _sum(F.when(hit, F.col("q"))).alias("total"),
        F.array(*[_sum(F.when(age == a, F.greatest("q", F.lit(0.0)))) for a in range(PERIOD - 1, -1, -1)]).alias("tail"),
    )


def combine(earlier: DataFrame, later: DataFrame, alpha=ALPHA, beta=BETA, item="MDCODE") -> DataFrame:
    """The states of two stretches of time of which the second follows the first, as one state per item. An item
    may be in one of them only."""
    a, b = (df.select(item, F.struct(*STATE).alias(s)) for df, s in ((earlier, "a"), (later, "b")))
    both = a.join(b, item, "full")
    old, new = F.col("a"), F.col("b")
    merged = {
        "first": F.least(old["first"], new["first"]), "last": F.greatest(old["last"], new["last"]),
        "k": old["k"] + new["k"],
        "first_hit": F.coalesce(old["first_hit"], new["first_hit"]), "last_hit": F.coalesce(new["last_hit"], old["last_hit"]),
        "v1": F.coalesce(old["v1"], new["v1"]),
        "size": old["size"] * _keep(alpha, new["k"]) + new["size"],
        "occ": old["occ"] * _keep(beta, F.datediff(new["last"], old["last"])) + new["occ"],
        "gaps": old["gaps"] * _keep(alpha, new["k"]) + new["gaps"] + F.coalesce(
            alpha * _keep(alpha, new["k"] - 1) * F.datediff(new["first_hit"], old["last_hit"]), F.lit(0.0)),
        "total": old["total"] + new["total"],
        "tail": F.transform(new["tail"], lambda x, i: x + F.coalesce(
            F.get(old["tail"], i + F.datediff(new["last"], old["last"])), F.lit(0.0))),
    }
    return both.select(item, *[
        F.when(new.isNull(), old[c]).when(old.isNull(), new[c]).otherwise(merged[c]).alias(c) for c in STATE])


def combine_all(states: DataFrame, by: str, alpha=ALPHA, beta=BETA, item="MDCODE") -> DataFrame:
    """The states of many stretches, which follow each other in the order of ``by``, as one state per item."""
    whole, before = W.partitionBy(item), W.partitionBy(item).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(item).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    rows = states.withColumns({
        "later": F.sum("k").over(whole) - F.sum("k").over(upto),
        "end": F.max("last").over(whole),
        "before": F.max("last_hit").over(before),
    })
    days, fade = F.datediff("end", "last"), _keep(alpha, F.col("later"))
    bridge = alpha * fade * _keep(alpha, F.col("k") - 1) * F.datediff("first_hit", "before")
    return rows.groupBy(item).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("k").alias("k"),
        F.min("first_hit").alias("first_hit"), F.max("last_hit").alias("last_hit"),
        F.min_by("v1", "first_hit").alias("v1"),
        _sum(F.col("size") * fade).alias("size"), _sum(F.col("occ") * _keep(beta, days)).alias("occ"),
        _sum(F.col("gaps") * fade + F.coalesce(bridge, F.lit(0.0))).alias("gaps"),
        F.sum("total").alias("total"),
        F.array(*[_sum(F.get("tail", days + i)) for i in range(PERIOD)]).alias("tail"),
    )


def as_of(states: DataFrame, day: Column, beta=BETA) -> DataFrame:
    """The states with days without demand added up to ``day``; a state that ends later stays as it is."""
    days = F.col("__days")
    states = states.withColumn("__days", F.greatest(F.datediff(day, F.col("last")), F.lit(0)))
    return states.withColumns({
        "occ": F.col("occ") * _keep(beta, days),
        "tail": F.transform("tail", lambda _, i: F.coalesce(F.get("tail", i + days), F.lit(0.0))),
        "last": F.greatest(F.col("last"), day),
    }).drop("__days")


def model_state(states: DataFrame, alpha=ALPHA) -> DataFrame:
    """Columns over which the smoothing models of ``forecast`` are defined: n days, position f of the first demand,
    smoothed size z and interval, occ, tail and last_value."""
    k = F.col("k")
    f = F.datediff("first_hit", "first")
    first_gap = (alpha * _keep(alpha, k - 1) + _keep(alpha, k)) * (f + 1)
    return states.withColumns({
        "cutoff": F.col("last"), "n": F.datediff("last", "first") + 1, "f": f,
        "z": F.when(k > 0, F.col("size") + _keep(alpha, k) * F.col("v1")).otherwise(0.0),
        "interval": F.when(k > 0, F.col("gaps") + first_gap),
        "newest_age": F.datediff("last", "last_hit"), "sum_qty": F.col("total"),
        "last_value": F.element_at("tail", -1),
    })


def forecast_states(states: DataFrame, horizon: int, models: list[str] | None = None, item="MDCODE") -> DataFrame:
    """Horizon rows of the classical daily models from stored states, as ``forecast_daily`` gives from a series."""
    chosen = {m: c for m, c in daily_models(F.col("h")).items() if models is None or m in models}
    rows = over_horizon(model_state(states), horizon, item)
    return rows.select(F.col(item).alias("Medicine_ID"), "Forecast_Date", "h", model_rows(chosen))


class StateStore:
    """States in a shared folder: ``segments/month=<first day>`` of one month each, and ``upto/month=<first day>`` of
    all months up to it. A month may be written again: it then follows from the same month before it, so a repeated
    run changes nothing. After a correction of an older month, ``rebuild`` makes ``upto`` anew from the segments."""

    def __init__(self, spark: SparkSession, root: str, alpha=ALPHA, beta=BETA):
        self.spark, self.root, self.alpha, self.beta = spark, root.rstrip("/"), alpha, beta

    def months(self, kind: str = "upto") -> list[str]:
        """The first days of the months that are stored, in order."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n.partition("=")[2] for n in names if n.startswith("month="))

    def read(self, month: str, kind: str = "upto") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/month={month}")

    def _write(self, states: DataFrame, month: str, kind: str) -> None:
        states.write.mode("overwrite").parquet(f"{self.root}/{kind}/month={month}")

    def extended(self, month: str) -> DataFrame:
        """The states up to ``month``, from its segment and the states up to the month stored before it."""
        before = [m for m in self.months() if m < month]
        own = self.read(month, "segments")
        return combine(self.read(before[-1]), own, self.alpha, self.beta) if before else own

    def add_month(self, month: str, daily: DataFrame) -> DataFrame:
        """Add the demand of one month, which is all that is read of it; returns the states up to it."""
        inside = daily.where(F.trunc("INVDT", "month") == F.lit(month).cast("date"))
        self._write(segment_states(inside, alpha=self.alpha, beta=self.beta), month, "segments")
        self._write(self.extended(month), month, "upto")
        return self.read(month)

    def load(self, daily: DataFrame) -> None:
        """Segments of all months of a history in one pass, and the states up to the last of them."""
        month = F.trunc("INVDT", "month")
        states = segment_states(daily.withColumn("month", month), ["month"], self.alpha, self.beta)
        states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.root}/segments")
        months = self.months("segments")
        if months:
            self.rebuild(months[-1])

    def rebuild(self, month: str) -> DataFrame:
        """The states up to ``month`` from all segments up to it."""
        segments = self.spark.read.option("basePath", f"{self.root}/segments").parquet(f"{self.root}/segments")
        upto = segments.where(F.col("month").cast("date") <= F.lit(month).cast("date"))
        self._write(combine_all(upto, "month", self.alpha, self.beta), month, "upto")
        return self.read(month)
