"""Data-quality reports. Each returns a DataFrame; none blocks the load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.guards import any_of, require_columns
from ..functions.quantiles import exact_quantiles


def union_all(frames: list[DataFrame]) -> DataFrame | None:
    """None for no frames."""
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------- landing files

def file_report(listing: DataFrame, files: list[str], months: list[str] | None = None) -> DataFrame:
    """Month x required-file grid from a listing of (month, file, size_bytes). ``months`` are the month
    folders, so that an empty one shows; without them the listing's own months are taken. A table landed as a
    folder bears its file's name with or without the ending."""
    seen = listing.select("month").distinct()
    if months is not None:
        seen = listing.sparkSession.createDataFrame([(m,) for m in months], "month string")
    wanted = seen.select("month", F.explode(F.array(*[F.lit(f) for f in dict.fromkeys(files)])).alias("file"))
    ended = F.create_map(*[F.lit(x) for f in files for x in (f.rpartition(".")[0] or f, f)])
    listing = listing.withColumn("file", F.coalesce(ended[F.col("file")], F.col("file")))
    found = listing.groupBy("month", "file").agg(F.sum("size_bytes").alias("size_bytes"))
    return wanted.join(found, ["month", "file"], "left").select(
        "month",
        "file",
        F.col("size_bytes").isNotNull().alias("exists"),
        F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce(F.col("size_bytes") == 0, F.lit(False)).alias("is_empty"),
    )


def schema_report(schemas: DataFrame, months: DataFrame | None = None,
                  tables: list[str] | None = None, order: str = "chronological") -> DataFrame:
    """Column list of each (table, month) against the table's first month.

    ``schemas`` has one row per landed file: table, month, columns (ordered array). Its size is the
    number of files, so the per-table window is small.
    """
    from ..functions.cleaning import source_month_date

    rank = F.col("month") if order == "lexical" else F.coalesce(
        source_month_date(F.col("month")).cast("string"), F.col("month"))
    if months is not None:
        wanted = F.array(*map(F.lit, tables or S.LANDING_TABLES))
        grid = months.select("month").distinct().select("month", F.explode(wanted).alias("table"))
        schemas = grid.join(schemas, ["table", "month"], "left")
    first = F.min_by(
        F.struct("columns", "month"), F.when(F.col("columns").isNotNull(), rank)
    ).over(W.partitionBy("table"))
    df = schemas.withColumn("base", first)
    present = F.col("columns").isNotNull()
    return df.select(
        "table",
        "month",
        F.when(present, F.size("columns")).alias("column_count"),
        F.coalesce(F.col("columns") == F.col("base.columns"), F.lit(False)).alias(
            "matches_reference"),
        F.col("base.month").alias("reference_month"),
        F.when(present, F.array_sort(F.array_except("base.columns", "columns"))).alias(
            "missing_columns"),
        F.when(present, F.array_sort(F.array_except("columns", "base.columns"))).alias(
            "extra_columns"),
        F.when(~present, F.lit("File not found")).alias("error"),
    )


def datatype_report(types: DataFrame) -> DataFrame:
    """Columns whose type differs between months; input rows are (table, month, column, dtype)."""
    return (
        types.groupBy("table", "column")
        .agg(
            F.array_sort(F.collect_set("dtype")).alias("dtypes_found"),
            F.array_sort(F.collect_set("month")).alias("months_affected"),
        )
        .where(F.size("dtypes_found") > 1)
        .select("table", "column", F.size("dtypes_found").alias("dtype_count"), "dtypes_found",
                "months_affected")
    )


# ---------------------------------------------------------------- keys

def shown(c, decimals: int | None) -> F.Column:
    """A percentage as reports show it; None leaves it unrounded."""
    return c if decimals is None else F.round(c, decimals)


def duplicate_report(df: DataFrame, table: str, keys: list[str], decimals: int | None = 2) -> DataFrame:
    """Rows that share their key with another row, counted from per-key totals."""
    if any(k not in df.columns for k in keys):
        missing = [k for k in keys if k not in df.columns]
        return df.agg(F.count("*").alias("total_rows")).select(
            F.lit(table).alias("table"), F.array(*map(F.lit, keys)).alias("duplicate_key"),
            "total_rows", F.lit(None).cast("bigint").alias("duplicate_rows"),
            F.lit(None).cast("double").alias("duplicate_percent"), F.lit("FAILED").alias("status"),
            F.lit(f"Missing key columns: {missing}").alias("message"),
        )
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )
    clean = F.col("duplicate_rows") == 0
    percent = F.col("duplicate_rows") * 100.0 / F.col("total_rows")
    return totals.where(F.col("total_rows") > 0).select(
        F.lit(table).alias("table"),
        F.array(*map(F.lit, keys)).alias("duplicate_key"),
        "total_rows",
        "duplicate_rows",
        shown(percent, decimals).alias("duplicate_percent"),
        F.when(clean, "PASSED").otherwise("WARNING").alias("status"),
        F.when(clean, "No duplicates found").otherwise("Duplicate records found").alias("message"),
    )


def duplicate_samples(df: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """First n duplicated rows by key. Every such key has two rows or more, so the n/2 lowest keys
    suffice, and that bounded list is what gets broadcast."""
    low_keys = (
        df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > 1)
        .orderBy(*keys).limit((n + 1) // 2)
        .select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    rest = [c for c in df.columns if c not in keys]
    return df.join(F.broadcast(low_keys), same, "left_semi").orderBy(*keys, *rest).limit(n)


def validate_duplicates(tables: dict[str, DataFrame], duplicate_keys=None,
                        decimals: int | None = 2) -> DataFrame | None:
    specs = duplicate_keys or S.DUPLICATE_KEYS
    return union_all([duplicate_report(tables[t], t, k, decimals) for t, k in specs.items() if t in tables])


def _orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Per-key child counts without a parent. Counting first collapses hot keys to one row each;
    a null key matches nothing and so is an orphan."""
    kind = common_key_type(child.schema[child_key].dataType, parent.schema[parent_key].dataType)
    counts = child.groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("as_parent", F.col("key").cast(kind))
    parents = parent.select(F.col(parent_key).cast(kind).alias("parent_key")).where(
        F.col("parent_key").isNotNull()).distinct()
    return counts.join(parents, F.col("as_parent") == F.col("parent_key"), "left").withColumn(
        "orphan", F.col("parent_key").isNull()).drop("as_parent")


def common_key_type(child, parent) -> str:
    """Type in which keys of two tables are equal exactly when their values are: the type of both, the wider of two
    numbers, a day for two points in time, else text."""
    if child == parent:
        return child.simpleString()
    if isinstance(child, T.NumericType) and isinstance(parent, T.NumericType):
        whole = [t for t in (child, parent) if isinstance(t, T.IntegralType)]
        if len(whole) == 2:
            return "bigint"
        exact = [t for t in (child, parent) if isinstance(t, T.DecimalType)]
        if len(exact) + len(whole) == 2:
            scale = max(t.scale for t in exact)
            digits = max([t.precision - t.scale for t in exact] + [19] * len(whole))
            return f"decimal({min(38, digits + scale)},{scale})"
        return "double"
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in (child, parent)):
        return "timestamp"
    return "string"


_ORPHANS = ["check_name", "parent_table", "child_table", "parent_key", "child_key", "child_rows", "orphan_rows",
            "orphan_percent", "status", "message"]


def orphan_report(child: DataFrame, parent: DataFrame, check: str, child_table: str, parent_table: str,
                  child_key: str, parent_key: str, decimals: int | None = 2) -> DataFrame:
    return orphan_reports(child, [(check, child_table, parent, parent_table, child_key, parent_key)], decimals)


def orphan_reports(child: DataFrame, checks: list[tuple], decimals: int | None = 2) -> DataFrame:
    """All checks of one child table from one scan of it: its keys are counted together, tagged by check, and
    meet the tagged keys of all parents in one join. An empty child or parent is not checked."""
    able = [c for c in checks if c[4] in child.columns and c[5] in c[2].columns]
    rows = child.agg(F.count("*").alias("child_rows"))
    failed = [
        rows.select(*[F.lit(v).alias(n) for n, v in zip(_ORPHANS, (name, ptable, ctable, pkey, ckey))], "child_rows",
                    F.lit(None).cast("bigint").alias("orphan_rows"), F.lit(None).cast("double").alias("orphan_percent"),
                    F.lit("FAILED").alias("status"), F.lit("Parent key or child key missing").alias("message"))
        for name, ctable, _, ptable, ckey, pkey in checks if (name, ptable) not in {(a[0], a[3]) for a in able}
    ]
    if not able:
        return union_all(failed)
    kinds = [common_key_type(child.schema[c[4]].dataType, c[2].schema[c[5]].dataType) for c in able]
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c[4]).cast(kinds[i]).cast("string").alias("key")) for i, c in enumerate(able)])
    counts = child.select(F.explode(cells).alias("c")).groupBy("c.i", "c.key").agg(F.count("*").alias("n"))
    parents = union_all([
        c[2].select(F.lit(i).alias("pi"), F.col(c[5]).cast(kinds[i]).cast("string").alias("pkey")).distinct()
        for i, c in enumerate(able)])
    # a parent's rows without key count as rows, not as keys
    full = parents.groupBy("pi").agg(F.count("*").alias("parents"))
    met = counts.join(parents.where("pkey is not null"), (F.col("i") == F.col("pi")) & (F.col("key") == F.col("pkey")), "left")
    totals = met.groupBy("i").agg(
        F.sum("n").alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("pkey").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
    ).join(F.broadcast(full), F.col("i") == F.col("pi"))  # a row per check
    names = F.create_map(*[x for i, c in enumerate(able) for x in (
        F.lit(i), F.struct(*[F.lit(v).alias(n) for n, v in zip(_ORPHANS, (c[0], c[3], c[1], c[5], c[4]))]))])
    clean = F.col("orphan_rows") == 0
    found = totals.withColumn("name", names[F.col("i")]).select(
        "name.*", "child_rows", "orphan_rows",
        shown(F.col("orphan_rows") * 100.0 / F.col("child_rows"), decimals).alias("orphan_percent"),
        F.when(clean, "PASSED").otherwise("WARNING").alias("status"),
        F.when(clean, "No orphan records found").otherwise("Orphan records found").alias("message"))
    return union_all([found, *failed])


def orphan_samples(child, parent, child_key: str, parent_key: str, n: int = 100) -> DataFrame:
    """n orphan rows, lowest keys first; at most n keys are needed, and only those are broadcast."""
    low = (
        _orphan_keys(child, parent, child_key, parent_key).where("orphan")
        .orderBy(F.col("key").asc_nulls_first()).limit(n).select("key")
    )
    rest = [c for c in child.columns if c != child_key]
    return (
        child.join(F.broadcast(low), F.col(child_key).eqNullSafe(F.col("key")), "left_semi")
        .orderBy(F.col(child_key).asc_nulls_first(), *rest).limit(n)
    )


def validate_orphans(tables: dict[str, DataFrame], checks=None, decimals: int | None = 2) -> DataFrame | None:
    by_child: dict[str, list] = {}
    for child, parent, key in checks or S.REFERENCE_CHECKS:
        if child in tables and parent in tables:
            by_child.setdefault(child, []).append(
                (f"{child} {key} exists in {parent}", child, tables[parent], parent, key, key))
    return union_all([orphan_reports(tables[c], found, decimals) for c, found in by_child.items()])


def sample_reports(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Bounded samples of duplicated rows per table and of orphans per check."""
    out = {}
    for t, keys in S.DUPLICATE_KEYS.items():
        if t in tables and all(k in tables[t].columns for k in keys):
            out[f"duplicate_samples/{t}"] = duplicate_samples(tables[t], keys)
    for child, parent, key in S.REFERENCE_CHECKS:
        if child in tables and parent in tables and key in tables[child].columns and key in tables[parent].columns:
            out[f"orphan_samples/{child}_{key}_{parent}"] = orphan_samples(tables[child], tables[parent], key, key)
    return out


# ---------------------------------------------------------------- profile

def profile_dataframe(df: DataFrame, table: str, top: int = 5, decimals: int | None = 2) -> DataFrame:
    """One row per column: nulls (NaN is one), distinct values, most frequent values, numeric range and median.

    Everything but the median comes from one (column, value) count, combined before its shuffle, so
    a value that fills a third of the table costs one row per map task.
    """
    df = df.withColumns({c: F.nanvl(c, F.lit(None)) for c, kind in df.dtypes if kind in ("double", "float")})
    columns = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if isinstance(types[c], T.NumericType)]
    cells = df.select(
        F.explode(F.array(*[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("value"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"),
            ) for c in columns
        ])).alias("cell")
    )
    counts = cells.groupBy("cell.column", "cell.value", "cell.num").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(present).alias("unique_count"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.try_divide(F.sum(F.col("num") * F.col("n")),
                     F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"),
    )
    # the rank filter becomes a group limit before the shuffle: at most `top` rows per column leave
    rank = F.row_number().over(
        W.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first()))
    tops = (
        counts.withColumn("rank", rank).where(F.col("rank") <= top)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
        .select("column", F.transform("t", lambda x: F.struct(
            x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    )
    out = stats.join(F.broadcast(tops), "column")
    median = exact_quantiles(
        cells.select("cell.column", "cell.num"), "num", [0.5], by="column"
    ).select("column", F.col("value").alias("median"))
    out = out.join(F.broadcast(median), "column", "left")
    dtype = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c].simpleString()))])
    return out.select(
        F.lit(table).alias("table"),
        "column",
        dtype[F.col("column")].alias("dtype"),
        "total_rows",
        "null_count",
        shown(F.col("null_count") * 100.0 / F.col("total_rows"), decimals).alias("null_percent"),
        (F.col("total_rows") - F.col("null_count")).alias("non_null_count"),
        "unique_count",
        shown(F.col("unique_count") * 100.0 / F.col("total_rows"), decimals).alias("unique_percent"),
        (F.col("unique_count") <= 1).alias("is_constant"),
        "top_values",
        "min",
        "max",
        "mean",
        "median",
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([profile_dataframe(df, name) for name, df in tables.items()])


def run_all_validations(tables: dict[str, DataFrame], listing: DataFrame | None = None,
                        columns: DataFrame | None = None, files: list[str] | None = None,
                        months: list[str] | None = None) -> dict[str, DataFrame]:
    """All reports, lazily; the tables pass through untouched. ``listing`` and ``columns`` come from the landed
    files (file_listing, landed_columns), ``files`` are the names that every month must have."""
    reports = {
        "duplicates": validate_duplicates(tables),
        "orphans": validate_orphans(tables),
        "profile": profile_tables(tables),
        **sample_reports(tables),
    }
    if listing is not None:
        reports["files"] = file_report(listing, files or S.LANDING_TABLES, months)
    if columns is not None:
        lists = columns.groupBy("table", "month").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("columns"))
        reports["schemas"] = schema_report(lists, columns.select("month"), list(tables))
        reports["datatypes"] = datatype_report(columns)
    return {name: report for name, report in reports.items() if report is not None}


# ---------------------------------------------------------------- contracts of the demand side

def check_series(df: DataFrame, item="MDCODE", day="INVDT", qty="Demand_Qty") -> DataFrame:
    """One-row violations report of a demand series."""
    require_columns(df, [item, day, qty], "series")
    number = F.col(qty).try_cast("double")
    when = F.to_date(day)
    per_key = df.groupBy(F.col(item).alias("k"), when.alias("d")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(item).isNull() | (F.trim(F.col(item).cast("string")) == "")).alias("no_id"),
        F.count_if(number.isNull() | F.isnan(number)).alias("no_qty"),
        F.count_if(F.abs(number) == float("inf")).alias("inf_qty"),
        F.count_if(number < 0).alias("neg_qty"),
    )
    return per_key.agg(
        F.coalesce(F.sum("no_id"), F.lit(0)).alias("missing_id"),
        F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("bad_date"),
        F.coalesce(F.sum("no_qty"), F.lit(0)).alias("missing_qty"),
        F.coalesce(F.sum("inf_qty"), F.lit(0)).alias("infinite_qty"),
        F.coalesce(F.sum("neg_qty"), F.lit(0)).alias("negative_qty"),
        F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n") - 1)), F.lit(0)).alias(
            "duplicate_day"),
    )


def check_routing(routing: DataFrame, models: list[str], challenger: str,
                  threshold: float = S.ROUTING_THRESHOLD) -> DataFrame:
    """One-row violations report of a routing table."""
    adv = F.col("Validation_Advantage_Pct")
    finite = adv.isNotNull() & ~F.isnan(adv) & (F.abs(adv) != float("inf"))
    expected = F.col("Selected_Model").eqNullSafe(F.lit(challenger)) == (adv >= threshold)
    per_id = routing.groupBy("Medicine_ID").agg(
        F.count("*").alias("n"),
        F.count_if(~finite).alias("bad_adv"),
        F.count_if(~F.coalesce(F.col("Selected_Model").isin(models), F.lit(False))).alias("bad_model"),
        F.count_if(F.coalesce(F.abs(F.col("Threshold") - threshold) > 1e-9, F.lit(True))).alias(
            "bad_threshold"),
        F.count_if(finite & ~expected).alias("bad_rule"),
    )
    empty = F.col("Medicine_ID").isNull() | (F.trim("Medicine_ID") == "")
    return per_id.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_id"),
        F.count_if(empty).alias("empty_id"),
        F.coalesce(F.sum("bad_adv"), F.lit(0)).alias("advantage_not_finite"),
        F.coalesce(F.sum("bad_model"), F.lit(0)).alias("unknown_model"),
        F.coalesce(F.sum("bad_threshold"), F.lit(0)).alias("wrong_threshold"),
        F.coalesce(F.sum("bad_rule"), F.lit(0)).alias("decision_against_rule"),
    )


def check_forecast(forecast: DataFrame, models: list[str], probabilistic: list[str],
                   horizon: int = S.HORIZON, form: str = "service") -> DataFrame:
    """One-row violations report of forecast output.

    ``service``: probabilistic models need P10<=P50<=P90, point models carry no quantiles.
    ``router``: all nine quantiles on every row, non-decreasing, P50 equal to the point.
    """
    require_columns(forecast, ["Medicine_ID", "Forecast_Date", "Predicted_Demand",
                               "Selected_Model", *S.QUANTILE_COLUMNS], "forecast")
    q = [F.col(c) for c in S.QUANTILE_COLUMNS]
    is_prob = F.col("Selected_Model").isin(probabilistic)
    point = F.col("Predicted_Demand")
    bad_number = point.isNull() | F.isnan(point) | (F.abs(point) == float("inf"))
    falling = any_of([a > b for a, b in zip(q, q[1:])])
    if form == "service":
        order = is_prob & ((F.col("P10") > F.col("P50")) | (F.col("P50") > F.col("P90"))
                           | any_of([F.col(c).isNull() for c in ("P10", "P50", "P90")]))
        presence = ~is_prob & any_of([c.isNotNull() for c in q])
        off_point = F.lit(False)
    else:
        order = falling
        presence = any_of([c.isNull() | F.isnan(c) for c in q])
        off_point = F.abs(F.col("P50") - point) > 1e-9
    per_day = forecast.groupBy("Medicine_ID", "Forecast_Date").agg(
        F.count("*").alias("n"),
        F.count_if(bad_number).alias("bad"),
        F.count_if(point < 0).alias("neg"),
        F.count_if(~F.coalesce(F.col("Selected_Model").isin(models), F.lit(False))).alias("model"),
        F.count_if(F.coalesce(order, F.lit(False))).alias("order"),
        F.count_if(F.coalesce(presence, F.lit(False))).alias("presence"),
        F.count_if(F.coalesce(off_point, F.lit(False))).alias("off"),
    )
    per_id = per_day.groupBy("Medicine_ID").agg(
        F.count("*").alias("days"),
        F.max("Forecast_Date").alias("hi"), F.min("Forecast_Date").alias("lo"),
        *[F.sum(c).alias(c) for c in ("n", "bad", "neg", "model", "order", "presence", "off")],
    )
    return per_id.agg(
        F.coalesce(F.sum(F.col("n") - F.col("days")), F.lit(0)).alias("duplicate_date"),
        F.count_if(F.col("days") != horizon).alias("wrong_horizon"),
        F.count_if(F.datediff("hi", "lo") + 1 != F.col("days")).alias("date_gap"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_finite"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negative"),
        F.coalesce(F.sum("model"), F.lit(0)).alias("unknown_model"),
        F.coalesce(F.sum("order"), F.lit(0)).alias("quantile_order"),
        F.coalesce(F.sum("presence"), F.lit(0)).alias("quantile_presence"),
        F.coalesce(F.sum("off"), F.lit(0)).alias("median_off_point"),
    )


def check_forecast_store(forecast: DataFrame) -> DataFrame:
    """One-row violations report of a stored forecast snapshot."""
    require_columns(forecast, ["Medicine_ID", "Forecast_Date", "Predicted_Demand"], "forecast store")
    point = F.col("Predicted_Demand")
    per_day = forecast.groupBy("Medicine_ID", "Forecast_Date").agg(
        F.count("*").alias("n"),
        F.count_if(point.isNull() | F.isnan(point) | (point < 0)).alias("bad"),
    )
    return per_day.agg(
        F.count_if(F.col("Medicine_ID").isNull() | F.col("Forecast_Date").isNull()).alias("null_key"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_date"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_point"),
    )


def check_comparison_input(df: DataFrame, columns: list[str],
                           splits=("validation", "holdout")) -> DataFrame:
    """Columns at analysis time; one row telling which splits are absent."""
    require_columns(df, [*columns, "Split"], "comparison input")
    return df.agg(*[
        F.when(F.count_if(F.col("Split") == s) == 0, 1).otherwise(0).alias(f"missing_{s.lower()}")
        for s in splits
    ])


def conservation_check(daily: DataFrame, monthly: DataFrame, item="MDCODE", qty="Demand_Qty",
                       tolerance: float = 1e-8) -> DataFrame:
    """Items whose daily and monthly totals differ."""
    d = daily.groupBy(item).agg(F.sum(qty).alias("daily_total"))
    m = monthly.groupBy(item).agg(F.sum(qty).alias("monthly_total"))
    diff = F.abs(F.coalesce("daily_total", F.lit(0.0)) - F.coalesce("monthly_total", F.lit(0.0)))
    return d.join(m, item, "full").withColumn("difference", diff).where(diff > tolerance)


def landed_schemas(tables_by_month: list[tuple[str, str, T.StructType]],
                   spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(schemas, types) frames from the footers of landed files: metadata only, one row per file."""
    s = [(t, m, [f.name for f in sc.fields]) for t, m, sc in tables_by_month]
    c = [(t, m, f.name, f.dataType.simpleString()) for t, m, sc in tables_by_month for f in sc.fields]
    return (
        spark.createDataFrame(s, "table string, month string, columns array<string>"),
        spark.createDataFrame(c, "table string, month string, column string, dtype string"),
    )
