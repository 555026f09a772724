"""Equi-joins of facts with dimensions.

No broadcast is forced here: Spark broadcasts a side only below autoBroadcastJoinThreshold, and
adaptive execution splits skewed shuffle partitions. ``salted_join`` is for a key so hot that one
must not wait for run-time detection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import ContractError, require_columns, require_unique
from ..session import stored


def _aligned(fact: DataFrame, dim: DataFrame, fact_keys: list[str], dim_keys: list[str]):
    """Dimension without the columns the fact already has, its keys renamed out of the way."""
    require_columns(fact, fact_keys, "fact")
    require_columns(dim, dim_keys, "dimension")
    kept = [c for c in dim.columns if c not in fact.columns and c not in dim_keys]
    return dim.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(dim_keys)], *kept)


def _condition(fact: DataFrame, fact_keys: list[str], null_safe: bool, by_first: bool = False):
    pairs = [(F.col(k), F.col(f"__key_{i}")) for i, k in enumerate(fact_keys)]
    parts = [l.eqNullSafe(r) if null_safe else l == r for l, r in pairs]
    if by_first:  # the same comparison in a form that is no join key, or Spark would deal by it too
        parts[1:] = [l.isin(r) for l, r in pairs[1:]]
    return reduce(lambda a, b: a & b, parts)


def merge_dimension(fact: DataFrame, dim: DataFrame, fact_key, dim_key=None, how: str = "left",
                    check_unique: bool = False, null_safe: bool = False, by_first: bool = False) -> DataFrame:
    """Add the dimension's new columns to the fact; keys may be one name or a list.

    ``by_first``: rows meet by the first key and the others are conditions, so sides that lie by the first key alone do
    not move, and those that do lie by it afterwards. A fact row is compared with all dimension rows of its first key:
    for numbers that begin anew each month, as many as there are months.
    """
    if by_first and null_safe:
        raise ValueError("by_first compares no nulls")
    fact_keys = [fact_key] if isinstance(fact_key, str) else list(fact_key)
    dim_keys = fact_keys if dim_key is None else (
        [dim_key] if isinstance(dim_key, str) else list(dim_key)
    )
    if len(fact_keys) != len(dim_keys):
        raise ContractError("fact and dimension key lists differ in length")
    if check_unique:
        require_unique(dim, dim_keys, "dimension")
    other = _aligned(fact, dim, fact_keys, dim_keys)
    out = fact.join(other, _condition(fact, fact_keys, null_safe, by_first), how)
    return out.drop(*[f"__key_{i}" for i in range(len(fact_keys))])


def merge_dimension_composite(fact, dim, fact_keys, dim_keys, how="left") -> DataFrame:
    """Several keys, many-to-one: a repeated dimension key is an error."""
    return merge_dimension(fact, dim, fact_keys, dim_keys, how, check_unique=True)


def join_multiple_tables(base: DataFrame, joins) -> DataFrame:
    """Left-deep fold over (dimension, fact_key, dimension_key, how)."""
    return reduce(lambda df, j: merge_dimension(df, j[0], j[1], j[2], j[3]), joins, base)


def salted_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "left", salts: int = 32,
                hot_share: float = 0.01) -> DataFrame:
    """Join whose hot keys are spread over ``salts`` tasks.

    A key is hot when it holds more than ``hot_share`` of the fact, so there are at most
    1/hot_share of them: that bound is what makes the hot list safe to broadcast and the
    replicated dimension rows few. Rows without a key match nothing, so they are spread too and
    need no copies. Every other key joins with salt 0, unreplicated.
    """
    if how not in ("left", "inner"):
        raise ValueError("salting supports left and inner joins")
    # counted once for the total and both sides
    per_key = stored(fact.groupBy(key).agg(F.count("*").alias("__n")), "keys")
    total = per_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).scalar()
    hot = per_key.where(F.col(key).isNotNull() & (F.col("__n") > total * hot_share)).select(
        F.col(key).alias("__hot"), F.lit(True).alias("__is_hot")
    )
    hot = F.broadcast(hot)
    # a hash of the row, not a random or running number: a retried task must salt a row as before
    spread = F.when(F.col("__is_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(*fact.columns), F.lit(salts)))
    left = (
        fact.join(hot, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.coalesce(spread, F.lit(0)).cast("int"))
        .drop("__hot", "__is_hot")
    )
    copies = F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    kept = [c for c in dim.columns if c not in fact.columns]
    right = (
        dim.select(F.col(key).alias("__key"), *kept)
        .join(hot, F.col("__key") == F.col("__hot"), "left")
        .withColumn("__salt_r", F.explode(copies))
        .drop("__hot", "__is_hot")
    )
    on = (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__salt_r"))
    return left.join(right, on, how).drop("__key", "__salt", "__salt_r")


# --- named joins of the sales and purchase chains ---

def join_sales_invoice_line(line: DataFrame, invoice: DataFrame, how: str = "left", by_first: bool = False) -> DataFrame:
    return merge_dimension(line, invoice, ["INVNO", "SOURCE_MONTH"], how=how, by_first=by_first)


def join_sales_dimensions(sales, salesperson, product, dates, tax=None) -> DataFrame:
    chain = [
        (salesperson.drop("SOURCE_MONTH"), "SCODE", "SCODE", "left"),
        (product.drop("SOURCE_MONTH"), "MDCODE", "MDCODE", "left"),
        (dates, "INVDT", "full_date", "left"),
    ]
    if tax is not None:
        chain.append((tax.drop("SOURCE_MONTH"), "TCODE", "TCODE", "left"))
    return join_multiple_tables(sales, chain)


def join_purchase_header_line(line, header, composite: bool = True, by_first: bool = False) -> DataFrame:
    """Composite (PINVNO, SOURCE_MONTH) by default; PINVNO alone can fan out across months."""
    keys = ["PINVNO", "SOURCE_MONTH"] if composite else ["PINVNO"]
    return merge_dimension(line, header, keys, by_first=by_first)


def join_purchase_dimensions(purchase, supplier, product, dates, tax=None) -> DataFrame:
    chain = [
        (supplier.drop("SOURCE_MONTH"), "SUPNO", "SUPNO", "left"),
        (product.drop("SOURCE_MONTH"), "MDCODE", "MDCODE", "left"),
        (dates, "PINVDT", "full_date", "left"),
    ]
    if tax is not None:
        chain.append((tax.drop("SOURCE_MONTH"), "TCODE", "TCODE", "left"))
    return join_multiple_tables(purchase, chain)


def keys_without_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct left keys absent on the right; deduplicated before the join, so hot keys collapse."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def only_keys(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Semi join against a key set."""
    return df.join(keys_df.select(*keys).distinct(), keys, "left_semi")
