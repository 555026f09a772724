"""Business KPIs. Groupings drop null keys and report 0 for an all-null sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import require_columns
from ..functions.metrics import (
    days_of_inventory, growth_rate, inventory_turnover, pct, profit_margin, rate, ratio,
)


def total(df: DataFrame, amount: str, name: str = "Total") -> DataFrame:
    require_columns(df, [amount])
    return df.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(name))


def average(df: DataFrame, amount: str, name: str = "Average") -> DataFrame:
    require_columns(df, [amount])
    return df.agg(F.avg(amount).alias(name))


def unique_count(df: DataFrame, key: str, name: str = "Unique", approx: float | None = None):
    """Distinct non-null keys; give ``approx`` (relative error) for a sketch instead."""
    require_columns(df, [key])
    count = F.approx_count_distinct(key, approx) if approx else F.count_distinct(key)
    return df.agg(count.alias(name))


def totals(df: DataFrame, sums: dict[str, str], means: dict[str, str] | None = None,
           distinct: dict[str, str] | None = None) -> DataFrame:
    """Several of the three figures above by result name, from one pass over the table."""
    require_columns(df, [*sums.values(), *(means or {}).values(), *(distinct or {}).values()])
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()],
                  *[F.avg(c).alias(n) for n, c in (means or {}).items()],
                  *[F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()])


def sum_by(df: DataFrame, keys, amount: str, name: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    require_columns(df, [*keys, amount])
    return df.dropna(subset=keys).groupBy(*keys).agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias(name))


def mean_by(df: DataFrame, keys, amount: str, name: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    require_columns(df, [*keys, amount])
    return df.dropna(subset=keys).groupBy(*keys).agg(F.avg(amount).alias(name))


def daily_sales(df, date="INVDT", amount="NET_AMT"):
    return sum_by(df, date, amount, "Daily_Sales")


def monthly_sales(df, year="year", month="month", amount="NET_AMT"):
    return sum_by(df, [year, month], amount, "Monthly_Sales")


def yearly_sales(df, year="year", amount="NET_AMT"):
    return sum_by(df, year, amount, "Yearly_Sales")


def customer_sales(df, customer="CCODE", amount="NET_AMT"):
    return sum_by(df, customer, amount, "Customer_Sales")


def average_customer_order(df, customer="CCODE", amount="NET_AMT"):
    return mean_by(df, customer, amount, "Average_Order_Value")


def product_sales(df, product="MDCODE", amount="NET_AMT"):
    return sum_by(df, product, amount, "Product_Sales")


def daily_purchase(df, date="PINVDT", amount="Purchase_Value"):
    return sum_by(df, date, amount, "Daily_Purchase")


def monthly_purchase(df, year="year", month="month", amount="Purchase_Value"):
    return sum_by(df, [year, month], amount, "Monthly_Purchase")


def yearly_purchase(df, year="year", amount="Purchase_Value"):
    return sum_by(df, year, amount, "Yearly_Purchase")


def supplier_purchase(df, supplier="SUPNO", amount="Purchase_Value"):
    return sum_by(df, supplier, amount, "Supplier_Purchase")


def average_supplier_order(df, supplier="SUPNO", amount="Purchase_Value"):
    return mean_by(df, supplier, amount, "Average_Supplier_Order")


def medicine_purchase(df, product="MDCODE", amount="Purchase_Value"):
    return sum_by(df, product, amount, "Medicine_Purchase")


def top_by_sum(df: DataFrame, key: str, amount: str, name: str, n: int = 10) -> DataFrame:
    """Top n keys by total, ties by key; runs as a bounded top-k, not a full sort."""
    return sum_by(df, key, amount, name).orderBy(F.col(name).desc(), key).limit(n)


def top_selling_products(df, product="MDCODE", qty="QTY", top_n=10):
    return top_by_sum(df, product, qty, "Quantity_Sold", top_n)


def top_purchased_medicines(df, product="MDCODE", qty="QTY", top_n=10):
    return top_by_sum(df, product, qty, "Quantity_Purchased", top_n)


def growth(periodic: DataFrame, order: list[str], amount: str, name: str = "Growth_Pct",
           rounded: bool = True) -> DataFrame:
    """Change against the previous period. Input holds one row per period (calendar-bounded), so
    the unpartitioned window sorts a few hundred rows."""
    w = W.orderBy(*order)
    prev = F.lag(amount).over(w)
    change = growth_rate(F.col(amount), prev) if rounded else pct(F.col(amount) - prev, prev, 0.0)
    return periodic.withColumn("Previous", prev).withColumn(name, change)


def contribution(df: DataFrame, key: str, amount: str, name: str = "Contribution_Pct",
                 rounded: bool = True) -> DataFrame:
    """Share of the grand total per key."""
    per_key = sum_by(df, key, amount, "Amount")
    whole = df.dropna(subset=[key]).agg(F.sum(amount).alias("t")).scalar()
    share = rate(F.col("Amount"), whole) if rounded else pct(F.col("Amount"), whole, 0.0)
    return per_key.withColumn(name, share)


def order_kpis(lines: DataFrame, order="INVNO", customer="CCODE", qty="QTY", amount="LINE_AMT",
               returned="RETURNED", day="INVDT", decimals: int | None = 2) -> DataFrame:
    """Ratios of a sales table in one row: order value, items, repeat buyers, returns, per-day and
    per-customer sales.

    Lines combine to orders, orders to one row per customer and one per day (a two-way tag instead of
    two passes), and those to the totals.
    """
    orders = lines.groupBy(order).agg(
        F.first(customer, ignorenulls=True).cast("string").alias("customer"),
        F.first(day, ignorenulls=True).cast("string").alias("day"),
        F.coalesce(F.sum(qty), F.lit(0.0)).alias("qty"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"),
        F.max(F.when(F.col(returned), 1).otherwise(0)).alias("returned"),
    )
    tag = F.inline(F.array(
        F.struct(F.lit("customer").alias("kind"), F.col("customer").alias("key")),
        F.struct(F.lit("day").alias("kind"), F.col("day").alias("key"))))
    keys = orders.select(order, "qty", "amount", "returned", tag).groupBy("kind", "key").agg(
        F.count(order).alias("orders"), F.sum("qty").alias("qty"),
        F.sum("amount").alias("amount"), F.sum("returned").alias("returned"))
    buyer = F.col("kind") == "customer"
    known = F.col("key").isNotNull()
    of = lambda c: F.sum(F.when(buyer, F.col(c)))
    t = keys.agg(
        of("orders").alias("Total_Orders"), of("qty").alias("Total_Quantity"),
        of("amount").alias("Total_Sales"), of("returned").alias("Returned_Orders"),
        F.count_if(~buyer & known).alias("Sales_Days"),
        F.count_if(buyer & known).alias("Total_Customers"),
        F.count_if(buyer & known & (F.col("orders") > 1)).alias("Repeat_Customers"))
    of_two = lambda n, d: ratio(F.col(n), F.col(d), decimals)
    return t.withColumns({
        "Average_Order_Value": of_two("Total_Sales", "Total_Orders"),
        "Average_Items_Per_Order": of_two("Total_Quantity", "Total_Orders"),
        "Sales_Per_Customer": of_two("Total_Sales", "Total_Customers"),
        "Sales_Per_Day": of_two("Total_Sales", "Sales_Days"),
        "Return_Rate": rate(F.col("Returned_Orders"), F.col("Total_Orders"), decimals),
        "Repeat_Customer_Rate": rate(F.col("Repeat_Customers"), F.col("Total_Customers"), decimals),
    })


def margin_kpis(lines: DataFrame, revenue: str, cost: str, keys: list[str],
                decimals: int | None = 2) -> DataFrame:
    """Revenue, cost, profit and margin per key."""
    return lines.groupBy(*keys).agg(
        F.coalesce(F.sum(revenue), F.lit(0.0)).alias("Revenue"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("Cost"),
    ).withColumn("Profit", F.col("Revenue") - F.col("Cost")).withColumn(
        "Profit_Margin", profit_margin(F.col("Profit"), F.col("Revenue"), decimals))


def average_unit_cost(df: DataFrame, qty="QTY", amount="Purchase_Value", decimals: int | None = 2) -> DataFrame:
    return df.agg(ratio(F.sum(amount), F.sum(qty), decimals).alias("Average_Unit_Cost"))


def average_order_value(df: DataFrame, order: str, amount: str, decimals: int | None = 2) -> DataFrame:
    return df.agg(ratio(F.sum(amount), F.count_distinct(order), decimals).alias("Average_Order_Value"))


def inventory_value(df: DataFrame, qty: str, unit_cost: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col(qty) * F.col(unit_cost)), F.lit(0.0)).alias(
        "Inventory_Value"))


def inventory_kpis(inventory: DataFrame, sold_qty: F.Column | float, cost_of_goods: F.Column | float,
                   dead_days: int = 0, decimals: int | None = 2) -> DataFrame:
    """Stock totals and item rates from the inventory table in one pass.

    ``sold_qty`` and ``cost_of_goods`` come from the sales side, as numbers or scalar subqueries.
    """
    sold = sold_qty if isinstance(sold_qty, F.Column) else F.lit(float(sold_qty))
    cogs = cost_of_goods if isinstance(cost_of_goods, F.Column) else F.lit(float(cost_of_goods))
    out = inventory.agg(
        F.count("*").alias("Total_Items"),
        F.coalesce(F.sum("SOH"), F.lit(0.0)).alias("Total_Stock"),
        F.avg("SOH").alias("Average_Stock"),
        F.coalesce(F.sum("Inventory_Value"), F.lit(0.0)).alias("Inventory_Value"),
        F.avg("Inventory_Value").alias("Average_Inventory_Value"),
        F.count_if(F.col("Reorder_Flag")).alias("Reorder_Items"),
        F.count_if(F.col("Stock_Status") == "Low Stock").alias("Low_Stock_Items"),
        F.count_if(F.col("Stock_Status") == "Out Of Stock").alias("Stock_Out_Items"),
        F.count_if(F.col("Days_To_Expiry") <= dead_days).alias("Dead_Stock_Items"),
    ).withColumns({"Sold_Quantity": sold, "Cost_Of_Goods": cogs})
    n = F.col("Total_Items")
    return out.withColumns({
        "Reorder_Rate": rate(F.col("Reorder_Items"), n, decimals),
        "Low_Stock_Rate": rate(F.col("Low_Stock_Items"), n, decimals),
        "Stock_Out_Rate": rate(F.col("Stock_Out_Items"), n, decimals),
        "Dead_Stock_Rate": rate(F.col("Dead_Stock_Items"), n, decimals),
        "Stock_Utilization": rate(F.col("Sold_Quantity"), F.col("Total_Stock"), decimals),
        "Stock_Availability": rate(F.col("Total_Stock"), F.col("Sold_Quantity"), decimals),
        "Inventory_Turnover": inventory_turnover(
            F.col("Cost_Of_Goods"), F.col("Average_Inventory_Value"), decimals),
    }).withColumn("Days_Of_Inventory", days_of_inventory(F.col("Inventory_Turnover"), decimals))
