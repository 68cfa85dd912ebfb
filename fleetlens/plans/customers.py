"""Customer revenue (Q39-Q45)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import COUNT, period, ratio
from fleetlens.operators import (
    in_latest_period,
    period_delta,
    share_of_total,
    sort_key,
    top_dense_rank,
)
from fleetlens.plans.registry import report
from fleetlens.sources import Tables


def customer_revenue(
    t: Tables, unit: str | None = None, with_name: bool = False, loads: DataFrame | None = None
) -> DataFrame:
    """Revenue, load count and revenue count per customer (and load period).

    Loads are aggregated per customer (and period) before the join to the
    customer table, so each map task sends at most one row per customer and
    period and a hot customer's loads never meet in one task. The result is
    aggregated again by the report keys, which keeps the semantics of joining
    first even if a customer id repeated.
    """
    loads = loads if loads is not None else t.loads
    cust_cols = ["customer_id"] + (["customer_name"] if with_name else [])
    customers = t.customers.select(*cust_cols)
    periods = [period("load_date", unit).alias(unit)] if unit else []
    pre = loads.groupBy("customer_id", *periods).agg(
        F.sum("revenue").alias("rev"),
        F.count("load_id").alias("n_loads"),
        F.count("revenue").alias("n_rev"),
    )
    keys = [*cust_cols, unit] if unit else cust_cols
    return pre.join(customers, "customer_id").groupBy(*keys).agg(
        F.sum("rev").alias("revenue"),
        F.sum("n_loads").alias("n_loads"),
        F.sum("n_rev").alias("n_rev"),
    )


@report("customer_revenue", 39, "Total revenue per customer")
def customer_revenue_total(t: Tables) -> DataFrame:
    out = customer_revenue(t).select("customer_id", F.round("revenue", 2).alias("total_revenue"))
    return out.orderBy(sort_key("total_revenue", True), F.col("customer_id").asc_nulls_last())


@report("customer_revenue_per_load", 40, "Average revenue per load per customer")
def customer_revenue_per_load(t: Tables) -> DataFrame:
    agg = customer_revenue(t, with_name=True)
    return agg.select(
        "customer_id",
        "customer_name",
        F.col("n_loads").alias("total_loads"),
        F.round("revenue", 2).alias("total_revenue"),
        ratio(F.col("revenue"), F.col("n_rev"), 2, den_type=COUNT).alias("revenue_per_load"),
    ).orderBy(sort_key("revenue_per_load", True), F.col("customer_id").asc_nulls_last())


def _monthly_change(t: Tables, with_name: bool) -> DataFrame:
    monthly = customer_revenue(t, "month", with_name=with_name).select(
        "customer_id", *(["customer_name"] if with_name else []), "month", F.col("revenue").alias("cur")
    )
    return period_delta(monthly, ["customer_id"], "month", "cur", "prev", keep_first=False)


@report("customer_revenue_mom", 41, "Month-over-month revenue per customer")
def customer_revenue_mom(t: Tables) -> DataFrame:
    out = _monthly_change(t, with_name=False)
    return out.select(
        "customer_id",
        "month",
        F.round("prev", 2).alias("prev_month_revenue"),
        F.round("cur", 2).alias("current_month_revenue"),
        F.round(F.col("cur") - F.col("prev"), 2).alias("revenue_trend"),
    ).orderBy(F.col("customer_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("customer_top5_quarter", 42, "Top 5 customers by revenue in each quarter")
def customer_top5_quarter(t: Tables) -> DataFrame:
    quarterly = customer_revenue(t, "quarter", with_name=True)
    # Ranked on the unrounded revenue, reported rounded.
    top = top_dense_rank(quarterly, "revenue", "quarterly_rank", 5, ["quarter"])
    return top.select(
        "customer_id",
        "customer_name",
        "quarter",
        F.round("revenue", 2).alias("quarterly_revenue"),
        "quarterly_rank",
    ).orderBy(F.col("quarter").asc_nulls_last(), sort_key("quarterly_revenue", True), F.col("customer_id").asc_nulls_last())


@report("customer_revenue_share", 43, "Customer share of total revenue")
def customer_revenue_share(t: Tables) -> DataFrame:
    per_customer = customer_revenue(t, with_name=True)
    shares = share_of_total(per_customer, "revenue", "grand", "customer_revenue_percentage")
    return shares.select(
        "customer_id",
        "customer_name",
        F.round("revenue", 2).alias("customer_revenue"),
        F.round("grand", 2).alias("total_revenue"),
        "customer_revenue_percentage",
    ).orderBy(sort_key("customer_revenue_percentage", True), F.col("customer_id").asc_nulls_last())


@report("customer_revenue_growth", 44, "Month-over-month revenue growth rate per customer")
def customer_revenue_growth(t: Tables) -> DataFrame:
    out = _monthly_change(t, with_name=True)
    cur, prev = F.col("cur"), F.col("prev")
    return out.select(
        "customer_id",
        "customer_name",
        "month",
        F.round(prev, 2).alias("prev_month_revenue"),
        F.round(cur, 2).alias("current_month_revenue"),
        F.round(cur - prev, 2).alias("revenue_trend"),
        ratio(cur - prev, prev, 2, pct=True).alias("revenue_growth_percentage"),
    ).orderBy(F.col("customer_id").asc_nulls_last(), F.col("month").asc_nulls_last())


@report("customer_top_year", 45, "Top customer by revenue in the latest year")
def customer_top_year(t: Tables) -> DataFrame:
    # The latest year is taken from all loads and applied before aggregation.
    recent = in_latest_period(t.loads, "load_date", "year", t.dated("loads"))
    yearly = customer_revenue(t, "year", with_name=True, loads=recent)
    top = top_dense_rank(yearly, "revenue", "yearly_rank", 1)
    return top.select(
        "customer_id",
        "customer_name",
        "year",
        F.round("revenue", 2).alias("yearly_revenue"),
        "yearly_rank",
    ).orderBy(F.col("customer_id").asc_nulls_last(), "customer_name")
