"""Customer segments (R11, R12): features, standardisation, k-means, naming."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double, days_between, sum0, timestamp_literal
from basketlens.functions.materialise import reliable
from basketlens.operators import kmeans
from basketlens.schema import (
    SEGMENT_INACTIVE, SEGMENT_LOYAL, SEGMENT_NEW, SEGMENT_OCCASIONAL, SEGMENT_VIP, Params,
)

ROWS_PER_TASK = 100_000      # customers that a task of a k-means step has at least, where there are so many

ACTIVE_FEATURES = ["total_orders", "total_spent", "recency_days", "order_frequency"]
ALL_FEATURES = [*ACTIVE_FEATURES, "lifetime_days"]


def customer_features(lines: DataFrame, params: Params = Params(), variant: str = "active") -> DataFrame:
    """A21/A22 + P15-P17 (+ F4 for ``active``): one row per e-mail.

    ``active``: Σ stored order counts, Σ line revenue, customers whose last
    order is at most ``trailing_days`` old. ``all``: Σ stored counts and Σ
    stored spend for every customer, plus lifetime. Stored totals repeat on
    every line and are summed per line as the reference does; set
    ``dedupe_customer_totals`` to take them once (max) instead.
    """
    if variant not in ("active", "all"):
        raise ValueError("variant must be 'active' or 'all'")
    take = F.max if params.dedupe_customer_totals else sum0
    spent = sum0("line_revenue") if variant == "active" else take("customer_total_spent")
    agg = (lines.filter(F.col("email").isNotNull()).groupBy("email").agg(
        take("customer_total_orders").cast("long").alias("total_orders"),
        as_double(spent).alias("total_spent"),
        F.min("customer_first_order").alias("first_order"),
        F.max("customer_last_order").alias("last_order")))
    return with_recency(agg, params, variant)


def with_recency(agg: DataFrame, params: Params, variant: str) -> DataFrame:
    """F4 and P15-P17 on totals and order dates per e-mail."""
    as_of = timestamp_literal(params.as_of)
    if variant == "active":
        agg = agg.filter(F.col("last_order") >= as_of - F.make_dt_interval(F.lit(params.trailing_days)))
    out = agg.withColumns({
        "recency_days": days_between(as_of, F.col("last_order")),
        "order_frequency": F.col("total_orders") / F.lit(365.0),
    })
    if variant == "all":
        out = out.withColumn("lifetime_days", days_between(F.col("last_order"), F.col("first_order")))
    return out


def scale_features(features: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """M1: (x - mean) / population std per column; constant (or single) -> 0.

    All means and deviations come from one aggregate, inlined as a single
    struct-valued scalar subquery (computed once), so nothing is collected.
    """
    stats = []
    for c in cols:
        stats += [F.avg(as_double(c)).alias(f"m_{c}"), F.stddev_pop(as_double(c)).alias(f"s_{c}")]
    sq = features.agg(*stats).select(F.struct(*[F.col(f"{p}_{c}") for c in cols for p in "ms"])).scalar()
    df = features.withColumn("_st", sq)     # one subquery (one job), read per column below
    out = {}
    for c in cols:
        x, mean, std = as_double(c), F.col(f"_st.m_{c}"), F.col(f"_st.s_{c}")
        out[c + suffix] = F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))
    return df.withColumns(out).drop("_st")


def segment_label(orders: Column, spent: Column, recency: Column, params: Params = Params()) -> Column:
    """M3: the naming rule, first match wins."""
    return (F.when((orders > params.loyal_min_orders) & (spent > params.loyal_min_spent), SEGMENT_LOYAL)
            .when(spent > params.vip_min_spent, SEGMENT_VIP)
            .when(orders == params.new_orders, SEGMENT_NEW)
            .when(recency > params.inactive_days, SEGMENT_INACTIVE)
            .otherwise(SEGMENT_OCCASIONAL))


def customer_activity(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """Distinct orders, Σ line revenue and days since the last order per e-mail, named by M3.

    Two-level aggregation (e-mail, order) -> e-mail instead of countDistinct.
    """
    per_order = (lines.filter(F.col("email").isNotNull())
                 .groupBy("email", "order_number")
                 .agg(F.sum("line_revenue").alias("revenue"), F.max("order_date").alias("last_date")))
    per_cust = per_order.groupBy("email").agg(
        F.count("order_number").alias("total_orders"),
        as_double(sum0("revenue")).alias("total_spent"),
        F.max("last_date").alias("last_order"))
    per_cust = per_cust.withColumn("recency_days", days_between(timestamp_literal(params.as_of), F.col("last_order")))
    return per_cust.withColumn("segment", segment_label(F.col("total_orders"), F.col("total_spent"),
                                                        F.col("recency_days"), params))


@dataclass
class Segmentation:
    assignments: DataFrame     # one row per customer with its cluster
    summary: DataFrame         # one row per cluster, named
    dropped: int               # customers left out for null features
    k: int
    coverage: DataFrame        # one row: customers, left_out, k
    fit: kmeans.Fit | None = None       # centres and inertia in millionths of a deviation
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def segment(features: DataFrame, cols: list[str], params: Params = Params()) -> Segmentation:
    """M1 + M2 + A23 + M3: standardise, k-means, summarise, name.

    Fitting runs Spark jobs (the one place an operator acts). Rows with a null
    feature are dropped and counted; k shrinks to the customer count. The fit
    (``kmeans.fit``) does not depend on how rows are dealt; clusters are
    numbered in the order of their centres, and the summary names each from
    its means. ``params.tol`` is scikit-learn's: squared centre shifts may add
    up to ``tol`` times the mean variance of the standardised features.
    """
    complete_flag = F.lit(True)
    for c in cols:
        complete_flag = complete_flag & F.col(c).isNotNull()
    base = reliable(features.withColumn("_complete", complete_flag))      # the only pass over the lines
    done = F.col("_complete")
    counts = base.agg(F.count_if(done).alias("n"), F.count_if(~done).alias("dropped"),
                      *[F.stddev_pop(F.when(done, F.col(c).cast("double"))).alias(c) for c in cols]).first()
    n, dropped = counts["n"], counts["dropped"]
    complete = base.filter(F.col("_complete")).drop("_complete")
    k = min(params.k, n)
    coverage = base.agg(F.count(F.lit(1)).alias("customers"), F.count_if(~done).alias("left_out"), F.lit(k).alias("k"))
    if k < 1:
        empty = features.sparkSession.createDataFrame([], _summary_schema(cols))
        return Segmentation(complete.withColumn("cluster", F.lit(None).cast("int")), empty, dropped, 0, coverage, cached=[base])
    scaled = scale_features(complete, cols)
    ucols = [c + "_u" for c in cols]
    points = scaled.select(*complete.columns, *[kmeans.units(F.col(c + "_z")).alias(u) for c, u in zip(cols, ucols)])
    varying = sum(1 for c in cols if (counts[c] or 0) > 0)
    tol = params.tol * varying / len(cols) * kmeans.UNIT * kmeans.UNIT
    # Every step reads the points, a task per partition: few customers are put into few partitions.
    held = points.select("email", *ucols).coalesce(n // ROWS_PER_TASK + 1).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = kmeans.fit(held, "email", ucols, k, params.seed, params.starts, params.max_iter, tol)
    finally:
        held.unpersist()
    assigned = points.withColumn("cluster", kmeans.nearest(ucols, fit.centres)).drop(*ucols)
    return Segmentation(assigned, cluster_summary(assigned, cols, params), dropped, k, coverage, fit, [base])


def _summary_schema(cols: list[str]) -> str:
    return ", ".join(["cluster int", *[f"{c} double" for c in cols], "customers long", "segment string"])


def cluster_summary(assigned: DataFrame, cols: list[str], params: Params = Params()) -> DataFrame:
    """A23 + M3: feature means and customer count per cluster, named by the rule."""
    summary = assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols],
                                              F.count("email").alias("customers"))
    return summary.withColumn("segment", segment_label(F.col("total_orders"), F.col("total_spent"),
                                                       F.col("recency_days"), params))


def segment_check(seg: Segmentation) -> DataFrame:
    """One row on a segmentation: customers, left_out, k, clustered (Σ cluster sizes) and inertia (Σ whole squared
    distances to the nearest centre, in squared millionths of a deviation)."""
    sizes = seg.assignments.agg(F.count("cluster").alias("clustered"))
    return seg.coverage.crossJoin(F.broadcast(sizes)).select(      # one row each
        "customers", "left_out", F.col("k").cast("int").alias("k"), "clustered", F.lit(float(seg.fit.inertia) if seg.fit else 0.0).alias("inertia"))


def rule_summary(activity: DataFrame) -> DataFrame:
    """A23 over the customers as M3 names them: means (four decimals, half-even) and customer count by segment."""
    return activity.groupBy("segment").agg(*[F.bround(F.avg(c), 4).alias(c) for c in ("total_orders", "recency_days")],
                                           F.count("email").alias("customers"))


def assignments_view(assigned: DataFrame) -> DataFrame:
    """M4: the scatter-plot data (spent, frequency, cluster) per customer."""
    return assigned.select("email", "total_spent", "order_frequency", "cluster")
