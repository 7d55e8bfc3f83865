"""Regional revenue (R5): city -> county lookup, county/city rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double, sum0
from basketlens.operators.ranking import top_n_per_group
from basketlens.operators.periods import in_latest_years
from basketlens.schema import Params


def regional_revenue(lines: DataFrame, cities: DataFrame, params: Params = Params()) -> DataFrame:
    """J1 + A9: Σ line revenue per (year, county, city) over the last years.

    Lines are pre-aggregated to (year, city) before the lookup join, so the
    join sees one row per year and city instead of every line; duplicate map
    rows still count a city once per row, as a line-level left join would.
    The latest years are those of orders (lines holding an order number).
    Lines without a city, or whose city has no county, drop out.
    """
    recent = in_latest_years(lines, params.recent_years, source=lines.filter(F.col("order_number").isNotNull()))
    by_city = (recent.filter(F.col("city").isNotNull())
               .groupBy("year", "city").agg(sum0("line_revenue").alias("revenue")))
    return located(by_city, cities)


def located(by_city: DataFrame, cities: DataFrame) -> DataFrame:
    """J1 on revenue per (year, city): the county of each city, once per row of the map."""
    lookup = cities.select("city", "county").filter(F.col("city").isNotNull() & F.col("county").isNotNull())
    return (by_city.join(lookup, "city")
            .groupBy("year", "county", "city").agg(F.sum("revenue").alias("revenue")))


def top_counties(regional: DataFrame, params: Params = Params()) -> DataFrame:
    """A10 + K4: top counties per year."""
    per = regional.groupBy("year", "county").agg(F.sum("revenue").alias("revenue"))
    top = top_n_per_group(per, ["year"], [F.desc("revenue"), F.asc("county")], params.top_regions)
    return top.select("year", "rank", "county", as_double("revenue").alias("revenue"))


def top_cities(regional: DataFrame, params: Params = Params()) -> DataFrame:
    """A11 + K4: top (mapped) cities per year."""
    per = regional.groupBy("year", "city").agg(F.sum("revenue").alias("revenue"))
    top = top_n_per_group(per, ["year"], [F.desc("revenue"), F.asc("city")], params.top_regions)
    return top.select("year", "rank", "city", as_double("revenue").alias("revenue"))


def county_totals(regional: DataFrame) -> DataFrame:
    """County totals over all years of the regional table."""
    return regional.groupBy("county").agg(as_double(F.sum("revenue")).alias("revenue"))
