"""Report column headers as the shop reports print them.

Operators name columns in snake case; ``for_display`` renames a report
table's columns to the printed headers. Columns without a header keep
their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# --- fixed values: printed headers per report table (Hungarian/English as printed) ---
HEADERS: dict[str, dict[str, str]] = {
    "category_shares": {"last_category": "Kategória", "revenue": "Bevétel (Ft)", "percentage": "Arány (%)"},
    "top_products": {"item_id": "Termék ID", "item_name": "Termék név", "revenue": "Bevétel (Ft)"},
    "top_counties": {"county": "Megye", "revenue": "Bevétel (Ft)"},
    "top_cities": {"city": "Város", "revenue": "Bevétel (Ft)"},
    "low_stock_head": {"item_id": "Termék ID", "item_name": "Termék név", "quantity": "Értékesített mennyiség",
                       "daily_avg": "Átlagos napi fogyás", "stock_quantity": "Jelenlegi készlet"},
    "excess_stock_head": {"item_id": "Termék ID", "item_name": "Termék név", "quantity": "Értékesített mennyiség",
                          "daily_avg": "Átlagos napi fogyás", "stock_quantity": "Jelenlegi készlet"},
    "discount_summary": {"year": "Year", "discount_total": "Elengedett Összeg (Ft)",
                         "discounted_orders": "Kedvezményes Rendelések Száma"},
    "weekday_revenue": {"year": "Év", "weekday": "Hét napja", "revenue": "Bevétel (Ft)"},
    "hourly_revenue": {"year": "Év", "hour": "Óra", "revenue": "Bevétel (Ft)"},
    "gender_summary": {"orders": "Rendelések száma", "revenue": "Bevétel (Ft)"},
    "customer_features_active": {"email": "Customer Email", "total_orders": "Total Orders",
                                 "total_spent": "Total Spent", "first_order": "First Order Date",
                                 "last_order": "Last Order Date", "recency_days": "Order Recency",
                                 "order_frequency": "Order Frequency"},
    "customer_features_all": {"email": "Customer Email", "total_orders": "Total Orders",
                              "total_spent": "Total Spent", "first_order": "First Order Date",
                              "last_order": "Last Order Date", "recency_days": "Order Recency",
                              "order_frequency": "Order Frequency", "lifetime_days": "Customer Lifetime"},
    "cluster_summary": {"cluster": "Cluster", "total_orders": "Total Orders", "total_spent": "Total Spent",
                        "recency_days": "Order Recency", "order_frequency": "Order Frequency",
                        "lifetime_days": "Customer Lifetime", "customers": "Number of Customers"},
}


def for_display(df: DataFrame, table: str) -> DataFrame:
    """Rename ``df``'s columns to the printed headers of report ``table``."""
    mapping = {c: h for c, h in HEADERS.get(table, {}).items() if c in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df
