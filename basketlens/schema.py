"""Canonical column names, source-name mapping, labels and parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

# --- fixed values: export column names and their canonical names ----------
# The webshop export uses these header names; the left side must stay exactly
# as the export writes it, the right side is our snake-case name.
SOURCE_TO_CANONICAL = {
    "Order Number": "order_number",
    "Order Date": "order_date",
    "Customer Note": "customer_note",
    "Order Status": "order_status",
    "City (Billing)": "city",
    "Email (Billing)": "email",
    "Order Shipping Amount": "order_shipping_amount",
    "Shipping Method Title": "shipping_method_title",
    "Order Line Total (include tax)": "line_total",
    "Order Refund Amount": "refund_amount",
    "Payment Method Title": "payment_method_title",
    "Customer Total Spent": "customer_total_spent",
    "Customer Total Orders": "customer_total_orders",
    "Customer first order date": "customer_first_order",
    "Customer last order date": "customer_last_order",
    "SKU": "sku",
    "Item ID": "item_id",
    "Item Name": "item_name",
    "Product Id": "product_id",
    "Short Description": "short_description",
    "Description": "description",
    "Type": "type",
    "Quantity": "quantity",
    "Stock Quantity": "stock_quantity",
    "Stock Status": "stock_status",
    "Item Discount Amount": "discount_amount",
    "Coupon Code": "coupon_code",
    "Full names for categories": "category_path",
    "Category": "category",
    "Gender (Billing)": "gender",
    "Origin": "origin",
    # personal columns known to the anonymiser
    "First Name (Billing)": "first_name",
    "Last Name (Billing)": "last_name",
    "First Name (Shipping)": "first_name_shipping",
    "Last Name (Shipping)": "last_name_shipping",
    "Phone (Billing)": "phone_billing",
    "Phone (Shipping)": "phone_shipping",
    "Address 1&2 (Billing)": "address_billing",
    "State Code (Billing)": "state_code_billing",
    "Postcode (Billing)": "postcode_billing",
    "Country Code (Billing)": "country_code_billing",
    "Address 1&2 (Shipping)": "address_shipping",
    "State Code (Shipping)": "state_code_shipping",
    "Postcode (Shipping)": "postcode_shipping",
    "Country Code (Shipping)": "country_code_shipping",
}

# Columns the analyser keeps, in the export's order (canonical names).
KEEP_COLUMNS = [
    "order_number", "order_date", "customer_note", "order_status",
    "city", "email",
    "order_shipping_amount", "shipping_method_title",
    "line_total", "refund_amount",
    "payment_method_title", "customer_total_spent", "customer_total_orders",
    "customer_first_order", "customer_last_order",
    "sku", "item_id", "item_name", "product_id", "short_description", "description",
    "type", "quantity", "stock_quantity", "stock_status",
    "discount_amount", "coupon_code",
    "category_path", "category", "gender", "origin",
]

# Personal columns dropped by the anonymiser (absent ones are ignored).
PII_COLUMNS = [
    "first_name", "last_name",
    "first_name_shipping", "last_name_shipping",
    "phone_billing", "phone_shipping",
    "address_billing", "state_code_billing", "postcode_billing", "country_code_billing",
    "address_shipping", "state_code_shipping", "postcode_shipping", "country_code_shipping",
]

# Money columns coerced to numbers (unparsable or null -> 0).
MONEY_COLUMNS = ["line_total", "refund_amount", "discount_amount"]
# Columns every revenue report needs; missing ones fail early with a message.
REQUIRED_COLUMNS = ["order_number", "order_date", "order_status", *MONEY_COLUMNS]

# Optional line ordinal ("file order"); "first" aggregates use it.
LINE_ORDINAL = "line_no"

MONEY_TYPE = "decimal(28,6)"

# --- fixed values: report labels (Hungarian, as the shop reports print) ----
COMPLETED_STATUS = "Teljesítve"
REST_LABEL = "Minden más"          # "everything else" row of category shares
OTHER_LABEL = "Egyéb"              # folded small origins
GENDER_MALE = "Férfi"
GENDER_FEMALE = "Nő"
GENDER_UNKNOWN = "Ismeretlen"
FEMALE_NAME_MARK = "ne"            # normalised form of the "-né" married-name suffix
MASK_DOMAIN = "@masked.com"

SEGMENT_LOYAL = "Hűséges vásárlók (gyakran visszatérnek és magas költéssel)"
SEGMENT_VIP = "Magas értékű vásárlók (VIP szegmens)"
SEGMENT_NEW = "Új vásárlók (első vásárlás)"
SEGMENT_INACTIVE = "Inaktív vásárlók (hosszabb ideje nem vásároltak)"
SEGMENT_OCCASIONAL = "Alkalmi vásárlók (ritkán vásárlók)"

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@dataclass(frozen=True)
class Params:
    """Report parameters. Defaults reproduce the reference behaviour."""

    completed_status: str = COMPLETED_STATUS
    # Pattern for text dates (Spark datetime pattern, e.g. "yyyy.MM.dd HH:mm");
    # None parses ISO-like text, "infer" finds each column's best pattern first.
    # Text that does not match becomes null.
    date_format: str | None = None
    # Reference clock. None means "now" (current_timestamp at query time).
    as_of: dt.datetime | None = None
    recent_years: int = 2
    top_categories: int = 8
    top_products: int = 8
    top_regions: int = 4
    rest_label: str = REST_LABEL
    other_label: str = OTHER_LABEL
    share_threshold: float = 1.0
    origin_min_year: int = 2024
    trailing_days: int = 365
    high_quantile: float = 0.8
    low_quantile: float = 0.2
    low_stock_days: float = 7.0
    excess_stock_days: float = 90.0
    head_rows: int = 10
    approx_quantiles: bool = False      # percentile_approx instead of exact
    approx_accuracy: int = 100_000
    # customer segments
    k: int = 4
    seed: int = 42
    max_iter: int = 300
    tol: float = 1e-4                   # scikit-learn style (relative), see segments.segment
    starts: int = 2                     # starts of k-means, of which the one of least inertia is kept
    loyal_min_orders: float = 5
    loyal_min_spent: float = 50_000
    vip_min_spent: float = 100_000
    new_orders: float = 1
    inactive_days: float = 180
    dedupe_customer_totals: bool = False   # reference sums stored totals per line
    # anonymiser
    mask_digits: int = 10
    mask_salt: str = ""

    def __post_init__(self) -> None:
        positive = {"recent_years": self.recent_years, "top_categories": self.top_categories,
                    "top_products": self.top_products, "top_regions": self.top_regions,
                    "head_rows": self.head_rows, "k": self.k, "max_iter": self.max_iter,
                    "trailing_days": self.trailing_days, "mask_digits": self.mask_digits}
        bad = [name for name, v in positive.items() if v < 1]
        bad += [name for name in ("high_quantile", "low_quantile") if not 0.0 <= getattr(self, name) <= 1.0]
        bad += [name for name in ("low_stock_days", "excess_stock_days", "tol") if getattr(self, name) < 0]
        if self.mask_digits > 64:
            bad.append("mask_digits")
        if bad:
            raise ValueError(f"invalid report parameters: {sorted(bad)}")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
