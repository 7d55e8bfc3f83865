"""Report-level plans must agree with the single-query catalog."""

import pytest

from basketlens.plans import catalog as C
from basketlens.plans.reports import bound_reports

SF = "/root/testdata/sf0.001"
K_MEANS = {"R11_segments_active", "R12_segments_all"}


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("report", [r for r in sorted(bound_reports(None, SF)) if r not in K_MEANS])
def test_report_outputs_match_catalog(spark, report):
    rep = bound_reports(spark, SF)[report]()
    try:
        checked = 0
        for name, df in rep.outputs.items():
            if name in C.QUERIES:
                assert rows(df) == rows(C.QUERIES[name](spark, SF)), name
                checked += 1
        assert checked >= 1
    finally:
        rep.release()


@pytest.mark.parametrize("report", sorted(K_MEANS))
def test_segment_reports_run(spark, report):
    rep = bound_reports(spark, SF)[report]()
    try:
        summary = rep.outputs["cluster_summary"].collect()
        assert 1 <= len(summary) <= 4
        assert sum(r["customers"] for r in summary) == rep.outputs["assignments"].count()
    finally:
        rep.release()


def test_bundle_matches_catalog(spark):
    from basketlens.plans.bundle import release, report_bundle
    from basketlens.sources import tables
    lines = C.lines(spark, SF, "city", "category_path", "item_id", "item_name", "quantity", "stock_quantity",
                    "email", "customer_total_orders", "customer_total_spent", "customer_first_order",
                    "customer_last_order")
    b = report_bundle(lines, tables.city_county_table(spark, SF), C.P)
    try:
        pairs = {"revenue_matrix": "revenue_matrix", "revenue_matrix_text": "revenue_matrix_text",
                 "yearly_totals": "yearly_totals", "aov_matrix": "aov_matrix", "top_products": "bundle_top_products",
                 "top_categories": "bundle_top_categories", "county_totals": "county_totals",
                 "stock_risk_counts": "stock_risk_counts"}
        for out, query in pairs.items():
            assert rows(C.finalize(b[out])) == rows(C.QUERIES[query](spark, SF)), out
        summary = b["cluster_summary"].collect()
        assert 1 <= len(summary) <= 4
    finally:
        release(b)


def test_display_headers(spark):
    from basketlens.plans.display import for_display
    df = for_display(C.QUERIES["discount_summary"](spark, SF), "discount_summary")
    assert df.columns == ["Year", "Elengedett Összeg (Ft)", "Kedvezményes Rendelések Száma"]
    same = for_display(C.QUERIES["monthly_revenue"](spark, SF), "no_such_table")
    assert same.columns == ["year", "month", "net_revenue"]
