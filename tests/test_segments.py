import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens import Params
from basketlens.operators import segments
from basketlens.schema import SEGMENT_INACTIVE, SEGMENT_LOYAL, SEGMENT_NEW, SEGMENT_OCCASIONAL, SEGMENT_VIP

AS_OF = dt.datetime(2024, 6, 1)


def features(spark, n, constant=False):
    rows = []
    for i in range(n):
        rows.append((f"c{i}@x", 1 if constant else i % 4 + 1, float(1000 * (i + 1)),
                     i * 10, (1 if constant else i % 4 + 1) / 365.0))
    return spark.createDataFrame(rows, "email string, total_orders long, total_spent double, "
                                       "recency_days long, order_frequency double")


@pytest.mark.parametrize("n", [0, 2, 5, 40])
def test_segment_counts(spark, n):
    seg = segments.segment(features(spark, n), segments.ACTIVE_FEATURES, Params())
    summary = seg.summary.collect()
    assert seg.k == min(4, n)
    assert len(summary) <= 4
    assert sum(r["customers"] for r in summary) == n
    assert seg.assignments.count() == n


def test_constant_feature_scales_to_zero(spark):
    df = segments.scale_features(features(spark, 6, constant=True), ["total_orders"])
    assert {r["total_orders_z"] for r in df.collect()} == {0.0}


def test_scaling_population_std(spark):
    df = segments.scale_features(features(spark, 5), ["total_spent"])
    got = sorted(r["total_spent_z"] for r in df.collect())
    x = np.array([1000.0 * (i + 1) for i in range(5)])
    want = sorted((x - x.mean()) / x.std())
    assert np.allclose(got, want)


def test_every_customer_nearest_centre(spark):
    feats = features(spark, 40)
    cols = segments.ACTIVE_FEATURES
    seg = segments.segment(feats, cols, Params())
    scaled = segments.scale_features(feats, cols).select("email", *[c + "_z" for c in cols])
    a = seg.assignments.join(scaled, "email").toPandas()
    z = a[[c + "_z" for c in cols]].to_numpy()
    centres = np.array([z[a["cluster"] == k].mean(axis=0) for k in sorted(a["cluster"].unique())])
    labels = sorted(a["cluster"].unique())
    nearest = [labels[int(np.argmin(((centres - row) ** 2).sum(axis=1)))] for row in z]
    # Lloyd's fixed point: each point sits in the cluster of its nearest centroid
    assert (np.array(nearest) == a["cluster"].to_numpy()).mean() == 1.0
    # A23 recomputed from the assignment table agrees with the summary
    summ = {r["cluster"]: r for r in seg.summary.collect()}
    for k in labels:
        assert abs(summ[k]["total_spent"] - a.loc[a["cluster"] == k, "total_spent"].mean()) < 1e-6


def test_null_features_dropped_and_counted(spark):
    df = features(spark, 6).withColumn("recency_days", F.when(F.col("email") == "c0@x", None)
                                       .otherwise(F.col("recency_days")))
    seg = segments.segment(df, segments.ACTIVE_FEATURES, Params())
    assert seg.dropped == 1 and seg.assignments.count() == 5


def test_segment_rule_all_branches(spark):
    rows = [(6, 60000.0, 10), (2, 150000.0, 10), (1, 10.0, 10), (3, 10.0, 200), (3, 10.0, 10)]
    df = spark.createDataFrame(rows, "o long, s double, r long")
    got = [r[0] for r in df.select(segments.segment_label(F.col("o"), F.col("s"), F.col("r"))).collect()]
    assert got == [SEGMENT_LOYAL, SEGMENT_VIP, SEGMENT_NEW, SEGMENT_INACTIVE, SEGMENT_OCCASIONAL]


def test_customer_features_variants(spark):
    rows = [("a@x", 3, 100.0, 1000.0, dt.datetime(2023, 1, 1), dt.datetime(2024, 5, 31, 1), "1", dt.datetime(2024, 5, 1)),
            ("a@x", 3, 50.0, 1000.0, dt.datetime(2023, 1, 1), dt.datetime(2024, 5, 31, 1), "2", dt.datetime(2024, 5, 2)),
            ("b@x", 1, 10.0, 10.0, dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1), "3", dt.datetime(2021, 1, 1))]
    df = spark.createDataFrame(rows, "email string, customer_total_orders long, line_revenue double, "
                                     "customer_total_spent double, customer_first_order timestamp_ntz, "
                                     "customer_last_order timestamp_ntz, order_number string, order_date timestamp_ntz")
    p = Params(as_of=AS_OF)
    active = {r["email"]: r for r in segments.customer_features(df, p, "active").collect()}
    assert set(active) == {"a@x"}
    assert (active["a@x"]["total_orders"], active["a@x"]["total_spent"], active["a@x"]["recency_days"]) == (6, 150.0, 0)
    full = {r["email"]: r for r in segments.customer_features(df, p, "all").collect()}
    assert full["a@x"]["total_spent"] == 2000.0 and full["b@x"]["lifetime_days"] == 366
    dedup = {r["email"]: r for r in segments.customer_features(df, p.with_(dedupe_customer_totals=True), "all").collect()}
    assert dedup["a@x"]["total_orders"] == 3


def test_same_segments_whatever_the_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{i}@x", int(rng.integers(1, 9)), float(rng.lognormal(9, 1.5)), int(rng.integers(0, 400)), float(rng.random())) for i in range(700)]
    df = spark.createDataFrame(rows, "email string, total_orders long, total_spent double, recency_days long, order_frequency double")
    found = []
    for n in (3, 50):
        seg = segments.segment(df.repartition(n, F.rand(n)), segments.ACTIVE_FEATURES, Params())
        found.append((seg.fit.centres, seg.fit.inertia, sorted(map(tuple, seg.assignments.select("email", "cluster").collect()))))
        seg.release()
    assert found[0] == found[1]


def test_fit_follows_the_rule_of_its_start(spark):
    """The same k-means in plain Python, with its own hashes."""
    import hashlib
    import math

    from basketlens.operators import kmeans
    rng = np.random.default_rng(8)
    points = {f"k{i}": [int(x) for x in rng.normal(i % 3 * 4, 1, 2) * 1e6] for i in range(90)}
    points |= {"same": points["k0"], "far": [90_000_000, 0]}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, x long, y long")
    fit = kmeans.fit(df, "id", ["x", "y"], 3, seed=5, starts=2, max_iter=50, tol=0.0)

    def u(start, step, key):
        return (int(hashlib.md5(f"5:{start}:{step}:{key}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52

    def far(p, centres):
        return [(p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2 for c in centres]

    results = []
    for s in range(2):
        centres = [points[min(points, key=lambda k: u(s, 0, k))]]
        for step in (1, 2):
            centres.append(points[min((k for k in points if min(far(points[k], centres)) > 0), key=lambda k: -math.log(u(s, step, k)) / min(far(points[k], centres)))])
        for _ in range(50):
            groups = [[] for _ in centres]
            for p in points.values():
                groups[int(np.argmin(far(p, centres)))].append(p)
            new = [[sum(p[i] for p in g) / len(g) for i in (0, 1)] if g else c for g, c in zip(groups, centres)]
            if new == centres:
                break
            centres = new
        results.append((sum(math.floor(min(far(p, centres))) for p in points.values()), s, sorted(centres)))
    assert (fit.inertia, fit.centres) == (min(results)[0], min(results)[2])


def test_fewer_different_points_than_clusters(spark):
    from basketlens.operators import kmeans
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 5, 5)], "id string, x long, y long")
    fit = kmeans.fit(df, "id", ["x", "y"], 3, seed=1, starts=2, max_iter=20, tol=0.0)
    assert fit.inertia == 0 and {tuple(c) for c in fit.centres} == {(1.0, 1.0), (5.0, 5.0)}
