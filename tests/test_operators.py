"""Operators on small hand tables: quantiles, ranking, cleaning, encoding, blends."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from zonecast.operators import analytics as A
from zonecast.operators import cleaning
from zonecast.operators.blend import blend, normalized_weights
from zonecast.operators.encoding import apply_encoding, fit_encoding
from zonecast.operators.folds import assign_folds, explode_training_folds
from zonecast.operators.quantiles import exact_quantiles
from zonecast.operators.ranking import global_row_number


def _np_q(vals, p):
    return float(np.quantile(np.array(vals, dtype=float), p))


@pytest.mark.parametrize("small", [100_000, 7])
def test_exact_quantiles_both_paths(spark, small):
    rng = np.random.default_rng(3)
    rows = []
    # hot group (skew), tied values, single row, constant group, NULLs, NULL key
    rows += [("hot", float(x)) for x in rng.normal(size=400).round(3)]
    rows += [("ties", float(x)) for x in [1, 1, 1, 2, 2, 3, 3, 3, 3, 9] * 3]
    rows += [("one", 5.0), ("const", 2.5), ("const", 2.5), ("const", 2.5), ("const", 2.5),
             ("const", 2.5), ("const", 2.5), ("const", 2.5), ("const", 2.5),
             ("nulls", None), ("nulls", 4.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    got = {r["k"]: r for r in exact_quantiles(df, "v", ["k"], probs, small=small).collect()}
    groups = {}
    for k, v in rows:
        if k is not None and v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vals in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(_np_q(vals, p), abs=1e-12), (k, name)


def test_exact_global_median_refinement(spark):
    vals = [float(i % 97) / 7 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_quantiles(df, "v", [], {"m": 0.5, "p9": 0.9}, small=50).first()
    assert got["m"] == pytest.approx(_np_q(vals, 0.5), abs=1e-12)
    assert got["p9"] == pytest.approx(_np_q(vals, 0.9), abs=1e-12)


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 13).alias("m")).repartition(7)
    order = [F.col("m").desc(), F.col("id").asc()]
    got = global_row_number(df, order, "rn").select("id", "rn")
    exp = df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_cleaning_rules(spark):
    rows = [(1, " qp0001 ", "  ", 2.0, None, "Sunny ", 0.1),
            (2, "qp0001", None, 3.0, 10.0, None, 0.2),
            (2, "qp0001", None, 3.0, 10.0, None, 0.2),
            (3, "qp0002", "Highway", None, 20.0, "Rainy", 0.3),
            (4, "qp0002", "Street", 4.0, None, "Foggy", None)]
    df = spark.createDataFrame(rows, "row_id long, geohash string, RoadType string, "
                                     "NumberofLanes double, Temperature double, Weather string, "
                                     "demand double")
    d = cleaning.dedup(df)
    assert d.count() == 4
    m = cleaning.fit_medians(d)
    assert m.temperature == 15.0 and m.lanes == 3  # lanes median 3.0
    out = {r["row_id"]: r for r in cleaning.clean(d, m).collect()}
    assert out[1]["RoadType"] == ""          # whitespace-only: filled first, then stripped
    assert out[2]["RoadType"] == "Unknown" and out[2]["Weather"] == "Unknown"
    assert out[1]["geohash"] == "qp0001" and out[1]["Weather"] == "Sunny"
    assert out[3]["NumberofLanes"] == 3 and out[1]["Temperature"] == 15.0


@pytest.mark.parametrize("lanes,expected", [([2.0, 3.0], 2), ([3.0, 4.0], 4), ([None, None], 1)])
def test_lane_median_half_even(spark, lanes, expected):
    df = spark.createDataFrame([(float(i), l) for i, l in enumerate(lanes)],
                               "Temperature double, NumberofLanes double")
    assert cleaning.fit_medians(df).lanes == expected


def test_missing_counts(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "a", 1.0)], "a long, b string, c double")
    got = {r["column_name"]: r["n_missing"] for r in cleaning.missing_counts(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_zone_encoding_fallbacks(spark):
    train = spark.createDataFrame(
        [("qp0001", 0.1), ("qp0001", 0.3), ("qp0002", 0.5), ("qp0102", 0.7), ("dr5000", None),
         ("dr5001", 0.9)], "geohash string, demand double")
    enc = fit_encoding(train)
    zones = {r["geohash"]: r for r in enc.zones.collect()}
    assert zones["qp0002"]["geo_std_demand"] == 0.0          # single row
    assert zones["dr5000"]["geo_mean_demand"] is None          # all-NULL demand zone
    assert zones["dr5000"]["geo_freq"] == 0
    assert zones["qp0002"]["geo_rank"] == 3 and zones["dr5000"]["geo_rank"] == 5
    score = spark.createDataFrame(
        [(1, "qp0001"), (2, "qp0003"), (3, "qp0109"), (4, "qp0999"), (5, "zz0000"), (6, "dr5000")],
        "row_id long, geohash string")
    out = {r["row_id"]: r for r in apply_encoding(score, enc).collect()}
    assert out[1]["geo_mean_demand"] == pytest.approx(0.2)
    assert out[2]["geo_mean_demand"] == pytest.approx((0.1 + 0.3 + 0.5) / 3)     # prefix 5
    assert out[3]["geo_mean_demand"] == pytest.approx(0.7)                         # prefix 4
    assert out[4]["geo_mean_demand"] == pytest.approx((0.1 + 0.3 + 0.5 + 0.7) / 4)  # prefix 3
    assert out[5]["geo_mean_demand"] == pytest.approx(enc.global_mean)             # global
    assert out[6]["geo_mean_demand"] == pytest.approx(0.9)                         # dr500 prefix
    assert out[5]["geo_rank"] == 6 and out[5]["geo_freq"] == 1.0
    assert out[5]["geo_median_demand"] == pytest.approx(enc.global_median)
    assert out[6]["geo_freq"] == 0.0


def test_rank_ties_by_geohash(spark):
    train = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "geohash string, demand double")
    z = {r["geohash"]: r["geo_rank"] for r in fit_encoding(train).zones.collect()}
    assert z == {"c": 1, "a": 2, "b": 3}


def test_oof_explode_equals_refit(spark):
    rows = [(i, f"qp00{i % 7}", float(i % 11) / 10) for i in range(120)]
    df = assign_folds(spark.createDataFrame(rows, "row_id long, geohash string, demand double"), 5)
    ex = explode_training_folds(df, 5)
    from zonecast.operators.encoding import zone_stats
    per_fold = {(r["fold"], r["geohash"]): r for r in zone_stats(ex, ["fold"]).collect()}
    for f in range(5):
        ref = {r["geohash"]: r for r in zone_stats(df.where(F.col("fold") != f)).collect()}
        for g, r in ref.items():
            got = per_fold[(f, g)]
            assert got["geo_mean_demand"] == pytest.approx(r["geo_mean_demand"])
            assert got["geo_median_demand"] == pytest.approx(r["geo_median_demand"])
            assert got["geo_std_demand"] == pytest.approx(r["geo_std_demand"])


@pytest.mark.parametrize("n,k", [(10_003, 5), (4, 5), (0, 3), (7, 1), (1000, 8)])
def test_folds_are_blocks_of_the_shuffled_rows(spark, monkeypatch, n, k):
    from zonecast.operators import folds
    monkeypatch.setattr(folds, "FEW", 20)  # so that several passes are needed
    monkeypatch.setattr(folds, "PASS_BITS", 5)
    got = {r.row_id: r.fold for r in assign_folds(spark.range(n).withColumnRenamed("id", "row_id"), k).collect()}
    order = sorted(range(n), key=lambda i: int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16))
    sizes = [n // k + (f < n % k) for f in range(k)]
    assert [got[i] for i in order] == [f for f in range(k) for _ in range(sizes[f])]


def test_blend_weights():
    assert normalized_weights(["a", "b"], None) == {"a": 0.5, "b": 0.5}
    assert normalized_weights(["a", "b", "c"], {"a": 1.0, "b": 1.0}) == {"a": 0.5, "b": 0.5, "c": 0.0}
    # weights of absent members still enter the normaliser
    assert normalized_weights(["a"], {"a": 1.0, "z": 1.0}) == {"a": 0.5}
    with pytest.raises(ValueError):
        normalized_weights([], None)


def test_blend_expression(spark):
    df = spark.createDataFrame([(0.1, 0.3)], "a double, b double")
    r = df.select(blend({"a": F.col("a"), "b": F.col("b")}, {"a": 0.6, "b": 0.4}).alias("x"),
                  blend({"a": F.col("a"), "b": F.col("b")}, None, (0.25, 0.3)).alias("c")).first()
    assert r["x"] == pytest.approx(0.18) and r["c"] == pytest.approx(0.25)


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)],
                               "x double, y double, k double")
    got = {(r["a"], r["b"]): r["r"] for r in A.correlation(df, ["x", "y", "k"]).collect()}
    assert got[("x", "k")] is None
    assert got[("x", "x")] == pytest.approx(1.0)
    assert got[("x", "y")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "demand double")
    h = {r["bin"]: r["n"] for r in A.histogram(df, "demand", 50).collect()}
    assert sum(h.values()) == 101 and max(h) == 50 and h[50] == 3


def test_hash_sample_is_deterministic(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "row_id")
    a = [r[0] for r in A.hash_sample(df, 50).collect()]
    b = [r[0] for r in A.hash_sample(df.repartition(5), 50).collect()]
    assert a == b and len(a) == 50


def test_drop_strict_and_string_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a long, b string, c double")
    assert cleaning.drop_strict(df, ["b"]).columns == ["a", "c"]
    with pytest.raises(KeyError):
        cleaning.drop_strict(df, ["zz"])
    assert cleaning.string_columns(df) == ["b"]
    aligned = cleaning.align_schema(df, ["c", "missing", "a"])
    assert aligned.columns == ["c", "missing", "a"] and aligned.first()["missing"] == 0


def test_grouped_row_number_matches_window(spark):
    from zonecast.operators.ranking import grouped_row_number
    df = spark.range(0, 400).select((F.col("id") % 3).alias("g"), F.col("id"),
                                    (F.col("id") % 17).alias("m")).repartition(5)
    order = [F.col("m").desc(), F.col("id").asc()]
    got = grouped_row_number(df, "g", order, "rn").select("g", "id", "rn")
    exp = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("rn"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_encoder_statistics_same_on_refinement_path(spark, monkeypatch):
    """A hot zone (a third of all rows) through the bucket-refinement path gives
    the same fitted statistics as the direct path."""
    import zonecast.operators.quantiles as Q
    rows = [("qp0hot", float((i * 37) % 101) / 100) for i in range(300)]
    rows += [(f"qp0{i % 9}", float((i * 13) % 29) / 50) for i in range(600)]
    train = spark.createDataFrame(rows, "geohash string, demand double")
    direct = fit_encoding(train)
    d = {r["geohash"]: r for r in direct.zones.collect()}
    monkeypatch.setattr(Q, "SMALL_GROUP", 20)
    refined = fit_encoding(train)
    for r in refined.zones.collect():
        assert r["geo_median_demand"] == pytest.approx(d[r["geohash"]]["geo_median_demand"], abs=1e-12)
        assert r["geo_rank"] == d[r["geohash"]]["geo_rank"]
    assert refined.global_median == pytest.approx(direct.global_median, abs=1e-12)


def test_impute_coerces_text_numbers(spark):
    df = spark.createDataFrame([(1, "12.5", "3"), (2, "warm", "n/a"), (3, None, "2.9")],
                               "row_id long, Temperature string, NumberofLanes string")
    out = {r["row_id"]: r for r in cleaning.impute(df, cleaning.Medians(20.0, 4)).collect()}
    assert out[1]["Temperature"] == 12.5 and out[1]["NumberofLanes"] == 3
    assert out[2]["Temperature"] == 20.0 and out[2]["NumberofLanes"] == 4
    assert out[3]["Temperature"] == 20.0 and out[3]["NumberofLanes"] == 2   # truncation


def test_medians_on_text_columns(spark):
    df = spark.createDataFrame([("10", "2"), ("x", "4"), ("30", "zz"), (None, "3")],
                               "Temperature string, NumberofLanes string")
    m = cleaning.fit_medians(df)
    assert m.temperature == 20.0 and m.lanes == 3


def test_pivot_missing_cells_are_zero(spark):
    df = spark.createDataFrame([("Highway", 8, 0.2), ("Highway", 9, 0.4), ("Street", 8, 0.1),
                                (None, 8, 0.9)], "RoadType string, hour int, demand double")
    got = {r["RoadType"]: r for r in A.pivot_mean(df, "RoadType", "hour", [8, 9, 10], "h").collect()}
    assert set(got) == {"Highway", "Street"}
    assert got["Street"]["h9"] == 0.0 and got["Highway"]["h10"] == 0.0
    assert got["Highway"]["h8"] == pytest.approx(0.2)


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("Sunny", v) for v in vals], "Weather string, demand double")
    r = A.box_stats(df, "Weather").first()
    q1, q3 = np.quantile(vals, 0.25), np.quantile(vals, 0.75)
    assert r["q1"] == q1 and r["q3"] == q3
    assert r["upper_whisker"] == 8.0 and r["lower_whisker"] == 1.0 and r["n_outliers"] == 1


def test_encoding_invariant_to_partitioning(spark):
    rows = [(i, f"qp0{i % 23:02d}", float((i * 7) % 31) / 40) for i in range(700)]
    df = spark.createDataFrame(rows, "row_id long, geohash string, demand double")
    a = {r["geohash"]: tuple(r) for r in fit_encoding(df.coalesce(1)).zones.collect()}
    b = {r["geohash"]: tuple(r) for r in
         fit_encoding(df.repartition(13, "row_id").orderBy(F.rand(3))).zones.collect()}
    assert a.keys() == b.keys()
    for g in a:
        for x, y in zip(a[g], b[g]):
            assert x == pytest.approx(y, abs=1e-12) if isinstance(x, float) else x == y


def test_all_seen_zones_never_fall_back(spark):
    rows = [(i, f"qp0{i % 11:02d}", float(i % 5) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, geohash string, demand double")
    enc = fit_encoding(df)
    out = apply_encoding(df, enc).join(enc.zones.select(
        "geohash", F.col("geo_mean_demand").alias("z")), "geohash")
    assert out.where(F.col("geo_mean_demand") != F.col("z")).count() == 0
    assert out.where(F.col("geo_rank") > enc.n_zones).count() == 0
