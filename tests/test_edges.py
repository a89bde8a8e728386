"""Edge cases of scans, quantiles, folds and analytics: no caps, one behaviour at every size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.functions.geo import geohash_latlon
from zonecast.functions.temporal import with_time_features
from zonecast.operators import analytics as A
from zonecast.operators import cleaning
from zonecast.operators.encoding import fit_encoding, unseen_zones
from zonecast.operators.folds import assign_folds, mix
from zonecast.operators.quantiles import exact_quantiles
from zonecast.operators.validation import validate_submission
from zonecast.sources.readers import (literal_observations, read_observations_csv, read_submission, stream_observations_csv)

# ---- quantiles


VALUES = {
    "spread": [10.0 ** e for e in range(-150, 151)],
    "signs": [-(2.0 ** e) for e in range(-60, 60)] + [2.0 ** e for e in range(-60, 60)] + [0.0],
    "infinite": [float("-inf")] * 3 + [1.0, 2.0, 20.0, 30.0] + [float("inf")] * 2,
    "all_inf": [float("inf")] * 9,
    "ties": [5.0] * 40 + [1.0] * 3 + [9.0] * 3,
    "nan": [float("nan")] * 5 + [1.0, 2.0, 4.0],
    "tiny": [5e-324, 1e-323, 2e-323, -5e-324, 0.0],
}


@pytest.mark.parametrize("small", [100_000, 2])
def test_quantiles_agree_on_both_paths(spark, small):
    rnd = random.Random(1)
    rows = [(k, v) for k, vs in VALUES.items() for v in vs] + [("null", None)] * 3
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "m": 0.5, "q9": 0.9}
    got = {r.k: r for r in exact_quantiles(df, "v", ["k"], probs, small=small).collect()}
    assert set(got) == set(VALUES)
    for k, vs in VALUES.items():
        xs = np.sort([v for v in vs if not math.isnan(v)])
        for name, p in probs.items():
            pos = (len(xs) - 1) * p
            lo, hi = xs[math.floor(pos)], xs[math.ceil(pos)]
            want = lo if lo == hi else (math.ceil(pos) - pos) * lo + (pos - math.floor(pos)) * hi
            assert got[k][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, name)


def test_refined_quantiles_keep_a_flat_plan(spark):
    df = spark.createDataFrame([(float(i) ** 3,) for i in range(500)], "v double")
    out = exact_quantiles(df, "v", [], {"m": 0.5}, small=10)
    assert out.first()["m"] == pytest.approx((249.0 ** 3 + 250.0 ** 3) / 2)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


# ---- geohash and time


def bits_midpoint(g):
    bits = "".join(f"{'0123456789bcdefghjkmnpqrstuvwxyz'.index(c):05b}" for c in g.lower())
    lon, lat = bits[::2], bits[1::2]
    half = lambda b: (int(b, 2) + 0.5) / 2 ** len(b) if b else 0.5
    return -90 + 180 * half(lat), -180 + 360 * half(lon)


def test_geohash_of_any_length(spark):
    texts = ["qp02z1", "u4pruydqqvj", "u4pruydqqvj8", "u4pruydqqvj8p", "U4PRUYDQQVJ8PR9YC27", "s" * 40, "7", "qp0a11", "", None, "qp02z1 "]
    df = spark.createDataFrame([(t,) for t in texts], "g string")
    lat, lon = geohash_latlon(F.col("g"))
    got = df.select(lat, lon).collect()
    for t, r in zip(texts, got):
        if not t or any(c not in "0123456789bcdefghjkmnpqrstuvwxyz" for c in t.lower()):
            assert r[0] is None and r[1] is None
        else:
            assert tuple(r) == pytest.approx(bits_midpoint(t), abs=1e-12)
    one = spark.createDataFrame([(1, "u4pruydqqvj8p", 2.0, 0.5)], "row_id long, geohash string, NumberofLanes double, demand double")
    assert A.zone_map(one).count() == 1  # a long geohash stays on the map


def test_malformed_times_stay_missing(spark):
    df = spark.createDataFrame([(1, "8:15", 5), (2, "oops", 6), (3, None, None), (4, "23:59", 3), (5, "x:10", 1)], "row_id long, timestamp string, day int")
    got = {r.row_id: r for r in with_time_features(df).collect()}
    assert (got[1].is_peak_hour, got[1].time_block, got[1].is_weekend) == (1, "Morning", 1)
    assert (got[4].is_peak_hour, got[4].time_block, got[4].is_weekend) == (0, "Night", 0)
    for k in (2, 3, 5):
        assert got[k].hour is None and got[k].is_peak_hour is None and got[k].time_block is None
    assert got[3].is_weekend is None and got[2].is_weekend == 1
    rows = with_time_features(df).withColumn("demand", F.lit(1.0))
    assert {r.is_peak_hour for r in A.peak_contrast(rows).collect()} == {0, 1}


# ---- folds and sample


def test_seeds_give_unrelated_folds(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "row_id")
    both = assign_folds(ids, 5, 42).withColumnRenamed("fold", "a").withColumn("row", F.col("row_id"))
    both = both.withColumn("b", F.pmod(mix(F.col("row_id"), 43), F.lit(5)))
    cells = {(r.a, r.b): r["count"] for r in both.groupBy("a", "b").count().collect()}
    assert len(cells) == 25 and all(650 < n < 950 for n in cells.values())
    assert assign_folds(spark.createDataFrame([(None,)], "row_id long"), 5).first()["fold"] is not None


def test_sample_of_large_ids_is_spread(spark):
    ids = spark.range(0, 10 ** 11, 10 ** 11 // 20_000).select(F.col("id").alias("row_id"))
    got = sorted(r.row_id for r in A.hash_sample(ids, 1000).collect())
    parts = np.histogram(got, bins=10, range=(0, 10 ** 11))[0]
    assert len(got) == 1000 and parts.min() > 60


# ---- CSV in batch and stream


HEADER = ["geohash", "Index", "demand", "Weather", "RoadType", "day", "timestamp", "NumberofLanes", "LargeVehicles", "Landmarks", "Temperature", "extra"]
LINES = ["qp02z1,1,0.5,Sunny,Highway,48,8:15,2,Allowed,Yes,11.5,x", "qp02z2,2,NA,none,NA,48.0,9:00,n/a,#N/A N/A,null,NaN,x", "NULL,3,0.25,na,   ,oops,,1.0,None,Yes,-nan,x",
         "qp02z3,4.0,1e-1,Null,N/A N/A,49,7:5,3,Allowed,No,<NA>,x"]


def written_csv(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(HEADER), *LINES]) + "\n")
    return str(tmp_path / "in")


def test_csv_tokens_and_header_names(spark, tmp_path):
    got = {r.row_id: r for r in read_observations_csv(spark, written_csv(tmp_path)).collect()}
    assert got[1].geohash == "qp02z1" and got[1].Temperature == 11.5 and got[1].day == 48
    assert got[2].Weather == "none" and got[2].RoadType is None and got[2].day == 48 and got[2].NumberofLanes is None
    assert got[2].LargeVehicles is None and got[2].Landmarks is None and got[2].Temperature is None and got[2].demand is None
    assert got[3].geohash is None and got[3].Weather == "na" and got[3].RoadType == "   " and got[3].day is None and got[3].timestamp is None
    assert got[4].Weather == "Null" and got[4].RoadType == "N/A N/A" and got[4].demand == 0.1
    m = cleaning.Medians(10.0, 2)
    assert {r.row_id: r.RoadType for r in cleaning.clean(read_observations_csv(spark, str(tmp_path / "in")), m).collect()}[3] == ""


def test_stream_reads_what_the_batch_reads(spark, tmp_path):
    path = written_csv(tmp_path)
    stream = stream_observations_csv(spark, path)
    assert stream.schema == read_observations_csv(spark, path).schema
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, read_observations_csv(spark, path).collect()))


def test_literal_rows(spark):
    got = literal_observations(spark, [{"row_id": 7, "geohash": "qp02z1", "day": 48}]).first()
    assert (got.row_id, got.geohash, got.day, got.Weather) == (7, "qp02z1", 48, None)


def test_submission_is_validated_from_its_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Index,demand\n1,0.5\n2,0.25\n3,\n")
    sub = read_submission(spark, str(tmp_path / "s.csv"))
    assert dict(sub.dtypes) == {"Index": "bigint", "demand": "double"}
    got = {r["check"]: (r.value, r.status) for r in validate_submission(sub, 3).collect()}
    assert got["rows"] == (3.0, "PASS") and got["columns"] == (2.0, "PASS") and got["missing"] == (1.0, "FAIL") and got["max"] == (0.5, "INFO")


# ---- analytics and reports


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (10.0,), (None,)], "demand double")
    got = A.histogram(df, "demand", 50).collect()
    assert [r.bin for r in sorted(got)] == list(range(1, 51)) and sum(r.n for r in got) == 3
    assert A.histogram(df.where("false"), "demand", 50).collect() == []


def test_kde_is_close_to_the_exact_kernel_sum(spark):
    xs = np.random.default_rng(3).gamma(2.0, 1.0, 800)
    df = spark.createDataFrame([(float(x),) for x in xs], "demand double")
    h = xs.std(ddof=1) * len(xs) ** -0.2
    for r in A.kde(df, "demand", 100, 4096).collect():
        exact = np.exp(-0.5 * ((r.x - xs) / h) ** 2).sum() / (len(xs) * h * math.sqrt(2 * math.pi))
        # a point moves at most half a bin, so the density by the kernel's steepest slope times that
        bound = (xs.max() - xs.min()) / 4096 / 2 / h ** 2 / math.sqrt(2 * math.pi * math.e)
        assert abs(r.density - exact) <= bound


def test_pivot_header_is_bounded(spark):
    df = spark.range(20).select(F.col("id").alias("x"))
    assert A.distinct_values(df, "x", 20) == list(range(20))
    with pytest.raises(ValueError):
        A.distinct_values(df, "x", 19)


def test_correlation_is_symmetric_with_ones(spark):
    rnd = np.random.default_rng(4)
    m = rnd.normal(size=(200, 3)) @ rnd.normal(size=(3, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in A.correlation(df, ["a", "b", "c"]).collect()}
    want = np.corrcoef(m.T)
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            assert got[a, b] == pytest.approx(want[i, j])


def test_best_of_each_equals_arg_best(spark):
    rows = [(h, z, float(((h or 0) * 7 + len(z or "")) % 5)) for h in (None, 1, 2, 10) for z in ("b", "a", None, "cc")]
    df = spark.createDataFrame(rows, "hour int, zone string, demand double")
    wanted = [("top", "hour", True), ("low", "hour", False), ("zone", "zone", True)]
    got = {r.kpi: (r.key, r.value) for r in A.best_of_each(df, wanted).collect()}
    for name, key, largest in wanted:
        r = A.arg_best(df, key, largest=largest).first()
        assert got[name] == (str(r[key]), pytest.approx(r.m))


def test_zone_without_labels_is_unseen(spark):
    train = spark.createDataFrame([("qp0001", 0.2), ("qp0002", None)], "geohash string, demand double")
    rows = spark.createDataFrame([(1, "qp0001"), (2, "qp0002"), (3, "qp0003"), (4, None)], "row_id long, geohash string")
    assert {r.row_id for r in unseen_zones(rows, fit_encoding(train).zones).collect()} == {2, 3, 4}


def test_dedup_report(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "b"), (2, "b"), (2, "b")], "a int, b string")
    assert tuple(cleaning.dedup_report(df).first()) == (6, 3, 3)
    assert tuple(cleaning.dedup_report(df.where("false")).first()) == (0, 0, 0)
