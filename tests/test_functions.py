"""Row-wise expressions: geohash golden vectors, time features, labels."""

import math

from pyspark.sql import functions as F

from zonecast.functions.geo import geohash_latlon
from zonecast.functions.labels import delta_status, demand_class, pct_delta, risk_pct
from zonecast.functions.temporal import with_time_features

GOLDEN = [
    ("ezs42", 42.60498046875, -5.60302734375),
    ("u4pruydqqvj", 57.64911063015461, 10.407439693808556),
    ("qp02z1", -5.48492431640625, 90.6646728515625),
    ("QP03XX", -5.32012939453125, 90.6866455078125),
    ("s", 22.5, 22.5),
    ("qp", -2.8125, 95.625),
    ("9q8yyk8ytpx", 37.77489937841892, -122.41939969360828),
    ("qp0a11", None, None),
    ("", None, None),
    (None, None, None),
]


def midpoint(g):
    """The cell's centre: every second bit of the text, read as a number over its power of two."""
    bits = "".join(f"{'0123456789bcdefghjkmnpqrstuvwxyz'.index(c):05b}" for c in g.lower())

    def centre(half, low, span):
        return low + span * ((int(half, 2) if half else 0) + 0.5) / 2 ** len(half)

    return centre(bits[1::2], -90.0, 180.0), centre(bits[0::2], -180.0, 360.0)


def test_geohash_golden(spark):
    df = spark.createDataFrame([(g,) for g, _, _ in GOLDEN], "g string")
    la, lo = geohash_latlon(F.col("g"))
    got = {r["g"]: (r["la"], r["lo"]) for r in df.select("g", la.alias("la"), lo.alias("lo")).collect()}
    for g, lat, lon in GOLDEN:
        assert got[g] == (lat, lon), g


def test_geohash_matches_bit_arithmetic(spark):
    import random
    rnd = random.Random(7)
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"
    gs = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in range(1, 13) for _ in range(20)]
    gs.append("zzzzzzzzzzzz")
    df = spark.createDataFrame([(g,) for g in gs], "g string")
    la, lo = geohash_latlon(F.col("g"))
    for r in df.select("g", la.alias("la"), lo.alias("lo")).collect():
        assert (r["la"], r["lo"]) == midpoint(r["g"])


def test_time_features(spark):
    rows = [("5:00", 48), ("12:30", 49), ("17:05", 55), ("21:59", 0), ("4:10", -1),
            ("08:30", 48), ("8", 48), ("1:2:3", 48), (None, 48), ("x:10", 48)]
    df = with_time_features(spark.createDataFrame(rows, "timestamp string, day int"))
    got = {r["timestamp"]: r for r in df.collect()}
    assert got["5:00"]["time_block"] == "Morning"
    assert got["12:30"]["time_block"] == "Afternoon"
    assert got["17:05"]["time_block"] == "Evening" and got["17:05"]["is_peak_hour"] == 1
    assert got["21:59"]["time_block"] == "Night"
    assert got["4:10"]["time_block"] == "Night"
    assert got["4:10"]["day_of_week"] == 6 and got["4:10"]["is_weekend"] == 1  # floor modulo
    assert got["08:30"]["hour"] == 8 and got["08:30"]["total_minutes"] == 510
    assert got["08:30"]["is_peak_hour"] == 1
    assert math.isclose(got["08:30"]["hour_sin"], math.sin(2 * math.pi * 8 / 24))
    for bad in ("8", "1:2:3", None, "x:10"):
        assert got[bad]["hour"] is None
    peaks = {h: with_time_features(spark.createDataFrame([(f"{h}:00", 1)], "timestamp string, day int"))
             .first()["is_peak_hour"] for h in range(24)}
    assert [h for h, p in peaks.items() if p] == [7, 8, 9, 17, 18, 19]


def test_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.149,), (0.15,), (0.5,), (-0.01,), (None,)],
                               "d double")
    got = df.select("d", demand_class(F.col("d")).alias("c"), risk_pct(F.col("d")).alias("r")).collect()
    c = {r["d"]: (r["c"], r["r"]) for r in got}
    assert c[0.0] == ("LOW", 0)
    assert c[0.05] == ("MEDIUM", 25)
    assert c[0.149][0] == "MEDIUM"
    assert c[0.15] == ("HIGH", 75)
    assert c[0.5] == ("HIGH", 100)
    assert c[-0.01] == ("LOW", -5)
    assert c[None] == (None, None)


def test_delta_status(spark):
    df = spark.createDataFrame([(23.0, 20.0), (95.0, 100.0), (1.2, 1.0), (0.9, 1.0), (1.0, 0.0)],
                               "s double, b double")
    d = pct_delta(F.col("s"), F.col("b"))
    got = [(round(r["d"], 9) if r["d"] is not None else None, r["st"])
           for r in df.select(d.alias("d"), delta_status(d).alias("st")).collect()]
    assert got[0] == (15.0, "STABLE CONDITIONS")
    assert got[1] == (-5.0, "STABLE CONDITIONS")
    assert got[2][1] == "HIGH CONGESTION RISK"
    assert got[3][1] == "CONGESTION ALLEVIATED"
    assert got[4] == (None, None)
