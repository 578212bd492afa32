"""Column functions against independent arithmetic and published values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fieldlens.functions import compass, geo, hashes, lanes, solar
from fieldlens.functions.num import half_up, round6
from fieldlens.operators.counters import counter_of
from fieldlens.operators.estimate import wilson
from fieldlens.operators.parcels import class_names, clean_text, owner_term
from fieldlens.operators.rates import pressure_band, rate_per_100, temp_band


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row[0] if len(cols) == 1 else row


def lit(x):
    return F.lit(x)


def test_half_up_goes_toward_positive_infinity(spark):
    assert one(spark, x=half_up(lit(-2.5))) == -2
    assert one(spark, x=half_up(lit(2.5))) == 3
    assert one(spark, x=round6(lit(-0.0000015))) == pytest.approx(-0.000002)


def test_distance_of_a_point_to_itself_is_zero_and_unknown_stays_unknown(spark):
    assert one(spark, m=geo.haversine_m(lit(44.1), lit(-90.2), lit(44.1), lit(-90.2))) == 0
    assert one(spark, m=geo.haversine_m(lit(44.1), lit(None).cast("double"), lit(44.1), lit(-90.2))) is None


def test_a_degree_of_latitude(spark):
    m = one(spark, m=geo.haversine_m(lit(44.0), lit(-90.0), lit(45.0), lit(-90.0)))
    assert m == pytest.approx(6371000 * math.pi / 180, rel=1e-9)


def test_utm_against_a_published_point(spark):
    # CN Tower: 43.642567 N, 79.387139 W is zone 17T 630084 E 4833438 N
    u = one(spark, u=geo.to_utm(lit(43.642567), lit(-79.387139), geo.utm_zone(lit(-79.387139))))
    assert u["x"] == pytest.approx(630084, abs=1) and u["y"] == pytest.approx(4833438, abs=2)
    assert one(spark, z=geo.utm_zone(lit(-79.387139))) == 17


def test_albers_origin(spark):
    a = one(spark, a=geo.to_albers(lit(23.0), lit(-96.0)))
    assert abs(a["x"]) < 1e-6 and abs(a["y"]) < 1e-6


def test_geohash_and_degree_texts(spark):
    cell = one(spark, c=geo.geohash_cell(lit("ezs42")))
    assert cell["south"] == pytest.approx(42.583, abs=1e-3) and cell["north"] == pytest.approx(42.627, abs=1e-3)
    assert cell["west"] == pytest.approx(-5.625, abs=1e-3) and cell["east"] == pytest.approx(-5.581, abs=1e-3)
    assert one(spark, c=geo.geohash_cell(lit("a!"))) is None
    assert one(spark, d=geo.dms_degrees(lit("N44 7.407360"))) == pytest.approx(44.123456)
    assert one(spark, d=geo.dms_degrees(lit("W 90 30.0"))) == pytest.approx(-90.5)
    assert one(spark, d=geo.dms_degrees(lit("N44 61.0"))) is None
    assert one(spark, d=geo.dms_degrees(lit("N95 1.0"))) is None


def test_ring_area_of_a_survey_section(spark):
    # one mile square near 44 N: 640 acres
    d_lat = 1609.344 / (math.pi * 6371008.8 / 180)
    d_lng = d_lat / math.cos(math.radians(44.0 + d_lat / 2))
    ring = F.array(*[F.struct(lit(x).alias("lng"), lit(y).alias("lat")) for x, y in (
        (-90.0, 44.0), (-90.0 + d_lng, 44.0), (-90.0 + d_lng, 44.0 + d_lat), (-90.0, 44.0 + d_lat))])
    assert one(spark, a=geo.ring_acres(ring)) == pytest.approx(640, rel=1e-4)


def test_ring_contains_with_hole(spark):
    def ring(a):
        return F.array(*[F.struct(lit(x).alias("lng"), lit(y).alias("lat")) for x, y in ((-a, -a), (a, -a), (a, a), (-a, a))])
    rings = F.array(ring(3.0), ring(1.0))
    assert one(spark, a=geo.rings_contain(rings, lit(2.0), lit(0.0))) is True
    assert one(spark, a=geo.rings_contain(rings, lit(0.0), lit(0.0))) is False
    assert one(spark, a=geo.rings_contain(rings, lit(4.0), lit(0.0))) is False


def test_compass_edges(spark):
    for deg, point, octant in ((0.0, "N", "N"), (348.75, "N", "N"), (348.0, "NNW", "N"), (-90.0, "W", "W"), (22.5, "NNE", "NE"),
                               (22.4, "NNE", "N"), (719.0, "N", "N")):
        r = one(spark, p=compass.compass_point(lit(deg)), o=compass.octant(lit(deg)))
        assert (r["p"], r["o"]) == (point, octant), deg
    assert one(spark, p=compass.compass_point(lit(None).cast("double"))) is None
    assert one(spark, p=compass.points_apart(lit("N"), lit("NNW"))) == 1
    assert one(spark, p=compass.points_apart(lit("N"), lit("?"))) is None


def test_sunrise_against_almanac(spark):
    # Greenwich, 21 June 2024: sunrise 03:43 UTC, sunset 20:21 UTC, to the minute or two
    df = spark.createDataFrame([(1718971200000.0, 51.4779, 0.0)], "ms double, lat double, lng double")
    s = solar.with_sun(df, F.col("ms"), F.col("lat"), F.col("lng")).first()
    assert abs(s["sunrise"] / 60000 - (1718928000 + 3 * 3600 + 43 * 60) / 60) < 3
    assert abs(s["sunset"] / 60000 - (1718928000 + 20 * 3600 + 21 * 60) / 60) < 3


def test_polar_day_has_no_band(spark):
    df = spark.createDataFrame([(1718971200000.0, 78.0, 15.0)], "ms double, lat double, lng double")
    assert solar.with_light_band(df, F.col("ms"), F.col("lat"), F.col("lng")).first()["band"] == "unknown"


def test_solar_day_east_and_west(spark):
    noon_utc = lit(1704110400000.0)                     # 2024-01-01T12:00Z
    assert str(one(spark, d=solar.solar_day(noon_utc, lit(-179.0)))) == "2024-01-01"
    assert str(one(spark, d=solar.solar_day(noon_utc, lit(179.9)))) == "2024-01-01"
    assert str(one(spark, d=solar.solar_day(noon_utc + 3600000.0, lit(179.9)))) == "2024-01-02"


def test_season_wraps_the_year(spark):
    for day, phase in (("2024-12-31", "Late season"), ("2024-01-31", "Late season"), ("2024-02-01", "Off season"), ("2024-11-07", "Peak rut — best week")):
        assert one(spark, p=solar.season_phase(lit(day).cast("date")))["phase"] == phase


def test_full_moon(spark):
    m = one(spark, m=solar.moon_phase(lit(1706205240000.0)))          # full moon 2024-01-25T17:54Z
    assert m["name"] == "full" and m["illum"] > 0.99


def test_wilson_known_values_and_refusals(spark):
    w = one(spark, w=wilson(lit(5), lit(10)))
    assert w["lo"] == pytest.approx(0.2366, abs=1e-4) and w["hi"] == pytest.approx(0.7634, abs=1e-4)
    assert one(spark, w=wilson(lit(0), lit(10)))["lo"] == 0
    assert one(spark, w=wilson(lit(3), lit(0))) is None
    assert one(spark, w=wilson(lit(11), lit(10))) is None


def test_rates_refuse_below_ten_hours(spark):
    assert one(spark, r=rate_per_100(lit(4), lit(9))) is None
    assert one(spark, r=rate_per_100(lit(0), lit(10))) == 0
    assert one(spark, r=rate_per_100(lit(1), lit(10))) == 10


def test_bands(spark):
    assert [one(spark, b=temp_band(lit(t))) for t in (19.9, 20.0, 35.0, 64.9, 65.0)] == ["lt20", "20s", "30s", "50s", "gte65"]
    assert [one(spark, b=pressure_band(lit(p))) for p in (29.79, 29.8, 30.1, 30.11)] == ["low", "mid", "mid", "high"]
    assert one(spark, b=temp_band(lit(None).cast("double"))) is None


def test_counter_names(spark):
    for name, n in (("PICT0431.JPG", 431), ("DCIM\\100X\\IMG_12-0007.jpeg", 7), ("photo.jpg", None), (None, None), ("a1b22.c3", 22)):
        assert one(spark, n=counter_of(lit(name).cast("string"))) == n


def test_hamming_needs_the_same_algorithm(spark):
    a, b = "d1:" + "0" * 64, "d1:" + "0" * 63 + "f"
    assert one(spark, h=hashes.hamming(lit(a), lit(b))) == 4
    assert one(spark, h=hashes.hamming(lit("d2:" + "0" * 64), lit(b))) is None


def test_lanes_block_the_winds_behind_them(spark):
    # a lane due south is spoiled by wind from the north
    lane = F.struct(lit(None).cast("string").alias("label"), lit(180.0).alias("bearing"), lit("S").alias("point"),
                    lit(60).alias("metres"), lit(10.0).alias("spread"), lit(21.0).alias("width_m"))
    winds = one(spark, w=lanes.huntable_winds(F.array(lane)))
    assert not {"N", "NNE", "NNW"} & set(winds) and "S" in winds and len(winds) == 13
    assert one(spark, s=lanes.spread_for_width(lit(0.0), lit(5.0))) is None


def test_lanes_are_worked_out_once(spark):
    """A filter on the winds must not put the lanes' geometry into the test of each of the sixteen winds."""
    rows = spark.range(3).select((F.col("id") * 1.0).alias("lat"), F.array(F.lit(0.5)).alias("raw"))
    rows = rows.withColumn("lanes", F.transform("raw", lambda x: F.struct(
        F.lit("a").alias("label"), F.asinh(F.col("lat") + x).alias("bearing"), F.lit(10.0).alias("spread"))))
    derived = lanes.huntable_winds(F.col("lanes"))
    for found in (derived, lanes.blocked_winds(F.col("lanes")), lanes.winds_compared(derived, F.array(lit("N")))["only_derived"]):
        kept = rows.select("lat", found.alias("w")).where(F.size("w") > 0)
        assert kept.count() == 3
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("asinh(") <= 2                          # once where tested, once where returned


def test_parcel_texts(spark):
    assert one(spark, c=clean_text(lit(" None "))) is None
    assert one(spark, c=class_names(lit("5M, 4 4"))) == "agricultural forest, agricultural"
    assert one(spark, t=owner_term(lit("o'brien  & sons; ltd"))) == "O'BRIEN & SONS LTD"
