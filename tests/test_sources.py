"""Files in and out, documents of several shapes, merges and refusals."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import exposure, health, rates
from fieldlens.sources import documents, files, store, telemetry

NOW = dt.datetime(2024, 1, 26, 12)

NORMAL = {
    "id": "a1", "config": {"name": "North"}, "status": {
        "model": "M-1", "lastUpdate": "2024-01-20T10:00:00Z", "batteries": [55],
        "powerSources": [{"type": "UNK", "percentage": 80, "level": "good"}],
        "coordinates": [
            {"dateTime": "2024-01-01T00:00:00Z", "position": {"coordinates": [-90.5, 44.5]}},
            {"dateTime": "2024-01-09T00:00:00Z", "position": {"coordinates": [-90.25, 44.25]}, "latitude": "N44 15.0", "longitude": "W90 15.0"},
            {"position": {"coordinates": [-1.0, 1.0]}}],
        "signal": {"type": "LTE", "bar": 3, "processed": {"percentage": 70, "bar": 4, "level": "n/a"}},
        "temperature": {"value": 31, "unit": "F"}, "memory": {"used": 10, "size": 100}},
    "subscriptions": [{"plan": {"name": "Basic", "photoCountPerMonth": 250}, "photoCount": 12, "endDateBillingCycle": "2024-02-01"}]}
LEGACY = {"id": "b2", "latitude": 43.5, "longitude": -89.5, "model": "M-0", "status": {}}
ODD = {"id": "c3", "power": {"remainingPct": 41}, "gps": {"lastFix": {"latDeg": 44.1, "lonDeg": -90.1}}, "heartbeat": "2024-01-19 08:00:00"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d["id"], json.dumps(d)) for d in (NORMAL, LEGACY, ODD)] + [("z", "{broken")], "camera_id string, raw string")


def test_camera_shapes(docs):
    got = {r.camera_id: r for r in documents.camera_rows(docs).where("camera_id IS NOT NULL").collect()}
    a = got["a1"]
    assert (a.lat, a.lng, a.gps_fix) == (44.25, -90.25, "2024-01-09T00:00:00Z")
    assert (a.battery, a.battery_source, a.signal_level, a.signal_bars) == (80.0, None, None, 4)
    assert (a.photo_limit, a.plan, a.cycle_end) == (250, "Basic", "2024-02-01")
    assert (got["b2"].lat, got["b2"].lng, got["b2"].model, got["b2"].battery) == (43.5, -89.5, "M-0", None)
    assert got["c3"].lat is None and got["c3"].name == "c3"


def test_leaves_and_blank_report(docs):
    leaves = documents.leaf_table(docs, "camera_id")
    paths = [r.path for r in leaves.where("camera_id = 'a1'").orderBy("pos").collect()]
    assert "status.batteries" in paths and "status.batteries[0]" in paths
    assert "status.coordinates[1].position.coordinates" in paths
    assert leaves.where("camera_id = 'z'").count() == 0
    rows = documents.camera_rows(docs).where("camera_id IS NOT NULL")
    odd = {r.label: r.candidates for r in documents.blank_fields(rows, leaves, "camera_id").where("camera_id = 'c3'").collect()}
    assert "gps.lastFix.latDeg" in odd["position"] and odd["battery"] == ["power.remainingPct"]
    assert odd["last contact"] == ["heartbeat"] and odd["photo quota"] is None


def test_redaction_masks_positions_and_keeps_times(spark):
    df = spark.createDataFrame([("gps.lat", "44.123456"), ("gps.fix", '"N44 7.4"'), ("gps.at", '"2024-01-09T00:00:00Z"'), ("name", '"North"'),
                                ("sim", '"8901A"'), ("pos.coordinates", "[-90.1, 44.1]")], "path string, value string")
    got = {r.path: r.shown for r in df.select("path", documents.redacted(F.col("path"), F.col("value")).alias("shown")).collect()}
    assert got == {"gps.lat": "<number 6dp>", "gps.fix": '"A## #.#"', "gps.at": '"2024-01-09T00:00:00Z"', "name": '"North"',
                   "sim": '"####A"', "pos.coordinates": "[<numbers>]"}


def test_photo_dates_and_addresses(spark):
    p = [{"id": "1", "originDate": "nope", "createDate": "2024-01-02T03:04:05Z", "large": {"host": "", "path": "x"}, "medium": {"host": "m.h", "path": "p"}},
         {"id": "2", "date": "2024-01-02T03:04:05Z", "large": {"host": "https://l.h/", "path": "q"}, "tag": ["deer", "buck"]}]
    df = documents.photo_rows(spark.createDataFrame([(json.dumps(x),) for x in p], "raw string"))
    got = {r.photo_id: r for r in df.collect()}
    assert got["1"].url == "https://m.h/p" and got["2"].url == "https://l.h/q"
    assert got["1"].taken_at == got["2"].taken_at == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert documents.claims_from_tags(df).count() == 2


def test_header_roles():
    roles, rest = telemetry.detect_roles(["AnimalID", "Sex", "Timestamp", "Latitude", "Longitude", "MoveRate", "TempC", "Speed"])
    assert roles == {"animal": "AnimalID", "sex": "Sex", "timestamp": "Timestamp", "lat": "Latitude", "lng": "Longitude", "rate": "MoveRate", "temp": "TempC"}
    assert rest == ["Speed"]


def test_csv_load_blank_rate_is_missing_not_zero(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('AnimalID,Sex,Date,Hour,MoveRate\n"d,1",m,2024-01-01,5,0\nd2,F,2024-01-01,6,\nd3,F,2024-01-01,7,-1\nd4,,bad,7,3\nd5,f,2024-01-02,23.9,2.5\n')
    raw = telemetry.read_csv(spark, str(path))
    out = telemetry.typed(raw)
    good = {r.animal: (r.rate, r.hour, r.sex) for r in out.where("usable").collect()}
    assert good == {"d,1": (0.0, 5, "M"), "d5": (2.5, 23, "F")}
    assert telemetry.load_counts(out).first().asDict() == {"total": 5, "skipped": 3}
    assert telemetry.inspect(raw)["missing"] == []
    with pytest.raises(ValueError):
        telemetry.typed(raw.drop("MoveRate"))


def test_photo_log_drops_bad_lines_and_sorts_newest_first(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in (1, 2):
        rows = spark.createDataFrame([(f"p{i}", "c", dt.datetime(2024, 1, i), "u", ["deer"])],
                                     "photo_id string, camera_id string, taken_at timestamp, url string, tags array<string>")
        files.append_photo_log(rows, path)
    (tmp_path / "log" / "part-bad.json").write_text("{not json\n")
    assert [r.photo_id for r in files.read_photo_log(spark, path).collect()] == ["p2", "p1"]


def fleet(spark, rows):
    cols = ("camera_id string, name string, battery bigint, photo_count bigint, photo_limit bigint, cycle_start timestamp, "
            "cycle_end timestamp, last_seen timestamp")
    return spark.createDataFrame(rows, cols)


def test_quota_edges(spark):
    start, end = dt.datetime(2024, 1, 6, 12), dt.datetime(2024, 2, 5, 12)
    q = health.quota(fleet(spark, [
        ("spent", None, 50, 250, 250, start, end, NOW), ("warn", None, 50, 200, 250, start, end, NOW), ("fast", None, 50, 190, 250, start, end, NOW),
        ("slow", None, 50, 20, 250, start, end, NOW), ("none", None, 50, 20, None, start, end, NOW), ("zero", None, 50, 20, 0, start, end, NOW),
        ("undated", None, 50, 20, 250, None, None, NOW)]), F.lit(NOW))
    got = {r.camera_id: (r.quota_level, r.remaining, r.days_left, r.per_day) for r in q.collect()}
    assert got["spent"] == ("bad", 0, 10, None) and got["warn"][0] == "warn"
    assert got["fast"][0] == "warn" and got["slow"] == ("ok", 230, 10, 1.0)
    assert got["none"] == got["zero"] == ("ok", None, None, None)
    assert got["undated"] == ("ok", 230, None, None)


def test_health_and_day_state(spark):
    now = F.lit(NOW)
    q = health.quota(fleet(spark, [
        ("fine", None, 90, 1, 9, None, None, NOW), ("low", None, 10, 1, 9, None, None, NOW), ("quiet", None, 31, 1, 9, None, None, NOW - dt.timedelta(days=7)),
        ("silent", None, 31, 1, 9, None, None, NOW - dt.timedelta(days=30)), ("never", None, None, 9, 9, None, None, None)]), now)
    got = {r.camera_id: (r.health, r.notes) for r in health.health(q, now).collect()}
    assert got["fine"] == ("ok", []) and got["low"] == ("bad", ["battery 10%"]) and got["quiet"] == ("warn", ["quiet 7 days"])
    assert got["silent"] == ("bad", ["silent 30 days"]) and got["never"] == ("bad", ["never reported", "quota spent"])
    states = {r.camera_id: r.s for r in q.select("camera_id", health.day_state(F.col("last_seen"), now, F.col("remaining")).alias("s")).collect()}
    assert states["fine"] == "live" and states["quiet"] == "silent" and states["never"] == "unknown"


def test_csv_export_quotes_and_blanks(spark, tmp_path):
    cams = fleet(spark, [("c1", 'Big "oak", north', None, 20, 250, dt.datetime(2024, 1, 6, 12), dt.datetime(2024, 2, 5, 12), NOW - dt.timedelta(days=3))])
    out = str(tmp_path / "cams")
    files.export_cameras(cams, health.quota(cams, F.lit(NOW)), F.lit(NOW), out)
    rows = [r for f in glob.glob(out + "/part-*.csv") for r in csv.DictReader(open(f))]
    assert rows[0]["name"] == 'Big "oak", north' and rows[0]["battery"] == ""
    assert rows[0]["photos_per_day"] == "1.00" and rows[0]["days_since_seen"] == "3" and rows[0]["quota_level"] == "ok"


def test_plan_round_trip(spark, tmp_path):
    plan = spark.createDataFrame([("2024-11-05", "AM", 41)], "day string, window string, total int")
    files.write_plan(plan, str(tmp_path / "plan"))
    (tmp_path / "plan" / "part-x.json").write_text("[[")
    assert files.read_plan(spark, str(tmp_path / "plan"), plan.schema).collect() == plan.collect()


def test_patch_absent_differs_from_null_and_frozen_columns_stay(spark):
    base = spark.createDataFrame([(1, "a", 5, "prime"), (2, "b", 6, "good")], "id int, name string, deer int, predicted string")
    patches = spark.createDataFrame([(1, 1, {"name": "x", "predicted": "poor"}), (1, 2, {"deer": None}), (2, 1, {"deer": "9"}), (2, 3, {"deer": "8"})],
                                    "id int, seq int, changes map<string,string>")
    got = {r.id: tuple(r)[1:] for r in store.apply_patches(base, patches, "id", {"name": "string", "deer": "int"}).collect()}
    assert got == {1: ("x", None, "prime"), 2: ("b", 8, "good")}


def test_camera_day_merge_is_safe_to_repeat(spark):
    rows = spark.createDataFrame([("c", dt.date(2024, 1, 1), "live", 9, NOW), ("c", dt.date(2024, 1, 1), "silent", 3, NOW + dt.timedelta(hours=1))],
                                 "camera_id string, day date, state string, photos int, observed_at timestamp")
    once = store.merge_camera_days(rows)
    assert (once.first().state, once.first().photos) == ("silent", 9)
    assert store.merge_camera_days(once.unionByName(rows.select(once.columns))).collect() == once.collect()


def test_validation_lists_every_reason(spark):
    df = spark.createDataFrame([(1, "deer", 3), (0, "elk", None), (1, "bear", 4)], "n int, species string, individual_id int")
    good, bad = store.split_valid(df, store.detection_rules(["deer", "bear"]))
    assert good.count() == 1
    assert sorted(len(r.violations) for r in bad.collect()) == [1, 2]


# ---- the rate board on a hand-made season -------------------------------------------------

def board_inputs(spark, dark=()):
    days = [dt.date(2023, 10, d) for d in range(1, 21)]
    cams = spark.createDataFrame([(1, 1, 44.0, -90.0), (2, 1, 44.0, -90.0)], "camera_id bigint, location_id bigint, lat double, lng double")
    state = spark.createDataFrame([(c, d, "quota-dark" if (c, d.day) in dark else "live") for c in (1, 2) for d in days], "camera_id bigint, day date, state string")
    wx = spark.createDataFrame([(1, dt.datetime(2023, 10, 1) + dt.timedelta(hours=h), 0.0 if h // 24 % 2 else 180.0, 5.0, 40.0, 30.0) for h in range(-24, 24 * 22)],
                               "location_id bigint, hour_utc timestamp, wind_dir double, wind_mph double, temp_f double, pressure_inhg double")
    # camera 1 sees an animal every evening on a north wind, camera 2 never does
    shots = [(i, 1, dt.datetime(2023, 10, d.day, 23, 30)) for i, d in enumerate(days) if (d.day - 1) % 2]
    photos = spark.createDataFrame(shots, "photo_id bigint, camera_id bigint, taken_at timestamp")
    dets = spark.createDataFrame([(s[0], "deer", 1, None, "manual", True) for s in shots],
                                 "photo_id bigint, species string, n int, individual_id bigint, source string, confirmed boolean")
    return cams, state, wx, photos, dets


def test_planted_wind_signal_is_found_and_none_invented(spark):
    cams, state, wx, photos, dets = board_inputs(spark)
    hours = exposure.watched_hours(state, cams, wx)
    cells = rates.axis_rates(hours, rates.hourly_hits(rates.sightings(dets, photos)), cams)
    got = {(r.camera_id, r.bucket): r.rate for r in cells.where("claim = 'yours' AND axis IN ('wind', 'light')").collect()}
    assert got[(1, "N")] > 0 and got[(1, "S")] == 0 and got[(1, "E")] is None
    assert got[(1, "dusk")] > 0 and got[(1, "dawn")] == 0 and got[(2, "N")] == 0
    guesses = cells.where("claim = 'camera'").agg(F.sum("hits")).first()[0]
    assert guesses == 0


def test_dark_days_move_no_rate_but_the_hours(spark):
    cams, state, wx, photos, dets = board_inputs(spark, dark={(2, d) for d in range(1, 21)})
    b = rates.board(exposure.watched_hours(state, cams, wx), rates.sightings(dets, photos), cams)
    got = {r.camera_id: (r.hours, r.rate) for r in b.where("claim = 'yours'").collect()}
    assert got[1][0] == 480 and got[1][1] == pytest.approx(100 * 10 / 480)
    assert got[2] == (0, None)


def test_unconfirmed_assist_rows_fall_in_neither_set(spark):
    p = spark.createDataFrame([(1, 1, NOW), (2, 1, NOW), (3, 1, NOW)], "photo_id bigint, camera_id bigint, taken_at timestamp")
    d = spark.createDataFrame([(1, "deer", "assist", False), (2, "deer", "camera-ai", False), (3, "deer", "camera-ai", True)],
                              "photo_id bigint, species string, source string, confirmed boolean")
    assert sorted((r.photo_id, r.claim) for r in rates.sightings(d, p).collect()) == [(2, "camera"), (3, "yours")]


def test_insert_keeps_the_first_arrival(spark):
    held = spark.createDataFrame([("a", 1)], "name string, id bigint")
    sent = spark.createDataFrame([("n", 9, 2), ("n", 1, 5), ("a", 7, 0)], "name string, id bigint, seq int")
    assert {tuple(r) for r in store.insert_new(held, sent, "name", "seq").collect()} == {("a", 1), ("n", 9)}


def test_absent_cells_move_no_other_and_edges_come_back(spark):
    from fieldlens.sources import grids
    cells = {(1, c, r): float(10 * c + r) for c in range(3) for r in range(3) if (c, r) != (1, 0) and c != 2 and r != 2} | {(2, 0, 0): 1.0}
    df = spark.createDataFrame([(*k, z) for k, z in cells.items()], "grid_id bigint, c int, r int, z double")
    sizes = spark.createDataFrame([(1, 3, 3), (2, 2, 1), (3, 1, 2)], "grid_id bigint, cols int, rows int")
    back = {(x.grid_id, x.c, x.r): x.z for x in grids.explode_rows(grids.pack_rows(df, sizes)).collect()}
    whole = [(g, c, r) for g, cols, rows in [(1, 3, 3), (2, 2, 1), (3, 1, 2)] for c in range(cols) for r in range(rows)]
    assert back == {k: cells.get(k) for k in whole}


def test_every_camera_answers_every_question(spark):
    from fieldlens.operators import evidence
    cameras = spark.createDataFrame([(1,), (2,), (3,)], "camera_id bigint")
    hours = spark.createDataFrame([(c, h, "dawn", True, "N", 30.0) for c in (1, 2) for h in range(12)],
                                  "camera_id bigint, hour_no bigint, band string, daylight boolean, wind string, pressure_inhg double")
    none = spark.createDataFrame([], "camera_id bigint, taken_at timestamp")
    sits = spark.createDataFrame([("AM", "N"), ("PM", "S")], "window string, wind string")
    got = {(r.question, r.camera_id): (r.rung, r.hours, r.enough) for r in evidence.matched_evidence(cameras, hours, none, sits).collect()}
    assert got["AM/N", 1] == (3, 12, True) and got["AM/N", 3] == (3, 0, False) and len(got) == 6
    assert got["PM/S", 1][0] == 0
    short = evidence.matched_evidence(cameras, hours.where("hour_no < 3"), none, sits)
    assert {(r.rung, r.hours) for r in short.collect()} == {(None, 0)}
    assert {r.tier for r in evidence.confidence(short).collect()} == {"none"}


def test_animals_never_confirmed_stay(spark):
    hours = spark.createDataFrame([(1,)] * 12, "camera_id bigint")
    sight = spark.createDataFrame([(1, "yours", 7)], "camera_id bigint, claim string, individual_id bigint")
    animals = spark.createDataFrame([(7, "A"), (8, "B")], "individual_id bigint, individual_name string")
    got = {(r.individual_id, r.camera_id, r.hits) for r in rates.individual_camera_rates(hours, sight, animals).collect()}
    assert got == {(7, 1, 1), (8, None, 0)}
