"""The supplied star-schema tables seen as camera, photo, sit and telemetry tables.

Every method reads only the columns it needs and derives whole tables from whole
inputs; nothing is sampled or filtered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Bindings:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- cameras, photos, detections, weather from the event stream -----------------

    def _events(self) -> DataFrame:
        return self.table("events").withColumn("camera_id", F.col("user_id") % 5).withColumn(
            "at", F.col("ts").cast("timestamp"))

    def cameras(self) -> DataFrame:
        k = F.col("camera_id")
        return self.camera_spans().select(
            "camera_id", (k % 3).alias("location_id"),
            (F.lit(44.0) + k.cast("double") * 0.013).alias("lat"),
            (F.lit(-90.0) - k.cast("double") * 0.37).alias("lng"))

    def photos(self) -> DataFrame:
        return self._events().select(
            F.col("event_id").alias("photo_id"), "camera_id", F.col("at").alias("taken_at"),
            F.date_trunc("hour", "at").alias("hour_utc"), F.col("props").alias("raw"))

    def detections(self) -> DataFrame:
        e = F.col("event_id")
        return self._events().select(
            e.alias("photo_id"), F.col("event_type").alias("species"), (e % 3 + 1).alias("n"),
            F.when(e % 7 == 0, F.col("user_id") % 4).alias("individual_id"),
            F.when(e % 3 == 0, "manual").otherwise("camera-ai").alias("source"),
            ((e % 3 == 0) | (e % 5 == 0)).alias("confirmed"))

    def individuals(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("individual_id"),
                                           F.col("n_name").alias("individual_name"))

    def camera_spans(self) -> DataFrame:
        """First and last photo day per camera."""
        return self._events().groupBy("camera_id").agg(
            F.to_date(F.min("at")).alias("from_day"), F.to_date(F.max("at")).alias("to_day"))

    def camera_days(self) -> DataFrame:
        d = (F.dayofmonth("day") + F.col("camera_id")) % 7
        return self.camera_spans().select("camera_id", F.explode(
            F.sequence("from_day", "to_day")).alias("day")).withColumn(
            "state", F.when(d == 0, "quota-dark").when(d == 1, "silent").otherwise("live"))

    def weather(self) -> DataFrame:
        spans = self.camera_spans().groupBy((F.col("camera_id") % 3).alias("location_id")).agg(
            F.min("from_day").alias("a"), F.max("to_day").alias("b"))
        dom, h, loc = F.dayofmonth("day").cast("bigint"), F.col("h").cast("bigint"), F.col("location_id")
        return (spans.select("location_id", F.explode(F.sequence("a", "b")).alias("day"))
                .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
                .select("location_id",
                        F.timestamp_seconds(F.unix_date("day") * 86400 + h * 3600).alias("hour_utc"),
                        F.when((dom + h) % 19 != 0, (dom * 53 + h * 37 + loc * 90) % 360)
                        .cast("double").alias("wind_dir"),
                        ((dom + h * 3 + loc) % 25).cast("double").alias("wind_mph"),
                        (15 + (dom * 3 + h * 2 + loc) % 60).cast("double").alias("temp_f"),
                        (F.lit(29.5) + ((dom * 7 + h + loc * 3) % 80).cast("double") * 0.01)
                        .alias("pressure_inhg"),
                        (((dom + h) % 10).cast("double") * 0.02).alias("precip_in"),
                        ((dom * 11 + h * 5) % 101).cast("double").alias("cloud_pct")))

    # ---- sits from orders -----------------------------------------------------------

    def sits(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        rating = F.element_at(F.array(*map(F.lit, ["prime", "strong", "good", "fair", "poor"])),
                              F.substring("o_orderpriority", 1, 1).cast("int"))
        start = F.unix_date(F.to_date("o_orderdate")) * 86400 + F.when(o % 2 == 0, 5).otherwise(15) * 3600
        return self.table("orders").select(
            o.alias("sit_id"), (c % 10).alias("stand_id"), F.to_date("o_orderdate").alias("date"),
            F.when(o % 2 == 0, "AM").otherwise("PM").alias("window"), rating.alias("rating"),
            F.when(o % 11 != 0, c % 6).alias("deer"), (c % 3).alias("bucks"),
            ((o * 23) % 360).cast("double").alias("predicted_wind_deg"),
            ((o * 23 + c % 4 * 20) % 360).cast("double").alias("wind_deg"),
            F.timestamp_seconds(start).alias("started_at"),
            F.timestamp_seconds(start + (c % 5) * 3600).alias("ended_at"),
            (o % 13 == 0).alias("shot"), (o % 26 == 0).alias("harvested"))

    # ---- telemetry, imagery and pins ------------------------------------------------

    def telemetry(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("animal"), F.col("l_returnflag").alias("sex"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24).alias("hour"),
            F.col("l_extendedprice").alias("rate"), F.col("l_quantity").alias("temp"),
            F.col("l_shipdate").cast("timestamp").alias("at"))

    def readings(self) -> DataFrame:
        """NDVI per field and date (clearest value of the day)."""
        return (self.table("lineitem").groupBy(F.col("l_partkey").alias("field_id"),
                                               F.to_date("l_shipdate").alias("date"))
                .agg(F.round(F.max("l_discount") * 9 + 0.0, 6).alias("ndvi")))

    @staticmethod
    def place(key: Column) -> list[Column]:
        return [(F.lit(44.0) + (key % 97).cast("double") * 0.01).alias("lat"),
                (F.lit(-90.0) - (key % 89).cast("double") * 0.012).alias("lng")]

    def pins(self) -> DataFrame:
        c = self.table("customer").select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pin_id"),
            F.lit("stand").alias("kind"), *self.place(F.col("c_custkey")),
            F.col("c_mktsegment").alias("property"))
        s = self.table("supplier").select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("pin_id"),
            F.lit("camera").alias("kind"), *self.place(F.col("s_suppkey")),
            F.lit(None).cast("string").alias("property"))
        return c.unionByName(s)

    def hashes(self) -> DataFrame:
        """256-bit perceptual hashes: one hex digit per vector component."""
        digit = F.transform("embedding", lambda v: F.lower(F.hex(
            F.when(v.cast("double") > -0.1, 8).otherwise(0)
            + F.when(v.cast("double") > 0.0, 4).otherwise(0)
            + F.when(v.cast("double") > 0.05, 2).otherwise(0)
            + F.when(v.cast("double") > 0.1, 1).otherwise(0))))
        return self.table("embeddings").select(
            F.col("vec_id").alias("photo_id"), F.col("label").cast("bigint").alias("camera_id"),
            F.concat(F.lit("d1:"), F.array_join(digit, "")).alias("phash"))

    # ---- stands, properties and fields ----------------------------------------------

    def properties(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("bigint").alias("property_id"),
                                           F.col("r_name").alias("property_name"))

    def stands(self) -> DataFrame:
        from fieldlens.constants import COMPASS, STAND_TYPES
        k = F.col("c_custkey")
        points, types = F.array(*map(F.lit, COMPASS)), F.array(*map(F.lit, STAND_TYPES))
        winds = F.array(F.get(points, (k % 5 * 3).cast("int")), F.get(points, (k % 3 * 4 + 1).cast("int")))
        return self.table("customer").select(
            k.alias("stand_id"), F.col("c_name").alias("stand_name"), *self.place(k),
            (F.col("c_nationkey") % 7).cast("bigint").alias("property_id"),
            F.get(types, (k % 6).cast("int")).alias("type"),
            F.when(k % 4 != 0, F.array_join(F.array_distinct(winds), ",")).alias("good_winds"))

    def fleet(self) -> DataFrame:
        """Registered cameras with health figures."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("camera_id"), F.col("s_name").alias("camera_name"), *self.place(k),
            (F.col("s_nationkey") % 7).cast("bigint").alias("property_id"),
            F.when(k % 9 != 0, F.floor(F.col("s_acctbal") / 110)).cast("bigint").alias("battery"),
            F.when(k % 8 != 0, (k * 37) % 1001).alias("photo_count"),
            F.when(k % 5 != 0, F.lit(1000).cast("bigint")).alias("photo_limit"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")).alias("cycle_start"),
            F.date_add(F.lit("2024-01-31").cast("date"), (k % 20).cast("int")).alias("cycle_end"),
            F.when(k % 11 != 0, F.timestamp_seconds(F.lit(1706227200) - (k * 13 % 45) * 86400 - k % 7 * 3600))
            .alias("last_seen"))

    def fields(self) -> DataFrame:
        """Crop fields: a small quadrilateral per part around its place."""
        from fieldlens.constants import CROP_KINDS
        k = F.col("p_partkey")
        lat, lng = self.place(k)
        d = F.lit(0.0005) + (F.col("p_size") % 7).cast("double") * 0.0001
        at = [(lng - d, lat - d), (lng + d, lat - d), (lng + d * 1.5, lat + d), (lng - d, lat + d)]
        ring = F.array(*[F.struct(x.alias("lng"), y.alias("lat")) for x, y in at])
        crops = F.array(*map(F.lit, CROP_KINDS))
        return self.table("part").select(
            k.alias("field_id"), F.get(crops, (F.col("p_size") % 9).cast("int")).alias("crop"),
            F.when(k % 3 != 0, F.date_add(F.lit("2023-09-20").cast("date"), (k % 60).cast("int")))
            .alias("cut_date"), ring.alias("ring"))

    def markers(self) -> DataFrame:
        from fieldlens.constants import MARKER_LABELS
        k = F.col("p_partkey")
        kinds = F.array(*map(F.lit, MARKER_LABELS))
        found = F.lit(1685577600) + (k % 200) * 86400 + (k % 24) * 3600
        return self.table("part").select(
            k.alias("marker_id"), F.get(kinds, (F.col("p_size") % 8).cast("int")).alias("kind"),
            *self.place(k), F.when(k % 6 != 0, F.timestamp_seconds(found)).alias("found_at"))

    # ---- numbered photos, bursts, imagery -------------------------------------------

    def numbered_photos(self) -> DataFrame:
        """Photos whose document carries a file name with the camera's own counter."""
        n = F.lpad((F.col("event_id") % 3000).cast("string"), 4, "0")
        name = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("DCIM/PICT"), n, F.lit(".JPG"))).otherwise("odd.JPG")
        return self._events().select(
            "camera_id", F.col("at").alias("taken_at"),
            F.to_json(F.struct(name.alias("originName"), F.col("event_id").alias("id"))).alias("raw"))

    def bursts(self) -> DataFrame:
        """Bursts of four frames: a block of set bits moving over a noisy background."""
        v = F.col("vec_id")
        step = (v % 4).cast("int")
        kind = F.floor(v / 4) % 3
        block = F.when(kind == 0, step).when(kind == 1, 3 - step).otherwise(1)
        digit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(
            (k >= 16) & (k < 48) & (k % 4 == block), "f").when(
            (k >= 60) & (F.get("embedding", k).cast("double") > 0.2), "1").otherwise("0"))
        return self.table("embeddings").select(
            v.alias("photo_id"), F.floor(v / 4).alias("visit_id"), F.col("label").cast("bigint").alias("camera_id"),
            F.timestamp_seconds(F.lit(1704067200) + v * 7).alias("taken_at"),
            F.concat(F.lit("d1:"), F.array_join(digit, "")).alias("phash"))

    def crop_history(self) -> DataFrame:
        kinds = F.array(*[F.lit(x) for x in ("corn", "soybeans", "alfalfa", None, "corn")])
        return (self.table("lineitem").groupBy(F.col("l_partkey").alias("field_id"),
                                               F.year("l_shipdate").alias("year"))
                .agg(F.get(kinds, (F.sum("l_quantity").cast("bigint") % 5).cast("int")).alias("crop")))

    @staticmethod
    def spread(key: Column) -> list[Column]:
        """A place that stays distinct for far more keys than `place`."""
        return [(F.lit(30.0) + (key % 2000).cast("double") * 0.01).alias("lat"),
                (F.lit(-120.0) + (F.floor(key / 2000) % 12500).cast("double") * 0.0048).alias("lng")]

    def spread_fields(self) -> DataFrame:
        k = F.col("p_partkey")
        lat, lng = self.spread(k)
        d = F.lit(0.0005) + (F.col("p_size") % 7).cast("double") * 0.0001
        at = [(lng - d, lat - d), (lng + d, lat - d), (lng + d * 1.5, lat + d), (lng - d, lat + d)]
        return self.table("part").select(k.alias("field_id"), F.array(*[
            F.struct(x.alias("lng"), y.alias("lat")) for x, y in at]).alias("ring"))

    def pixels(self) -> DataFrame:
        lat, lng = self.spread(F.col("l_partkey"))
        n = F.col("l_linenumber").cast("double")
        return self.table("lineitem").select(
            F.col("l_linestatus").alias("scene"), (lat + (n - 4.0) * 0.00017).alias("lat"),
            (lng + (n - 3.0) * 0.00021).alias("lng"),
            F.when(F.col("l_quantity") != 50, F.col("l_tax") * 1000 + 100).alias("red"),
            (F.col("l_discount") * 5000 + 150).alias("nir"), (F.col("l_quantity") % 12).cast("int").alias("klass"))

    def scenes(self) -> DataFrame:
        """Imagery catalogue entries: one per shipment of a part."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("field_id"), (F.col("l_suppkey") % 3).cast("string").alias("tile"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scene_id"),
            F.to_date("l_shipdate").alias("date"), (F.col("l_discount") * 700).alias("cloud"))

    # ---- ground, routes and walks ---------------------------------------------------

    def spread_stands(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("stand_id"), F.col("c_name").alias("stand_name"),
                                             F.col("c_nationkey").cast("bigint").alias("ground_id"), *self.spread(k))

    def routes(self) -> DataFrame:
        """A walk of six points up to each stand from its south-west."""
        k = F.col("c_custkey")
        lat, lng = self.spread(k)
        points = [F.struct((lng - 0.0004 * i).alias("lng"), (lat - 0.0006 * i + (k % 5).cast("double") * 0.0002).alias("lat"))
                  for i in range(5, -1, -1)]
        return self.table("customer").select(k.alias("route_id"), k.alias("stand_id"),
                                             F.array(*points).alias("points"))

    def route_winds(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("route_id"), F.when(k % 10 != 0, (k * 37 % 360).cast("double"))
                                             .alias("wind_from_deg"))

    def fixes(self, events: DataFrame | None = None) -> DataFrame:
        """Recorded walks: one track per user, with poor fixes and wild jumps in it."""
        e = F.col("event_id")
        return (self.table("events") if events is None else events).select(
            F.col("user_id").alias("track_id"), e.alias("seq"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t_ms"),
            (F.lit(44.0) + (e % 500).cast("double") * 0.0002 + F.when(e % 23 == 0, 1.0).otherwise(0.0)).alias("lat"),
            (F.lit(-90.0) + (e * 7 % 11).cast("double") * 0.00002).alias("lng"),
            F.when(e % 31 != 0, (e % 60 + 3).cast("double")).alias("acc"))

    def raw_parcels(self) -> DataFrame:
        """Parcel features as a land office sends them, blanks and all."""
        k = F.col("p_partkey")
        lat, lng = self.spread(k)
        d = F.lit(0.0006) + (F.col("p_size") % 7).cast("double") * 0.0001
        ring = F.array(*[F.struct(x.alias("lng"), y.alias("lat")) for x, y in (
            (lng - d, lat - d), (lng + d, lat - d), (lng + d, lat + d), (lng - d, lat + d))])
        codes = F.array(*[F.lit(c) for c in ("1", "4,5M", "6, 6", "99", None, "2 8")])
        return self.table("part").select(
            F.when(k % 13 != 0, k.cast("string")).otherwise(" ").alias("parcel_id"), F.array(ring).alias("rings"),
            F.when(k % 7 != 0, F.col("p_name")).otherwise("None").alias("owner_1"),
            F.when(k % 5 == 0, F.concat(F.lit(" "), F.col("p_brand"))).otherwise("").alias("owner_2"),
            (F.col("p_retailprice") / 7).alias("acres"), F.col("p_type").alias("county"),
            F.get(codes, (F.col("p_size") % 6).cast("int")).alias("class_code"))

    # ---- elevation ------------------------------------------------------------------

    GRID_SIDE = 20

    def elevation_cells(self) -> DataFrame:
        """Parts as 20 x 20 elevation patches with a saddle in the middle and some holes."""
        n = self.GRID_SIDE
        k = F.col("p_partkey")
        at = k % (n * n)
        c, r = (at % n).cast("int"), F.floor(at / n).cast("int")
        x, y = c.cast("double") - 10.0, r.cast("double") - 9.0
        z = F.lit(200.0) + (x * x - y * y) * 0.4 + x * y * 0.15 + F.col("p_size").cast("double") * 0.02
        return self.table("part").select(F.floor(k / (n * n)).alias("grid_id"), c.alias("c"), r.alias("r"),
                                         F.when(k % 97 != 0, z).alias("z"))

    def elevation_grids(self) -> DataFrame:
        n = self.GRID_SIDE
        g = F.col("grid_id").cast("double")
        return self.table("part").select(F.floor(F.col("p_partkey") / (n * n)).alias("grid_id")).distinct().select(
            "grid_id", (F.lit(-90.0) + g * 0.01).alias("west"), F.lit(44.0).alias("south"), F.lit(0.0002).alias("d_lng"),
            F.lit(0.00015).alias("d_lat"), F.lit(n).alias("cols"), F.lit(n).alias("rows"), F.lit(12.0).alias("spacing_m"))
