"""Time the headline queries: one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

`value` sums HEADLINE only, so rounds compare; `queries` also has MORE. `rows_per_sec` gives the
rows of the tables a query reads over its time, here and on the next smaller tables beside it.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = ["camera_band_board", "axis_rates", "camera_board", "photo_visits", "photo_visit_assignment", "detections_with_weather",
            "band_estimates", "matched_evidence", "counter_gap_summary", "movement_by_hour", "movement_by_temperature",
            "wind_climatology", "rating_spearman", "harvest_states", "zonal_ndvi", "ground_clusters", "stands_near_cameras",
            "points_in_parcels", "scent_hits", "stand_ranking", "terrain_slope_aspect", "terrain_hillshade", "terrain_summary",
            "merge_photos"]
MORE = ["terrain_smoothed", "terrain_saddles", "terrain_benches", "best_shifts", "crop_verdicts", "reference_radius",
        "empty_scene_matches", "track_cleaning", "document_leaves", "stream_counter_holes"]
SCALED = ["axis_rates", "photo_visits", "movement_by_hour", "zonal_ndvi", "terrain_slope_aspect"]
RUNS = 2


def timed(run, spark, folder: str, runs: int) -> float:
    best = None
    for _ in range(runs):
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    return best


def rows_read(spark, df) -> int:
    """Rows of the files a query reads, each once."""
    return sum(spark.read.parquet(f).count() for f in set(df.inputFiles()) if "/checkpoint" not in f)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    from pyspark.sql import SparkSession

    from fieldlens.queries import load
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("fieldlens-bench")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    registry["photo_visits"].run(spark, folder).write.format("noop").mode("overwrite").save()      # warm the JVM
    times = {name: round(timed(registry[name].run, spark, folder, RUNS if name in HEADLINE else 1), 3) for name in HEADLINE + MORE}
    smaller = folder.rstrip("/").removesuffix("0.1") + "0.01"
    pace: dict[str, dict[str, int]] = {name: {} for name in SCALED}
    for at in filter(os.path.isdir, (folder, smaller)):
        for name in SCALED:
            took = times[name] if at == folder else timed(registry[name].run, spark, at, 1)
            pace[name][os.path.basename(at.rstrip("/"))] = round(rows_read(spark, registry[name].run(spark, at)) / took)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec",
                      "queries": times, "rows_per_sec": pace, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
