"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_incidents", "q8_out_of_order", "w1_sliding_windows", "w2_align_grid", "w5_decimate", "s1_read_points_jsonl", "s6_prom_text_to_points",
    "s13_parse_folded", "c1_counter_rate", "c3_host_cpu_pct", "c17_group_aggregate", "p3_off_cpu", "p4_run_queue_latency", "p8_syscalls", "t4_rank",
    "d1_fit_stats", "d5_pot_thresholds", "d6_ewma", "d10_event_ring", "d20_median_filter", "d21_flag_and_segment", "x1_cusum", "x10_robust_fusion",
    "e2_segment_f1", "e3_vus_pr", "a5_severity", "a10_chi_square_ci", "h4_group_incidents", "f1_validate_feedback", "k1_process_series", "k11_flame_tree",
    "r4_sliding_windows", "x4_pot_gpd", "d12_spectral_scores", "t5_hysteresis", "k5_episodes", "r3_warmup_scorer",
]


def main() -> None:
    from telemill.plans.catalog import QUERIES
    from telemill.session import builder, clean

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-"))  # local master: one machine sees it
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()  # also starts the engine before the clock
    took: dict[str, float] = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        clean(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "events_per_sec": {q: round(rows / max(t, 1e-3)) for q, t in took.items()}, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
