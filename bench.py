"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seriesloom.session import build_session  # noqa: E402
from seriesloom.workload import QUERIES  # noqa: E402

HEADLINE = [
    "w1_strongest_moments",
    "d8_derived_view",
    "w2_energy_ticks",
    "w5_two_rail_keyframes",
    "w9_leaky_sum",
    "w13_cusum",
    "w12_first_alarm",
    "b11_dispositions",
    "j1_as_of_join",
    "j2_two_sided_blend",
    "a6_decile_rates",
    "f3_magnitude_spectra",
    "f4_frame_loudness",
    "f16_tempo",
    "w16_phase_average",
    "b5_coding_cost",
    "b6_b7_b8_snapshot_metrics",
    "h1_content_hash",
    "h2_bar_recall",
    "h6_greedy_pool",
    "h3_h4_linked_ledger",
    "x5_blended_signature",
    "x7_top_matches",
    "st5_sliding_frames",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["w5_two_rail_keyframes"](spark, sf_dir).count()  # start the JVM's and Python's workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
