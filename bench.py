"""Time the headline queries on the tables in $BENCH_SF_DIR; prints one JSON line.

Each query is run twice and the second time counts, so that class loading and code
generation of the first run do not. Results go to the noop sink: every row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from panelspark.plans import catalog
from panelspark.session import local_session

HEADLINE = [
    "q05_distinct_keys", "q09_cohort_shift_join", "q12_grid_completion", "q15_product_complement", "q18_argmin_per_group",
    "q22_lag_cumsum", "q23_gap_fill_linear", "q24_midpoint_to_single", "q26_union_project_forward", "q27_transition_rates",
    "q28_composition_roll", "q29_coupled_roll", "q29_scenario_averted", "q31_cumulative_averted", "q33_calibration",
    "q33b_calibration_full_grid", "q35_potential_impact", "q37b_cascade_impact", "q41_survival_prob", "q44_cost_per_unit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    took: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
