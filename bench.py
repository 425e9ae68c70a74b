"""Time the headline queries. Prints one JSON line."""

import json
import os
import sys
import time

from caseledger.session import local_session
from catalogue import queries

HEADLINE = (
    "s07_dedupe_events", "a01_fold", "a04_phase_reach", "a06_stage_dwell_in", "a06_dwell_of_parts",
    "a07_funnel", "a12_channels", "x23_activity", "c08_board", "m02_screen", "m06_run_ladder",
    "x14_role_from_body", "r01_embed_lexical", "j11_blocked_similarity", "p01_scrub_text",
    # Timed since the second round; the heaviest of the composed reports and the resolver.
    "c10_statistics", "c11_today", "r05_place_signals", "r06_find_duplicates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    registered = queries()
    # Start the workers and the code cache before anything is timed.
    registered["f06_confidence_floor"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
