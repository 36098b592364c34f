"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2, the
better one counts), BENCH_QUERIES (set: time the registered queries as they are). Every column of every row is produced (noop sink). The encoding jobs are timed on the arrays
they hand to a trainer, not on the digests their registered queries reduce them to.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "text_training_batches",
    "image_training_batches",
    "serving_batches",
    "training_feed",
    "assign_batches",
    "pad_right",
    "crop_plan",
    "grid_mean_pool",
    "tokenize",
    "vocab_lookup",
    "running_meter",
    "keep_last_k",
    "restore_boxes",
    "stream_prompts",
]


def main() -> None:
    from pixelquilt.catalog import QUERIES
    from pixelquilt.catalog import intake, jobs, sequences
    from pixelquilt.session import build_session

    raw = {
        "text_training_batches": intake.text_batches,
        "image_training_batches": jobs.image_rows,
        "serving_batches": jobs.serving_rows,
        "training_feed": jobs.feed_rows,
        "pad_right": sequences.padded_rows,
    }
    timed = dict(QUERIES) if os.environ.get("BENCH_QUERIES") else {**QUERIES, **raw}

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench", f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            timed[name](spark, directory).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
