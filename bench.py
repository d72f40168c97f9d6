"""Benchmark: load the graph snapshot, then time every BI read query.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; one warm-up run is added).  Prints one JSON line:
{"metric": "bi_total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [s for s in os.environ.get("BENCH_ONLY", "").split(",") if s]

    from graphbi.plans import bi
    from graphbi.session import build_session
    from graphbi.sources.store import load_graph

    spark = build_session(cpus=cpus)
    t0 = time.time()
    g = load_graph(spark, sf_dir, fresh=True)
    load_sec = time.time() - t0

    times: dict[str, float] = {"load": round(load_sec, 3)}
    for name, fn in bi.QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        params = bi.DEFAULTS[name]
        runs = []
        for i in range(repeat + 1):
            t = time.time()
            fn(g, **params).collect()
            if i > 0:
                runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
    if not only or "refresh" in only:
        # write path: one daily batch (inserts, cascading deletes, precomputations)
        from graphbi.plans import refresh as R
        from graphbi.plans.refresh_queries import batch_deletes
        batched = R.with_batches(g)
        deletes = R.store(spark, batch_deletes(batched, R.FIRST_BATCH))
        initial, batch = R.initial_and_batch(spark, g)
        initial, batch = R.store(spark, initial), R.store(spark, batch)
        t = time.time()
        R.refresh_batch(spark, initial, batch, deletes)
        times["refresh_batch_writes"] = round(time.time() - t, 3)
        # the same batch applied in place (appends + touched partitions only)
        from graphbi.plans.live_store import LiveStore, apply_batch_in_place
        from graphbi.session import scratch_path
        store = LiveStore.create(spark, scratch_path(spark, "live"), batched, R.FIRST_BATCH,
                                 {t: g[t] for t in R.STATIC})
        ins = R.store(spark, R.batch_rows(batched, R.FIRST_BATCH))
        t = time.time()
        apply_batch_in_place(spark, store, R.FIRST_BATCH, ins, deletes)
        times["refresh_in_place_writes"] = round(time.time() - t, 3)
    total = round(sum(v for k, v in times.items() if k.startswith("bi_")), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "bi_total_median_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
