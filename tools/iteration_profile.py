"""Where does the time of a training iteration that is a job go (sets beyond the
bounds of one task)? Runs a few one-vs-all iterations with Spark's event log written to a fresh scratch folder and
summarises job wall time, stage time and task run time per iteration job.
Usage: python tools/iteration_profile.py [sf_dir] [iterations]
"""

from __future__ import annotations

import dataclasses
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    iters = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    log_dir = tempfile.mkdtemp(prefix="multisvm-eventlog-")
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").appName("multisvm-profile")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from multisvm.operators.coding import OneVsAllCoding, collect_inventory
    from multisvm.operators.trainer import cache_rows, fit_coded, relayout
    from multisvm.plans.classifiers import OVA_DEFAULTS
    from multisvm.sources import embeddings, with_split

    train = with_split(embeddings(spark, sf)).where("split = 'train'").drop("split")
    params = dataclasses.replace(OVA_DEFAULTS, iterations=iters)
    cached = cache_rows(train.select("id", "label", "features"))
    inv = collect_inventory(cached)
    laid = relayout(cached, sum(inv.counts), params=params, dim=inv.dim)
    driver_sec = fit_coded(laid, OneVsAllCoding(inv.k), inv.classes, inv.dim, params, cache=False, in_task=False).history
    spark.stop()

    events = []
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as f:
            events += [json.loads(line) for line in f if line.strip()]
    jobs, stages, tasks, metrics = {}, {}, {}, {}
    for e in events:
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "stages": e["Stage IDs"]}
        elif kind == "SparkListenerJobEnd":
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            stages[info["Stage ID"]] = info.get("Completion Time", 0) - info.get("Submission Time", 0)
        elif kind == "SparkListenerTaskEnd":
            info = e["Task Info"]
            tasks.setdefault(e["Stage ID"], []).append(info["Finish Time"] - info["Launch Time"])
            m = e.get("Task Metrics") or {}
            metrics.setdefault(e["Stage ID"], []).append({
                "deserialize_ms": m.get("Executor Deserialize Time", 0),
                "run_ms": m.get("Executor Run Time", 0),
                "gc_ms": m.get("JVM GC Time", 0),
                "result_ser_ms": m.get("Result Serialization Time", 0),
            })
    # The last `iters` jobs are the iteration jobs (one each).
    it_jobs = sorted(jobs)[-len(driver_sec):]
    rows = []
    for j in it_jobs:
        job = jobs[j]
        st = [s for s in job["stages"] if s in stages]
        rows.append({
            "job_ms": job.get("end", job["start"]) - job["start"],
            "stage_ms": sum(stages[s] for s in st),
            "task_ms_max": max((max(tasks.get(s, [0])) for s in st), default=0),
            "tasks": sum(len(tasks.get(s, [])) for s in st),
            **{k: max((t[k] for s in st for t in metrics.get(s, [])), default=0)
               for k in ("deserialize_ms", "run_ms", "gc_ms", "result_ser_ms")},
        })
    med = lambda xs: sorted(xs)[len(xs) // 2]
    summary = {
        "iterations": len(rows),
        "driver_ms_per_iteration": round(1000 * med(driver_sec[2:] or driver_sec), 1),
        "job_ms": med([r["job_ms"] for r in rows[2:] or rows]),
        "stage_ms": med([r["stage_ms"] for r in rows[2:] or rows]),
        "task_ms_max": med([r["task_ms_max"] for r in rows[2:] or rows]),
        "tasks_per_job": med([r["tasks"] for r in rows]),
        **{k: med([r[k] for r in rows[2:] or rows]) for k in ("deserialize_ms", "run_ms", "gc_ms", "result_ser_ms")},
        "event_log": log_dir,
    }
    print(json.dumps(summary))


if __name__ == "__main__":
    main()
