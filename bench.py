"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs its whole plan into Spark's ``noop`` sink (every row and column is computed,
nothing is collected to the driver).  Timings include building the plan and, for
``tag_entities``, running the tagger and checkpointing its table; what the library remembers
for a session (label statistics, fixture plans) is paid by the first run only.

The test tables are single files of one row group, which Spark reads in one task.  At scale a
table has far more splits than cores, so the two tables that the queries read are first copied
into ``PARTS`` files each (not timed) and the queries read that copy, whole.  With
``BENCH_LAYOUT=given`` the tables are read as they are.

Every query runs four times: the first (cold) run pays one-time code generation and JIT
compilation; the median of the three warm runs is reported in ``queries`` / ``value``, the first
runs in ``cold_queries`` / ``cold_total``.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "encode_label",
    "mark_entities",
    "pair_input",
    "typed_pair_input",
    "tag_entities",
    "two_sentence_input",
    "hypothesis_input",
    "hypothesis_statements",
    "encode_pair",
    "softmax",
    "threshold_decode",
    "ensemble_soft_vote",
    "pair_soft_vote",
    "hard_vote",
    "hypothesis_rollup",
    "accuracy",
    "confusion_counts",
    "bce_with_logits",
    "score_batches",
    "score_hypotheses",
    "score_two_sentence",
]


PARTS = 32


def spread_copy(spark, sf_dir: str) -> str:
    """A copy of the folder's tables below the scratch folder, the large ones in ``PARTS`` files."""
    from relspark.session import scratch_path

    out = scratch_path(spark, "bench-tables")
    for name, parts in {"documents": PARTS, "embeddings": PARTS, "labels": 1, "nation": 1, "region": 1}.items():
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{out}/{name}.parquet")
    return out


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in sys.argv[1:]] or HEADLINE

    from relspark.plans.registry import QUERIES
    from relspark.session import build_session

    spark = build_session(
        f"local[{cpus}]",
        shuffle_partitions=max(8, cpus * 2),
        app_name="relspark-bench",
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    source = sf_dir
    if os.environ.get("BENCH_LAYOUT") != "given":
        sf_dir = spread_copy(spark, sf_dir)
    # warm-up: JVM, the fixture scan, and the Python workers used by mapInPandas
    run_noop(QUERIES["pair_input"](spark, sf_dir))
    run_noop(
        spark.range(0, 1000, 1, cpus).mapInPandas(lambda it: (b for b in it), "id long")
    )

    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in only:
        runs = []
        for _ in range(4):
            t0 = time.perf_counter()
            run_noop(QUERIES[name](spark, sf_dir))
            runs.append(round(time.perf_counter() - t0, 3))
        cold[name], times[name] = runs[0], sorted(runs[1:])[1]
    spark.stop()
    sf = os.path.basename(source).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "cold_total": round(sum(cold.values()), 3),
                "cold_queries": cold,
            }
        )
    )


if __name__ == "__main__":
    main()
