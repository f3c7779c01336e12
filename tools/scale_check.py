"""Time core queries at sf0.1 and at an N-times copy of it (ids shifted per copy), to check
that cost grows linearly with the data.

    python tools/scale_check.py N [query ...]
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SRC = "/root/testdata/sf0.1"
DEFAULT = ["pair_input", "mark_entities", "hypothesis_input", "encode_pair", "tag_entities",
           "ensemble_soft_vote", "hard_vote", "accuracy", "hypothesis_rollup"]


def build_copy(spark, n: int, out: str) -> None:
    from pyspark.sql import functions as F

    span = 10_000_000
    for name, key in [("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")]:
        df = spark.read.parquet(f"{SRC}/{name}.parquet")
        big = (
            df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn(key, F.col(key) + F.col("__copy") * span)
            .drop("__copy")
        )
        big.repartition(max(8, n)).write.parquet(f"{out}/{name}.parquet")
    for name in ["nation", "region"]:
        spark.read.parquet(f"{SRC}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")


def time_queries(spark, d: str, names: list[str]) -> dict[str, float]:
    from relspark.plans.registry import QUERIES

    out = {}
    for name in names:
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        out[name] = round(runs[1], 3)
    return out


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 10
    names = sys.argv[2:] or DEFAULT
    from relspark.session import build_session

    spark = build_session("local[8]", 16, extra={"spark.driver.memory": "16g"})
    out = subprocess.check_output(["mktemp", "-d", "/tmp/scale-XXXXXX"]).decode().strip()
    build_copy(spark, n, out)
    base = time_queries(spark, SRC, names)
    big = time_queries(spark, out, names)
    print(json.dumps({"copies": n, "sf0.1": base, f"x{n}": big,
                      "ratio": {k: round(big[k] / base[k], 2) for k in names}}))


if __name__ == "__main__":
    main()
