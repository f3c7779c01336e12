"""Run headline queries at sf0.1 and print their physical plans (as planned before AQE
re-optimizes stages at run time).

    python tools/dump_plans.py > /tmp/plans.txt
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NAMES = ["hypothesis_input", "hypothesis_statements", "score_hypotheses", "score_two_sentence", "encode_label", "mark_entities", "tag_entities", "accuracy",
         "hard_vote", "hypothesis_rollup", "read_raw_examples", "stack_predictions", "score_batches",
         "accuracy_from_scores", "bce_with_logits", "threshold_sweep", "accuracy_interval", "encode_subwords", "token_batches", "tag_paths"]


def main() -> None:
    from relspark.plans.inspect import physical_plan
    from relspark.plans.registry import QUERIES
    from relspark.session import build_session

    spark = build_session("local[8]", 16)
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    for name in NAMES:
        df = QUERIES[name](spark, d)
        text = physical_plan(df, "simple")
        final = re.sub(r"#\d+L?", "", text)
        final = re.sub(r"\[plan_id=\d+\]", "", final)
        lines = [ln[:180] for ln in final.splitlines() if ln.strip()]
        print(f"### {name}\n\n```")
        print("\n".join(lines))
        print("```\n")


if __name__ == "__main__":
    main()
