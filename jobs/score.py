"""M7 batch scoring job.

    spark-submit jobs/score.py --model-dir <dir> --requests <parquet> --output <dir>
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv=None):
    ap = argparse.ArgumentParser(description="Score flight requests with a saved two-stage model")
    ap.add_argument("--model-dir", required=True)
    ap.add_argument("--requests", required=True)
    ap.add_argument("--output", required=True)
    a = ap.parse_args(argv)
    from skylag.operators.model import TwoStageModel, score_requests
    from skylag.session import get_session
    spark = get_session()
    model = TwoStageModel.load(spark, f"{a.model_dir}/model")
    score_requests(model, spark.read.parquet(a.requests)).write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
