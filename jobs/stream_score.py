"""ST1 streaming scoring job.

    spark-submit jobs/stream_score.py --model-dir <dir> --source <dir of request parquet files>
        --output <dir> --checkpoint <shared dir> [--every "30 seconds"] [--max-files 8]

Without ``--every`` it scores what is available and stops. The checkpoint
folder must be on shared storage; a restarted job resumes from it.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv=None):
    ap = argparse.ArgumentParser(description="Score a stream of flight requests")
    ap.add_argument("--model-dir", required=True)
    ap.add_argument("--source", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--checkpoint", required=True)
    ap.add_argument("--every", default=None)
    ap.add_argument("--max-files", type=int, default=8)
    a = ap.parse_args(argv)
    from skylag.operators.model import TwoStageModel
    from skylag.session import get_session
    from skylag.streaming.jobs import stream_scoring
    spark = get_session()
    model = TwoStageModel.load(spark, f"{a.model_dir}/model")
    schema = spark.read.parquet(a.source).schema
    stream_scoring(spark, model, a.source, schema, a.output, a.checkpoint, a.max_files, a.every).awaitTermination()


if __name__ == "__main__":
    main()
