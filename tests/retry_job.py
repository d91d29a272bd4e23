"""Run by test_retries.py in its own process: reconcile with injected task
failures (first attempt of some tasks fails) and print the results as JSON."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tradetally.operators.reconcile import reconcile  # noqa: E402
from tradetally.session import build_session  # noqa: E402
from tradetally.sources.fixtures import FEED_ORDER, feed_a, feed_b  # noqa: E402


def _flaky(x):
    ctx = TaskContext.get()
    if ctx is not None and ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        raise RuntimeError("injected first-attempt failure")
    return x


def main():
    spark = build_session("local[4,4]", 4)       # up to 4 attempts per task
    flaky = F.udf(_flaky, "string")
    sf = sys.argv[1]
    a = feed_a(spark, sf).withColumn("trade_id", flaky("trade_id"))       # map-stage failures
    r = reconcile(a, feed_b(spark, sf), order_by=FEED_ORDER, run_id="retry")
    breaks, obs = r.observed_breaks()
    out = tempfile.mkdtemp(prefix="tt-retry-")
    breaks.withColumn("break_type", flaky("break_type")).write.mode("overwrite").parquet(out)  # result stage
    written = spark.read.parquet(out)
    print(json.dumps({"observed": obs.get, "written": written.count(),
                      "distinct_ids": written.select("break_id").distinct().count()}))
    spark.stop()


if __name__ == "__main__":
    main()
