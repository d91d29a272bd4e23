"""White space is stripped once for each column, by the same rules as before."""

import re

from pyspark.sql import functions as F

from tradetally.functions.text import fold_strip, strip
from tradetally.plans.registry import all_queries
from tradetally.schemas import NA_TOKENS, WHITE_SPACE

SF = "/root/testdata/sf0.001"


def test_strip_equals_python_on_every_white_space(spark):
    odd = [w for w in WHITE_SPACE] + ["", "x", "\x7f", "\x00", "é", "日", "​", "~", "!"]
    texts = [a + m + b for a in odd for m in ("", "a", "é b", " ") for b in odd] + [None, *NA_TOKENS, " N/A "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", strip(F.col("t")).alias("s"), fold_strip(F.col("t")).alias("f")).collect():
        want = None if r.t is None else r.t.strip(WHITE_SPACE)
        assert r.s == want
        assert r.f == (None if r.t in NA_TOKENS else want)


def test_each_column_is_stripped_once(spark):
    plan = all_queries()["validate_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\btrim\(BOTH|\bbtrim\(|\btrim\(", plan)) <= 14
