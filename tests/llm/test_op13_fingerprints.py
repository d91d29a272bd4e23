import hashlib
import re

import duckdb
from pyspark.sql import functions as F
from util import SF

from tradetally.llm import op13_fingerprints as op

LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
TEXTS = [(5, "one two three four five six seven eight nine ten eleven twelve"), (4, None), (3, ""), (2, "  \t\n "),
         (9, "a b c"), (8, "x" * 100), (7, LONG), (6, LONG + " end"), (None, "no id at all"), (None, None),
         (1, "same row twice " * 9), (1, "same row twice " * 9), (1, "same row twice " * 9), (0, "ß é 日本語日本語日本語 𝔘𝔫𝔦 x y"),
         (1, "same id, other text"), (10, "tie tie tie tie tie tie tie tie tie tie tie tie")]


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def anchors(text):
    u = re.findall(op.UNIT, text)
    if len(u) < op.K:
        return [f"0:{md5(' '.join(u))[:8]}"] if u else []
    r = [md5(" ".join(u[i:i + op.S]))[:8] for i in range(len(u) - op.S + 1)]
    out, before = [], None
    for i in range(len(u) - op.K + 1):
        inner = r[i:i + op.K - op.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(f"{0 if before is None else i - before}:{md5(' '.join(u[i:i + op.K]))[:8]}")
            before = i
    return out


def like(a, b):
    most = max(len(set(a)), len(set(b)))
    return len(set(a) & set(b)) / most if most else 1.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1])))
    out = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        a, e = anchors(text), anchors(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), " ".join(a), " ".join(e),
                    like(a, e), like(a, anchors(after))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", 7) for i, t in rows], "doc_id long, text string, pos string, key int")


def key(r):
    return tuple(str(x) for x in r)


def test_equals_brute_force(spark):
    for parts in (1, 5):
        got = op.fingerprints(spark, frame(spark, TEXTS).repartition(parts)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(TEXTS), key=key)


def test_many_equal_rows_and_blocks(spark):
    rows = [(7, "the very same text in all of these rows, again and again")] * 2500 + [
        (100 + i, f"text {i} of its own with some words {i * 7} more and more {i * 13}") for i in range(300)]
    got = op.fingerprints(spark, frame(spark, rows).repartition(6)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_one_document_and_empty_table(spark):
    one = [(3, "alone it is followed by itself and by nothing else at all")]
    assert [tuple(r) for r in op.fingerprints(spark, frame(spark, one)).collect()] == brute(one)
    assert op.fingerprints(spark, frame(spark, one).limit(0)).count() == 0


def test_other_sizes_of_runs(spark):
    text = TEXTS[0][1] * 3
    row = spark.createDataFrame([(text,)], "t string").select(op.anchors(F.col("t"), 5, 3).alias("a"))
    u = re.findall(op.UNIT, text)
    r = [md5(" ".join(u[i:i + 3]))[:8] for i in range(len(u) - 2)]
    at = [i for i in range(len(u) - 4) if min(r[i:i + 3]) in (r[i], r[i + 2])]
    assert [x.split(":")[1] for x in row.first().a] == [md5(" ".join(u[i:i + 5]))[:8] for i in at]


def test_edits_leave_the_other_anchors(spark):
    words = [f"word{i * 37 % 1009}" for i in range(400)]
    edited = words[:200] + ["new", "words", "here"] + words[200:]
    a, b = anchors(" ".join(words)), anchors(" ".join(edited))
    assert like(a, b) > 0.9 and like(["1:x"], a) == 0


def test_sql_gives_the_same(spark):
    got = op.query(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(op.ORACLE_SQL)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    assert sum(r[5] > 0.5 > r[6] for r in rows) > 0.75 * len(rows)


def test_plan_is_native(spark):
    plan = op.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions|ExistingRDD", plan)
