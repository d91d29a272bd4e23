import numpy as np
from pyspark.sql import functions as F

from tradetally.llm import op4_permutation as op


def brute(rows, k=5):
    """Exact neighbours of every id divisible by 50."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    good = list({i: (i, v) for i, v in good if np.any(v)}.values())
    out = {}
    for i, q in good:
        if i % 50 == 0:
            s = [(-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for j, v in good if j != i]
            out[i] = sorted((round(x, 12), j) for x, j in s)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(-r.score, 12), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def run(spark, rows):
    v = frame(spark, rows).withColumn("id", F.lit(1)).withColumn("near", F.lit("x")).repartition(3)
    return found(op.search(spark, v, v.where("vec_id % 50 = 0")))


def vectors(n, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, 8)).astype(np.float32)
    return [(i, x[i].tolist()) for i in range(n)]


def test_few_vectors_are_all_found(spark):
    rows = vectors(4) + [(50, [1.0] * 8), (7, None), (8, []), (9, [0.0] * 8), (10, [float("nan")] * 8),
                         (11, [float("inf")] + [1.0] * 7), (12, [None] + [1.0] * 7), (100, [0.0] * 8), (None, [1.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_copies_and_ties(spark):
    rows = vectors(300) + [(1000 + i, vectors(1)[0][1]) for i in range(120)]
    rows += [rows[3], rows[50]]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    assert got[0] == want[0] and got[1000] == want[1000]  # ties go to the smaller ids
    hit = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_a_query_that_the_index_leaves_short(spark, monkeypatch):
    monkeypatch.setattr(op, "PIVOTS", 8.0)
    monkeypatch.setattr(op, "POSTED", 1)
    monkeypatch.setattr(op, "PROBED", 1)
    rows = vectors(60)
    got, want = run(spark, rows), brute(rows)
    assert all(len(got[q]) == 5 for q in want)


def test_empty_table(spark):
    v = frame(spark, [])
    assert op.search(spark, v, v).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = found(op.query(spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hit = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
