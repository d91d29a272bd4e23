import math

import duckdb
import numpy as np
import pytest
from util import SF

from tradetally.llm import op12_codes as op


def brute(rows):
    """(vec_id, code, error) of plain assignment in Python's integers, and the codebooks."""
    kept = [(i, [max(-op.LIMIT, min(op.LIMIT, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // op.PARTS)
    kept = [(i, v + [0] * (width * op.PARTS - len(v))) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:op.ENTRIES]
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(op.PARTS)]
    books = [[cut(v)[p] for _, v in first] for p in range(op.PARTS)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(op.ROUNDS):
        parts = [(p, near(x, p)[1], x) for _, v in kept for p, x in enumerate(cut(v))]
        new = [list(b) for b in books]
        for p in range(op.PARTS):
            for e in range(len(books[p])):
                own = [x for q, f, x in parts if (q, f) == (p, e)]
                if own:
                    new[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
        books = new
    out = []
    for i, v in kept:
        best = [near(x, p) for p, x in enumerate(cut(v))]
        out.append((i, bytes(e for _, e in best), sum(d for d, _ in best)))
    return out, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, (i or 0) % 3 if i != 5 else None, 9) for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, code int")


def key(r):
    return str(r)


def sample(n, dim, seed, scale=1.0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32) * np.float32(scale)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_plain_assignment(spark, parts):
    rows = sample(400, 32, 3, 0.2)
    rows += [(None, rows[4][1]), (7, rows[7][1]), (7, rows[9][1]), (900, None), (901, [math.nan] * 32),
             (902, [math.inf] + [0.0] * 31), (903, [None] + [0.0] * 31), (904, [0.0] * 32), (905, [1.0] * 20), (906, [])]
    got, books = op.codes(spark, frame(spark, rows).repartition(parts))
    want, plain = brute(rows)
    assert sorted([(r.vec_id, bytes(r.code), r.error) for r in got.collect()], key=key) == sorted(want, key=key)
    assert books.tolist() == [[list(c) for c in b] for b in plain]


def test_ties_and_few_rows(spark):
    rows = [(i, [float(i % 2)] * 16) for i in range(10)]
    got, _ = op.codes(spark, frame(spark, rows))
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in got.collect()) == brute(rows)[0]


def test_huge_components(spark):
    rows = [(i, [float(np.float32(v * (1 + j * i))) for j, v in enumerate(x)]) for i, x in sample(90, 16, 5, 3000.0)] + [(500, [3e38] * 16)]
    got, _ = op.codes(spark, frame(spark, rows))
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in got.collect()) == brute(rows)[0]


def test_bounds_spare_measuring():
    """Most parts stay with their entry by bounds alone, and bounds hold."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 4)) * 60).astype(np.int64)
    book = x[:64].copy()
    near, low, outer = op.nearest(op.distances(x, book), 16)
    new = book + rng.integers(-3, 4, book.shape)
    drift = np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-12)
    best, order, bounds, out, needed = op.moved(x, new, near, low, outer, drift)
    d = op.distances(x, new)
    assert (order[:, 0] == d.argmin(1)).all() and (best == d.min(1)).all()
    true = np.sqrt(np.take_along_axis(d, order.astype(int), 1))
    assert (bounds[:, 1:] <= true[:, 1:]).all()
    others = np.ones_like(d, bool)
    np.put_along_axis(others, order.astype(int), False, 1)
    assert (out <= np.sqrt(np.where(others, d, 1 << 60).min(1))).all()
    assert (needed == 1).mean() > 0.5 and (needed < 16).mean() > 0.9
    cut = op.adapted(order[:, None], bounds[:, None], out[:, None], needed[:, None], 8)
    assert 8 <= cut[0].shape[2] <= 16 and (cut[2] <= out[:, None]).all()


def test_empty_table(spark):
    got, books = op.codes(spark, frame(spark, sample(3, 16, 1)).limit(0))
    assert got.count() == 0 and books.size == 0


def test_sql_gives_the_same(spark):
    got = op.query(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(op.ORACLE_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
