import random

import numpy as np

from tradetally.llm import op1_decontam as op

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert op.common_subsequence(op._masks(a), len(a), b) == lcs(a, b)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    common = ["the", "of", "and", "to", "in"]

    def make(n):
        return [rng.choice(common) if rng.random() < 0.35 else rng.choice(vocabulary) for _ in range(n)]
    items = [make(n) for n in (15, 18, 25, 30, 38, 45, 55, 70, 120)]
    docs = {}
    for i in range(150):
        docs[i] = " ".join(make(rng.randint(5, 400)))
    want = {}
    for k, item in enumerate(items):
        exact, changed = list(item), list(item)
        for at in rng.sample(range(len(item) - 4), max(1, len(item) // 8)):
            changed[at] = rng.choice(vocabulary)
        docs[1000 + k] = " ".join(make(100) + exact + make(77))
        docs[1100 + k] = " ".join(make(31) + changed + make(200)).title()
        docs[1200 + k] = " ".join(item)
        want |= {1000 + k: [k], 1100 + k: [k], 1200 + k: [k]}
    docs[1300] = " ".join(make(3000) + items[3] + make(50) + items[5] + make(4000))
    want[1300] = [3, 5]
    return [(k, " ".join(x)) for k, x in enumerate(items)], docs, want


def test_planted_passages(spark):
    items, docs, want = corpus()
    rows = [(i, t, 1) for i, t in docs.items()] + [(2000, None, 1), (2001, "", 1), (None, docs[1000], 1), (1000, docs[1000], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, share int").repartition(4)
    b = spark.createDataFrame(items + [(50, None), (51, "  "), (None, "x"), (60, items[0][1])], "item_id long, text string")
    got = op.find_leaks(spark, d, b).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = want.get(r.doc_id, [0] if r.doc_id is None else [])
        if 0 in expected:
            expected = [*expected, 60]
        assert r.item_ids == expected and r.contaminated == bool(expected), r.doc_id


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in op.find_leaks(spark, d, b).collect()] == [False]
    b = spark.createDataFrame([(1, "some text of three")], "item_id long, text string")
    assert op.find_leaks(spark, d.limit(0), b).count() == 0


def test_svd_finds_the_main_directions(spark):
    items, docs, _ = corpus()
    d = spark.createDataFrame([(i, t) for i, t in docs.items()], "id long, text string")
    df, n = op.document_frequency(op.hashed_words(d))
    assert n == len(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.01
    basis = op.randomised_svd(op.hashed_words(d), [], idf, 1)
    assert np.allclose(basis.T @ basis, np.eye(op.RANK), atol=1e-4)
    gram = np.zeros((op.BUCKETS, op.RANK))
    power = 0.0
    for t in docs.values():
        cell, offsets = op._buckets([t.encode()])
        for lo, hi in op._passages(cell, offsets, 48):
            c, k = np.unique(cell[lo:hi], return_counts=True)
            x = k * idf[c]
            x /= np.sqrt((x * x).sum())
            gram[c] += np.outer(x, x @ basis[c])
            power += 1
    kept = np.trace(basis.T @ gram)
    assert kept > 1.5 * power * op.RANK / 1500  # more than directions at random would hold


def test_svd_products_hold_every_passage():
    """Against one passage at a time."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)).encode() for n in (0, 1, 23, 24, 25, 48, 49, 72, 73, 500)]
    idf = rng.random(op.BUCKETS + 1)
    idf[-1] = 0
    right = rng.standard_normal((op.BUCKETS + 1, 7))
    cell, offsets = op._buckets(texts)
    want = np.zeros((op.BUCKETS + 1, 7))
    for lo, hi in op._passages(cell, offsets, 48):
        c, k = np.unique(cell[lo:hi], return_counts=True)
        x = k * idf[c]
        x /= np.sqrt((x * x).sum())
        want[c] += np.outer(x, x @ right[c])
    got = np.zeros((op.BUCKETS + 1, 7))
    op._product(got, (right * idf[:, None]).astype(np.float32), idf, cell, offsets)
    assert np.allclose(got, want, atol=1e-3)


def test_svd_is_fitted_on_all_documents(spark):
    """Documents of words of their own, of which a sample would hold a part: the
    space holds the direction that the last one of many shares with none."""
    rows = [(1, " ".join(f"a{i % 40}" for i in range(200))) for _ in range(2600)] + [(1, " ".join(f"z{i % 40}" for i in range(4000)))] * 20
    d = spark.createDataFrame(rows, "id long, text string").repartition(8)
    df, n = op.document_frequency(op.hashed_words(d))
    basis = op.randomised_svd(op.hashed_words(d), [], np.log((n + 1) / (df + 1)) + 0.01, n)
    for letter in "az":
        cell = op._buckets([" ".join(f"{letter}{i}" for i in range(40)).encode()])[0]
        x = np.zeros(op.BUCKETS)
        x[cell] += np.log((n + 1) / (df[cell] + 1)) + 0.01
        assert np.linalg.norm(basis.T @ x) > 0.95 * np.linalg.norm(x)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r.item_ids for r in op.query(spark, SF).collect()}
    assert got.keys() <= docs.keys()
    exact = {i: {k for k, b in items.items() if b in (t or "")} for i, t in docs.items()}
    assert sum(map(bool, exact.values())) > 3
    for i, found in exact.items():
        assert found <= set(got.get(i, ()))
    assert sum(not exact[i] for i in got) <= 0.01 * len(docs)


def test_buckets_are_those_of_words():
    texts = [b"", b"one Two one", b"  \n", "é 日本 Z\tz".encode(), b"x" * 200_000, b"w1 w2 " * 70_000]
    cell, offsets = op._buckets(texts)
    words = [t.lower().split() for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    known = {w: int(op._buckets([w])[0][0]) for w in set(flat)}
    assert cell.tolist() == [known[w] for w in flat]
    many = [f"word{i}".encode() for i in range(20_000)]
    assert len(set(op._buckets(many)[0].tolist())) > 0.65 * op.BUCKETS
