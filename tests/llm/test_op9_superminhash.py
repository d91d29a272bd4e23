import random
import re

import numpy as np

from tradetally.llm import op9_superminhash as op

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size=5):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORDS.findall(low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    by_id = {}
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            by_id.setdefault(i, x)
            up[top(x)] = top(by_id[i])  # rows of one id are one node
    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            if i is None or j is None or not a or not b:
                continue
            common = len(a & b)
            if 100 * common >= 85 * (len(a) + len(b) - common):
                up[top(x)] = top(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            least[top(x)] = min(least.get(top(x), i), i)
    return [(i, len(s), least[top(x)] if i is not None and s else i, (i is None or not s or least[top(x)] == i))
            for x, (i, s) in enumerate(sets)]


def texts(rng):
    def make(n):
        return [rng.choice("abcdefghijkl") + str(rng.randint(0, 50)) for _ in range(n)]
    out = [None, "", " \t\n", "one", "One", "ONE  two", "one two", "a b c d e", "A b\nc d E", "a a a a a a a", "a a a a a a a a a"]
    for size in (30, 80, 200, 500):
        base = make(size)
        out += [" ".join(base)] * 5 + [" ".join(base).upper()]
        for _ in range(25):
            near = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                near[rng.randrange(size)] = rng.choice(["new", "other", "é"])
            out.append("  ".join(near))
        chain = list(base)
        for k in range(12):  # neighbours are linked, the ends are not
            chain = chain[max(1, size // 60):] + make(max(1, size // 60))
            out.append(" ".join(chain))
    out += [" ".join(make(rng.randint(5, 300))) for _ in range(40)]
    return out


def test_brute_force(spark):
    rng = random.Random(11)
    rows = [(i * 2 + 5, t) for i, t in enumerate(texts(rng))]
    rng.shuffle(rows)
    rows += [(None, rows[3][1]), rows[20], rows[20]]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, band long, id long").repartition(6)
    got = op.near_duplicates(spark, docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:2])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_groups_are_compared_in_blocks(spark, monkeypatch):
    """A large cluster of copies with few to many changes, in small blocks."""
    monkeypatch.setattr(op, "BLOCK", 8)
    monkeypatch.setattr(op.between_groups, "__defaults__", (8,))
    rng = random.Random(5)
    base = [rng.choice("abcdef") + str(rng.randint(0, 99)) for _ in range(150)]
    rows = []
    for i in range(120):
        near = list(base)
        for _ in range(rng.randint(0, 8)):
            near[rng.choice([3, 40, 77, 100, 120, rng.randrange(150)])] = rng.choice(["x", "y"])
        rows.append((i, " ".join(near)))
    rng.shuffle(rows)
    got = op.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r)[:4] for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()}
    want = set(brute(rows))
    assert got == want and 2 < len({r[2] for r in want}) < 110


def test_intersections():
    rng = np.random.default_rng(2)
    value = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 1, 20, 40, 50, 60)]
    left, right = np.array([0, 2, 3]), np.array([1, 4, 5])
    got = op.intersections(value, left, right, columns=7)
    assert got.tolist() == [[len(np.intersect1d(value[i], value[j])) for j in right] for i in left]


def test_signature_is_superminhash():
    """Against the sequential definition: every element's full permutation."""
    rng = np.random.default_rng(0)
    sizes = [0, 1, 3, 40, 700]
    value = rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got = op.super_min_hash(value, offsets, 16)
    for t in range(len(sizes)):
        want = np.full(16, np.inf)
        for x in value[offsets[t]:offsets[t + 1]]:
            p = list(range(16))
            for level in range(16):
                d = int(op.mix(np.array([int(x) + op._STEP * (level + 1) & (1 << 64) - 1], np.uint64))[0])
                k = level + (d >> 40) % (16 - level)
                p[level], p[k] = p[k], p[level]
                want[p[level]] = min(want[p[level]], level + (d & (1 << 40) - 1) / (1 << 40))
        assert np.array_equal(got[t], want)


def test_empty_table(spark):
    assert op.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    from util import SF
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in op.query(spark, SF).collect()}
    assert got == set(brute(rows)) and sum(not r[3] for r in got) > 5
