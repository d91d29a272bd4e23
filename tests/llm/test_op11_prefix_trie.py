import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from util import SF

from tradetally.llm import op11_prefix_trie as op


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, out = {}, []
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        below = kids.get(n, [])
        leaves[n] = sum(leaves[k] for k in below) or 1
        saved[n] = sum(saved[k] for k in below) + (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])),
                    leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 5) for r in rows],
                                 "conv_id long, turn long, role string, text string, p1 string, depth int")


def got(spark, df):
    return sorted(map(tuple, op.trie(spark, df).collect()), key=lambda r: r[:2])


def some(n, seed, words=4):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["ab", "é日𝔘", "", None, "long text"][:words]))
            for c in range(n) for t in range(r.randrange(1, 8))]


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_brute_force(spark, parts):
    rows = some(250, 1) + [(None, 0, "user", "no id"), (-5, 1, "user", "ab"), (-150, 0, "user", "x"), (-101, 9, "user", "x"),
                           (300, None, "user", "null first"), (300, None, "user", "tie"), (300, 4, "a", "b"), (300, 4, "a", "b"),
                           (912, 1, "user", "base is absent"), (10**15 + 7, 1, "u", "v")]
    rows += [(400 + c, t, "user", "same everywhere") for c in range(60) for t in range(9)]
    assert got(spark, frame(spark, rows).repartition(parts)) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(4000)]
    rows += [(101, t, "user", f"turn {t % 7}") for t in range(3500)]  # rebuilt as its base, then its own
    rows += [(102, t, "user", "the same") for t in range(3000)] + [(7, None, None, None)] * 2000
    assert got(spark, frame(spark, rows).repartition(8)) == brute(rows)


def test_a_small_sketch_changes_nothing(spark, monkeypatch):
    rows = some(300, 2, 5)
    monkeypatch.setattr(op, "BLOCK", 64)
    monkeypatch.setattr(op, "MOST_COUNTERS", 128)
    monkeypatch.setattr(op, "PIECE", 60)
    assert got(spark, frame(spark, rows).repartition(3)) == brute(rows)


def test_sketch_never_counts_short(spark):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4000, 9000)
    df = spark.createDataFrame([(int(i), int(i) * 31, 1) for i in ids], "p1 long, p2 long, depth long").repartition(5)
    width = 1 << 16
    bits = op.sketch(df, width)
    values, counts = np.unique(ids, return_counts=True)
    proven = np.zeros(len(values), bool)
    for row, at in zip(bits, op.slots(values, values * 31, np.ones(len(values), np.int64), width)):
        proven |= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 0
    assert not proven[counts > 1].any() and proven[counts == 1].mean() > 0.99


def test_tails_are_screened(spark):
    rows = [(c, t, "user", f"own text {c} {t}") for c in range(200) for t in range(8)]
    turns, _ = op.placed(spark, frame(spark, rows))
    _, prefixes, _ = op.rebuilt(spark, turns)
    found, _ = op.screened(spark, prefixes)
    assert found.where("tail").count() > 0.5 * prefixes.count()


def test_turnless_and_empty(spark):
    h = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(h, 1, "user", "its base is absent, its one turn goes")]
    assert got(spark, frame(spark, rows)) == brute(rows)
    assert got(spark, frame(spark, rows).limit(0)) == []


def test_sql_gives_the_same(spark):
    df = op.query(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.sql(op.ORACLE_SQL)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
