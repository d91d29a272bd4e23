import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradetally.llm import op8_substrings as op

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=50):
    """Rows (id, text): (id, words, removed, kept words) by the definition."""
    first = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for j in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[j:j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def texts():
    rng = random.Random(3)
    def make(n):
        return [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["", ".", "é"]) for _ in range(n)]
    passage, other, line = make(130), make(55), make(51)
    out = [None, "", "  \n\t ", "one", " ".join(make(49)), "x " * 700, "x " * 60, "y " * 49, "x " * 51 + "z"]
    base = make(400)
    out += [" ".join(base)] * 7
    for k in range(12):
        near = list(base)
        near[rng.randrange(400)] = "changed"
        out.append("\n".join(near))
    for k in range(40):
        out.append(" ".join(make(rng.randint(0, 80)) + passage[rng.randint(0, 30):] + make(rng.randint(0, 60))))
    for k in range(20):
        out.append("  ".join(make(5) + other + make(20) + line + other[:50]))
    out.append(" ".join(make(3000) + passage + make(2000)))
    return out


@pytest.mark.parametrize("group", [op.GROUP, 700, 256, 3])
def test_brute_force(spark, group):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    rows += [(None, rows[5][1]), (None, " ".join(["x"] * 80)), rows[7], (rows[9][0], rows[11][1])]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, row long, kept string")
    got = op.remove_repeats(spark, docs.repartition(5), group=group).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_lengthened_prefixes_are_used(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = op._input(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    steps = op.prefixes(docs, 50, 12, 3)[0]
    assert len(steps) == len(op.lengths(50, 12)) == 3 and all(len(x) > 5 for x in steps)
    some = op.prefixes(docs, 50, 12, 700)[0]
    assert len(some) > 1 and len(some[0]) > 0
    assert [len(x) for x in op.prefixes(docs, 50, 12, 10**6)[0]] == [0]


def test_groups_do_not_grow_with_the_input(spark):
    """With ten times the input no subtree gets more words than before."""
    group, few = 3000, [(i, t) for i, t in enumerate(texts())]
    for rows in (few, [(i * 10 + k, t) for i, t in few for k in range(10)]):
        docs = op._input(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        large, shared = op.prefixes(docs, 50, 12, group)
        large, common = spark.sparkContext.broadcast(large), spark.sparkContext.broadcast(op.common_words(docs))
        lists = shared.groupBy("doc").agg(F.collect_set("prefix").alias("shared"))
        dealt = op._deal(docs.join(lists, "doc", "left"), large, common, 50, op.lengths(50, 12)).where("at >= 0")
        words = dealt.groupBy("prefix").agg(F.sum(F.length("words") / 2).alias("n")).agg(F.max("n")).first()[0]
        assert 0 < words <= group


def test_texts_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = op.remove_repeats(spark, docs)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_subtrees_by_definition():
    rng = np.random.default_rng(5)
    for depth, top in ((5, 2), (7, 3), (50, 1), (50, 70_000), (9, 70_000)):
        size = rng.integers(depth, depth + 40, 30)
        words = np.concatenate([np.tile(rng.integers(0, top + 1, 4), 30)[:n] for n in size])
        start = np.repeat(np.cumsum(size) - size, size)
        end = np.repeat(np.cumsum(size), size)
        want = sorted((tuple(words[i:i + depth]), i) for i in range(len(words)) if end[i] - i >= depth)
        order, head = op.subtrees(words, size, depth)
        assert [tuple(words[i:i + depth]) for i in order] == [w for w, _ in want] and set(order) == {i for _, i in want}
        assert head.tolist() == [k == 0 or want[k][0] != want[k - 1][0] for k in range(len(want))]
        assert len(start) == len(end)


@pytest.mark.parametrize("common", [65_535, 3])
def test_words_come_through_their_numbers(common, monkeypatch):
    monkeypatch.setattr(op, "COMMON", 65_535)
    frequent = np.sort(np.arange(common, dtype=np.uint64) * np.uint64(7919))
    words = [np.array([7919, 14, 7919 * 2, 14, 15], np.uint64), np.array([15, 0], np.uint64)]
    sent = [np.where(op._among(w, frequent), np.searchsorted(frequent, w), 65_535).astype("<u2") for w in words]
    rare = [w[s == 65_535].astype("<u8").tobytes() for w, s in zip(words, sent)]
    number, size = op._decoded([s.tobytes() for s in sent], rare)
    assert size.tolist() == [5, 2]
    whole = np.concatenate(words)
    assert [[a == b for b in number] for a in number] == [[a == b for b in whole] for a in whole]


def test_empty_table(spark):
    assert op.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    import hashlib

    from util import SF
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows)}
    assert {tuple(r) for r in op.query(spark, SF).collect()} == want
    assert sum(x[2] for x in want) > 0
