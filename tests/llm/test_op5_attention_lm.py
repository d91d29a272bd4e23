import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradetally.llm import op5_attention_lm as op

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def base(rows, learn):
    c = Counter(t for i, x in rows if learn(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(i, not learn(i), len(t := tokens(x)), sum(c[w] > 0 for w in t), n,
             sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, x in rows]


def same(got, want):
    key = lambda r: (str(r[0]), *map(float, r[2:]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_query_base_and_model(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = op.query(spark, SF).collect()
    same([tuple(r)[:6] for r in out], base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2))
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_edges(spark, monkeypatch, frequent):
    monkeypatch.setattr(op, "FREQUENT", frequent)
    rows = [(1, None), (2, ""), (3, "A a\tÀ à a"), (4, "word " * 3000), (5, "a b c"), (5, "a b c"), (6, "　 x"), (None, "a q q"), (7, "new 7 words")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, rid int").repartition(3)
    got = op.score(spark, docs, F.coalesce(F.col("doc_id"), F.lit(0)) < 7).collect()
    same([tuple(r)[:6] for r in got], base(rows, lambda i: (i or 0) < 7))
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] < 0
    none = op.score(spark, docs, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.n_known == 0 and r.base_score == 0 for r in none)
    assert op.score(spark, docs.limit(0), F.lit(True)).count() == 0


def test_tasks_forget_words(spark, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5)
    monkeypatch.setattr(op, "SLICE", 2)
    rows = [(i, f"A{i % 7} b{i} word É {'x ' * (i % 5)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    same([tuple(r)[:6] for r in op.score(spark, docs, F.col("doc_id") % 3 != 0).collect()], base(rows, lambda i: i % 3 != 0))


def test_ids_of_words_are_those_of_the_text(spark):
    words, encode = op.Words(op.default_tokenizer(), {}), op.WordIds.of(op.default_tokenizer())
    for t in ("It's a TEST, of. words é\x0b.,x don't 12 ..", "", "again a TEST", "　 wide", "É. é, ß ª º. µ, ÿ Ā ΣΑΣ. e\u0301, x.. ,. . , a1. _. İ <|endoftext|>."):
        got = words.ids(words.places(t.encode().split()))
        assert got.tolist() == op._ids(encode, [t.encode()])[0].tolist()[:-1]


def lm():
    rng = np.random.default_rng(0)
    counts = np.zeros(op.VOCABULARY)
    counts[:50] = rng.integers(1, 100, 50)
    counts[op.BORDER] = 20
    return op.Attention(counts)


def test_windows_score_every_id_once():
    """Against one window at a time, without batches."""
    net, rng = lm(), np.random.default_rng(1)
    net.p["far"] = rng.standard_normal(op.WINDOW).astype(np.float32)
    texts = [np.append(rng.integers(0, 60, n), op.BORDER) for n in (0, 1, 18, 19, 20, 33, 34, 35, 49, 200)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.score(np.concatenate(texts), offsets, net.tables())
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def step(context, target):
        e = p["e"][net.row[context]]
        s = (e[-1] @ p["q"]) @ (e @ p["k"]).T / math.sqrt(op.DIM) + p["far"][np.arange(len(e))[::-1]]
        a = np.exp(s) / np.exp(s).sum()
        z = np.tanh(a @ (e @ p["v"]) @ p["o"] + e[-1] @ p["r"] + p["b"]) @ p["c"] + p["d"]
        return (z[net.cls[target]] - np.log(np.exp(z).sum())) / math.log(10) + net.within[target]
    for t, value in zip(texts, got):
        before = np.append(op.BORDER, t[:-1])
        want = 0.0
        for i in range(len(t)):
            lo = 0 if i < op.WINDOW else -(-(i - op.WINDOW + 1) // op.STRIDE) * op.STRIDE
            want += step(before[lo:i + 1], t[i])
        assert abs(want - value) < 1e-3 * max(1, abs(want))


def test_probabilities_sum_to_one():
    net = lm()
    all_ids = np.arange(op.VOCABULARY)
    # the texts of one id: its probability times that of the end
    z = net.p["d"] + np.tanh(net.tables()["v"][net.row[op.BORDER]] + net.tables()["r"][net.row[op.BORDER]]) @ net.p["c"]
    cls = np.exp(z) / np.exp(z).sum()
    assert abs((cls[net.cls[all_ids]] * 10 ** net.within[all_ids]).sum() - 1) < 1e-4


def test_training_helps():
    rng = np.random.default_rng(2)
    x = np.cumsum(np.ones((400, op.WINDOW + 1), int), axis=1) + rng.integers(0, 40, (400, 1))
    x = x % 40  # each id follows from the one before it
    net = lm()
    flat = np.append(x[0][1:], op.BORDER)
    before = net.score(flat, np.array([0, len(flat)]), net.tables())[0]
    net.train(x[:, :-1], x[:, 1:], np.ones((400, op.WINDOW), np.float32))
    assert net.score(flat, np.array([0, len(flat)]), net.tables())[0] > before + 5


def test_every_training_text_is_learnt_from(spark, monkeypatch):
    """The start sees a window of about one text; what follows what is learnt from the others."""
    monkeypatch.setattr(op, "SAMPLE", 1)
    monkeypatch.setattr(op, "WINDOWS_PER_TEXT", 1)
    seen, learn = [], op.learn_all
    monkeypatch.setattr(op, "learn_all", lambda *a: seen.append(learn(*a)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[(i + k) % 26] for k in range(400))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [r.score for r in op.score(spark, docs, F.col("doc_id") % 10 != 0).collect() if r.doc_id % 10 == 0]
    assert seen == [1350 * 21]  # 400 ids and the end
    # a letter is 1 of 26, about 0.04, unless the one before it tells
    assert all(s > -0.8 * 400 * math.log10(26) for s in got)


def test_scores_do_not_follow_the_dealing(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARDING", 8)  # several shards
    rng = np.random.default_rng(3)
    rows = [(i % 290, " ".join(f"w{n}" for n in rng.zipf(1.5, int(rng.integers(1, 200))) % 500)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for n in (1, 4, 16):
        out = op.score(spark, docs.repartition(n, F.rand(n)), F.col("doc_id") % 7 != 2)
        got.append(sorted(tuple(r) for r in out.select("doc_id", "n_tokens", "n_known", "score").collect()))
    for other in got[1:]:
        assert [r[:3] for r in got[0]] == [r[:3] for r in other]
        assert np.allclose([r[3] for r in got[0]], [r[3] for r in other], rtol=1e-4)


def test_gradients():
    """Against differences of the loss."""
    net, rng = lm(), np.random.default_rng(4)
    net.p["far"] = rng.standard_normal(op.WINDOW).astype(np.float32)
    inputs, targets = rng.integers(0, 50, (2, 6, op.WINDOW))
    weight = (rng.random(inputs.shape) < 0.8).astype(np.float32)

    def loss():
        p = {k: v.astype(np.float64) for k, v in net.p.items()}
        e = p["e"][net.row[inputs]]
        s = (e @ p["q"]) @ (e @ p["k"]).transpose(0, 2, 1) / math.sqrt(op.DIM) + p["far"][net.distance] + net.mask
        a = np.exp(s - s.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        z = np.tanh(a @ (e @ p["v"]) @ p["o"] + e @ p["r"] + p["b"]) @ p["c"] + p["d"]
        own = np.take_along_axis(z, net.cls[targets][:, :, None], axis=2)[:, :, 0]
        return (weight * (np.log(np.exp(z).sum(axis=2)) - own)).sum() / weight.sum()
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradients(grads, inputs, targets, weight)
    for name, g in grads.items():
        at = np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape)
        for place in zip(*at):
            value, h = net.p[name][place], np.float32(1e-2)
            net.p[name][place] = value + h
            up = loss()
            net.p[name][place] = value - h
            down = loss()
            net.p[name][place] = value
            assert abs((up - down) / (2 * h) - g[place]) < 0.02 * abs(g[place]) + 1e-4, (name, place)


def test_a_reading_task_hands_its_memory_back(spark, monkeypatch):
    """Python workers live on: what a task leaves unused stays with its executor beside the later stages."""
    import pyarrow as pa

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    class Frequent:
        value = {}
    released = []
    monkeypatch.setattr(op, "release", lambda: released.append(1))
    monkeypatch.setattr(op, "TaskContext", Task)
    run = op.read(Rows(), op.default_tokenizer(), Frequent)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", None]), pa.array([True, True])], ["id", "text", "learn"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 2 + 2 + 2
    assert released == [1]


def test_gradients_of_great_values():
    """Against the same batch with every class's value lowered alike."""
    net, rng = lm(), np.random.default_rng(5)
    inputs, targets = rng.integers(0, 50, (2, 6, op.WINDOW))
    weight, got = np.ones(inputs.shape, np.float32), []
    for shift in (0, 500, -500):
        net.p["d"] += np.float32(shift)
        grads = {k: np.zeros_like(v) for k, v in net.p.items()}
        net.gradients(grads, inputs, targets, weight)
        net.p["d"] -= np.float32(shift)
        got.append(grads)
    for other in got[1:]:
        assert all(np.allclose(got[0][k], other[k], rtol=1e-2, atol=1e-4) for k in other)


def test_a_step_looks_for_no_greatest_values(monkeypatch):
    """Only where attention values differ so much that a row's sum might vanish; with the same gradients."""
    net, rng = lm(), np.random.default_rng(6)
    inputs, targets = rng.integers(0, 50, (2, 16, op.WINDOW))
    weight, looked, got, greatest = np.ones(inputs.shape, np.float32), [], [], op._greatest
    monkeypatch.setattr(op, "_greatest", lambda x: looked.append(1) or greatest(x))
    for far, spread in ((0, op.SPREAD), (0, 0), (300, op.SPREAD)):
        net.p["far"][:] = np.linspace(0, -far, op.WINDOW)
        monkeypatch.setattr(op, "SPREAD", spread)
        grads = {k: np.zeros_like(v) for k, v in net.p.items()}
        net.gradients(grads, inputs, targets, weight)
        got.append((len(looked), grads))
    assert [n for n, _ in got] == [0, 1, 2]
    assert all(np.allclose(got[0][1][k], got[1][1][k], rtol=1e-3, atol=1e-6) for k in net.p)
    assert all(np.isfinite(g).all() for g in got[2][1].values())


def test_gradients_by_blocks_are_those_of_one_product(monkeypatch):
    net, rng = lm(), np.random.default_rng(7)
    inputs, targets = rng.integers(0, 50, (2, 16, op.WINDOW))
    weight, got = (rng.random(inputs.shape) < 0.8).astype(np.float32), []
    for block in (8, 16, 5):  # in two, in one, and not even
        monkeypatch.setattr(op, "BLOCK", block)
        grads = {k: np.ones_like(v) for k, v in net.p.items()}
        net.gradients(grads, inputs, targets, weight)
        got.append(grads)
    assert all(np.allclose(got[0][k], other[k], rtol=1e-3, atol=1e-6) for other in got[1:] for k in net.p)


def test_steps_are_those_of_adam():
    from tradetally.llm.common import Adam
    rng = np.random.default_rng(8)
    start = rng.standard_normal(50).astype(np.float32)
    steps, other = op.Steps({"x": start}, 0.01), Adam({"x": start.astype(np.float64)}, 0.01)
    for _ in range(20):
        grad = rng.standard_normal(50).astype(np.float32)
        steps.g["x"][:] = grad
        steps.step()
        other.step({"x": grad.astype(np.float64)})
    assert np.allclose(steps.p["x"], other.p["x"], rtol=1e-4, atol=1e-5)


def test_marks_behind_words_are_parts_of_their_own(spark, monkeypatch):
    """The tokenizer gets a run of marks once, not once a word; ids are those of the text."""
    words, encode = op.Words(op.default_tokenizer(), {}), op.WordIds.of(op.default_tokenizer())
    text = "that*** this*** é*** a!? b!? James' it's x'.. [a] a<|b a_ _a µ. a.̸ KK. Å, \x00 a\x00 a\x01."
    got = words.ids(words.places(text.encode().split()))
    assert got.tolist() == op._ids(encode, [text.encode()])[0].tolist()[:-1]
    asked = []

    class Encode:
        class tokenizer:
            @staticmethod
            def encode_batch_fast(texts, **more):
                asked.extend(texts)
                return encode.tokenizer.encode_batch_fast(texts, **more)
        letters = encode.letters
    words = op.Words(op.default_tokenizer(), {})
    words.encode = Encode
    words.learn([b"that***", b"this***", b"the***"])
    assert asked == ["***"]


def test_a_slice_looks_each_word_up_once(spark):
    import pyarrow as pa
    words, n = op.words_of(pa.array(["a b  a", "", " \x0b", " b a\x1cb\x0cb ", "É"]))
    assert words.dictionary.to_pylist() == ["a", "b", "a\x1cb", "É"]
    assert words.indices.to_pylist() == [0, 1, 0, 1, 2, 1, 3] and n.tolist() == [3, 0, 0, 3, 1]


def test_a_stem_is_encoded_once_a_task(monkeypatch):
    words, encode = op.Words(op.default_tokenizer(), {}), op.WordIds.of(op.default_tokenizer())
    given, flat = [], op._flat
    monkeypatch.setattr(op, "_flat", lambda tokenizer, texts: given.extend(",".join(texts).split(",")) or flat(tokenizer, texts))
    words.places(["market".encode(), "für".encode()])
    given.clear()
    later = ["Market,", "MARKET", "zebra", "FÜR!", "x1", "zebra."]
    places = words.places([w.encode() for w in later])
    assert given == ["zebra"]
    for word, place in zip(later, places):
        assert words.ids(np.array([place])).tolist() == encode.tokenizer.encode(word, add_special_tokens=False).ids
