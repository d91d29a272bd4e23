import numpy as np

from tradetally.llm import op10_toxicity as op

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_gradients(monkeypatch):
    """Backward pass against finite differences, in double precision."""
    rng = np.random.default_rng(0)
    net = op.Net({b"aa": 1, b"bb": 2}, 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = [b"aa", b"bb", b"cc", b"dddd"]
    cells = op.char_cells(words)
    index = rng.integers(0, 4, (5, 3))
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    mask[1:, 2] = 0
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        v = net.forward(net.embed(words, cells)[0].astype(np.float64), index, mask)[0]
        return float(np.mean(np.log1p(np.exp(v)) - target * v))

    class Keep:
        rate = 0.0

        def step(self, grads):
            self.g = grads
    keep = Keep()
    net.train_step(keep, words, cells, index, mask, target)
    for k, x in net.p.items():
        flat = x.reshape(-1)
        at = np.argsort(-np.abs(keep.g[k].reshape(-1)))[:4]
        for i in at:
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - keep.g[k].reshape(-1)[i]) < 2e-3 * max(1, abs(up - down) / 2e-4), k


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        cuts = op.cut(n)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(b - a <= op.WINDOW for a, b in cuts)
        assert all(c[0] < p[1] for p, c in zip(cuts, cuts[1:]))


def test_held_out(spark):
    out = op.query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = out.join(labels, "doc_id").where("held_out").collect()
    score, toxic = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    # some junk texts are labelled toxic without a word that tells them apart
    assert auc(score, toxic) >= 0.92
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["sun", "tree", "river", "stone"], 40)) for _ in range(300)]
    docs = [(i, t + (" vileword" if i % 2 else "")) for i, t in enumerate(clean)]
    long = "sun tree " * 4000 + "vileword"
    docs += [(1000, None), (1001, ""), (1002, long), (1002, "sun"), (None, "tree vileword river")]
    d = spark.createDataFrame([(i, t, 1.0, 7) for i, t in docs], "doc_id long, text string, score double, toxic int")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (6, 9, 0)], "doc_id long, toxic int, text int")
    net = op.train(spark, d, lab)
    got = {(r.doc_id, r.text): r.score for r in op.score(spark, d, net).collect()}
    assert len(got) == len(docs)
    assert got[None, "tree vileword river"] > 0.5 > got[1002, "sun"] and got[1002, long] > 0.5
    assert 0 <= got[1000, None] == got[1001, ""] <= 1
    assert op.score(spark, d.limit(0), net).count() == 0
    assert op.train(spark, d, lab.where("toxic = 1")) is None and op.train(spark, d, lab.limit(0)) is None
    assert {r.score for r in op.score(spark, d, None).collect()} == {0.0}
