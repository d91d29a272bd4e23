"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as its own embedding, if it was seen often enough in
training, joined with the mean embedding of its hashed character n-grams.
Overlapping windows of words are read by two gated recurrent units, one from
each side, and pooled by attention; all windows of a text are scored, and the
most toxic one decides. The model is trained in numpy on windows of a bounded
sample of labelled texts: first all windows of a toxic text count as toxic,
then those only that the network itself finds so, and at least the worst of
each text. Last, the largest window value is mapped to a probability on
sampled texts that the network has not seen.

Defined results: null text counts as empty; an empty text is scored as one
window without words; without labelled texts of both kinds every score is 0;
null labels teach nothing; equal texts get equal scores; an empty table gives
no rows; further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import Adam, fold, mix, release, rows_of, sample_of, slices, stored, table, text_once, utf8, with_fields

#: Labelled texts of either kind in the training sample, about (a quarter of them for
#: the calibration), and windows of each text.
PER_LABEL = 1200
WINDOWS_PER_TEXT = 40
#: Words in a window and from one window's start to the next.
WINDOW = 32
STRIDE = 24
#: Hidden units per direction, embedding width of words and of character n-grams.
HIDDEN = 12
WORD_DIM = 12
CHAR_DIM = 12
CHAR_BUCKETS = 4096
#: A word has its own embedding if so many sampled windows hold it.
LEAST_COUNT = 30
MOST_WORDS = 20_000
ROUNDS = 3
#: Steps of a round, each on a batch that is half toxic.
STEPS = 130
BATCH = 256
#: Decay of the embeddings in a step, in learning rates; share of words left out of training windows.
DECAY = 0.3
DROPPED = 0.2
THRESHOLD = 0.5
#: Bytes of text that a task scores at once.
SCORED_BYTES = 1 << 20
MARKS = b".,;:!?*#$%&|<>()[]{}\"'`~+=/\\_-"


def char_cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- and 4-byte runs of each word with its borders: buckets and their words."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03\x03" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 3 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    three = data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16)
    four = three[:-1] | data[3:] << np.uint64(24) | np.uint64(1 << 40)
    cells, owners = [], []
    for value, reach in ((three, 3), (four, 4)):
        inside = left[:len(value)] >= reach
        cells.append((mix(value[inside]) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        owners.append(owner[:len(value)][inside])
    return np.concatenate(cells), np.concatenate(owners)


def cut(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over ``n`` words; the last one ends with the text."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + WINDOW)))
        if at + WINDOW >= n:
            return out
        at += STRIDE


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Net:
    """Parameters and passes; all arrays are float32."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        def w(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        wide = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {"word": (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32),
                  "char": (0.3 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIM))).astype(np.float32),
                  "attend": w(2 * HIDDEN, HIDDEN), "query": w(HIDDEN, 1)[:, 0],
                  "out": w(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(wide, 3 * HIDDEN), f"h{d}": w(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def embed(self, words: list[bytes], cells=None):
        """(words x width) inputs, and what the backward pass needs."""
        ids = np.array([self.vocabulary.get(x, 0) for x in words], np.int64)
        cell, owner = cells if cells is not None else char_cells(words)
        count = np.bincount(owner, minlength=len(words)).astype(np.float32)[:, None]
        chars = np.empty((len(words), CHAR_DIM), np.float32)
        for k in range(CHAR_DIM):
            chars[:, k] = np.bincount(owner, weights=self.p["char"][cell, k], minlength=len(words))
        word = self.p["word"][ids]
        word[ids == 0] = 0
        return np.hstack([word, chars / np.maximum(count, 1)]), (ids, cell, owner, count)

    def direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """Gated recurrent unit over (steps, batch, 3 x hidden) projected inputs."""
        u, n = self.p[f"h{d}"], HIDDEN
        h = np.zeros((x.shape[1], n), np.float32)
        out, saved = np.empty((x.shape[0], x.shape[1], n), np.float32), []
        steps = range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1)
        for t in steps:
            a = h @ u[:, :2 * n]
            a += x[t, :, :2 * n]
            gates = _sigmoid(a)
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[t, :, 2 * n:] + (r * h) @ u[:, 2 * n:])
            new = h + z * (c - h) * mask[t][:, None]
            if keep:
                saved.append((t, h, z, r, c))
            h = out[t] = new
        return out, saved

    def forward(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Values of windows; ``index`` (steps x batch) are rows of ``inputs``."""
        hidden, saved = [], {}
        for d in "fb":
            projected = (inputs @ self.p[f"x{d}"] + self.p[f"c{d}"])[index]
            out, saved[d] = self.direction(d, projected, mask, keep)
            hidden.append(out)
        h = np.concatenate(hidden, axis=2)
        a = np.tanh(h @ self.p["attend"])
        e = a @ self.p["query"] + np.where(mask > 0, 0, -1e4)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", weight, h)
        value = pooled @ self.p["out"] + self.p["bias"][0]
        return value, (h, a, weight, pooled, saved)

    def train_step(self, opt: Adam, words: list[bytes], cells, index, mask, target) -> None:
        inputs, (ids, cell, owner, count) = self.embed(words, cells)
        value, (h, a, weight, pooled, saved) = self.forward(inputs, index, mask, keep=True)
        n, g = HIDDEN, {}
        dv = ((_sigmoid(value) - target) / len(target)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ dv, dv.sum(keepdims=True)
        dpool = dv[:, None] * self.p["out"]
        dweight = np.einsum("tbk,bk->tb", h, dpool)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["query"] = np.einsum("tb,tbk->k", de, a)
        da = de[:, :, None] * self.p["query"] * (1 - a * a)
        g["attend"] = np.tensordot(h, da, axes=([0, 1], [0, 1]))
        dh = weight[:, :, None] * dpool + da @ self.p["attend"].T
        dinputs = np.zeros_like(inputs)
        for k, d in enumerate("fb"):
            u, own = self.p[f"h{d}"], dh[:, :, k * n:(k + 1) * n]
            du, carry = np.zeros_like(u), np.zeros(own.shape[1:], np.float32)
            dx = np.zeros((*index.shape, 3 * n), np.float32)
            for t, prev, z, r, c in reversed(saved[d]):
                total, m = own[t] + carry, mask[t][:, None]
                dc = total * z * m * (1 - c * c)
                dz = total * (c - prev) * m * z * (1 - z)
                back = dc @ u[:, 2 * n:].T
                dr = back * prev * r * (1 - r)
                dx[t] = np.hstack([dz, dr, dc])
                du[:, :2 * n] += prev.T @ dx[t, :, :2 * n]
                du[:, 2 * n:] += (r * prev).T @ dc
                carry = total * (1 - z * m) + back * r + dx[t, :, :2 * n] @ u[:, :2 * n].T
            g[f"h{d}"], flat = du, dx.reshape(-1, 3 * n)
            summed = _sum_rows(flat, index.ravel(), len(inputs))
            g[f"x{d}"], g[f"c{d}"] = inputs.T @ summed, flat.sum(axis=0)
            dinputs += summed @ self.p[f"x{d}"].T
        known = dinputs[:, :WORD_DIM] * (ids > 0)[:, None]
        g["word"] = _sum_rows(known, ids, len(self.p["word"]))
        g["char"] = _sum_rows((dinputs[:, WORD_DIM:] / np.maximum(count, 1))[owner], cell, CHAR_BUCKETS)
        opt.step({x: y.astype(np.float32) for x, y in g.items()})
        for k in ("word", "char"):
            self.p[k] *= 1 - opt.rate * DECAY

    def values(self, texts: list[list[bytes]]) -> np.ndarray:
        """Largest window value of each text."""
        names = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        inputs = self.embed(list(names) or [b""])[0]
        flat = np.fromiter((names[w] for t in texts for w in t), np.int64)
        start, stop, owner, at = [], [], [], 0
        for i, t in enumerate(texts):
            for lo, hi in cut(len(t)):
                start.append(at + lo)
                stop.append(at + hi)
                owner.append(i)
            at += len(t)
        start, stop = np.array(start), np.array(stop)
        out = np.full(len(texts), -np.inf)
        for lo in range(0, len(start), 1024):
            index, mask = _grid(flat, start[lo:lo + 1024], stop[lo:lo + 1024])
            np.maximum.at(out, owner[lo:lo + 1024], self.forward(inputs, index, mask)[0])
        return out

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        return _sigmoid(np.clip(self.values(texts) * self.scale + self.shift, -30, 30))


def _sum_rows(x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((n, x.shape[1]), np.float32)
    for k in range(x.shape[1]):
        out[:, k] = np.bincount(to, weights=x[:, k], minlength=n)
    return out


def _grid(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps x windows) word rows and their mask."""
    steps = np.arange(WINDOW)[:, None]
    mask = (start + steps < stop).astype(np.float32)
    if not len(flat):
        return np.zeros(mask.shape, np.int64), mask
    return flat[np.minimum(start + steps, len(flat) - 1)] * mask.astype(np.int64), mask


def fit(windows: list[list[bytes]], owner: np.ndarray, toxic: np.ndarray, seed: int = 7) -> Net:
    """Network for windows of texts; ``toxic`` is by text, ``owner`` by window."""
    rng = np.random.default_rng(seed)
    count = Counter(w for x in windows for w in set(x))
    frequent = sorted((w for w, n in count.items() if n >= LEAST_COUNT), key=lambda w: (-count[w], w))[:MOST_WORDS]
    net = Net({w: i + 1 for i, w in enumerate(frequent)}, seed)
    names = {w: i for i, w in enumerate(dict.fromkeys(w for x in windows for w in x))}
    words = list(names) or [b""]
    cells = char_cells(words)
    by_word = np.split(cells[0][np.argsort(cells[1], kind="stable")], np.cumsum(np.bincount(cells[1], minlength=len(words)))[:-1])
    flat = np.fromiter((names[w] for x in windows for w in x), np.int64)
    size = np.array([len(x) for x in windows])
    start = np.cumsum(size) - size
    target, opt = toxic[owner].astype(np.float32), Adam(net.p, 0.01)
    for turn in range(ROUNDS):
        if turn:
            inputs = net.embed(words, cells)[0]
            value = np.concatenate([net.forward(inputs, *_grid(flat, start[i:i + 4096], start[i:i + 4096] + size[i:i + 4096]))[0]
                                    for i in range(0, len(start), 4096)])
            best = np.full(len(toxic), -np.inf)
            np.maximum.at(best, owner, value)
            target = (toxic[owner] & ((value > 0) | (value >= best[owner]))).astype(np.float32)
        bad, good = np.flatnonzero(target > 0), np.flatnonzero(target == 0)
        # clean windows that look toxic come up more often
        hard = None if not turn else 0.1 + _sigmoid(value[good] + 2)
        for _ in range(STEPS):
            rows = np.concatenate([rng.choice(bad, BATCH // 2), rng.choice(good, BATCH // 2, p=None if hard is None else hard / hard.sum())])
            index, mask = _grid(flat, start[rows], start[rows] + size[rows])
            mask *= rng.random(mask.shape) >= DROPPED
            used, local = np.unique(index, return_inverse=True)
            own = [by_word[j] for j in used]
            some = (np.concatenate(own), np.repeat(np.arange(len(used)), [len(c) for c in own]))
            net.train_step(opt, [words[j] for j in used], some, local.reshape(index.shape), mask, target[rows])
    return net


def calibrate(net: Net, value: np.ndarray, toxic: np.ndarray, rate: float) -> None:
    """Logistic map of the largest window value of whole texts; toxic texts
    weigh as much as their share ``rate`` of the labels."""
    center, spread = float(value.mean()), float(value.std()) + 1e-6
    x, p = ((value - center) / spread).astype(np.float64), {"w": np.array([1.0, 0.0])}
    weight = np.where(toxic, rate / max(1, toxic.sum()), (1 - rate) / max(1, (~toxic).sum()))
    opt = Adam(p, 0.05)
    for _ in range(400):
        d = (_sigmoid(x * p["w"][0] + p["w"][1]) - toxic) * weight
        opt.step({"w": np.array([(d * x).sum(), d.sum()]) + 1e-4 * p["w"]})
    net.scale = p["w"][0] / spread
    net.shift = p["w"][1] - net.scale * center


def _words(text: bytes) -> list[bytes]:
    """Words without case (A-Z) and outer marks; a word that follows itself counts once."""
    return [w for w, _ in groupby(map(bytes.strip, text.lower().split(), repeat(MARKS))) if w]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Net | None:
    """Network for ``docs`` (id, text) and ``labels`` (id, 0/1)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    chosen = stored(spark, sample_of(known, id_col, label_col, PER_LABEL), "toxic-sample")
    rows = rows_of(docs.select(id_col, F.col(text_col).cast("string").alias("text")), chosen, id_col, "text")
    rows = rows.select(F.col(id_col).cast("long"), F.col(label_col).cast("int"), "text")

    def windows(batches):
        """A bounded number of windows of each text, spread over it by a hash."""
        for b in batches:
            ids, label, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))
            out = []
            for i, t in enumerate(texts):
                words = _words(t)
                cuts = cut(len(words))
                lot = mix(np.arange(len(cuts), dtype=np.uint64) + np.uint64(hash((ids[i], len(cuts))) & (1 << 62) - 1))
                out += [(ids[i], label[i], lo, b" ".join(words[lo:hi])) for lo, hi in
                        (cuts[j] for j in sorted(np.argsort(lot)[:WINDOWS_PER_TEXT]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                                             ["id", "toxic", "at", "words"])

    # the texts of one fold are left for the calibration
    fitted, rest = (rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(4)) != 0),
                    rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(4)) == 0))
    got = sorted((r.id, r.at, r.toxic, bytes(r.words)) for r in
                 fitted.mapInArrow(windows, "id long, toxic int, at long, words binary").collect())
    ids = sorted({r[0] for r in got})
    place = {x: i for i, x in enumerate(ids)}
    owner, toxic = np.array([place[r[0]] for r in got], np.int64), np.zeros(len(ids), bool)
    for r in got:
        toxic[place[r[0]]] = r[2] == 1
    if not len(ids) or toxic.all() or not toxic.any():
        return None
    net = fit([r[3].split() for r in got], owner, toxic)

    shared = spark.sparkContext.broadcast(net)

    def whole(batches):
        for b in batches:
            texts = utf8(b.column(2))
            for lo, hi in slices(texts, SCORED_BYTES):
                v = shared.value.values([_words(t) for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(v)], ["toxic", "value"])

    got = rest.mapInArrow(whole, "toxic int, value double").collect()
    if len({r.toxic for r in got}) < 2:
        got = rows.mapInArrow(whole, "toxic int, value double").collect()
    share = {r[0]: r["count"] for r in known.groupBy(label_col).count().collect()}
    calibrate(net, np.array([r.value for r in got]), np.array([r.toxic == 1 for r in got]), share[1] / (share[0] + share[1]))
    return net


def score(spark: SparkSession, docs: DataFrame, net: Net | None, text_col: str = "text", out_col: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not named) with the probability of being toxic."""
    shared, kept = spark.sparkContext.broadcast(net), [c for c in keep or docs.columns if c != out_col]
    rows, at, own = text_once(docs, text_col, kept)

    def run(batches):
        for b in batches:
            texts = utf8(b.column(at))
            for lo, hi in slices(texts, SCORED_BYTES):
                s = np.zeros(hi - lo) if shared.value is None else shared.value.score([_words(t) for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[own:], pa.array(s.astype(np.float64))], [*kept, out_col])
            release()

    return rows.mapInArrow(run, with_fields(docs.select(*kept), **{out_col: "double"}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    net = train(spark, docs, labels.where(fold("doc_id", 5) != 0))
    return score(spark, docs, net, keep=["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
