"""Scoring of texts by a causal self-attention language model over subword ids.

One pass over the texts cuts them into words and subword ids and counts both
in the training texts. Subword ids are split into classes of about equal probability mass by frequency; the
probability of an id is that of its class, given the ids before it by the
attention model, times its share of the class in the corpus counts. The model
(one attention layer with learnt distance weights) starts from a few windows of
a bounded sample; then the training texts are dealt by a hash of id and subword
ids into shards, whose number follows the root of the number of windows; a task
steps from there through all windows of its shard in the order of the hash, and
the shards' weights are averaged by their windows. So each id of each training
text is learnt from, and the weights do not depend on how the rows lie on tasks
(scores agree to the rounding of float32). Scoring cuts each text's ids
into overlapping windows, so that every id is scored once with at least
``WINDOW - STRIDE`` ids before it, and attends in batches under a causal mask.

The base figures need the corpus count of every word. The exact counts of
``FREQUENT`` words, chosen as the most frequent ones of the sample, are
broadcast; all others are joined by word.

Defined results: null text counts as empty; an empty text is its end alone;
without training texts all counts are 0 and the model is uniform; equal rows
are scored each; a null id counts as fold 0; an empty table gives no rows;
further columns of the input are ignored. Words are told apart by 64-bit hashes.
Rows equal in id and text are learnt from each, in one shard that streams them.
"""

from __future__ import annotations

import copy
import gc
import json
import math
from codecs import charmap_decode
from collections import Counter
from functools import cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import fold, mix, pooled, release, signed, slices, stored, table, utf8
from tradetally.llm.op2_packing import WordIds, default_tokenizer

#: Inputs of a window, and from one window's start to the next.
WINDOW = 20
STRIDE = 16
#: Width of the model, classes of ids, ids with an embedding of their own.
DIM = 16
CLASSES = 32
OWN = 4096
VOCABULARY = 49_408
#: The id that stands before a text and ends it.
BORDER = 49_407
#: Texts in the sample that training starts from, about, and windows of each.
SAMPLE = 1500
WINDOWS_PER_TEXT = 10
EPOCHS = 4
BATCH = 256
RATE = 0.01
#: Training shards: the root of the number of windows, divided by this.
SHARDING = 64
#: Attention values of a batch that differ by less need no greatest value of their own: exponentials stay in float32's range.
SPREAD = 60
#: Steps of a weight when shards' weights are summed: whole numbers add up alike in any order.
FINE = 1 << 20
#: Frequent words: so many of the sample, by their counts there.
FREQUENT = 50_000
#: Words that a task remembers before it sends their counts on and forgets them.
REMEMBERED = 1_000_000
#: Windows of a block in products of long narrow matrices.
BLOCK = 8
SLICE_BYTES = 2 << 20
SLICE = 300
#: A word of the letters below U+0100 and the ASCII marks behind them, if any.
LATIN = r"^(?P<stem>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)$"
#: Words that are encoded as one text.
JOINED = 64
#: Windows that are scored at once: their arrays stay within a processor's cache.
SCORED = 512


class Steps:
    """Adam steps over parameters that lie in one array, as their gradients do.
    The running sums ``m`` and ``v`` are not scaled to means; their factors are in the step."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        flat = np.concatenate([x.ravel() for x in params.values()])
        self.flat, self.grad, self.rate, self.t = flat, np.zeros_like(flat), rate, 0
        self.m, self.v, self.room = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        ends = np.cumsum([x.size for x in params.values()])
        self.p, self.g = ({k: part.reshape(params[k].shape) for k, part in zip(params, np.split(whole, ends[:-1]))}
                          for whole in (self.flat, self.grad))

    def step(self) -> None:
        """One step along the gradients, which are used up."""
        self.t += 1
        g, m, v, room = self.grad, self.m, self.v, self.room
        m *= np.float32(0.9)
        m += g
        g *= g
        v *= np.float32(0.999)
        v += g
        np.sqrt(v, out=room)
        shown = math.sqrt(0.001 / (1 - 0.999 ** self.t))  # times the root of v: the root of the mean square
        room += np.float32(1e-8 / shown)
        np.divide(m, room, out=room)
        room *= np.float32(0.1 * self.rate / (1 - 0.9 ** self.t) / shown)
        self.flat -= room


def _greatest(x: np.ndarray) -> np.ndarray:
    """The greatest value of each row, of many short rows: looked for across
    them, which costs a fraction of looking along each."""
    return np.ascontiguousarray(x.reshape(-1, x.shape[-1]).T).max(axis=0).reshape(*x.shape[:-1], 1)


def _blocks(x: np.ndarray) -> np.ndarray:
    """Rows of all windows in blocks, if they come out even, or in one: products
    of long narrow matrices are taken block by block, from the nearest cache."""
    return x.reshape(-1, (BLOCK if len(x) % BLOCK == 0 else len(x)) * x.shape[1], x.shape[2])


class Attention:
    """Parameters, training and scoring; all arrays are float32."""

    def __init__(self, counts: np.ndarray, seed: int = 5):
        """``counts``: of each id in the training texts, the border as the end."""
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[order] + 0.5)
        cls = np.minimum(((mass - counts[order] - 0.5) / mass[-1] * CLASSES).astype(np.int64), CLASSES - 1)
        self.cls = np.empty(len(counts), np.int64)
        self.cls[order] = cls
        self.row = np.empty(len(counts), np.int64)
        self.row[order] = np.where(np.arange(len(counts)) < OWN, np.arange(len(counts)), OWN + cls)
        smooth = counts + 0.5
        total = np.bincount(self.cls, weights=smooth, minlength=CLASSES)
        self.within = np.log10(smooth / total[self.cls])

        def w(*shape):
            return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        prior = np.log(np.maximum(total / total.sum(), 1e-12)).astype(np.float32)
        self.p = {"e": (0.3 * rng.standard_normal((OWN + CLASSES, DIM))).astype(np.float32), "q": w(DIM, DIM), "k": w(DIM, DIM),
                  "v": w(DIM, DIM), "o": w(DIM, DIM), "r": w(DIM, DIM), "b": np.zeros(DIM, np.float32),
                  "far": np.zeros(WINDOW, np.float32), "c": 0.1 * w(DIM, CLASSES), "d": prior}
        step = np.arange(WINDOW)
        self.distance = np.maximum(step[:, None] - step[None, :], 0)
        self.mask = np.where(step[:, None] >= step[None, :], 0, -1e4).astype(np.float32)

    def train(self, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray, seed: int = 5) -> None:
        """``inputs`` and ``targets`` are ids (windows x WINDOW); weight 0 marks padding."""
        rng, opt = np.random.default_rng(seed), self.steps()
        for _ in range(EPOCHS):
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                self.step(opt, inputs[rows], targets[rows], weight[rows])

    def steps(self) -> Steps:
        """Steps that change this model's parameters."""
        opt = Steps(self.p, RATE)
        self.p = opt.p
        return opt

    def gradients(self, g: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> None:
        """Writes the gradients of a batch of windows into ``g``. What an input
        contributes (query, key, value, own part) is computed once a row of the
        embeddings, and all four come back through one product. Classes lie
        across ``z``, so what is done to all classes of an id runs along ids."""
        p, root = self.p, np.float32(1 / math.sqrt(DIM))
        cell, y, m = self.row[inputs].ravel(), self.cls[targets].ravel(), weight.ravel()
        m = m / max(np.float32(1), m.sum())
        order = cell.astype(np.uint16).argsort(kind="stable")  # by radix
        met = cell[order]
        new = np.ones(len(met), bool)
        np.not_equal(met[1:], met[:-1], out=new[1:])
        first = np.flatnonzero(new)
        met, number = met[first], np.empty_like(cell)
        number[order] = np.cumsum(new) - 1
        e = p["e"].take(met, axis=0)
        wide = np.concatenate([p["q"] * root, p["k"], p["v"] @ p["o"], p["r"]], axis=1)
        rows = e @ wide
        rows[:, 3 * DIM:] += p["b"]
        x = rows.take(number, axis=0).reshape(*inputs.shape, 4 * DIM)
        q, k, v, own = (x[:, :, i * DIM:(i + 1) * DIM] for i in range(4))
        a = q @ k.transpose(0, 2, 1)
        self.weigh(a)
        a /= (a @ np.ones(a.shape[2], np.float32))[:, :, None]
        mixed = a @ v
        h = mixed + own
        np.tanh(h, out=h)
        hs, back = _blocks(h), np.empty_like(x)
        flats = _blocks(back)
        z = np.empty((CLASSES, len(cell)), np.float32)
        zs = z.reshape(CLASSES, *hs.shape[:2]).transpose(1, 0, 2)  # the same by blocks
        np.matmul(np.ascontiguousarray(p["c"].T), hs.transpose(0, 2, 1), out=zs)
        z += p["d"][:, None]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z *= m / (np.ones(CLASSES, np.float32) @ z)
        z.ravel()[y * len(cell) + np.arange(len(cell))] -= m
        g["c"][:] = (zs @ hs).sum(axis=0).T
        g["d"][:] = z @ np.ones(len(cell), np.float32)
        du = zs.transpose(0, 2, 1) @ np.ascontiguousarray(p["c"].T)
        hs *= hs
        du *= np.subtract(1, hs, out=hs)
        du = du.reshape(mixed.shape)
        back[:, :, 3 * DIM:] = du
        g["b"][:] = np.ones(len(cell), np.float32) @ du.reshape(-1, DIM)
        np.matmul(a.transpose(0, 2, 1), du, out=back[:, :, 2 * DIM:3 * DIM])
        ds = du @ v.transpose(0, 2, 1)
        mixed *= du
        ds -= (mixed @ np.ones(DIM, np.float32))[:, :, None]
        ds *= a
        g["far"][:] = np.bincount(self.distance.ravel(), weights=ds.sum(axis=0).ravel(), minlength=WINDOW)
        np.matmul(ds, k, out=back[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=back[:, :, DIM:2 * DIM])
        f = (e.take(number, axis=0).reshape(*flats.shape[:2], DIM).transpose(0, 2, 1) @ flats).sum(axis=0)
        g["q"][:], g["k"][:], g["r"][:] = f[:, :DIM] * root, f[:, DIM:2 * DIM], f[:, 3 * DIM:]
        g["v"][:], g["o"][:] = f[:, 2 * DIM:3 * DIM] @ p["o"].T, p["v"].T @ f[:, 2 * DIM:3 * DIM]
        g["e"][:] = 0
        g["e"][met] = np.add.reduceat((flats @ np.ascontiguousarray(wide.T)).reshape(-1, DIM).take(order, axis=0), first, axis=0)

    def weigh(self, a: np.ndarray) -> None:
        """Products of queries and keys become exponentials, under the causal
        mask and by distance. One value is taken off all of them where that
        leaves each row a sum far from 0, else each row's greatest value."""
        far = self.p["far"]
        top, low = a.max() + far.max(), a.min() + far.min()
        near = top - low < SPREAD
        a += (far - top if near else far)[self.distance] + self.mask
        if not near:
            a -= _greatest(a)
        np.exp(a, out=a)

    def step(self, opt: Steps, inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch of windows with the weights ``weight``."""
        self.gradients(opt.g, inputs, targets, weight)
        opt.step()

    def copy(self) -> Attention:
        out = copy.copy(self)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def tables(self) -> dict[str, np.ndarray]:
        """What an input contributes, by its embedding's row."""
        p = self.p
        return {"q": p["e"] @ p["q"] / np.float32(math.sqrt(DIM)), "k": p["e"] @ p["k"], "v": p["e"] @ p["v"] @ p["o"],
                "r": p["e"] @ p["r"] + p["b"]}

    def score(self, ids: np.ndarray, offsets: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of each text, its border at the end included.

        ``ids`` holds the texts' ids in a row, each text ended by the border."""
        n = np.diff(offsets)
        first = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))  # windows of each text
        text = np.repeat(np.arange(len(n)), first)
        number = np.arange(len(text)) - np.repeat(np.cumsum(first) - first, first)
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[offsets[:-1]] = BORDER
        row, cls, within = self.row[before], self.cls[ids], self.within[ids]
        bias = self.p["far"][self.distance] + self.mask
        out, c, d = np.zeros(len(n)), self.p["c"], self.p["d"]
        step = np.arange(WINDOW)
        for scored, select in ((WINDOW, number == 0), (STRIDE, number > 0)):
            skip = WINDOW - scored
            windows = np.flatnonzero(select)
            for at in range(0, len(windows), SCORED):
                w = windows[at:at + SCORED]
                place = number[w][:, None] * STRIDE + step
                real = place < n[text[w]][:, None]
                place = np.where(real, place, 0) + offsets[text[w]][:, None]
                r = row[place]
                late = r[:, skip:]
                s = tables["q"].take(late, axis=0) @ tables["k"].take(r, axis=0).transpose(0, 2, 1)
                s += bias[skip:]
                np.exp(s, out=s)
                total = (s @ np.ones(WINDOW, np.float32))[:, :, None]
                h = s @ tables["v"].take(r, axis=0)
                h /= total
                h += tables["r"].take(late, axis=0)
                np.tanh(h, out=h)
                z = (_blocks(h) @ c).reshape(-1, CLASSES)
                z += d
                target = place[:, skip:].ravel()
                own = z.ravel()[np.arange(0, z.size, CLASSES) + cls[target]]
                np.exp(z, out=z)
                value = (own - np.log(z @ np.ones(CLASSES, np.float32))) / math.log(10) + within[target]
                value = np.where(real[:, skip:].ravel(), value, 0).reshape(len(w), -1).sum(axis=1)
                out += np.bincount(text[w], weights=value, minlength=len(n))
        return out


def _ids(encode: WordIds, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all texts in a row, each ended by the border."""
    end = BORDER.to_bytes(4, "little")
    found = [x + end for x in encode([t.decode("utf-8") for t in texts])]
    offsets = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
    return np.frombuffer(b"".join(found), "<u4").astype(np.int64), offsets


def _hash(words: list[bytes]) -> np.ndarray:
    return signed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


@cache
def _joined(path: str):
    """The tokenizer for normal words between commas: the same merges. And which
    ids end a word: the model marks them."""
    from tokenizers import Tokenizer

    parts = json.loads(WordIds.of(path).tokenizer.to_str())
    comma = {"type": "Split", "pattern": {"String": ","}, "behavior": "Removed", "invert": False}
    ends = np.zeros(VOCABULARY, bool)
    ends[[i for word, i in parts["model"]["vocab"].items() if word.endswith(parts["model"]["end_of_word_suffix"])]] = True
    return Tokenizer.from_str(json.dumps(parts | {
        "normalizer": None, "pre_tokenizer": comma, "post_processor": None, "added_tokens": []})), ends


def _flat(tokenizer, texts: list[str]) -> np.ndarray:
    """Ids of all texts in a row."""
    found = [np.array(e.ids, np.uint16) for at in range(0, len(texts), 100)
             for e in tokenizer.encode_batch_fast(texts[at:at + 100], add_special_tokens=False)]
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of consecutive runs that begin at ``start`` and have ``size`` places."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts in a row, and the number of those of each text."""
    split = pc.ascii_split_whitespace(texts)
    words, n = split.flatten(), np.diff(np.asarray(split.offsets))
    some = pc.not_equal(words, "")  # white space at an end leaves an empty word
    text = np.repeat(np.arange(len(n)), n)[np.asarray(some)]
    return words.filter(some).dictionary_encode(), np.bincount(text, minlength=len(n))


class Words:
    """What a task knows of the words it has met: the hash of the folded word,
    its number among the frequent words (-1: none), its subword ids (those of
    a text are those of its words in a row), and how often it has come up in
    training texts."""

    def __init__(self, tokenizer: str, frequent: dict[int, int]):
        self.encode, self.frequent, (self.joined, self.ends) = WordIds.of(tokenizer), frequent, _joined(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.hash, self.number = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.start, self.size, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(0, np.uint16), 0

    def _subwords(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of words in a row, and their numbers. A word of Latin
        letters shares the ids of its folded form; ASCII marks behind such
        letters are a part of their own, so a word has up to two parts."""
        parts = pc.extract_regex(words, LATIN)
        other = parts.is_null().to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(pc.struct_field(parts.drop_null(), "stem")).dictionary_encode()
        marks = pc.struct_field(parts.drop_null(), "mark").dictionary_encode()
        known = len(stems.dictionary)
        # a stem that was a word of an earlier slice has its ids
        met = np.fromiter(map(self.index.get, stems.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, known)
        new = stems.dictionary.filter(pa.array(met < 0))
        cuts = np.append(np.arange(0, len(new), JOINED), len(new)).astype(np.int32)
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), new), ",").to_pylist()
        flat = _flat(self.joined, [
            row if row.isascii() else charmap_decode(row.encode(), "strict", self.encode.letters)[0] for row in rows])
        size = np.empty(known, np.int64)
        size[met < 0] = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        size[met >= 0] = self.size[met[met >= 0]]
        flat, own = np.concatenate([flat, self.ids(met[met >= 0])]), np.argsort(met >= 0, kind="stable")
        first = np.empty(known, np.int64)
        first[own] = np.cumsum(size[own]) - size[own]
        # behind the stems' parts: those of marks, of which one may be empty, and of other words
        rest = marks.dictionary.to_pylist() + words.filter(pa.array(other)).to_numpy(zero_copy_only=False).tolist()
        found = [e.ids for at in range(0, len(rest), 20_000)
                 for e in self.encode.tokenizer.encode_batch_fast(rest[at:at + 20_000], add_special_tokens=False)]
        # and an empty part
        more = np.append(np.fromiter(map(len, found), np.int64, len(found)), 0)
        first = np.append(first, len(flat) + np.cumsum(more) - more)
        size = np.append(size, more)
        flat = np.append(flat, np.fromiter(chain.from_iterable(found), np.uint16))
        part = np.full((len(words), 2), len(size) - 1)
        part[~other, 0] = stems.indices.to_numpy()
        part[~other, 1] = known + marks.indices.to_numpy()
        part[other, 0] = known + len(marks.dictionary) + np.arange(np.count_nonzero(other))
        total = size[part].sum(axis=1)
        return flat[_runs(first[part].ravel(), size[part].ravel())], total

    def learn(self, words: list[bytes]) -> None:
        texts = pa.array(words, pa.binary()).cast(pa.string())
        flat, size = self._subwords(texts)
        known, need = len(self.index), len(self.index) + len(words)
        if need > len(self.hash):
            grow = need  # doubles
            for k in ("hash", "number", "start", "size", "times"):
                x = getattr(self, k)
                setattr(self, k, np.concatenate([x, np.zeros(grow, x.dtype)]))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.used + len(flat), np.uint16)])
        self.index.update(zip(words, range(known, need)))
        h = _hash(pc.ascii_lower(texts).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        self.hash[known:need] = h
        self.number[known:need] = np.fromiter(map(self.frequent.get, h.tolist(), repeat(-1)), np.int32, len(words))
        self.size[known:need], self.start[known:need] = size, self.used + np.cumsum(size) - size
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Index of each word; new words are learnt."""
        out = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        holes = np.flatnonzero(out < 0).tolist()
        if holes:
            new, known = [words[i] for i in holes], len(self.index)
            once = list(dict.fromkeys(new))
            self.learn(once)
            out[holes] = np.arange(known, known + len(new)) if len(once) == len(new) else list(map(self.index.get, new))
        return out

    def ids(self, places: np.ndarray) -> np.ndarray:
        return self.pool[_runs(self.start[places], self.size[places])]


def _packed(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of consecutive 16-bit numbers."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * 2).astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())]).cast(pa.binary())


_READ = ("kind int, key long, n long, rid long, id long, learn boolean, n_tokens long, ids binary, frequent binary, "
         "words array<long>, times array<int>")


def read(rows: DataFrame, tokenizer: str, frequent) -> DataFrame:
    """One pass over all texts. Kind 0: a row for each text with its subword ids,
    the numbers of its frequent words, and its other words with their counts.
    Kind 1: counts of words in training texts by hash. Kind 2: counts of subword ids."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("rid", pa.int64()), ("id", pa.int64()),
                        ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("frequent", pa.binary()),
                        ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def counts(kind: int, key: np.ndarray, n: np.ndarray):
        some = np.flatnonzero(n)
        for at in range(0, len(some), 100_000):
            part = some[at:at + 100_000]
            yield batch(len(part), kind=pa.array(np.full(len(part), kind, np.int32)), key=pa.array(key[part]), n=pa.array(n[part]))

    def run(batches):
        known, id_counts = Words(tokenizer, frequent.value), np.zeros(VOCABULARY, np.int64)
        part, serial = TaskContext.get().partitionId() << 33, 0
        gc.disable()
        for b in batches:
            texts = utf8(b.column(1))
            learning = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(texts, SLICE_BYTES, 3 * SLICE):
                if len(known.index) > REMEMBERED:
                    yield from counts(1, known.hash, known.times)
                    known.forget()
                words, n = words_of(b.column(1).slice(lo, hi - lo).fill_null(""))
                text, learn = np.repeat(np.arange(hi - lo), n), learning[lo:hi]
                # a slice's words are looked up once each; what is known of them then lies close together
                places = known.places(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
                word = words.indices.to_numpy()
                known.times[places] += np.bincount(word[learn[text]], minlength=len(places))
                size = known.size[places]
                pool, start, size = known.ids(places), (np.cumsum(size) - size)[word], size[word]
                ids, of_text = pool[_runs(start, size)], np.bincount(text, weights=size, minlength=hi - lo).astype(np.int64)
                id_counts += np.bincount(ids[np.repeat(learn, of_text)], minlength=VOCABULARY)
                number = known.number[places][word]
                often = number >= 0
                # text and place of the hash among the slice's hashes as one number, which sorts at once
                hashes, place = np.unique(known.hash[places], return_inverse=True)
                both = np.sort(text[~often] * len(hashes) + place[word[~often]])
                new = np.ones(len(both), bool)
                np.not_equal(both[1:], both[:-1], out=new[1:])
                at = np.flatnonzero(new)
                t, x = np.divmod(both[at], max(1, len(hashes)))
                cuts = pa.array(np.searchsorted(t, np.arange(hi - lo + 1)).astype(np.int32))
                often_cuts = np.append(0, np.cumsum(np.bincount(text[often], minlength=hi - lo)))
                yield batch(hi - lo, kind=pa.array(np.zeros(hi - lo, np.int32)), rid=pa.array(part + serial + np.arange(hi - lo)),
                            id=b.column(0).slice(lo, hi - lo), learn=b.column(2).slice(lo, hi - lo), n_tokens=pa.array(n + 1),
                            ids=_packed(ids, np.append(0, np.cumsum(of_text))), frequent=_packed(number[often], often_cuts),
                            words=pa.ListArray.from_arrays(cuts, pa.array(hashes[x])),
                            times=pa.ListArray.from_arrays(cuts, pa.array(np.diff(np.append(at, len(both))).astype(np.int32))))
                serial += hi - lo
        yield from counts(1, known.hash, known.times)
        yield from counts(2, np.arange(VOCABULARY), id_counts)
        del known
        gc.enable()
        release()

    return rows.select("id", "text", "learn").mapInArrow(run, _READ)


def frequent_words(sample: DataFrame) -> list[int]:
    """Hashes of the most frequent words of a sample; a bounded number."""
    def run(batches):
        for b in batches:
            found = Counter(chain.from_iterable(t.lower().split() for t in utf8(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(_hash(list(found))), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    total = sample.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in total.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def sample_windows(docs: DataFrame, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and weights of windows, a bounded number of each text."""
    def run(batches):
        encode = WordIds.of(tokenizer)
        for b in batches:
            texts = utf8(b.column(1))
            for lo in range(0, len(texts), SLICE):
                ids, offsets = _ids(encode, texts[lo:lo + SLICE])
                keys, rows = [], []
                for i in range(len(offsets) - 1):
                    own = ids[offsets[i]:offsets[i + 1]]
                    starts = np.arange(0, len(own), WINDOW)
                    lot = mix(starts.astype(np.uint64) + np.uint64(len(own) << 32))
                    for s in np.sort(starts[np.argsort(lot)[:WINDOWS_PER_TEXT]]):
                        before = own[s - 1] if s else BORDER
                        part = np.concatenate([[before], own[s:s + WINDOW], np.full(max(0, WINDOW - len(own[s:])), -1)])
                        keys.append(int(s))
                        rows.append(part.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(offsets) - 1).take(pa.array(np.repeat(
                    np.arange(len(offsets) - 1), [min(WINDOWS_PER_TEXT, -(-int(n) // WINDOW)) for n in np.diff(offsets)]))),
                    pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], ["id", "at", "ids"])

    got = docs.select(F.col("id"), "text").mapInArrow(run, "id long, at long, ids binary").collect()
    got.sort(key=lambda r: (r.id is not None, r.id or 0, r.at, bytes(r.ids)))
    x = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<i4").reshape(len(got), WINDOW + 1).astype(np.int64)
    weight = (x[:, 1:] >= 0).astype(np.float32)
    x = np.maximum(x, 0)
    return x[:, :-1], x[:, 1:], weight


def _rows_of_ids(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each ended by the border, from their 16-bit numbers."""
    flat = [np.frombuffer(x, "<u2") for x in packed]
    offsets = np.zeros(len(flat) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in flat], out=offsets[1:])
    ids = np.full(int(offsets[-1]), BORDER, np.int64)
    inside = np.ones(len(ids), bool)
    inside[offsets[1:] - 1] = False
    ids[inside] = np.concatenate(flat)
    return ids, offsets


def windows(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and weights of windows that hold every id once as a target."""
    n = np.diff(offsets)
    count = -(-n // WINDOW)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = number[:, None] * WINDOW + np.arange(WINDOW)
    real = place < np.repeat(n, count)[:, None]
    place = np.where(real, place, 0) + np.repeat(offsets[:-1], count)[:, None]
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[offsets[:-1]] = BORDER
    return before[place], ids[place], real.astype(np.float32)


def learn_all(spark: SparkSession, model: Attention, texts: DataFrame, ids: int) -> int:
    """Trains ``model`` on all windows of ``texts`` (id, ids), which hold about
    ``ids`` ids: a task steps once through a shard from the model's weights,
    and the weights are averaged by windows. Returns the number of windows."""
    names, start = sorted(model.p), spark.sparkContext.broadcast(model)
    shards = math.ceil(math.sqrt(ids / WINDOW) / SHARDING) or 1
    lot = F.xxhash64("id", "ids")
    dealt = texts.select("ids", lot.alias("lot"), F.pmod(lot, F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("lot")

    def run(batches):
        pooled()
        net = start.value.copy()
        opt, rng, learnt = net.steps(), np.random.default_rng(7), 0
        held = None
        every = chain.from_iterable(b.column(0).to_pylist() for b in batches)
        while some := list(islice(every, SLICE)):
            new = windows(*_rows_of_ids(some))
            order = rng.permutation(len(new[0]))
            new = [x[order] for x in new]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            learnt += len(order)
            done = len(held[0]) // BATCH * BATCH
            for at in range(0, done, BATCH):
                net.step(opt, *(x[at:at + BATCH] for x in held))
            held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            net.step(opt, *held)
        if learnt:
            flat = np.concatenate([net.p[k].ravel() for k in names]).astype(np.float64)
            value = np.append(np.rint(flat * FINE).astype(np.int64) * learnt, learnt)
            place = np.append(np.arange(len(flat)), -1)
            for at in range(0, len(place), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(place[at:at + 50_000]), pa.array(value[at:at + 50_000])], ["place", "v"])
        del held
        release()

    size = sum(x.size for x in model.p.values())
    total = np.zeros(size + 1)
    rows = dealt.select("ids").mapInArrow(run, "place long, v long").groupBy("place").agg(F.sum("v").alias("v"))
    for r in rows.toLocalIterator():  # one row a weight, and the windows at -1
        total[r.place] = r.v
    if total[-1]:
        flat, at = (total[:-1] / total[-1] / FINE).astype(np.float32), 0
        for k in names:
            model.p[k] = flat[at:at + model.p[k].size].reshape(model.p[k].shape)
            at += model.p[k].size
    return int(total[-1])


def score(spark: SparkSession, docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text",
          tokenizer: str | None = None) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row; ``training`` is a condition on the rows to learn from."""
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), training.alias("learn"))
    learn = rows.where("learn")
    every = max(1, learn.count() // SAMPLE)
    sample = learn.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0).limit(4 * SAMPLE)
    sample = stored(spark, sample.select("id", "text"), "lm-sample")
    frequent = frequent_words(sample)
    numbers = spark.sparkContext.broadcast({h: i for i, h in enumerate(frequent)})
    found = stored(spark, read(rows, tokenizer, numbers), "lm-read")

    words = found.where("kind = 1").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c"))
    words = stored(spark, words, "lm-words")
    texts = found.where("kind = 0 and learn").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n + texts, total.v + (texts > 0)
    log_count = np.zeros(len(frequent) + 1)
    listed = spark.createDataFrame([(h, i) for i, h in enumerate(frequent)], "word long, number int")
    for r in words.join(F.broadcast(listed), "word").collect():  # at most FREQUENT rows
        log_count[r.number] = math.log10(r.c + 1)
    ids = np.zeros(VOCABULARY)
    for r in found.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).collect():  # at most VOCABULARY rows
        ids[r.key] = r.n
    ids[BORDER] += texts

    model = Attention(ids)
    if texts:
        model.train(*sample_windows(sample, tokenizer))
        learn_all(spark, model, found.where("kind = 0 and learn"), int(ids.sum()))
    shared = spark.sparkContext.broadcast((model, log_count))
    end_known, end_log = int(texts > 0), math.log10(texts + 1)

    def run(batches):
        pooled()
        net, logs = shared.value
        tables = net.tables()
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                text_ids, offsets = _rows_of_ids(s.column(4).to_pylist())
                number = [np.frombuffer(x, "<u2") for x in s.column(5).to_pylist()]
                value = logs[np.concatenate(number).astype(np.int64)]
                text = np.repeat(np.arange(len(number)), [len(x) for x in number])
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:4], pa.array(np.bincount(text[value > 0], minlength=len(number)) + end_known),
                     pa.array(np.bincount(text, weights=value, minlength=len(number)) + end_log),
                     pa.array(net.score(text_ids, offsets, tables))],
                    ["rid", "id", "learn", "n_tokens", "n_known", "base", "score"])
        release()

    scored = found.where("kind = 0").select("rid", "id", "learn", "n_tokens", "ids", "frequent").mapInArrow(
        run, "rid long, id long, learn boolean, n_tokens long, n_known long, base double, score double")
    rare = found.where("kind = 0").select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "rid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = rare.join(words, "word").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    out = scored.join(sums, "rid", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(tokens + distinct + 1)
    return out.select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens",
                      (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
