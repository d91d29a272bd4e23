"""Language identification by hierarchical discrimination.

A multinomial linear model on hashed byte n-grams of the whole text predicts
the language family; within it, one-versus-one linear support vector machines
on the same features separate the closely related languages by votes, then by
margins. Models are trained in numpy on a bounded sample: about ``PER_LABEL``
texts of each label, chosen by a hash of the id.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if nothing is there to learn from; a label without a known
family is a family of its own; null labels teach nothing; equal texts get
equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import Adam, fold, rows_of, sample_of, slices, stored, table, utf8

#: Texts of a label in the training sample, about.
PER_LABEL = 700
#: Hashed features: two- and three-byte runs.
BUCKETS = 4096
STEPS = 150

# fixed values: families of languages by ISO 639-1 code
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb", "yi", "sv", "da", "no", "nb", "nn", "is", "fo"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"), "semitic": ("ar", "he", "mt"),
}
UNKNOWN = "und"


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, langs in FAMILIES.items() if code in langs), f"={lang}")


def features(texts: list[bytes]) -> np.ndarray:
    """Unit rows of square roots of n-gram counts."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b"   ", np.uint8).astype(np.int32)
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, size)
    n = len(owner)
    two = data[:n] * 263 + data[1:n + 1] * 31
    three = (two * 97 + data[2:n + 2] * 1009) ^ (two >> 3)
    # runs that reach into the next text are left out
    left = np.repeat(start + size, size) - np.arange(n)
    out = np.zeros(len(texts) * BUCKETS, np.float32)
    for value, reach, half in ((two, 3, 0), (three, 4, 1)):
        inside = left >= reach
        cell = (value[inside] & (BUCKETS // 2 - 1)) + half * (BUCKETS // 2) + owner[inside]
        out += np.bincount(cell, minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(len(texts), BUCKETS))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_family(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    p = {"w": np.zeros((x.shape[1] + 1, classes), np.float32)}
    opt, target = Adam(p, 0.05), np.eye(classes, dtype=np.float32)[y]
    for _ in range(STEPS):
        d = (_softmax(x @ p["w"][:-1] + p["w"][-1]) - target) / len(x)
        opt.step({"w": np.vstack([x.T @ d, d.sum(axis=0)]) + 1e-6 * p["w"]})
    return p["w"]


def train_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear support vector machine for y in {-1, 1}: hinge loss with an L2 penalty."""
    p = {"w": np.zeros(x.shape[1] + 1, np.float32)}
    opt, weight = Adam(p, 0.05), np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    for _ in range(STEPS):
        slack = 1 - y * (x @ p["w"][:-1] + p["w"][-1])
        d = np.where(slack > 0, -y * weight, 0).astype(np.float32)
        opt.step({"w": np.append(x.T @ d, d.sum()).astype(np.float32) + 1e-5 * p["w"]})
    return p["w"]


class Hierarchy:
    """Families first, then pairs of languages within the family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(v) for v in langs])
        names = sorted({family(v) for v in self.langs})
        self.members = [[i for i, v in enumerate(self.langs) if family(v) == f] for f in names]
        of = np.array([names.index(family(v)) for v in self.langs])
        self.top = train_family(x, of[y], len(names))
        self.pairs = {}
        for group in self.members:
            for a, b in combinations(group, 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = train_svm(x[rows], np.where(y[rows] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = _softmax(x @ self.top[:-1] + self.top[-1])
        chosen = p.argmax(axis=1)
        lang, score = np.zeros(len(x), np.int64), p[np.arange(len(x)), chosen].astype(np.float64)
        for f, group in enumerate(self.members):
            rows = np.flatnonzero(chosen == f)
            if not len(rows):
                continue
            votes, margin = np.zeros((len(rows), len(self.langs))), np.zeros((len(rows), len(self.langs)))
            least = np.full((len(rows), len(self.langs)), np.inf)
            for (a, b), w in self.pairs.items():
                if a not in group:
                    continue
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                margin[:, a] += m
                margin[:, b] -= m
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
            rank = votes[:, group] + np.tanh(margin[:, group]) * 0.49
            lang[rows] = np.array(group)[rank.argmax(axis=1)]
            if len(group) > 1:
                score[rows] *= 1 / (1 + np.exp(-4 * least[np.arange(len(rows)), lang[rows]]))
        return [self.langs[i] for i in lang], np.clip(score, 0, 1)


def train(spark: SparkSession, labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Hierarchy | None:
    """``labelled`` (id, text, lang): its bounded sample is brought to the driver as features."""
    chosen = sample_of(labelled.where(F.col(lang_col).isNotNull()), id_col, lang_col, PER_LABEL).select(id_col)
    chosen = stored(spark, chosen.distinct(), "lang-sample")
    rows = labelled.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull())
    rows = rows_of(rows, chosen, id_col, text_col)
    rows = rows.where(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string"), text_col)

    def extract(batches):
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in slices(texts, 1 << 20, 500):
                x = features(texts[lo:hi]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 ["lang", "x"])

    got = rows.mapInArrow(extract, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    return Hierarchy(x, [r.lang for r in got])


def identify(spark: SparkSession, docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts, letters = utf8(b.column(1)), b.column(2).to_pylist()
            for lo, hi in slices(texts, 1 << 20, 500):
                lang, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                with_letter = [i for i in range(lo, hi) if letters[i]]
                if with_letter and shared.value is not None:
                    names, s = shared.value.predict(features([texts[i] for i in with_letter]))
                    for i, name, v in zip(with_letter, names, s):
                        lang[i - lo], score[i - lo] = name, v
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(id_col, F.col(text_col).cast("string"), letter).mapInArrow(
        run, f"{id_col} {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(spark, docs.where(fold("doc_id", 5) != 0), "doc_id", "text", "lang")
    return identify(spark, docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
