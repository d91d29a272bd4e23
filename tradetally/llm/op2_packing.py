"""Concatenate-and-cut packing of documents into fixed token windows.

First pass: every task tokenises its rows and keeps running token totals.
Second pass: exclusive prefix sums over the tasks' totals turn them into
global offsets; the one token stream is cut at multiples of the window.
A document that crosses cuts becomes several pieces (boundary records).

Defined results: null or empty text is a document of the end id alone; equal
rows and equal ids are packed as separate documents; an empty table gives no
pieces; further columns of the input are ignored. Only the last window of the
stream is not full.
"""

from __future__ import annotations

import gc
import json
import os
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import accumulate
from struct import pack as pack_ids

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import release, stored, table, utf8

WINDOW = 4096
END_ID = 2
#: Words whose ids a Python worker remembers; the memory is emptied when full.
REMEMBERED = 1_200_000
_KNOWN: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a text, word by word: the tokenizer drops white space and joins
    nothing across it, so ids of a text are those of its blank-separated parts
    in a row. Parts are encoded once and remembered. Only the four blanks
    below are split at; rarer white space goes to the tokenizer itself."""

    def __init__(self, path: str):
        self.most = REMEMBERED
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids = Tokenizer.from_file(path), {}
        # the same merges for words that are already single normal parts
        parts = json.loads(self.tokenizer.to_str())
        self.bare = Tokenizer.from_str(json.dumps(parts | {
            "normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        shown = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255]
        hidden = [i for i in range(256) if i not in shown]
        letter = {i: chr(i) for i in shown} | {i: chr(256 + n) for n, i in enumerate(hidden)}
        self.letters = "".join(letter[i] for i in range(256))

    @classmethod
    def of(cls, path: str, most: int = REMEMBERED) -> WordIds:
        """This worker's memory for a tokenizer, of at most ``most`` words."""
        if path not in _KNOWN:
            _KNOWN[path] = cls(path)
        _KNOWN[path].most = most
        return _KNOWN[path]

    def _encode(self, tokenizer, words: list[str], inputs: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            found = tokenizer.encode_batch_fast(inputs[at:at + 20_000], add_special_tokens=False)
            for w, e in zip(words[at:at + 20_000], found):
                i = e.ids
                self.ids[w] = pack_ids(f"<{len(i)}I", *i)

    def learn(self, words: set[str]) -> None:
        """Remembers words. Words of Latin letters alone need no normal form
        and no cutting, only lower case and their bytes as the model's letters;
        a comma or full stop behind them is a part of its own."""
        ids = self.ids
        if len(ids) + len(words) > self.most:
            ids.clear()
        if "," not in ids:
            ids[""] = b""
            self._encode(self.tokenizer, [",", "."], [",", "."])
        stems, other, made = {}, [], []
        for w in words:
            mark = "" if w.isalpha() else w[-1:]
            s = (w if not mark else w[:-1]).lower()
            if mark in ("", ",", ".") and s.isalpha():
                if s.isascii():
                    stems[s] = s
                elif max(b := s.encode()) < 0xC4:
                    stems[s] = charmap_decode(b, "strict", self.letters)[0]
                else:
                    other.append(w)
                    continue
                if s is not w:
                    made.append((w, s, mark))
            elif w:
                other.append(w)
        new = [s for s in stems if s not in ids]
        self._encode(self.bare, new, [stems[s] for s in new])
        self._encode(self.tokenizer, other, other)
        for w, s, mark in made:
            ids[w] = ids[s] + ids[mark] if mark else ids[s]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        found = [list(map(self.ids.get, p)) for p in parts]
        holes = [list(_places(f)) for f in found]
        self.learn({p[i] for p, h in zip(parts, holes) for i in h})
        for p, f, h in zip(parts, found, holes):
            for i in h:
                f[i] = self.ids[p[i]]
            yield b"".join(f)


def _places(values: list) -> Iterator[int]:
    """Indexes of the nulls."""
    at = -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        yield at


def token_table(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int,
                remembered: int = REMEMBERED) -> DataFrame:
    """(id, part, start, n_tokens, ids): ``start`` counts the tokens before
    the document in its task's part."""
    end = end_id.to_bytes(4, "little")

    def tokenise(batches):
        encode, part, start = WordIds.of(tokenizer, remembered), TaskContext.get().partitionId(), 0
        gc.disable()  # nothing here is cyclic, and large word tables are slow to walk
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                ids = [x + end for x in encode([t.decode("utf-8") for t in utf8(s.column(1))])]
                n = [len(x) // 4 for x in ids]
                ends = list(accumulate(n, initial=start))
                start = ends.pop()
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([part] * len(n), pa.int32()), pa.array(ends, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["id", "part", "start", "n_tokens", "ids"])
        gc.enable()
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tokenise, f"id {kind}, part int, start long, n_tokens long, ids binary")


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         remembered: int = REMEMBERED) -> DataFrame:
    """Pieces (id_col, start, length, doc_tokens, sequence_id, offset, ids);
    ``ids`` are little-endian unsigned 32-bit token ids. ``remembered`` bounds
    the words whose ids a worker keeps, which saves encoding them again."""
    tokens = token_table(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id, remembered)
    tokens = stored(spark, tokens, "tokens")
    # one row per task of the first pass, whatever the number of documents
    totals = sorted(tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect())
    before = list(zip((r.part for r in totals), accumulate((r.n for r in totals), initial=0)))
    offsets = spark.createDataFrame(before, "part int, before long")
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("start"))
    size = F.lit(window).cast("long")
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(
        F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n_tokens") - 1) / size))))
    lo = F.greatest(F.col("at"), F.col("sequence_id") * size)
    hi = F.least(F.col("at") + F.col("n_tokens"), (F.col("sequence_id") + 1) * size)
    pieces = pieces.withColumn("lo", lo).withColumn("length", hi - F.col("lo"))
    start = F.col("lo") - F.col("at")
    return pieces.select(
        F.col("id").alias(id_col), start.alias("start"), "length", F.col("n_tokens").alias("doc_tokens"),
        "sequence_id", (F.col("lo") - F.col("sequence_id") * size).alias("offset"),
        F.substring("ids", (start * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
