"""Removal of long passages that an earlier document has, by prefix-partitioned
suffix trees over words.

Only suffixes of at least ``WINDOW`` words matter, and of their tree the internal
nodes at that depth or deeper: one with leaves in two documents is a repeated
passage, and neighbouring leaves along a document join into its maximal repeats.

Suffixes are dealt to subtrees by a prefix. It is not taken at the suffix's own
first word but at the least of the k-word hashes within its first ``WINDOW``
words: equal suffixes still meet, and neighbouring suffixes of a document, which
share most of their words, travel together as one record of words. A prefix
that one document alone has leads to no repeat, so the places of all prefixes are
counted first, and documents get back those that they share with others. k is
variable: from ``PREFIX`` words on, a shared prefix whose records hold more than
``GROUP`` words in all is lengthened step by step, so that every group fits
the same memory whatever the input. The prefixes too large at each step are
broadcast; there are at most (words in records) / ``GROUP`` of them, 8 bytes
each, with about 3.5 words in records for a word of the input. A prefix as long as
the window has a single node, so a task sends its smallest document only,
and of the node only the owner (the smallest document of all) is brought back.

A task builds the subtrees of whole groups: it sorts their suffixes by their
first ``WINDOW`` words (ranks of ever longer runs, as in building suffix arrays);
neighbours in that order with a common prefix of ``WINDOW`` words are leaves of one
deep node. Words are sent as numbers of two bytes if they are among the
``COMMON`` most frequent of a sample of texts, else as 64-bit hashes; the
sample decides on lengths of records only, not on results.

Defined results: null or empty text has no words; documents shorter than a
window lose nothing; a null id neither removes from others nor loses words;
rows of equal id do not remove from each other; equal texts keep the words of
the smallest id only; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import rolling, signed, slices, sliding_min, stored, table, utf8, word_hashes

WINDOW = 50
#: Words of the shortest prefix, and lengths tried before the whole window.
PREFIX = 12
STEPS = 3
#: Words that the records of a group may hold.
GROUP = 1 << 20
#: Words with a number of two bytes, and texts whose words are counted for that.
COMMON = 65_535
SAMPLE = 1000
#: Owners that a task gathers before it sends them on, and words of records in a batch.
GATHERED = 1_000_000
BATCH_WORDS = 1 << 20

_ROWS = "prefix long, doc long, row long, at int, words binary, rare binary"


def lengths(window: int, prefix: int) -> list[int]:
    """Lengths of prefixes below the window's."""
    return sorted({prefix + (window - prefix) * i // STEPS for i in range(STEPS)})


def _windows(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every window of consecutive words inside one text."""
    n = int(offsets[-1]) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(text[:n] == text[window - 1:])
    return at, text[at]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _prefix(h: np.ndarray, at: np.ndarray, window: int, length: int) -> np.ndarray:
    """Prefix of the given length of the windows that begin at ``at``."""
    return sliding_min(rolling(h, length), window - length + 1)[at]


def _prefixes(h: np.ndarray, at: np.ndarray, window: int, sizes: list[int], large: list[np.ndarray]):
    """Of every window the first of its prefixes that is not too large, and
    the windows of which all judged ones are."""
    key, rest = np.zeros(len(at), np.uint64), np.arange(len(at))
    for length, known in zip(sizes, large):
        key[rest] = _prefix(h, at[rest], window, length)
        rest = rest[_among(key[rest], known)]
        if not len(rest):
            break
    return key, rest


def _records(text: np.ndarray, prefix: np.ndarray, at: np.ndarray):
    """Starts of the records: neighbouring windows of a text and a prefix."""
    if not len(at):
        return np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (prefix[1:] != prefix[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("row", F.xxhash64("text"))


def prefixes(rows: DataFrame, window: int, prefix: int, group: int) -> tuple[list[np.ndarray], DataFrame]:
    """For each length in turn, the shared prefixes whose records hold more than
    ``group`` words (a length after the first without any is not judged); and
    (doc, prefix) of all other shared ones."""
    spark, sizes, large, shared = rows.sparkSession, lengths(window, prefix), [], None
    for length in sizes:
        known = spark.sparkContext.broadcast(large)

        def places(batches, known=known, length=length):
            for b in batches:
                ids, texts = b.column(0).to_numpy(), utf8(b.column(1))
                for lo, hi in slices(texts):
                    h, offsets = word_hashes(texts[lo:hi])
                    at, text = _windows(offsets, window)
                    if known.value and len(at):
                        rest = _prefixes(h, at, window, sizes, known.value)[1]
                        at, text = at[rest], text[rest]
                    if not len(at):
                        continue
                    key = _prefix(h, at, window, length)
                    start = _records(text, key, at)
                    words = np.diff(np.append(start, len(at))) + window - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key[start])), pa.array(ids[lo + text[start]]), pa.array(words)], ["prefix", "doc", "n"])

        found = stored(spark, rows.where("doc is not null").select("doc", "text").mapInArrow(places, "prefix long, doc long, n long"), "prefixes")
        each = found.groupBy("prefix").agg(F.sum("n").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
        each = stored(spark, each.where("least < most").select("prefix", "n"), "shared-prefixes")
        fit = found.join(each.where(F.col("n") <= group).select("prefix"), "prefix").select("doc", "prefix")
        shared = fit if shared is None else shared.unionByName(fit)
        over = each.where(F.col("n") > group).select("prefix").collect()
        large.append(np.sort(np.array([r.prefix for r in over], np.int64).view(np.uint64)))
        if not over:
            break
    return large, shared


def common_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words of ``SAMPLE`` different texts,
    chosen by their hashes."""
    def count(batches):
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in slices(texts):
                words, n = np.unique(word_hashes(texts[lo:hi])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n, pa.int64())], ["word", "n"])

    few = rows.select("row").distinct().orderBy("row").limit(SAMPLE)
    texts = rows.join(F.broadcast(few), "row").dropDuplicates(["row"]).select("text")
    found = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    return np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Items of ``data`` between neighbouring cuts as binary values."""
    offsets = pa.py_buffer((cuts * data.itemsize).astype(np.int64).tobytes())
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data.tobytes())])
    return values.cast(pa.binary())


def _tagged(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    return key ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _deal(rows: DataFrame, large, common, window: int, sizes: list[int]) -> DataFrame:
    """Records of the shared prefixes (``rows`` has a list of them) by prefix; for
    a prefix of the whole window the task's smallest document."""
    def deal(batches):
        known, frequent, owners = large.value, common.value, {}

        def flush():
            if owners:
                keys = np.fromiter(owners.keys(), np.int64, len(owners))
                docs = np.fromiter(owners.values(), np.int64, len(owners))
                for i in range(0, len(keys), 50_000):
                    k = keys[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), pa.array(docs[i:i + 50_000]), pa.array(np.zeros(len(k), np.int64)),
                         pa.array(np.full(len(k), -1, np.int32)), pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.binary())],
                        ["prefix", "doc", "row", "at", "words", "rare"])
                owners.clear()

        for b in batches:
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            row, texts = b.column(2).to_numpy(zero_copy_only=False), utf8(b.column(1))
            none, lists = np.asarray(b.column(0).is_null()), b.column(3)
            for lo, hi in slices(texts):
                h, offsets = word_hashes([b"" if none[i] else texts[i] for i in range(lo, hi)])
                at, text = _windows(offsets, window)
                if not len(at):
                    continue
                key, rest = _prefixes(h, at, window, sizes, known)
                if len(rest):
                    keys, owner = signed(rolling(h, window)[at[rest]]), ids[lo + text[rest]]
                    order = np.lexsort((owner, keys))
                    keys, owner = keys[order], owner[order]
                    first = np.ones(len(keys), bool)
                    first[1:] = keys[1:] != keys[:-1]
                    for k, d in zip(keys[first].tolist(), owner[first].tolist()):
                        if owners.get(k, d) >= d:
                            owners[k] = d
                    if len(owners) > GATHERED:
                        yield from flush()
                    at, text, key = (np.delete(x, rest) for x in (at, text, key))
                # a prefix of one text taken for another's costs a record, no more
                own = lists.slice(lo, hi - lo)
                whose = np.repeat(np.arange(hi - lo), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                own = np.sort(_tagged(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), whose))
                mine = _among(_tagged(key, text), own)
                at, text, key = at[mine], text[mine], key[mine]
                start = _records(text, key, at)
                if not len(start):
                    continue
                number = np.searchsorted(frequent, h)
                number[~_among(h, frequent)] = COMMON
                number = number.astype("<u2")
                size = at[np.append(start[1:], len(at)) - 1] - at[start] + window
                ends, begin = np.cumsum(size), 0
                while begin < len(start):
                    done = ends[begin - 1] if begin else 0
                    to = max(begin + 1, int(np.searchsorted(ends, done + BATCH_WORDS, "right")))
                    part, n = start[begin:to], size[begin:to]
                    cuts = np.append(0, np.cumsum(n))
                    index = np.arange(cuts[-1]) + np.repeat(at[part] - cuts[:-1], n)
                    words = number[index]
                    rare = words == COMMON
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key[part])), pa.array(ids[lo + text[part]]), pa.array(row[lo + text[part]]),
                         pa.array((at[part] - offsets[text[part]]).astype(np.int32)), _binary(words, cuts),
                         _binary(h[index[rare]].astype("<u8"), np.append(0, np.cumsum(rare))[cuts])],
                        ["prefix", "doc", "row", "at", "words", "rare"])
                    begin = to
        yield from flush()

    return rows.select("doc", "text", "row", "shared").mapInArrow(deal, _ROWS)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the values without gaps, and the places in their order."""
    order = np.argsort(key)
    new = np.zeros(len(key), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


def subtrees(words: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of records, which follow each other in ``words`` with ``size``
    words each: the places of all that have ``depth`` words in their record, in
    the order of these words, and which of them begin a node of that depth; the
    others share so many words with the one before."""
    end = np.repeat(np.cumsum(size), size)
    suffix = end - np.arange(len(words)) >= depth
    rank, span = words.astype(np.int64), 1
    while True:  # ranks of runs of ``span`` words become those of longer runs
        bits = max(1, int(rank.max()).bit_length())
        several = 63 // bits  # at least two: a batch has far fewer than 2**31 words
        shifts = [*range(0, depth - span, span), depth - span][:several] if span * several < depth else \
            [*range(0, depth - span, span), depth - span]
        key = rank.copy()
        for s in shifts[1:]:
            key <<= bits
            key[:len(key) - s] |= rank[s:]
        rank, order = _ranked(key)
        if shifts[-1] + span >= depth:
            break
        span *= several
    order = order[suffix[order]]
    head = np.ones(len(order), bool)
    head[1:] = rank[order[1:]] != rank[order[:-1]]
    return order, head


def _decoded(words: list[bytes], rare: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers that tell the words of records apart, and the records' sizes."""
    number = np.frombuffer(b"".join(words), "<u2").astype(np.int64)
    which = number == COMMON
    number[which] += _ranked(np.frombuffer(b"".join(rare), "<u8"))[0]
    return number, np.array([len(x) for x in words]) // 2


def _repeats(records: DataFrame, window: int) -> DataFrame:
    """From records sorted by prefix: word ranges [lo, hi) that an earlier
    document has, and for prefixes of the whole window (lo = -1) the owner of a node."""
    def found(prefix, doc, row, at, words, rare):
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        group = np.cumsum(new) - 1
        owned = (at < 0) & new  # sorted by document: the first one owns the node
        out = [(doc[owned], np.zeros(owned.sum(), np.int64), np.full(owned.sum(), -1), prefix[owned])]
        # subtrees with leaves in two documents at least
        first = doc[np.flatnonzero(new)][group]
        several = np.zeros(group[-1] + 1, bool)
        several[group[(doc != first) & (at >= 0)]] = True
        keep = np.flatnonzero(several[group] & (at >= 0))
        if len(keep):
            number, size = _decoded([words[i] for i in keep], [rare[i] for i in keep])
            leaves, head = subtrees(number, size, window)
            rec = np.repeat(np.arange(len(keep)), size)
            place = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size) + at[keep][rec]
            # leaves of a deep node in other documents than its least one
            of = doc[keep][rec[leaves]]
            least = np.minimum.reduceat(of, np.flatnonzero(head))[np.cumsum(head) - 1]
            idx = np.sort(leaves[of > least])
            if len(idx):  # leaves in a row join into one range of the document
                r, w = rec[idx], place[idx]
                start = np.ones(len(idx), bool)
                start[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)
                s = np.flatnonzero(start)
                e = np.append(s[1:], len(idx)) - 1
                out.append((doc[keep][r[s]], row[keep][r[s]], w[s], w[e] + window))
        return [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(4)]

    def grow(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + \
                [np.array(b.column(i).to_pylist() + [None], object)[:-1] for i in (4, 5)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            # the last prefix may go on in the next batch; of a window's own one the first row is enough
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cols[3][cut] < 0 and cut + 1 < len(cols[0]):
                cols = [c[:cut + 1] for c in cols]
            held = [c[cut:] for c in cols]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(*(c[:cut] for c in cols))],
                                                 ["doc", "row", "lo", "hi"])
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(*held)], ["doc", "row", "lo", "hi"])

    dealt = records.repartition("prefix").sortWithinPartitions("prefix", "doc", "at")
    return dealt.mapInArrow(grow, "doc long, row long, lo long, hi long")


def _strip(joined: DataFrame, large, window: int, sizes: list[int]) -> DataFrame:
    """Kept text of each document."""
    def strip(batches):
        known = large.value
        whole = len(known) == len(sizes) and len(known[-1]) > 0
        for b in batches:
            out = []
            ids, texts = b.column(0), utf8(b.column(1))
            row, ranges, owned = (b.column(i).to_pylist() for i in (2, 3, 4))
            for i, t in enumerate(texts):
                words = t.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in ranges[i] or ():
                    if r["row"] == row[i]:
                        gone[r["lo"]] += 1
                        gone[r["hi"]] -= 1
                if whole and len(words) >= window and ids[i].is_valid:
                    h, offsets = word_hashes([t])
                    at, _ = _windows(offsets, window)
                    rest = _prefixes(h, at, window, sizes, known)[1]
                    if len(rest):
                        node = signed(rolling(h, window)[at[rest]])
                        lost = at[rest][~np.isin(node, np.array(owned[i] or [], np.int64))]
                        np.add.at(gone, lost, 1)
                        np.add.at(gone, lost + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                n = int(gone.sum())
                kept = b" ".join(words) if not n else b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((len(words), n, kept.decode("utf-8")))
                if len(out) == 500 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i + 1 - len(out), len(out)), pa.array([x[0] for x in out], pa.int64()),
                         pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                        ["doc", "n_words", "n_removed", "kept"])
                    out = []

    return joined.mapInArrow(strip, "doc long, n_words long, n_removed long, kept string")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(id_col, n_words, n_removed, kept): the words of each document outside
    of passages that a document of smaller id has, joined by blanks."""
    rows, sizes = _input(docs, id_col, text_col), lengths(window, prefix)
    known, nameless = rows.where("doc is not null"), rows.where("doc is null")
    large, shared = prefixes(known, window, prefix, group)
    large, common = spark.sparkContext.broadcast(large), spark.sparkContext.broadcast(common_words(known))
    # both joins with the texts are by the same column and of one kind, so texts are shuffled once
    dealt = known.join(shared.groupBy("doc").agg(F.collect_set("prefix").alias("shared")), "doc", "left")
    found = _repeats(_deal(dealt, large, common, window, sizes), window)
    # ranges and owned nodes of a document: no more than it has words
    found = found.groupBy("doc").agg(
        F.collect_list(F.when(F.col("lo") >= 0, F.struct("row", "lo", "hi"))).alias("ranges"),
        F.collect_list(F.when(F.col("lo") < 0, F.col("hi"))).alias("owned"))
    columns = ["doc", "text", "row", "ranges", "owned"]
    joined = known.join(found, "doc", "left").select(*columns)
    # rows without id do not meet in the join
    kinds = found.schema
    alone = nameless.select("doc", "text", "row", *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in ("ranges", "owned")])
    return _strip(joined, large, window, sizes).unionByName(_strip(alone, large, window, sizes)).withColumnRenamed("doc", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
