"""CSV records with line breaks in quoted fields, read in many tasks.

A line break ends a record if an even number of quotes lies before it in its
file. So each split counts its quotes, the counts are summed over the splits of
a file, and every split then knows whether it starts inside a field. It yields
the records that lie within it; those that cross into the next split (at most
one a split) are put together from their pieces.

The driver holds one number a split that starts or ends inside a field, never
text. Records are those of RFC 4180: quotes stand around a field and are
doubled inside it; line breaks are ``\\n`` or ``\\r\\n``; the encoding must keep
ASCII bytes as they are (UTF-8 and single-byte encodings do). A file with an odd
number of quotes cannot be cut into records and is refused. Other than Spark's
whole-file reader, a ``\r`` before the break that ends a record is no part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
#: Encodings whose bytes are not ASCII's; such files are read whole.
WIDE = ("utf-16", "utf16", "utf-32", "utf32")

_RECORD = "file string, block long, row long, value binary"


class UnclosedQuote(ValueError):
    """A file whose quotes do not pair up."""


def splittable(encoding: str) -> bool:
    return not encoding.lower().replace("_", "-").startswith(WIDE)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes, in scan order within each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def crossings(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, starts, ends, unclosed): the splits that start or end inside a
    quoted field. One row a split reaches the window of its file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    splits = lines.groupBy(F.col("_metadata.file_path").alias("file"),
                           F.col("_metadata.file_block_start").alias("block")).agg(F.sum(quotes).alias("quotes"))
    so_far = F.sum("quotes").over(Window.partitionBy("file").orderBy("block"))
    splits = splits.withColumn("ends", so_far % 2 == 1).withColumn("starts", (so_far - F.col("quotes")) % 2 == 1)
    last = F.col("block") == F.max("block").over(Window.partitionBy("file"))
    splits = splits.withColumn("unclosed", last & F.col("ends"))
    return splits.where("starts OR ends").select("file", "block", "starts", "ends", "unclosed")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, block), lines) pieces of batches, in order."""
    for batch in batches:
        blocks, files = batch["block"].to_numpy(), batch["file"].dictionary_encode()
        ids = files.indices.to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (ids[1:] != ids[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield (files.dictionary[int(ids[a])].as_py(), int(blocks[a])), batch["value"].slice(a, b - a)


def _inside(lines: pa.Array, inside: bool) -> np.ndarray:
    """For each line and the place after the last: does it start in a field?"""
    n = pc.count_substring(lines.cast(pa.large_binary()), pattern=QUOTE.encode()).to_numpy(zero_copy_only=False)
    return (np.concatenate([[0], np.cumsum(n)]) + inside) % 2 == 1


def _rows(split: tuple, rows: np.ndarray, values: pa.Array | list) -> pa.RecordBatch:
    k = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([split[0]] * k, pa.string()), pa.array(np.full(k, split[1], np.int64)), pa.array(rows),
         pa.array(values, pa.binary()) if isinstance(values, list) else values.cast(pa.binary())],
        ["file", "block", "row", "value"])


def records(lines: DataFrame, odd: set) -> DataFrame:
    """The records that lie within one split; ``odd`` has the splits that start
    inside a field. ``row`` is the number of the record's first line there."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, inside, kept, first = None, 0, False, None, 0
        for own, values in _by_split(batches):
            if own != split:
                split, at, inside, kept = own, 0, own in odd, None
            starts = _inside(values, inside)
            ends = ~starts[1:]
            single = np.flatnonzero(~starts[:-1] & ends)
            if len(single):
                yield _rows(split, at + single, values.take(pa.array(single)))
            many, places = [], []
            begin = 0
            for i in np.flatnonzero(starts[:-1] | starts[1:]):  # lines of records of several lines
                if not starts[i]:
                    kept, first, begin = [], at + int(i), int(i)
                if kept is not None:
                    kept.append(values[int(i)].as_py())
                    if ends[i]:
                        many.append(b"\n".join(kept))
                        places.append(first)
                        kept = None
            if many:
                yield _rows(split, np.array(places, np.int64), many)
            inside, at = bool(starts[-1]), at + len(values)

    return lines.mapInArrow(task, _RECORD)


def pieces(lines: DataFrame, odd: set) -> DataFrame:
    """Of records that cross splits: what lies at the start of a split and
    (``opens``) what its last record leaves open."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(opens: bool, row: int, kept: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*_rows(split, np.array([row], np.int64), [b"\n".join(kept)]).columns, pa.array([opens])],
                ["file", "block", "row", "value", "opens"])

        split, at, inside, head, tail, first = None, 0, False, None, None, 0
        for own, values in _by_split(batches):
            if own != split:
                if split and (head or tail):
                    yield out(head is None, first, tail if head is None else head)
                split, at, inside, tail, first = own, 0, own in odd, None, 0
                head = [] if inside else None
            starts = _inside(values, inside)
            for i in np.flatnonzero(starts[:-1] | starts[1:]):
                line = values[int(i)].as_py()
                if not starts[i]:
                    tail, first = [], at + int(i)
                part = head if head is not None else tail
                part.append(line)
                if not starts[i + 1]:
                    if head is not None:
                        yield out(False, 0, head)
                    head = tail = None
            inside, at = bool(starts[-1]), at + len(values)
        if split and (head or tail):
            yield out(head is None, first, tail if head is None else head)

    return lines.mapInArrow(task, _RECORD + ", opens boolean")


def joined(found: DataFrame) -> DataFrame:
    """Whole records from pieces: each belongs to the last one opened before it."""
    w = Window.partitionBy("file").orderBy("block", "opens")
    found = found.withColumn("from", F.last(F.when(F.col("opens"), F.col("block")), ignorenulls=True).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "opens", "value"))), lambda p: p["value"])
    text = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), parts[0],
                       lambda a, b: F.concat(a, F.lit(b"\n"), b))
    # the opening piece is the last of its split; those after it have larger blocks
    return found.groupBy("file", "from").agg(F.min(F.when(F.col("opens"), F.col("row"))).alias("row"),
                                             text.alias("value")).select(
        "file", F.col("from").alias("block"), "row", "value")


def _decoded(found: DataFrame, encoding: str) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [v.decode(encoding, "replace") for v in b["value"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["file"], b["block"], b["row"], pa.array(text, pa.string())],
                                             ["file", "block", "row", "text"])

    return found.mapInArrow(task, "file string, block long, row long, text string")


def read_records(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, block, row, text) of all records, headers among them; the order of
    a file is that of (block, row). One pass counts quotes; the text is then
    read when it is used."""
    marked = crossings(spark, path).collect()
    unclosed = [r.file for r in marked if r.unclosed]
    if unclosed:
        raise UnclosedQuote(f"{len(unclosed)} file(s) with an odd number of quotes, among them {unclosed[0]}")
    odd = {(r.file, r.block) for r in marked if r.starts}
    out = records(_lines(spark, path), odd)
    if marked:
        some = F.broadcast(spark.createDataFrame([(r.file, r.block) for r in marked], "file string, block long"))
        crossing = _lines(spark, path).join(some, ["file", "block"], "left_semi")
        out = out.unionByName(joined(pieces(crossing, odd)))
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        out = out.withColumn("text", F.col("value").cast("string"))
    else:
        out = _decoded(out, encoding)
    text = F.when(F.endswith("text", F.lit("\r")), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))
    first = (F.col("block") == 0) & (F.col("row") == 0)
    text = F.when(first, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return out.select("file", "block", "row", text.alias("text")).where(F.length("text") > 0)


def read_quoted_csv(spark: SparkSession, path: str, names: list[str], malformed: str,
                    encoding: str = "utf-8") -> DataFrame:
    """All-string columns ``names``, the whole text of rows that do not fit them
    as ``malformed``, and ``ingest_seq``. Each file begins with a header."""
    found = read_records(spark, path, encoding)
    options = {"escape": QUOTE, "columnNameOfCorruptRecord": malformed, "mode": "PERMISSIVE", "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    header = (F.col("block") == 0) & (F.col("row") == 0)
    # a generator's row is parsed once; a projection is parsed again in each filter above it
    fields = F.inline(F.array(F.from_csv("text", _ddl([*names, malformed]), options)))
    rows = found.where(~header).select(F.struct("file", "block", "row").alias("ingest_seq"), fields)
    return rows.select(*[f"`{n.replace('`', '``')}`" for n in [*names, malformed]], "ingest_seq")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
