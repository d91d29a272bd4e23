"""File fingerprints and source profiles (S5, S6): one row per file, hashed
in parallel over files that the ``binaryFile`` source lists."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.schemas import MIN_FILE_SIZE_BYTES


CHUNK_BYTES = 8 << 20
#: Children of a node of a file's hash tree.
FANOUT = 1024


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, sha256 of the bytes. A file is read in chunks by one
    task, so its size does not matter for memory; many part files are hashed
    side by side."""
    def digest(batches):
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                h = hashlib.sha256()
                with _open(name) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())],
                                             ["path", "length", "sha256"])

    return _binary(spark, path).select("path", "length").mapInArrow(digest, "path string, length long, sha256 string")


def merkle_roots(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, fanout: int = FANOUT) -> DataFrame:
    """S5 for huge files: path, length, chunks and the root of a hash tree over
    the file's chunks, which are read and hashed in many tasks.

    A leaf is the SHA-256 of ``chunk_bytes`` bytes (the last one of what is
    left; empty files are not listed); a node is the SHA-256 of the hex
    digests of up to ``fanout`` children in a row. A file of one chunk has its
    leaf as root. Levels follow the longest file, so no group has more than
    ``fanout`` rows, and the root does not depend on how chunks are dealt."""
    sizes = _binary(spark, path).select("path", "length")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("length") / chunk_bytes)).cast("long")
    sizes = sizes.withColumn("chunks", chunks)
    longest = sizes.agg(F.max("chunks")).first()[0] or 0

    def digest(batches):
        for b in batches:
            out = []
            for name, i in zip(b["path"].to_pylist(), b["place"].to_pylist()):
                with _open(name, seek=True) as f:
                    f.seek(i * chunk_bytes)
                    out.append(hashlib.sha256(f.read(chunk_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["path"], b["place"], pa.array(out, pa.string())],
                                             ["path", "place", "digest"])

    places = sizes.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("place"))
    nodes = places.repartition("path", "place").mapInArrow(digest, "path string, place long, digest string")
    while longest > 1:
        children = F.array_sort(F.collect_list(F.struct("place", "digest")))
        nodes = nodes.groupBy("path", F.floor(F.col("place") / fanout).alias("at")).agg(children.alias("c")).select(
            "path", F.col("at").alias("place"), F.when(F.size("c") + F.col("at") == 1, F.col("c")[0]["digest"]).otherwise(
                F.sha2(F.array_join(F.transform("c", lambda c: c["digest"]), ""), 256)).alias("digest"))
        longest = -(-longest // fanout)
    return sizes.join(nodes.select("path", F.col("digest").alias("merkle_root")), "path")


def _open(path: str, seek: bool = False):
    """Byte stream of a file that the ``binaryFile`` source has listed; with
    ``seek`` one that can begin at any place."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        system, inner = fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    else:
        system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(inner) if seek else system.open_input_stream(inner)


def source_profile(spark: SparkSession, path: str, expected: Sequence[str] | None = None,
                   min_bytes: int = MIN_FILE_SIZE_BYTES) -> DataFrame:
    """Per file ``path, length, too_small``; the ``content`` column is
    pruned, so no bytes are read. ``expected`` names file basenames that must be
    present; absent ones come back as rows with ``found = false``."""
    b = _binary(spark, path).select("path", "length")
    prof = b.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length",
                    (F.col("length") < min_bytes).alias("too_small"), F.lit(True).alias("found"))
    if expected:
        exp = b.sparkSession.createDataFrame([(e,) for e in expected], "name string")
        missing = exp.join(prof.select("name"), "name", "left_anti").select(
            F.lit(None).cast("string").alias("path"), "name", F.lit(None).cast("bigint").alias("length"),
            F.lit(None).cast("boolean").alias("too_small"), F.lit(False).alias("found"))
        prof = prof.unionByName(missing)
    return prof


def profile_failures(profile: DataFrame) -> DataFrame:
    """Rows that fail the pre-flight check, with a reason."""
    return profile.where(~F.col("found") | F.col("too_small")).select(
        "name", F.when(~F.col("found"), "not found").otherwise("too small").alias("reason"))
