"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in
the inverted files of its ``POSTED`` nearest pivots; a query looks into the
files of its ``PROBED`` nearest pivots, ranks what it finds there by the
footrule distance of the orders, and computes the exact cosine for the best.

Equal vectors form one class, which is posted once with as many of its
smallest ids as a result can hold. Files are dealt out in blocks of bounded
size, so neither a frequent pivot nor many queries meet in one task. Queries
that the index leaves without enough neighbours are run against all classes
in blocks.

Defined results: vectors that are null, empty, zero, of another length than
most, or that hold null or non-finite components take no part, neither as
query nor as candidate; ties in nearness go to the smaller id; a null id takes
no part; equal rows of one id count once; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradetally.llm.common import stored, table, with_fields

#: Nearest pivots kept of each vector, files it is posted in, files a query reads.
ORDER = 64
POSTED = 8
PROBED = 32
#: Of each file's block, the share that is reranked for a query, the best by
#: footrule distance; at least ``LEAST_RERANKED``.
RERANKED = 0.25
LEAST_RERANKED = 64
#: Classes and queries in a block of a file; queries in a block of the full search.
BLOCK = 1024
FULL_BLOCK = 2048
#: Pivots: this many times the square root of the number of classes, at most ``MOST_PIVOTS``.
PIVOTS = 2.0
MOST_PIVOTS = 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of vectors that can be compared; one row for each id and vector."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("id is not null and vec is not null and size(vec) > 0").where(~bad)
    return v.where(F.exists("vec", lambda x: x != 0)).distinct()


def _matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _orders(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(len(column), -1).astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither tiny nor huge components leave the doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", q, v), -1.0, 1.0)


def orders(frame: DataFrame, pivots: np.ndarray, files: int) -> DataFrame:
    """``frame`` (id, vec, ...) with the order of its ``ORDER`` nearest pivots,
    nearest first, as 16-bit numbers, and the first ``files`` of them as a list."""
    def run(batches):
        unit = _unit(pivots)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                near = _unit(_matrix(s.column(1))) @ unit.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :ORDER]
                yield pa.RecordBatch.from_arrays(
                    [*s.columns, pa.array([r.tobytes() for r in best.astype("<i2")], pa.binary()),
                     pa.array(list(best[:, :files].astype(np.int32)), pa.list_(pa.int32()))], [*b.schema.names, "near", "files"])

    return frame.mapInArrow(run, with_fields(frame, near="binary", files="array<int>"))


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` vectors with the largest
    cosine found for each row of ``queries``, without the query's own id."""
    take = k + 1  # a query finds itself
    rows = stored(spark, usable(vectors, id_col, vec_col), "vectors")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    most = F.size("vec") == (length[0].n if length else 0)
    rows = rows.where(most)
    # the smallest ids of each class, limited before the exchange
    smallest = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= take)
    classes = smallest.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stored(spark, classes.select("id", "vec", "ids"), "classes")
    count = classes.count()
    asked = stored(spark, usable(queries, id_col, vec_col).where(most), "queries")
    searched = asked.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")

    pivots = min(MOST_PIVOTS, max(1, math.ceil(PIVOTS * math.sqrt(count))))
    pick = classes.select(F.xxhash64("id").alias("h"), "id", "vec").orderBy("h", "id").limit(pivots).collect()
    pivots = np.array([r.vec for r in pick], np.float64)
    if not pick:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))

    posted = stored(spark, orders(classes, pivots, POSTED), "posted").withColumn("pivot", F.explode("files"))
    searched = stored(spark, orders(searched, pivots, PROBED), "searched")
    probes = searched.withColumn("pivot", F.explode("files"))
    blocks = posted.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(
        probes.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_blocks")), "pivot")
    blocks = F.broadcast(blocks)  # one row for each pivot

    def part(of):
        return F.pmod(F.xxhash64("id"), of).cast("int")

    left = posted.join(blocks, "pivot").withColumn("block", part(F.col("blocks"))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    right = probes.join(blocks, "pivot").withColumn("query_block", part(F.col("query_blocks"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["pivot", "block", "query_block"]
    n_pivots, order = len(pivots), min(ORDER, len(pivots))

    def places(column) -> np.ndarray:
        near = _orders(column)
        out = np.full((len(near), n_pivots), order, np.int16)
        np.put_along_axis(out, near, np.arange(near.shape[1], dtype=np.int16)[None, :], axis=1)
        return out

    def rank(x: pa.Table, q: pa.Table) -> pa.Table:
        if not len(x) or not len(q):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vec, asked_vec = _unit(_matrix(x["vec"])), _unit(_matrix(q["vec"]))
        own, ids, query = x["id"].to_numpy(), x["ids"].to_pylist(), q["id"].to_numpy()
        # pivots outside of both orders do not count, so the places of those within are enough
        at, near = places(x["near"]), _orders(q["near"])
        rest = (order - at).sum(axis=1)
        out_q, out_id, out_s = [], [], []
        step = np.arange(near.shape[1], dtype=np.int16)
        for i in range(len(query)):
            mine = at[:, near[i]]
            # |a - b| over the query's pivots, and the places of the vector's others to the end
            foot = np.abs(mine - step).sum(axis=1) + rest - (order - mine).sum(axis=1)
            n = min(max(LEAST_RERANKED, math.ceil(RERANKED * len(foot))), len(foot))
            best = np.argpartition(foot, n - 1)[:n]
            score = _cosine(np.broadcast_to(asked_vec[i], (n, vec.shape[1])), vec[best])
            for j in _top(own[best], score, take):
                for x_id in ids[best[j]]:
                    out_q.append(query[i])
                    out_id.append(x_id)
                    out_s.append(score[j])
        return pa.table({"query": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    hits = left.select(*key, "id", "vec", "ids", "near").groupBy(*key).cogroup(
        right.select(*key, "id", "vec", "near").groupBy(*key)).applyInArrow(rank, "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def nearest(found):
        found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= take)

    hits = stored(spark, nearest(hits), "hits")
    short = searched.join(hits.groupBy("query").count().where(F.col("count") >= min(take, count))
                          .select(F.col("query").alias("id")), "id", "left_anti").select("id", "vec")
    short = stored(spark, short, "short")
    missing, last = short.count(), None
    while missing > 0:  # blocks of bounded size against all classes
        block = short if last is None else short.where(F.col("id") > last)
        block = block.orderBy("id").limit(FULL_BLOCK).collect()
        if not block:
            break
        last = block[-1].id
        hits = hits.unionByName(nearest(_against_all(classes, block, take)))
    hits = hits.select("query", F.col("id").alias("found"), "score")
    own = asked.join(searched.select("vec", F.col("id").alias("query")), "vec").select(F.col("id").alias("query_id"), "query")
    out = stored(spark, own, "own").join(stored(spark, hits, "hits"), "query").where("found != query_id")
    order_by = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    return out.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("found").alias(id_col), "score")


def _against_all(classes: DataFrame, block: list, take: int) -> DataFrame:
    """The best of each task for a bounded block of queries."""
    query = np.array([r.id for r in block], np.int64)
    vecs = _unit(np.array([r.vec for r in block], np.float64))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                own, ids = s.column(0).to_numpy(), s.column(2).to_pylist()
                vec = _unit(_matrix(s.column(1)))
                out = []
                for i in range(len(query)):
                    score = _cosine(np.broadcast_to(vecs[i], vec.shape), vec)
                    out += [(query[i], x, score[j]) for j in _top(own, score, take) for x in ids[j]]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.float64())], ["query", "id", "score"])

    return classes.select("id", "vec", "ids").mapInArrow(run, "query long, id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0))
