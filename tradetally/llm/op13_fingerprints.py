"""Document fingerprints of closed syncmers, by DataFrame functions alone.

A text is a sequence of units: its runs without ASCII white space, cut from
their start into at most eight code points. Every run of ``K`` units is a
k-mer; inside it lie ``K - S + 1`` runs of ``S`` units, ranked by their MD5.
A k-mer is an anchor (closed syncmer) if its least inner run is its first or
its last one. That depends on the k-mer's own units only, so an edit elsewhere
moves no anchor. The fingerprint is the list of all anchors in order, each
written as ``distance:hash``, with the distance in units from the anchor
before (0: the first). Two fingerprints match position by position where hash
and distance agree; likeness is the share of matched distinct anchors in the
larger of both lists, so a shift of the whole text costs nothing.

The edited text of a document ends with the start of the next document. The
order of documents is that of falling ids, numbered from a range sort of ids
and digests; texts then move twice, to be joined with their number and to
meet their successor in blocks of ``BLOCK`` neighbours. The first of each
block is sent to the block before as well.

Defined results: null text counts as empty; a text of fewer than ``K`` units
has one anchor, all its units, and one without units has none (two empty
fingerprints are alike, 1.0, an empty one is unlike any other, 0.0); null ids
come last, equal ids in order of their texts' MD5, a null as an empty text;
equal rows stay rows of their own, collapsed before the shuffle and given
back at the end; a single document is its own successor; an empty table gives
no rows; further columns are ignored. A long text needs memory in proportion
to its own units only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradetally.llm.common import stored, table

#: A unit: at most eight code points of a run without ASCII white space.
UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: Units of a k-mer and of the runs inside that are ranked.
K, S = 6, 1
#: Neighbouring documents that meet in one window.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _short(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors of a text in order, as ``distance:hash``."""
    def pieces(units: Column, at: Column, size: int) -> Column:
        return F.concat_ws(" ", *[units[at + j] for j in range(size)])

    def along(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
        """Each value joined with the one ``step`` places on; the last ones stay."""
        return let(values, lambda v: F.zip_with(v, F.slice(v, step + 1, F.size(v)), join))

    def ranks(units: Column) -> Column:
        """Ranks of the runs of ``s`` units, by their place."""
        if s == 1:
            return F.transform(units, lambda x: _short(x))
        return F.transform(F.sequence(F.lit(0), F.size(units) - s), lambda i: _short(pieces(units, i, s)))

    def least(r: Column, width: int) -> Column:
        """Least of ``width`` ranks from each place on, by doubling."""
        span = 1
        while span < width:
            step = min(span, width - span)
            r = along(r, step, lambda a, b: F.least(a, b))
            span += step
        return r

    def chosen(units: Column) -> Column:
        last = k - s
        return let(ranks(units), lambda r: let(least(r, last + 1), lambda m: F.filter(
            F.sequence(F.lit(0), F.size(units) - k), lambda i: (m[i] == r[i]) | (m[i] == r[i + last]))))

    def named(units: Column) -> Column:
        return let(chosen(units), lambda p: F.transform(p, lambda at, i: F.concat_ws(
            ":", at - F.coalesce(F.get(p, i - 1), at), _short(pieces(units, at, k)))))

    whole = lambda u: F.array(F.concat(F.lit("0:"), _short(F.array_join(u, " "))))
    return let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.when(
        F.size(u) >= k, named(u)).when(F.size(u) > 0, whole(u)).otherwise(F.array().cast("array<string>")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal anchors in the larger of two lists."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def numbered(spark: SparkSession, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place in an order as ``pos`` (from 0) and the number of
    rows as ``total``: a stored range sort, then offsets of its partitions,
    of which there is one small row each."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = stored(spark, at.withColumn("_row", F.monotonically_increasing_id()), name)
    at = at.withColumn("_part", F.shiftright("_row", 33))
    parts = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy()).alias("total"))
    here = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(parts), "_part").withColumn("pos", F.col("_before") + here).drop(
        "_part", "_before", "_row")


def _copies(df: DataFrame, n: str) -> DataFrame:
    """Every row ``n`` times, in steps of at most a thousand."""
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / 1000))))
    left = F.least(F.lit(1000), F.col(n) - F.col("_k") * 1000)
    return df.withColumn("_k", F.explode(F.array_repeat(F.lit(0), left.cast("int")))).drop("_k")


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of every row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.md5(text).alias("md5"))
    docs = docs.withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "md5"))
    ids = docs.groupBy("key").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("md5").alias("md5"),
                                  F.count("*").alias("copies"))
    ids = numbered(spark, ids, [F.col("doc_id").desc_nulls_last(), F.col("md5")], "op13-order")
    texts = docs.groupBy("key").agg(F.any_value("text").alias("text"))
    rows = texts.join(ids.select("key", "doc_id", "copies", "pos", "total"), "key")
    # the first of a block comes after the last of the block before
    first = F.struct(F.when(F.col("pos") == 0, F.col("total")).otherwise(F.col("pos")).alias("pos"),
                     F.lit(True).alias("ahead"))
    own = F.struct("pos", F.lit(False).alias("ahead"))
    rows = rows.withColumn("at", F.explode(
        F.when(F.col("pos") % BLOCK == 0, F.array(own, first)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", "copies", F.col("at.pos").alias("pos"), F.col("at.ahead").alias("ahead"))
    rows = rows.withColumn("block", F.floor((F.col("pos") - F.col("ahead").cast("long")) / BLOCK))
    rows = rows.repartition("block").withColumn("own", anchors(F.col("text")))
    w = Window.partitionBy("block").orderBy("pos", "ahead")
    rows = rows.select("*", F.lead("text").over(w).alias("next_text"), F.lead("own").over(w).alias("next"))
    rows = rows.where(~F.col("ahead"))
    # of equal rows all but the last are followed by their like
    rows = rows.withColumn("last", F.explode(
        F.when(F.col("copies") > 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    rows = rows.withColumn("next_text", F.when(F.col("last"), F.col("next_text")).otherwise(F.col("text")))
    rows = rows.withColumn("next", F.when(F.col("last"), F.col("next")).otherwise(F.col("own")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    kept = (F.col("n_chars") - tail).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), kept),
                                                   F.substring("next_text", F.lit(1), tail)))
    rows = rows.withColumn("edited", anchors(F.col("edited_text")))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        F.array_join("own", " ").alias("fingerprint"), F.array_join("edited", " ").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.when(F.col("last"), F.lit(1)).otherwise(F.col("copies") - 1).alias("times"))
    return _copies(rows, "times").drop("times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def _anchors_sql(source: str, text: str, name: str) -> str:
    """CTEs that add the anchors of a text column, as list column ``name``."""
    return rf"""
{name}_l AS (SELECT pos, regexp_extract_all({text}, '[^\x20\x09-\x0D]{{1,8}}') AS l FROM {source}),
{name}_u AS (SELECT pos, len(l) AS n, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM {name}_l),
{name}_k AS (SELECT *, substr(md5(u), 1, 8) AS r, u || ' ' || lead(u) OVER w || ' ' || lead(u, 2) OVER w || ' '
    || lead(u, 3) OVER w || ' ' || lead(u, 4) OVER w || ' ' || lead(u, 5) OVER w AS k
    FROM {name}_u WINDOW w AS (PARTITION BY pos ORDER BY i)),
{name}_m AS (SELECT *, min(r) OVER (PARTITION BY pos ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS m,
    lead(r, 5) OVER (PARTITION BY pos ORDER BY i) AS z FROM {name}_k),
{name}_s AS (SELECT pos, i, k FROM {name}_m WHERE i <= n - 5 AND (m = r OR m = z)
    UNION ALL SELECT pos, 1, array_to_string(l, ' ') FROM {name}_l WHERE len(l) BETWEEN 1 AND 5),
{name}_g AS (SELECT pos, i, (i - coalesce(lag(i) OVER (PARTITION BY pos ORDER BY i), i)) || ':' || substr(md5(k), 1, 8) AS t
    FROM {name}_s),
{name}_a AS (SELECT pos, list(t ORDER BY i) AS {name} FROM {name}_g GROUP BY pos),
{name}_t AS (SELECT s.*, coalesce({name}, CAST([] AS VARCHAR[])) AS {name} FROM {source} s LEFT JOIN {name}_a USING (pos))"""


def _like_sql(a: str, b: str) -> str:
    most = f"greatest(len(list_distinct({a})), len(list_distinct({b})))"
    return f"CASE WHEN {most} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / {most} END::DOUBLE"


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(text)) AS pos, count(*) OVER () AS total FROM docs),
{_anchors_sql("ranked", "text", "own")},
paired AS (SELECT a.pos, a.doc_id, a.text, a.own, b.text AS next_text, b.own AS next, length(a.text) AS n_chars
    FROM own_t a JOIN own_t b ON b.pos = a.pos % a.total + 1),
cut AS (SELECT *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited_text FROM paired),
{_anchors_sql("cut", "edited_text", "edited")}
SELECT doc_id, n_chars, sha256(edited_text) AS edited_sha256, array_to_string(own, ' ') AS fingerprint,
    array_to_string(edited, ' ') AS edited_fingerprint,
    {_like_sql("own", "edited")} AS near_edited, {_like_sql("own", "next")} AS near_next
FROM edited_t"""
