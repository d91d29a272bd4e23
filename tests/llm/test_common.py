import numpy as np
import pytest
from pyspark.sql import functions as F

from tradetally.llm import common as c


def test_rolling_hashes_match_equal_runs():
    x = np.array([3, 1, 4, 1, 5, 9, 2, 6, 3, 1, 4, 1, 5, 9], np.uint64)
    for size in range(1, 15):
        h = c.rolling(x, size)
        runs = [tuple(x[i:i + size]) for i in range(len(x) - size + 1)]
        assert len(h) == len(runs)
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (runs[i] == runs[j])
    assert len(c.rolling(x, 15)) == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 40).astype(np.uint64)
    for size in range(1, 41):
        assert c.sliding_min(x, size).tolist() == [x[i:i + size].min() for i in range(41 - size)]
    assert len(c.sliding_min(x, 41)) == 0


def test_slices_cover_all_texts():
    texts = [b"x" * n for n in (0, 5, 1, 100, 0, 3)]
    for limit in (1, 4, 1000):
        for rows in (1, 2, 100):
            got = list(c.slices(texts, limit, rows))
            assert [i for a, b in got for i in range(a, b)] == list(range(6)) and all(b - a <= rows for a, b in got)
    assert list(c.slices([])) == []


def test_words_are_split_at_ascii_white_space_only():
    h, offsets = c.word_hashes(["a b\x0bc\x1cd e f".encode(), b"", b" \n"])
    assert offsets.tolist() == [0, 3, 3, 3] and len(set(h.tolist())) == 3


def test_fold_is_crc32_of_the_text(spark):
    import zlib
    rows = spark.range(50).select("id", c.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert spark.range(1).select(F.lit(None).cast("long").alias("id")).select(c.fold("id", 5)).first()[0] == 0


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from tradetally import session

    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake)


def test_hot_keys_are_broadcast_and_others_joined(spark):
    rows = spark.createDataFrame([(i, i % 2 or i) for i in range(100)], "id long, k long")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = c.join_counted(rows, per_key, ["k"], most=4).collect()
    assert len(got) == 100 and all((r.n, r.top) == ((50, 99) if r.k == 1 else (1, r.id)) for r in got)
    assert c.join_counted(rows.limit(0), per_key.limit(0), ["k"]).count() == 0


def test_dropped_tables_are_gone(spark):
    df, path = c.stored(spark, spark.range(3), "test", with_path=True)
    assert df.count() == 3
    c.dropped(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_rows_of_chosen_ids_are_bounded(spark):
    from tradetally.llm.common import rows_of
    rows = [(1, f"text {i}", "en") for i in range(20_000)] + [(2, "again", "en")] * 20_000 + [(3, "x", "de"), (3, "y", "de"), (3, None, "de")]
    rows += [(4, "not chosen", "en"), (None, "no id", "en")]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, toxic int")
    got = [tuple(r) for r in rows_of(df, chosen, "id", "text").select("id", "text", "toxic").collect()]
    assert len([r for r in got if r[0] == 1]) < 40
    assert sorted((r for r in got if r[0] == 3), key=str) == sorted([(3, "x", 1), (3, "y", 1), (3, None, 1)], key=str)
    assert len([r for r in got if r[0] == 2]) <= 1 and {r[0] for r in got} <= {1, 2, 3}
    assert rows_of(df.limit(0), chosen, "id", "text").count() == 0
