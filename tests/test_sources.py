"""Loaders (S1-S7): CSV, fixed width, query, fingerprints, profiles, ingest order."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from conftest import TRADE_HEADER
from tradetally.operators.reconcile import reconcile
from tradetally.sources import files, readers

ROW = "T{i},2024-01-15,2024-01-17,AAPL,US0378331005,BUY,{q},185.5,{c},CITI,INSTINET,,CONFIRMED"


def write(path, lines, header=TRADE_HEADER):
    with open(path, "w") as f:
        f.write(header + "\n" + "\n".join(lines) + "\n")


def test_missing_and_empty_files_raise(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        readers.load_csv(spark, f"{tmpdir_path}/nope.csv", "a")
    write(f"{tmpdir_path}/empty.csv", [])
    with pytest.raises(readers.SourceError, match="empty"):
        readers.load_csv(spark, f"{tmpdir_path}/empty.csv", "a")


def test_missing_required_column_raises(spark, tmpdir_path):
    write(f"{tmpdir_path}/x.csv", ["1,2"], header="trade_id,ticker")
    with pytest.raises(readers.SourceError, match="missing required columns"):
        readers.load_csv(spark, f"{tmpdir_path}/x.csv", "a")


def test_strict_dates_raise_and_quarantine_flags(spark, tmpdir_path):
    rows = [ROW.format(i=1, q=10, c=1855.0), ROW.format(i=2, q=10, c=1855.0).replace("2024-01-15", "2024/01/15")]
    write(f"{tmpdir_path}/d.csv", rows)
    with pytest.raises(readers.SourceError, match="Failed to parse date"):
        readers.load_csv(spark, f"{tmpdir_path}/d.csv", "a", date_format="%Y-%m-%d")
    q = readers.load_csv(spark, f"{tmpdir_path}/d.csv", "a", date_format="%Y-%m-%d", dates="quarantine")
    assert sorted(r["date_parse_failed"] for r in q.collect()) == [False, True]


def test_header_variants(spark, tmpdir_path):
    hdr = "Trade Ref,trade_date,Settle Date,ticker,isin,Direction, QTY ,Exec Price,amount,CPTY,Executing Broker,status"
    write(f"{tmpdir_path}/h.csv", ["T1,2024-01-15,2024-01-17,AAPL,US0378331005,B,10,185.5,1855,CITI,INST,CONFIRMED"], hdr)
    r = readers.load_csv(spark, f"{tmpdir_path}/h.csv", "a").first()
    assert (r["trade_id"], r["side"], r["quantity"], r["counterparty"], r["broker"]) == \
        ("T1", "BUY", 10.0, "CITI", "INST")


def test_ingest_order_over_many_files_keeps_file_order(spark, tmpdir_path):
    # the same id in two files: the copy in the first file (by name) survives
    d = f"{tmpdir_path}/multi"
    os.makedirs(d)
    write(f"{d}/part-0.csv", [ROW.format(i=1, q=1, c=185.5)] + [ROW.format(i=100 + k, q=1, c=185.5) for k in range(50)])
    write(f"{d}/part-1.csv", [ROW.format(i=1, q=2, c=371.0)] + [ROW.format(i=1000 + k, q=1, c=185.5) for k in range(5000)])
    a = readers.load_csv(spark, d, "a")
    b = readers.load_csv(spark, f"{d}/part-0.csv", "b")
    r = reconcile(a, b)
    c = r.counts().first()
    assert c["duplicate_a"] == 1 and c["qty_break"] == 0   # survivor quantity 1 = B's


def test_fixed_width(spark, tmpdir_path):
    lines = ["T1        2024-01-15BUY  10", "", "T2        2024-01-16S    7 "]
    with open(f"{tmpdir_path}/f.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    with pytest.raises(readers.SourceError):     # required columns absent
        readers.load_fixed_width(spark, f"{tmpdir_path}/f.txt", "a", [(0, 10), (10, 20)], ["trade_id", "trade_date"])


def test_query_source(spark):
    spark.createDataFrame([("T1", "2024-01-15", "2024-01-17", "AAPL", "US0378331005", "s", 5.0, 2.0, 10.0,
                            "C", "B", "PENDING")],
                          "ref string, exec_date string, value_date string, ticker string, isin string, "
                          "buy_sell string, units double, unit_price double, notional double, cp string, "
                          "agent string, status string").createOrReplaceTempView("src_t")
    r = readers.load_query(spark, "SELECT * FROM src_t", "q", order_by=["ref"]).first()
    assert (r["trade_id"], r["side"], r["quantity"], r["source"]) == ("T1", "SELL", 5.0, "q")


def test_load_source_dispatch_and_fingerprint(spark, tmpdir_path):
    write(f"{tmpdir_path}/s.csv", [ROW.format(i=1, q=10, c=1855.0)])
    df, fp = readers.load_source(spark, f"{tmpdir_path}/s.csv", "a", "CSV")
    assert df.count() == 1
    want = hashlib.sha256(open(f"{tmpdir_path}/s.csv", "rb").read()).hexdigest()
    assert fp.first()["sha256"] == want
    with pytest.raises(ValueError, match="Unsupported file type"):
        readers.load_source(spark, f"{tmpdir_path}/s.csv", "a", "xlsx")


def test_source_profile(spark, tmpdir_path):
    with open(f"{tmpdir_path}/tiny.csv", "w") as f:
        f.write("a\n")
    write(f"{tmpdir_path}/ok.csv", [ROW.format(i=1, q=10, c=1855.0)])
    prof = files.source_profile(spark, f"{tmpdir_path}/*.csv", expected=["ok.csv", "gone.csv"])
    fails = {r["name"]: r["reason"] for r in files.profile_failures(prof).collect()}
    assert fails == {"tiny.csv": "too small", "gone.csv": "not found"}


def test_reference_csv_and_enrichment(spark, tmpdir_path):
    from tradetally.operators import enrich
    with open(f"{tmpdir_path}/ref.csv", "w") as f:
        f.write("ticker,isin,name,asset_class,currency\n aapl ,US0378331005,Apple Inc,EQUITY,USD\n"
                "MSFT,US5949181045,Microsoft Corporation,EQUITY,USD\n")
    ref = readers.load_reference_csv(spark, f"{tmpdir_path}/ref.csv")
    trades = spark.createDataFrame([("T1", "AAPL"), ("T2", "ZZZ")], "trade_id string, ticker string")
    got = {r["trade_id"]: r["asset_class"] for r in enrich.enrich(trades, ref).collect()}
    assert got == {"T1": "EQUITY", "T2": None}
    assert [r["ticker"] for r in enrich.unmatched_keys(trades, ref).collect()] == ["ZZZ"]


def test_quoted_fields_with_commas_and_line_breaks(spark, tmpdir_path):
    body = ['T1,2024-01-15,2024-01-17,AAPL,US0378331005,BUY,10,185.5,1855,"CITI, London",INST,,CONFIRMED',
            'T2,2024-01-15,2024-01-17,AAPL,US0378331005,BUY,10,185.5,1855,"Two\nLines",INST,,CONFIRMED']
    write(f"{tmpdir_path}/q.csv", body)
    rows = {r["trade_id"]: r["counterparty"]
            for r in readers.load_csv(spark, f"{tmpdir_path}/q.csv", "a", multiline=True).collect()}
    assert rows == {"T1": "CITI, London", "T2": "Two\nLines"}


def test_lazy_strict_dates_fail_on_use(spark, tmpdir_path):
    rows = [ROW.format(i=1, q=10, c=1855.0), ROW.format(i=2, q=10, c=1855.0).replace("2024-01-15", "2024/01/15")]
    write(f"{tmpdir_path}/d.csv", rows)
    df = readers.load_csv(spark, f"{tmpdir_path}/d.csv", "a", date_format="%Y-%m-%d", dates="strict_lazy")
    with pytest.raises(Exception, match="Failed to parse date columns"):
        df.collect()
    ok = readers.load_csv(spark, f"{tmpdir_path}/d.csv", "a", date_format="%Y-%m-%d", dates="strict_lazy")
    assert ok.where("trade_id = 'T1'").select("trade_date").first()[0].isoformat() == "2024-01-15"


def test_fixed_width_success(spark, tmpdir_path):
    layout = [("trade_id", 0, 8), ("trade_date", 8, 18), ("settlement_date", 18, 28), ("ticker", 28, 34),
              ("isin", 34, 46), ("side", 46, 50), ("quantity", 50, 56), ("price", 56, 64),
              ("consideration", 64, 74), ("counterparty", 74, 80), ("broker", 80, 84), ("status", 84, 94)]
    def line(vals):
        return "".join(str(v).ljust(e - s)[: e - s] for v, (_, s, e) in zip(vals, layout))
    rows = [line(["T1", "2024-01-15", "2024-01-17", "aapl", "US0378331005", "B", "10", "185.5", "1855", "CITI",
                  "INST", "CONFIRMED"]),
            "",
            line(["T2", "2024-01-16", "2024-01-18", "MSFT", "US5949181045", "S", "7", "", "700", "UBS",
                  "GS", "PENDING"])]
    with open(f"{tmpdir_path}/fw.txt", "w") as f:
        f.write("\n".join(rows) + "\n")
    df = readers.load_fixed_width(spark, f"{tmpdir_path}/fw.txt", "a", [(s, e) for _, s, e in layout],
                                  [n for n, _, _ in layout], date_format="%Y-%m-%d")
    got = {r["trade_id"]: r for r in df.collect()}
    assert set(got) == {"T1", "T2"}                      # blank line skipped
    assert (got["T1"]["side"], got["T1"]["quantity"], got["T1"]["ticker"]) == ("BUY", 10.0, "aapl")
    assert got["T2"]["price"] is None and got["T2"]["side"] == "SELL"   # blank field -> NULL
    assert str(got["T2"]["settlement_date"]) == "2024-01-18"


def test_malformed_rows_are_refused_or_quarantined(spark, tmpdir_path):
    good = ROW.format(i=1, q=10, c=1855.0)
    rows = [good, good.replace("T1", "T2") + ",extra", "T3,2024-01-15", ROW.format(i=4, q="1,234", c=5.0)]
    write(f"{tmpdir_path}/m.csv", rows)
    with pytest.raises(readers.SourceError, match="3 malformed"):
        readers.load_csv(spark, f"{tmpdir_path}/m.csv", "a")
    from tradetally.operators import validate as V
    v = V.validate(readers.load_csv(spark, f"{tmpdir_path}/m.csv", "a", dates="quarantine"))
    got = {r["malformed_row"]: r["error_codes"] for r in v.collect()}
    assert got[None] == "" and {x: c for x, c in got.items() if x} == {x: "row:malformed" for x in rows[1:]}


def test_fixed_width_encoding(spark, tmpdir_path):
    names = ["trade_id", "trade_date", "settlement_date", "ticker", "isin", "side", "quantity", "price",
             "consideration", "counterparty", "broker", "status"]
    vals = ["T1", "2024-01-15", "2024-01-17", "AAPL", "US0378331005", "BUY", "10", "2", "20", "Société É", "INST", "PENDING"]
    with open(f"{tmpdir_path}/l.txt", "w", encoding="latin-1") as f:
        f.write("".join(v.ljust(14) for v in vals) + "\n")
    r = readers.load_fixed_width(spark, f"{tmpdir_path}/l.txt", "a", [(14 * i, 14 * i + 14) for i in range(12)], names,
                                 encoding="ISO-8859-1").first()
    assert [str(r[n]) for n in ("counterparty", "broker", "status")] == vals[-3:]


def test_query_keeps_na_text(spark):
    cols = ("ref string, exec_date string, value_date string, ticker string, isin string, side string, units double, "
            "unit_price double, notional double, cp string, agent string, status string")
    spark.createDataFrame([("T1", "2024-01-15", "2024-01-17", "NA", "US0378331005", "s", 5.0, 2.0, 10.0, "C", "B",
                            "PENDING")], cols).createOrReplaceTempView("src_na")
    assert readers.load_query(spark, "SELECT * FROM src_na", "q", order_by=["ref"]).first()["ticker"] == "NA"


def test_strip_takes_every_white_space(spark):
    from tradetally.functions.text import normalise_side
    df = spark.createDataFrame([("\tBUY\r",), ("\u00a0s\u3000",), (" \n",)], "s string")
    assert [r[0] for r in df.select(normalise_side(F.col("s"))).collect()] == ["BUY", "SELL", ""]


def test_fingerprint_streams_a_sparse_large_file(spark, tmpdir_path):
    size = (2 << 30) + 5
    with open(f"{tmpdir_path}/big.bin", "wb") as f:
        f.truncate(size)
    row = files.file_fingerprint(spark, f"{tmpdir_path}/big.bin").first()
    h = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        h.update(bytes(1 << 20))
    h.update(bytes(size % (1 << 20)))
    assert (row["length"], row["sha256"]) == (size, h.hexdigest())


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def _messy_csv(path, files=2, rows=400):
    import random
    r = random.Random(7)

    def field():
        return r.choice(['"two\nlines, and ""quotes"" ' + "x" * r.randrange(60) + '"', '"a\r\n\n\nb"', '""', "plain",
                         '"' + "line\n" * r.randrange(300) + '"', "é 日本"])

    for f in range(files):
        with open(f"{path}/f{f}.csv", "w", newline="", encoding="utf-8") as out:
            out.write(("\ufeff" if f else "") + "id,b,c,d\n")
            for i in range(rows):
                out.write(f"{f}-{i},{field()},{field()},x" + (",extra" if i % 97 == 0 else "") + "\n")
    return [f"{f}-{i}" for f in range(files) for i in range(rows)]


@pytest.mark.parametrize("size", ["64m", "7k", "900"])
def test_line_breaks_in_split_files_equal_the_whole_file_load(spark, tmpdir_path, small_splits, size):
    from tradetally.operators.normalise import MALFORMED
    from tradetally.sources import quoted
    ids = _messy_csv(tmpdir_path)
    whole = readers.read_csv_raw(spark, tmpdir_path, multiline=True)
    want = sorted(map(str, map(tuple, whole.collect())))
    small_splits(size)
    got = quoted.read_quoted_csv(spark, tmpdir_path, whole.columns[:-1], MALFORMED).collect()
    assert sorted(str(tuple(r)[:-1]) for r in got) == want
    assert [r[0] for r in sorted(got, key=lambda r: r.ingest_seq)] == ids
    assert sum(r[MALFORMED] is not None for r in got) == 10
    if size == "900":  # most splits lie within fields
        assert quoted.crossings(spark, tmpdir_path).count() > 100


def test_line_breaks_crlf_latin1_and_unclosed_quotes(spark, tmpdir_path, small_splits):
    from tradetally.sources import quoted
    with open(f"{tmpdir_path}/l.csv", "w", newline="", encoding="latin-1") as out:
        out.write("id,name\r\n" + "".join(f'{i},"Société\r\n{i}"\r\n' for i in range(300)))
    small_splits("1k")
    got = quoted.read_quoted_csv(spark, f"{tmpdir_path}/l.csv", ["id", "name"], "bad", "latin-1").collect()
    assert sorted((int(r.id), r.name) for r in got) == [(i, f"Société\r\n{i}") for i in range(300)]
    with open(f"{tmpdir_path}/u.csv", "w") as out:
        out.write('id,name\n1,"never closed\n2,x\n')
    with pytest.raises(quoted.UnclosedQuote):
        quoted.read_records(spark, f"{tmpdir_path}/u.csv")


def test_multiline_feed_in_many_splits(spark, tmpdir_path, small_splits):
    body = [ROW.format(i=i, q=10, c=1855.0).replace("CITI", f'"CITI\nLondon {i}"') for i in range(500)]
    write(f"{tmpdir_path}/m.csv", body)
    small_splits("2k")
    df = readers.load_csv(spark, f"{tmpdir_path}/m.csv", "a", multiline=True)
    assert df.count() == 500 and df.rdd.getNumPartitions() > 8
    assert {r.counterparty for r in df.collect()} == {f"CITI\nLondon {i}" for i in range(500)}


def _root(data, chunk, fanout):
    level = [hashlib.sha256(data[i:i + chunk]).hexdigest() for i in range(0, max(1, len(data)), chunk)]
    while len(level) > 1:
        groups = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        level = [g[0] if len(groups) == 1 == len(g) else hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
    return level[0]


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_merkle_roots_equal_plain_hash_trees(spark, tmpdir_path, partitions):
    data = {"one": b"abc", "exact": b"x" * 4000, "long": os.urandom(123_457), "level": os.urandom(9 * 1000 + 1)}
    for name, content in data.items():
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(content)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.path.rsplit("/", 1)[1]: r for r in files.merkle_roots(spark, tmpdir_path, 1000, 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {n: r.merkle_root for n, r in got.items()} == {n: _root(d, 1000, 3) for n, d in data.items()}
    assert got["long"].chunks == 124


def _dates(spark, **columns):
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_one_date_format_is_elected_for_a_column(spark):
    from tradetally.operators.elect import DateFormatError, elect
    assert elect(_dates(spark, trade_date=["03/04/2024", " 13/04/2024 ", "N/A"]), ["trade_date"]) == {"trade_date": "dd/MM/yyyy"}
    assert elect(_dates(spark, trade_date=["03/04/2024", "03/14/2024"]), ["trade_date"]) == {"trade_date": "MM/dd/yyyy"}
    # all values read alike both ways: no ambiguity
    assert elect(_dates(spark, trade_date=["03/03/2024", "04/04/2024"]), ["trade_date"]) == {"trade_date": "MM/dd/yyyy"}
    # another column of the source decides
    both = _dates(spark, trade_date=["03/04/2024", "05/06/2024"], settlement_date=["05/04/2024", "25/06/2024"])
    assert set(elect(both, ["trade_date", "settlement_date"]).values()) == {"dd/MM/yyyy"}
    with pytest.raises(DateFormatError, match="ambiguous"):
        elect(_dates(spark, trade_date=["03/04/2024", "05/06/2024"]), ["trade_date"])
    with pytest.raises(DateFormatError, match="no known format"):
        elect(_dates(spark, trade_date=["14/04/2024", "2024-04-14"]), ["trade_date"])
    # quarantine: the format of most values, the others fail row by row
    assert elect(_dates(spark, trade_date=["2024-04-13", "2024-04-14", "14/04/2024"]), ["trade_date"], whole=False) == {
        "trade_date": "yyyy-MM-dd"}
    assert elect(_dates(spark, trade_date=[None, ""]), ["trade_date", "settlement_date"]) == {}


def test_load_reads_a_column_in_one_format(spark, tmpdir_path):
    import datetime as dt
    days = ["03/04/2024", "13/04/2024"]
    rows = [ROW.format(i=i, q=10, c=1855.0).replace("2024-01-15", d).replace("2024-01-17", d) for i, d in enumerate(days)]
    write(f"{tmpdir_path}/d.csv", rows)
    got = {r.trade_id: r.trade_date for r in readers.load_csv(spark, f"{tmpdir_path}/d.csv", "a").collect()}
    assert got == {"T0": dt.date(2024, 4, 3), "T1": dt.date(2024, 4, 13)}
    write(f"{tmpdir_path}/m.csv", rows + [ROW.format(i=9, q=10, c=1855.0)])
    with pytest.raises(readers.SourceError, match="no known format"):
        readers.load_csv(spark, f"{tmpdir_path}/m.csv", "a")
    q = readers.load_csv(spark, f"{tmpdir_path}/m.csv", "a", dates="quarantine").collect()
    assert {r.trade_id for r in q if r.date_parse_failed} == {"T9"}
    write(f"{tmpdir_path}/u.csv", rows[:1])
    with pytest.raises(readers.SourceError, match="ambiguous"):
        readers.load_csv(spark, f"{tmpdir_path}/u.csv", "a")


def test_malformed_security_master_rows_fail_or_are_kept(spark, tmpdir_path):
    with open(f"{tmpdir_path}/ref.csv", "w") as f:
        f.write("ticker,name,asset_class\nAAA,Alpha,EQUITY\nBBB,Beta, Inc,EQUITY\nCCC,Gamma\n")
    with pytest.raises(readers.SourceError, match="2 malformed"):
        readers.load_reference_csv(spark, f"{tmpdir_path}/ref.csv")
    got = readers.load_reference_csv(spark, f"{tmpdir_path}/ref.csv", malformed="quarantine").collect()
    assert len(got) == 3 and [r.malformed_row for r in got if r.malformed_row] == ["BBB,Beta, Inc,EQUITY", "CCC,Gamma"]
