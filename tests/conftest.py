import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tradetally.session import build_session, checkpoint_dir
    s = build_session("local[*]", 8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tt-warehouse-")})
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tt-test-")


TRADE_HEADER = ("trade_id,trade_date,settlement_date,ticker,isin,side,quantity,price,consideration,"
                "counterparty,broker,trader_id,status")


def trades_df(spark, rows, source="source_a"):
    """Canonical frame from compact tuples; ``ingest_seq`` is the tuple index."""
    import datetime as dt
    from tradetally.schemas import TRADE_SCHEMA
    from pyspark.sql import types as T
    schema = T.StructType(TRADE_SCHEMA.fields + [T.StructField("ingest_seq", T.LongType())])
    out = []
    for i, r in enumerate(rows):
        d = dict(trade_id=None, trade_date=dt.date(2024, 1, 15), settlement_date=dt.date(2024, 1, 17),
                 ticker="AAPL", isin="US0378331005", side="BUY", quantity=1000.0, price=185.50,
                 consideration=185500.0, counterparty="CITI", broker="INSTINET", trader_id=None,
                 status="CONFIRMED", source=source)
        d.update(r)
        out.append(tuple(d[f.name] for f in TRADE_SCHEMA.fields) + (i,))
    return spark.createDataFrame(out, schema)
