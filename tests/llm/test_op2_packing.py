import zlib

import pytest
from tokenizers import Tokenizer

from tradetally.llm import op2_packing as op

TEXTS = [None, "", "Hello  WORLD it's 42!", "a b " * 3000, "tab\tnew\nline\x0b　end \x1c x", "é é ñandú ß", "a b " * 3000,
         "́ lone", "<|endoftext|> x", "don't  won't"]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (2, TEXTS[2], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, offset string").repartition(4)


def expected(text):
    t = Tokenizer.from_file(op.default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark, docs):
    out = op.pack(spark, docs, window=256).collect()
    assert sum(1 for r in out if r.start == 0) == len(TEXTS) + 2
    by = {}
    for r in out:
        if r.doc_id not in (None, 2):
            by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        if i == 2:
            continue
        pieces = sorted(by[i], key=lambda r: r.start)
        ids = b"".join(bytes(p.ids) for p in pieces)
        want = b"".join(x.to_bytes(4, "little") for x in expected(text))
        assert ids == want
        assert {p.doc_tokens for p in pieces} == {len(want) // 4}
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and r.length > 0
        filled[r.sequence_id] = r.offset + r.length
    last = max(filled)
    assert all(n == 256 for s, n in filled.items() if s != last) and filled[last] <= 256
    assert sorted(filled) == list(range(last + 1))


def test_empty_table(spark, docs):
    assert op.pack(spark, docs.limit(0)).count() == 0


def test_query_digest(spark):
    from util import SF
    out = op.query(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out[:40]:
        ids = expected(docs[r.doc_id])[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert r.doc_tokens == len(expected(docs[r.doc_id]))
