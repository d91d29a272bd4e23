import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradetally.llm import op6_pii as op

FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
           "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
           "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    for kind, p in FORMATS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                twice = "".join(str(int(c) * (1 + i % 2)) if i % 2 == 0 or int(c) < 5 else str(int(c) * 2 - 9)
                                for i, c in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or sum(map(int, twice)) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PIECES = st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "é", "1", "12", "255", "256.", "4111 1111 1111 1111", "4111111111111111",
                                   "+1 (988) 555-2485", "+", " ", "-", "\n", "1.2.3.4", "0001.2.3.4", "a.b+c@d-e.f.g", "(", "@a.b", "..",
                                   "٣", "007"]), max_size=14).map("".join)


@settings(max_examples=1500, deadline=None)
@given(PIECES)
def test_base_spans(text):
    assert op.base_spans(text) == plain(text)


def test_long_runs_stay_fast():
    for t in ("1 " * 100_000, "1 " * 100_000 + "x", "1x 1" * 50_000, "(1" * 50_000, "1" * 200_000 + "x", "a" * 200_000, "1." * 50_000, "@" * 100_000, "a@" * 50_000, "+1" * 50_000, "+1 " + "(" * 50_000):
        op.base_spans(t)
        op.wanted(t, [])


def test_runs_of_digit_groups():
    def found(text):
        return sorted(text[s:e] for s, e in op.runs(text, op.base_spans(text)))

    assert found("call 988 555 3000 or (988) 555-3001, not 12 34") == ["988 555 3000", "988) 555-3001"]
    assert found("card 4111 1111 1111 1112, 12.3456.7") == ["12.3456.7", "4111 1111 1111 1112"]
    assert found("x123 4567 8y 5é 66666") == []
    assert found("ok +1 (988) 555-2485 and 4111 1111 1111 1111 and 1.2.3.4") == []  # base spans
    assert found("+12 345678901234567890") == ["+12 345678901234567890"]
    assert op.outermost([(1, 3, 9), (1, 3, 5), (1, 5, 9), (0, 4, 5), (1, 8, 12)]) == [(0, 4, 5), (1, 3, 9), (1, 8, 12)]


def test_equal_kinds_and_repeated_rows(spark):
    rows = [(i, f"write to contact a{i}@b.org now") for i in range(8)] + [(20 + i, f"write to contact 10.0.0.{i} now") for i in range(8)]
    rows += [(50, "write to contact 777 888 999 now")] * 3
    spans = [r.spans for r in op.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 50").collect()]
    assert len(spans) == 3 and spans[0] == spans[1] == spans[2] == []  # no kind has the share that is asked for


def corpus():
    rows = [(i, f"please call hotline +1 (988) 555-{2000 + i} today and ask") for i in range(20)]
    rows += [(100 + i, f"please call hotline 988 555{3000 + i} today and ask") for i in range(3)]
    rows += [(100 + i, f"please call hotline 98855{3000 + i} today and ask") for i in range(3, 6)]
    rows += [(200 + i, f"in the year {10000 + i * 7} we saw") for i in range(20)]
    return rows + [(300, None), (301, ""), (302, "x " * 5000 + "a@b.cd")]


def test_patterns_find_unseen_identifiers(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in corpus()], "doc_id long, text string, kind string").repartition(3)
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in op.find(spark, docs).collect()}
    assert len(got) == len(corpus())
    texts = dict(corpus())
    for i, t in texts.items():
        assert [s[:3] for s in got[i] if s[3]] == plain(t or "")
    for i in range(100, 103):
        assert [(k, texts[i][s:e], b) for k, s, e, b in got[i]] == [("phone", f"988 555{3000 + i - 100}", False)]
    for i in range(103, 106):
        assert [(k, texts[i][s:e], b) for k, s, e, b in got[i]] == [("phone", f"98855{3000 + i - 100}", False)]
    assert all(not got[i] for i in range(200, 220))
    red = {r.doc_id: r.text for r in op.redact(op.find(spark, docs)).collect()}
    assert red[3] == "please call hotline <PHONE> today and ask" and red[103] == red[100] == red[3] and red[300] is None
    assert red[205] == texts[205] and red[302].endswith("x <EMAIL>")


def test_no_seeds_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "call 1234567 now"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in op.find(spark, docs).collect()] == [[], []]
    assert op.find(spark, docs.limit(0)).count() == 0


def test_support_does_not_grow_with_the_corpus(spark):
    """A pattern of seven instances counts among 160,000 others as it does alone."""
    rows = [(-1 - i, f"please call hotline +1 (988) 555-{2000 + i} today") for i in range(6)] + [(-9, "please call hotline 988553000 today")]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.range(160_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("in the year "), F.col("id") + 1_000_000, F.lit(" we saw")).alias("text"))
    for docs in (few, few.unionByName(many)):
        spans = op.find(spark, docs).where("doc_id = -9").first().spans
        assert [(s.kind, s.start, s.end, s.base) for s in spans] == [("phone", 20, 29, False)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in op.KINDS] == [sum(b[0] == k for b in base) for k in op.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined
    assert sum(r.n_email for r in rows) > 5
