from pyspark.sql import functions as F

from tradetally.llm import op7_urls as op

COLS = "page_id long, url string, host int"


def judged(spark, pages, labels=()):
    p = spark.createDataFrame([(i, u, 0) for i, u in pages], COLS)
    return op.judge(spark, p, spark.createDataFrame(list(labels), "page_id long, bad int"))


def test_hosts_paths_and_rules(spark):
    cases = [(None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"),
             ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
             ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
             ("http://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
             ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
             ("https://x.com", "x.com", "", None, "allow"), ("https://x.com?/en/", "x.com", "", None, "allow"),
             ("ftp://a.net/es/1#/", "a.net", "/es/1", "net/es/", "block"), ("q://net/fr/", "net", "/fr/", "net/fr/", "block"),
             ("http://a.net/esx", "a.net", "/esx", None, "allow"), ("x://y://z/w", "y:", "//z/w", None, "allow"),
             ("://", "", "", None, "allow"), ("http:///en/", "", "/en/", None, "allow"),
             ("http://Ä.DE/É", "Ä.de", "/É", None, "allow"), ("http://h\n.de/a b", "h\n.de", "/a b", None, "allow")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, [(i, c[0]) for i, c in enumerate(cases)]).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_reputation_is_shrunk(spark):
    pages = [(i, f"http://bad.org/{i}") for i in range(40)] + [(100 + i, f"http://good.org/{i}") for i in range(40)]
    pages += [(200, "http://few.org/1"), (201, "http://few.org/2"), (300, "http://none.org/"), (None, "http://bad.org/n")]
    labels = [(i, 1) for i in range(40)] + [(i, 0) for i in range(100, 140)] + [(200, 1), (5, 0), (5, None), (None, 1)]
    got = {r.page_id: r for r in judged(spark, pages, labels).collect()}
    assert got[3].verdict == got[None].verdict == "block" and got[101].verdict == "allow"
    assert got[200].verdict == "allow", "one bad page is not enough"
    assert got[300].bound < got[200].bound < got[3].bound


def test_subdomains_share_their_domain(spark):
    pages = [(i, f"http://s{i % 20}.spam.org/") for i in range(200)] + [(i, f"http://s{i % 20}.fine.org/") for i in range(200, 600)]
    pages += [(1000, "http://new.spam.org/"), (1001, "http://new.fine.org/")]
    got = {r.page_id: r.verdict for r in judged(spark, pages, [(i, int(i < 200)) for i in range(600)]).collect()}
    assert (got[1000], got[1001]) == ("block", "allow")


def test_registered_domains(spark):
    cases = [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.co.uk", "x.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("uk", "uk", "uk"),
             ("www.a.com", "a.com", "com"), ("co.com", "co.com", "com"), ("me.github.io", "me.github.io", "github.io"),
             ("a.me.github.io:80", "me.github.io", "github.io"), ("10.0.0.1", "10.0.0.1", op.ADDRESS), ("u:p@10.0.0.1:8080", "10.0.0.1", op.ADDRESS),
             ("[2001:db8::1]:443", "[2001:db8::1]", op.ADDRESS), ("1.2.3", "2.3", "3"), ("a.b.de.", "b.de", "de"), ("news.gov.br", "news.gov.br", "gov.br"),
             ("q.a.b.c", "b.c", "c"), (":80", "", ""), ("..", "", ""), ("x" * 5000 + ".org", "x" * 5000 + ".org", "org")]
    df = spark.createDataFrame([(c[0],) for c in cases], "host string").select("host", *op.domain_of(F.col("host")))
    assert {tuple(r) for r in df.collect()} == set(cases)


def test_neighbours_below_a_suffix_and_addresses_are_strangers(spark):
    pages = [(i, f"http://s{i % 5}.bad.co.uk/") for i in range(60)] + [(100 + i, f"http://s{i % 40}.d{i}.co.uk/") for i in range(300)]
    pages += [(1000 + i, "http://10.0.0.1:80/") for i in range(60)] + [(1100 + i, f"http://10.{i}.0.1/") for i in range(60)]
    pages += [(2000, "http://new.bad.co.uk/"), (2001, "http://new.d7.co.uk/"), (2002, "http://10.200.0.1/")]
    bad = [(i, int(i < 60 or 1000 <= i < 1100)) for i, _ in pages if i < 2000]
    got = {r.page_id: r.verdict for r in judged(spark, pages, bad).collect()}
    assert [got[i] for i in (0, 2000, 2001, 1000, 1100, 2002)] == ["block", "block", "allow", "block", "allow", "allow"]


def test_empty_tables(spark):
    assert judged(spark, []).count() == 0
    assert judged(spark, [], [(1, 1)]).count() == 0


def test_query_matches_its_sql(spark):
    import duckdb
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for t in ("pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(op.ORACLE_SQL).fetchall()
        got = [tuple(r) for r in op.query(spark, sf).collect()]
        key = lambda r: tuple(map(str, r))
        assert sorted(got, key=key) == sorted(want, key=key)
        assert spark.createDataFrame(got, "a long, b string, c string, d string, e string").where(F.col("e") == "block").count()
